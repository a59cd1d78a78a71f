from pyspark.sql import functions as F

from leadloom.functions import text
from leadloom.functions.expr import deterministic_uuid, fixed2, half_up

PAGE = """<!-- x --><html><head><title> Big &amp; <b>News</b> </title><style>p{}</style></head><body><script>1<2</script>
<p>First&nbsp;line &#1090;&#x44f; &amp;lt;b&amp;gt; &unknown;</p><p>FIRST line</p><div>Поделиться</div><p>same</p><p>Same</p><br><br><br>Мы используем файлы cookie, да<p>end</p></body></html>"""


def test_clean_page(spark):
    df = spark.createDataFrame([(1, PAGE, None), (2, "<script>x</script>", '{"title": ""}'), (3, "plain\r\ntext", '{"title": "T <i>1</i>"}'), (4, "t", '{"title": 5}'), (5, None, None)], "raw_item_id int, raw_text string, raw_payload string")
    got = {r["raw_item_id"]: r for r in text.normalize_items(df).collect()}
    assert got[1]["text"] == "First line тя &lt;b&gt; &unknown;\n\nFIRST line\n\nsame\n\nend" and got[1]["title"] == "Big & News"
    assert (got[2]["status"], got[2]["rejection_code"], got[2]["title"]) == ("REJECTED", "EMPTY_NORMALIZED_TEXT", None)
    assert (got[3]["text"], got[3]["title"], got[3]["language"]) == ("plain\ntext", "T 1", "en")
    assert got[4]["title"] is None and got[5]["status"] == "REJECTED"


def test_language(spark):
    rows = [("abc",), ("абв",), ("абab",), ("12 !",), ("аbc",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(text.detect_language(F.col("t"))).collect()] == ["en", "ru", "ru", "und", "en"]


def test_rounding(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (13.625,), (12.125,), (0.1 + 0.2,)], "x double")
    assert [r[0] for r in df.select(half_up(F.col("x"), 2)).collect()] == [1.01, 2.68, 13.63, 12.13, 0.3]
    assert [r[0] for r in df.select(fixed2(F.col("x"))).collect()] == ["1.00", "2.67", "13.63", "12.13", "0.30"]


def test_uuid(spark):
    import hashlib

    got = spark.range(1).select(deterministic_uuid("ns", "raw", F.lit("a"), F.lit(None).cast("string"))).first()[0]
    h = hashlib.sha256(b'["ns","raw","a",null]').hexdigest()
    assert got == f"{h[:8]}-{h[8:12]}-8{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}"


def test_lines_and_entities(spark):
    rows = [("A\r\n\r\n a \rB\n\n\nПоделиться\n\nb\nC\n\n", "A\n\nB\n\nC"), ("\n \n", ""), ("x\u00a0 y\nX Y", "x y"), (None, None), ("Мы используем файлы cookie!\nz", "z")]
    df = spark.createDataFrame(rows, "t string, w string")
    assert all(r[0] == r[1] for r in df.select(text.normalize_lines("t"), "w").collect())
    odd = [("&#1090;&#x1F600;&#xD800;&#1114112;&#00065;&AMP;lt;&nope;&nbsp;.", "т😀&#xD800;&#1114112;A&lt;&nope; ."), ("&#99999999999999999999;", "&#99999999999999999999;"), ("plain", "plain"), (None, None)]
    assert all(r[0] == r[1] for r in spark.createDataFrame(odd, "t string, w string").select(text.decode_entities("t"), "w").collect())
