"""Words of rules: patterns that have them match the same texts, and only texts with such a word meet a pattern."""

from pyspark.sql import functions as F

from leadloom.operators import classify
from leadloom.operators.rules import RULES_V1, RULES_V2, Rule
from leadloom.plans.catalog import PHRASES


def test_words_lose_no_match(spark):
    rules = list(dict.fromkeys(RULES_V1 + RULES_V2))
    assert all(r.words for r in rules)
    odd = [p.replace("в", "ᲀ").replace("д", "ᲁ").replace("о", "ᲂ").replace("с", "ᲃ").replace("т", "ᲄ") for p in PHRASES]
    texts = [y for p in [*PHRASES, *odd] for y in (p, p.upper(), p.title(), f"x {p.swapcase()} y")] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("low", classify.folded(F.col("text")))
    rows = df.select("text", "low", classify.match_rules(F.col("text"), rules).alias("a"), classify.match_rules(F.col("text"), rules, F.col("low")).alias("b")).collect()
    assert [x for x in rows if x["a"] != x["b"]] == []
    assert {i for x in rows for i in x["a"]} == {r.id for r in rules}


def test_letters_are_folded_as_patterns_take_them(spark):
    """Of all code points: whichever a pattern takes for a letter of the words is folded to that letter."""
    letters = sorted({c for r in RULES_V1 + RULES_V2 for w in r.words for c in w})
    every = spark.range(1, 0x110000).filter("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")).withColumn("low", classify.folded(F.col("c")))
    same = [F.col("c").rlike(f"(?iu)^[{letter}]$".replace("[-]", "-")) & (F.col("low") != letter) for letter in letters]
    assert every.filter(F.array_contains(F.array(*same), True)).count() == 0


def test_patterns_meet_only_texts_with_words(spark):
    df = spark.createDataFrame([("aa",)], "text string")
    asked = [Rule("g", "i", "a+", ("b",))]
    assert df.select(classify.match_rules(F.col("text"), asked, classify.folded(F.col("text")))).first()[0] == []
