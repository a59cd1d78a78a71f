"""URLs by literal cases of the URL standard, and the order of parameters of a locale."""

import pytest

from leadloom.functions import text, urls

CASES = {
    "https://u:p@EXAMPLE.test:443//notices//42/?b=2&utm_source=x&a=3&fbclid=9&a=1#top": "https://example.test/notices/42?a=1&a=3&b=2",
    "https://example.test/a/?_x=1&B=2&b=3&a=4&1=5": "https://example.test/a?_x=1&1=5&a=4&b=3&B=2",
    "http://bücher.test/ä b": "http://xn--bcher-kva.test/%C3%A4%20b", "http://[::1]:8080/": "http://[::1]:8080/", "http://example.test": "http://example.test/",
    "no url": None, "http://[bad": None, "": None, "//x.test/": None, "http://": None, "http://x.test:99999/": None, "http://a b.test/": None, "http://x.test:8a/": None,
    "http://x.test/x/../y/./z": "http://x.test/y/z", "http://x.test/a/b/..": "http://x.test/a", "http://x.test/../../a": "http://x.test/a", "http://x.test/%2e%2E/a/%2e": "http://x.test/a",
    "http://x.test/?q=a\\b": "http://x.test/?q=a%5Cb", "http:\\\\x.test\\a\\b?c\\d": "http://x.test/a/b?c%5Cd=", "http:x.test/a": "http://x.test/a", " \thttp://x.te\nst/a ": "http://x.test/a",
    "http://x.test/a?x=1+2%20&y=%E4&z": "http://x.test/a?x=1+2+&y=%EF%BF%BD&z=", "http://x.test/?a=~b*-._é": "http://x.test/?a=%7Eb*-._%C3%A9", "http://x.test/a%2fb%zz\"<>`{}|^'": "http://x.test/a%2fb%zz%22%3C%3E%60%7B%7D|^'",
    "HTTP://X.TEST:80/A": "http://x.test/A", "http://0x7f.1/": "http://127.0.0.1/", "http://256.1.1.1/": None, "http://192.168.257/": "http://192.168.1.1/", "http://[2001:DB8:0:0:1:0:0:1]/": "http://[2001:db8::1:0:0:1]/", "http://[::FFFF:1.2.3.4]/": "http://[::ffff:102:304]/",
    "http://%45xample.test/": "http://example.test/", "http://ex%41mple.test/?UTM_Campaign=1&yclid=2&_openstat=3": "http://example.test/", "http://straße.test/": "http://xn--strae-oqa.test/", "http://ｅｘ.test/": "http://ex.test/", "mailto:a@b.test?x=1": "mailto:a@b.test?x=1",
    "http://x.test/?é=1&f=2&e=3&E=4&e=10&ea=5": "http://x.test/?e=10&e=3&E=4&%C3%A9=1&ea=5&f=2", "http://x.test/?b=1&a-b=2&a_b=3&ab=4&a b=5": "http://x.test/?a+b=5&a_b=3&a-b=2&ab=4&b=1",
    "http://x.test/?a=2&&=&a=1&=x": "http://x.test/?=&=x&a=1&a=2",
}


def test_literal_cases(spark):
    rows = spark.createDataFrame([(u,) for u in [*CASES, None]], "u string")
    got = {r["u"]: r["c"] for r in text.canonicalize_urls(rows, "u", "c").collect()}
    assert {u: (got[u], want) for u, want in CASES.items() if got[u] != want} == {} and got[None] is None


@pytest.mark.parametrize("url", [u for u, want in CASES.items() if want])
def test_canonical_form_is_its_own(url):
    base, _ = urls.take_apart(CASES[url])
    assert urls.take_apart(base)[0] == base


def test_identity_conflicts(spark):
    from leadloom.sources.sinks import identity_conflicts

    schema = "a int, b string, x int, y int"
    stored = spark.createDataFrame([(1, "p", 1, 1), (1, "p", 1, 1), (2, None, 1, 1), (3, "q", None, 1), (4, "r", 1, 1), (4, "r", 2, 1)], schema)
    rows = spark.createDataFrame([(1, "p", 2, 1), (2, None, 1, 5), (3, "q", None, 1), (4, "r", 2, 1), (5, "s", 1, 1), (3, "q", 0, 2)], schema)
    got = sorted((r["a"], r["b"], r["differs"]) for r in identity_conflicts(rows, stored, ["a", "b"], ["x", "y"]).collect())
    assert got == [(1, "p", ["x"]), (2, None, ["y"]), (3, "q", ["x", "y"])]
