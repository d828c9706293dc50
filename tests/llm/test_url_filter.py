from tamis.llm.queries import URL_RULES
from tamis.llm.url_filter import judge

PAGES = "page_id long, url string, verdict string"


def got(spark, urls, rules=URL_RULES):
    rows = judge(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], PAGES), rules).orderBy("page_id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in rows]


def test_rules_and_precedence(spark):
    assert got(spark, [
        "http://A.Example.COM/en/7?x", "https://b.com/en/", "b.com/en/", None, "http://com/en/x#y", "http://notcom/en/", "x://a.net/de", "x://example.net/de/81",
        "http://a.example.com?/en/7", "", "http://org/es/://org/es/", "http://a.b.c.d.org/es/\u00e9",
    ]) == [
        ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("b.com", "/en/", "com/en/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("com", "/en/x", "com/en/", "block"), ("notcom", "/en/", None, "allow"), ("a.net", "/de", None, "allow"), ("example.net", "/de/81", "example.net/de/8", "block"),
        ("a.example.com", "", None, "allow"), ("", "", None, "allow"), ("org", "/es/://org/es/", "org/es/", "block"), ("a.b.c.d.org", "/es/\u00e9", "org/es/", "block"),
    ]


def test_matches_brute_force_with_repeats_and_ties(spark):
    rules = [("allow", "b.c/x"), ("block", "c/xyz"), ("block", "b.c/xy"), ("allow", "b.c/xy"), ("allow", "a.b.c/")]
    urls = [f"h://{h}/{p}" for h in ("a.b.c", "b.c", "c", "z.c", "a..c") for p in ("", "x", "xy", "xyz", "xyzz")] * 2

    def one(u):
        host, _, p = u[4:].partition("/")
        fit = [(len(r), len(r.split("/")[0]), v == "block", r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and ("/" + p).startswith(r[r.index("/") :])]
        return (host, "/" + p, *(max(fit)[3:] if fit else (None, "allow")))

    assert got(spark, urls, rules) == [one(u) for u in urls]
    assert got(spark, urls[:1], []) == [("a.b.c", "/", None, "allow")]
    assert judge(spark.createDataFrame([], PAGES), URL_RULES).count() == 0


def test_the_query_judges_by_the_rules_of_its_contract(spark, tmp_path):
    from tamis.llm.queries import op9_url_filter

    urls = ["http://a.net/de/1", "http://example.net/de/7", "http://example.net/de/8", "http://a.com/en/1", "http://example.com/en/7", "http://a.org/es/", "http://a.net/fr/"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [(r.rule, r.verdict) for r in op9_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()] == [
        ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow"),
    ]
