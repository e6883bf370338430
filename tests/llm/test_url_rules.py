"""op9: the contract's rules, by their own verdicts."""

from quillgraph.llm import urls


def test_rules_of_the_contract(spark):
    cases = [
        ("http://a.com/en/x", "com/en/", "block"),
        ("http://example.com/en/71", "example.com/en/7", "allow"),
        ("http://badexample.com/en/71", "com/en/", "block"),
        ("http://a.net/de/x", "net/de/", "allow"),
        ("http://casino-poker.net/de/porn", "net/de/", "allow"),
        ("http://www.example.net/de/8", "example.net/de/8", "block"),
        ("http://example.net/de/9", "net/de/", "allow"),
        ("http://A.ORG/es/?q", "org/es/", "block"),
        ("http://a.org/es", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u, "") for k, (u, _, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judged(pages).collect()}
    assert [got[k] for k in range(len(cases))] == [(r, v) for _, r, v in cases]
