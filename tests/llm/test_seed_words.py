"""Seeds of the URL filter: inflections, and seeds that no page's text holds."""

from quillgraph.llm import urls


def test_inflected_and_unseen_seeds_mark_hosts(spark):
    good, bad = "news of the garden and the tree " * 5, "free bets and free offers " * 5
    data = [(k, f"http://www.gardentree{k % 3}.example.org/fr/{k}", good) for k in range(30)]
    data += [(100 + k, f"http://free-bets.example.com/fr/win{k}", bad) for k in range(10)]
    data += [(200 + k, f"http://freepoker.example.com/fr/win{k}", "free offers") for k in range(5)]
    got = {r["page_id"]: r["verdict"] for r in urls.judged(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in range(30)} == {"allow"}
    assert {got[k] for k in range(100, 110)} == {"block"} and {got[k] for k in range(200, 205)} == {"block"}
