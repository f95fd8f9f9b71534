from __future__ import annotations

from foretide.plans import feed_queries


def test_base_is_the_least_host_of_all_pages(spark, tmp_path):
    """The query's address comes from the pages, whatever their hosts are."""
    urls = ["https://mid.example/a", "https://low.example/b", "https://www.low.example/c", "https://top.example/d"]
    spark.createDataFrame([(2 + 5 * i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.decision, r.reason) for r in feed_queries.url_access(spark, str(tmp_path)).collect()}
    assert got == {2: ("DENY", "HOST_NOT_LISTED"), 7: ("DENY", "NOT_HTTPS"), 12: ("ALLOW", ""), 17: ("DENY", "HOST_NOT_LISTED")}
