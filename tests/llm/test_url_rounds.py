"""PageRank runs until its tolerance is met."""

import pytest

from lithoframe.llm.url_filter import page_rank


def test_rank_reaches_far_hosts(spark):
    n = 40
    links = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(n)], "source string, target string, n bigint")
    seeds = spark.createDataFrame([("h0", 1)], "host string, weight bigint")
    ranks = {r.host: r["rank"] for r in page_rank(links, seeds).collect()}
    assert len(ranks) == n + 1
    for k in range(n + 1):
        assert ranks[f"h{k}"] == pytest.approx(0.15 * 0.85**k)
