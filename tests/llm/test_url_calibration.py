"""The URL filter's threshold covers all held-out URLs."""

import numpy as np

from whisperlake.llm import url_filter


def test_threshold_covers_sources_beyond_the_sample(spark):
    urls = [f"http://site{i % 37}.example.net/en/{i}" for i in range(2000)] + [f"http://free-bets.example.net/x/{i}" for i in range(60)]
    urls += [f"http://freebet.example.net/x/{i}" for i in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.judge(pages, (), url_filter.Settings(most=20)).collect()
    fine = [r.verdict for r in got if "bets." not in urls[r.page_id]]
    assert len(fine) == 2400 and fine.count("block") <= 24


def test_threshold_of_bins():
    bins, count = np.array([4096, -5, 8192, 0]), np.array([500, 300, 1, 199])
    assert url_filter.threshold_of(bins, count, 0.002) == 1 + 1 / 4096
    assert url_filter.threshold_of(bins, count, 0.0) == 2 + 1 / 4096
    assert url_filter.threshold_of(np.array([-9]), np.array([3]), 0.002) == 0.0
