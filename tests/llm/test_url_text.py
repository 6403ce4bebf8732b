"""The URL filter's models read the whole URL."""

from whisperlake.llm import url_filter


def test_query_part_and_missing_scheme_are_judged(spark):
    urls = [f"http://site{i % 37}.example.net/en/{i}?page={i}" for i in range(400)]
    urls += [f"http://a.example.net/go?to=free-casino-bets{i}" for i in range(40)] + [f"casino-win.example.com/x{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, ()).collect()}
    assert all(got[i].verdict == "block" for i in range(400, 480))
    assert sum(got[i].verdict == "block" for i in range(400)) <= 4
    assert (got[400].host, got[400].path, got[440].host, got[440].path) == ("a.example.net", "/go", "", "")
