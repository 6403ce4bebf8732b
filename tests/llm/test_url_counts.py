"""The URL models count all examples, and both ways to look them up agree."""

import numpy as np
import pyarrow as pa

from whisperlake.llm import arrays, url_filter


def pages_of(spark):
    urls = [f"http://site{i % 37}.example.net/en/{i}" for i in range(3000)] + [f"http://free.net/casino-{i}?é" for i in range(700)] + ["", None, "http://site1.example.net/en/1"]
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_models_learn_from_every_example(spark):
    s = url_filter.Settings(most=20)
    learnt = url_filter.train(pages_of(spark), s)
    rows = learnt.texts.collect()
    assert len(rows) == 3700 and 400 < sum(r.held for r in rows) < 800
    models = [url_filter.fit([r.text for r in rows if not r.held and r.bad == kind], s.order) for kind in (False, True)]
    texts = [r.text for r in rows]
    want = dict(zip(texts, url_filter.differences(arrays.texts_of(pa.array(texts)), *models, s.order)))
    got = url_filter.scored(learnt.texts.select("text"), learnt.runs, learnt.texts, s).collect()
    assert len(got) == 3700 and all(abs(r.score - want[r.text]) < 1e-7 for r in got)


def test_joined_and_sent_runs_give_the_same_scores(spark):
    pages = pages_of(spark)
    one, two = ({r.page_id: (r.verdict, r.score) for r in url_filter.judge(pages, (), url_filter.Settings(most=m)).collect()} for m in (20, 1 << 20))
    assert one == two and len(one) == pages.count()
    assert {one[i][0] for i in range(3000, 3700)} == {"block"} and np.mean([one[i][0] == "block" for i in range(3000)]) < 0.01
