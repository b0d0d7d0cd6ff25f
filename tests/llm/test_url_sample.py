"""The URL filter's statistics cover all labelled rows, its sample distinct URLs of both labels."""

import pytest
from pyspark.sql import functions as F

from quarterlens.llm import url_filter

RULES = [("allow", "good.org/"), ("block", "bad.org/")]


def test_one_hot_url_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_TRAIN", 60)
    urls = [f"http://a.bad.org/ads/{i}.exe" for i in range(50)] + [f"http://good.org/text/{i}.html" for i in range(50)]
    lowest = spark.createDataFrame([(u,) for u in urls], "url string").orderBy(F.xxhash64("url")).first()["url"]
    rows = urls + [lowest] * 500 + [f"http://x{i}.net/ads/{i}.exe" for i in range(10)] + [
        f"http://x{i}.net/text/{i}.html" for i in range(10)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    out = url_filter.judge(df, RULES).where("rule is null").collect()
    assert len(out) == 20
    assert all(r["block_score"] is not None and (r["verdict"] == "block") == ("/ads/" in r["path"]) for r in out)


@pytest.mark.parametrize("blocked, places", [(500, {0.0: 10, 1.0: 10}), (3, {0.0: 17, 1.0: 3})])
def test_sample_is_distinct_per_label_and_weighted(spark, monkeypatch, blocked, places):
    monkeypatch.setattr(url_filter, "MAX_TRAIN", 20)
    rows = [(f"u{i}", 0.0, 1 + i % 3) for i in range(200)] + [(f"v{i}", 1.0, 7) for i in range(blocked)]
    labelled = spark.createDataFrame(rows, "url string, label double, rows long")
    got = url_filter.training_sample(labelled).collect()
    assert len({r["url"] for r in got}) == len(got)
    for label, n in places.items():
        part = [r for r in got if r["label"] == label]
        assert len(part) == n
        assert abs(sum(r["weight"] for r in part) - sum(x[2] for x in rows if x[1] == label)) < 1e-6


def test_suffix_rates_count_every_labelled_row(spark, monkeypatch):
    """Hosts outside the sample have rates of their own."""
    monkeypatch.setattr(url_filter, "MAX_TRAIN", 40)
    seen, rates = [], url_filter._suffix_rates
    monkeypatch.setattr(url_filter, "_suffix_rates", lambda *a: seen.append(rates(*a)) or seen[-1])
    rules = [("block", f"b{i}.org/") for i in range(20)] + [("allow", f"a{i}.org/") for i in range(20)]
    urls = [f"http://{h}{i}.org/p/{k}" for h in "ab" for i in range(20) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert url_filter.judge(df, rules).count() == len(urls)
    hosts = {r["host_key_v"]: r["rate"] for r in seen[0].collect()}
    assert len(hosts) == 40
    assert all(abs(v - ((30 if h[0] == "b" else 0) + 10) / 50) < 1e-9 for h, v in hosts.items())
