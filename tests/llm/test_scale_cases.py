"""Buckets with many equal rows, and vectors of extreme magnitudes."""
import math
from collections import Counter

import numpy as np
import pytest

from quarterlens.llm import ann, sharding


def test_equal_rows_spread_over_buckets(spark):
    rows = [(1, "x" * 50, None)] * 3000 + [(i, "y" * (i % 40), "s") for i in range(6000)] + [(None, None, None)] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(6)
    written, buckets, n = sharding.external_shuffle(docs, bucket_bytes=5000)
    got = written.collect()
    assert n == len(rows) and Counter(tuple(r["record"]) for r in got) == Counter(rows)
    size = Counter()
    for r in got:
        size[r["bucket"]] += len(r["record"]["text"] or "") + 1
    assert max(size.values()) < 4 * 5000 and len(size) <= buckets
    out = sharding.shard(docs, 8, bucket_bytes=5000).collect()
    per = Counter(r["shard"] for r in out)
    assert sum(per.values()) == len(rows) and max(per.values()) - min(per.values()) <= 1
    # Equal rows are spread over the shards, too.
    assert all(200 < c < 600 for c in Counter(r["shard"] for r in out if r["record"]["doc_id"] == 1).values())


@pytest.mark.parametrize("factor", [1e200, 1e-200, 1e-300])
def test_extreme_magnitudes_score_as_plain_ones(spark, factor):
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(60, 6))
    stretched = plain * np.where(np.arange(60) % 3 == 0, factor, 1.0)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(stretched)], "vec_id long, embedding array<double>")
    unit = plain / np.linalg.norm(plain, axis=1, keepdims=True)
    cosine = unit @ unit.T
    got = ann.nearest(df, (ann.F.col("vec_id") % 10 == 0), k=5, shard_rows=20).collect()
    assert len(got) == 6 * 5
    for r in got:
        others = np.sort(np.delete(cosine[r["query_id"]], r["query_id"]))[::-1]
        assert math.isclose(r["score"], others[r["rank"] - 1], abs_tol=1e-9)
