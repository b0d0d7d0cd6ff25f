"""Importance resampling against a brute-force version: checksums, weights, draws, hard cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quarterlens.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_features(t, longest=2, buckets=10_000):
    ws = brute_words(t)
    return Counter(zlib.crc32(" ".join(ws[i:i + k]).encode()) % buckets
                   for k in range(1, longest + 1) for i in range(len(ws) - k + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abzAZ09é日 \n-\x00", max_size=60)), max_size=8), st.integers(1, 4),
       st.sampled_from([3, 20, 1 << 18]), st.sampled_from([4, 7, 64]))
def test_buckets_equal_zlib(texts, longest, step, reach):
    features = importance.Features(longest, 997, step, reach)
    words, got = np.zeros(len(texts), int), [Counter() for _ in texts]
    for owner, found in features.chunks([None if t is None else t.encode() for t in texts]):
        words += np.bincount(owner, minlength=len(texts))
        for docs, buckets in found:
            for d, b in zip(docs, buckets):
                got[d][int(b)] += 1
    assert words.tolist() == [len(brute_words(t)) for t in texts]
    assert got == [brute_features(t, longest, 997) for t in texts]


@pytest.mark.parametrize("length", [1, 63, 64, 65, 128, 129, 1000, 70_000])
def test_long_spans_fold_by_blocks(length):
    data = np.frombuffer(bytes((7 * i * i + 3) % 251 for i in range(length + 6)), np.uint8)
    crc = importance.SpanCrc()(data, np.array([0, 3, 4 + length]), np.array([2, 3 + length, 6 + length]))
    assert crc.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in ((0, 2), (3, 3 + length), (4 + length, 6 + length))]


def brute_resample(rows, target):
    corpus, goal = Counter(), Counter()
    for _, t in rows:
        corpus.update(brute_features(t))
    for t in target:
        goal.update(brute_features(t))
    S, T = sum(corpus.values()), sum(goal.values())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (S + 10_000) / ((n + 1) * (T + 10_000)))) for b, n in corpus.items()}
    out = []
    for doc_id, t in rows:
        f = brute_features(t)
        n = sum(f.values())
        weight = sum(gain[b] * c for b, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None,
                    len(brute_words(t))])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[:25 * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def found_by(spark, rows, target, schema="doc_id long, text string"):
    docs, goal = spark.createDataFrame(rows, schema), spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(docs, goal, carry=())
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resample_equals_brute_force(spark, edge_docs, no_docs):
    target = ["abc def gi", None, "", "same line here"] + [r["text"] for r in edge_docs.limit(20).collect()]
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert found_by(spark, rows, target) == brute_resample(rows, target)
    assert found_by(spark, rows, []) == brute_resample(rows, [])
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    drawn = importance.drawn_documents(edge_docs, goal)
    assert drawn.columns == edge_docs.columns
    want = Counter(r[0] for r in brute_resample(rows, target) if r[4])
    assert Counter(r["doc_id"] for r in drawn.collect()) == want
    assert importance.resample(no_docs, goal).count() == 0


def test_one_document_may_be_a_third_of_all_rows(spark):
    rows = [(i, f"word{i} " * 25) for i in range(40)] + [(7, "word7 " * 25)] * 20 + [(None, "x " * 30)] * 3
    assert found_by(spark, rows, ["word7 word9"]) == brute_resample(rows, ["word7 word9"])


def test_draws_lean_towards_the_target(spark):
    rows = [(i, ("north sea wind " if i % 2 else "salt hill road ") * 10) for i in range(400)]
    drawn = [r for r in found_by(spark, rows, ["north sea wind north sea wind"] * 9) if r[4]]
    assert len(drawn) == 100 and sum(r[0] % 2 for r in drawn) > 90
