"""MinHash near-dedup against brute force on full shingle sets, and star contraction on random graphs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quarterlens.llm import minhash
from quarterlens.llm._stars import star_components


def shingles(text, n=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()


def roots(n, edges):
    label = list(range(n))
    for a, b in edges:
        x, y = sorted((label[a], label[b]))
        label = [x if v == y else v for v in label]
    return label


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = roots(len(rows), edges)
    out = []
    for (doc, _), s, r in zip(rows, sets, label):
        least = min((d for (d, _), x in zip(rows, label) if x == r and d is not None), default=None)
        out.append((doc, len(s), least, doc == least))
    return sorted(out, key=str)


def found_by(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in minhash.near_duplicates(docs, **options).collect()), key=str)


def test_equals_brute_force_on_hard_cases(edge_docs, no_docs):
    out = minhash.near_duplicates(edge_docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert minhash.near_duplicates(no_docs).count() == 0


def near_copies(rnd, base, copies, changes):
    out = []
    for _ in range(copies):
        ws = list(base)
        for _ in range(rnd.randint(0, changes)):
            ws[rnd.randrange(len(ws))] = f"z{rnd.random()}"
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("cell", [2, 1000])
def test_chains_groups_and_limits(spark, cell):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    line = [word() for _ in range(500)]
    texts = [" ".join(line[5 * i:5 * i + 103]) for i in range(60)]  # a chain: only neighbours are similar
    base = [word() for _ in range(120)]
    texts += near_copies(rnd, base, 80, 4)  # some pairs on either side of the limit
    texts += [" ".join(line[:50]) + " tail " + " ".join(word() for _ in range(40)) for _ in range(30)]  # a shared passage
    side = [word() for _ in range(100)]
    texts += [" ".join(side[:93]), " ".join(side[10:103]), " ".join(side[:83])]  # 80 of 97, and exactly 80 of 90
    exact = [word() for _ in range(103)]
    texts += [" ".join(exact[:93]), " ".join(exact[:93][:83] + exact[93:])]  # 80 shared of 100
    rows = list(zip(rnd.sample(range(1000), len(texts)), texts))
    assert found_by(spark, rows, cell=cell) == brute(rows)


def test_a_third_of_all_rows_are_copies(spark):
    rnd = random.Random(6)
    base = [f"w{rnd.random()}" for _ in range(60)]
    rows = [(i, " ".join(base).upper() if i % 2 else " ".join(base)) for i in range(100)]
    rows += [(100 + i, t) for i, t in enumerate(near_copies(rnd, base, 60, 2))]
    rows += [(200 + i, " ".join(f"x{rnd.random()}" for _ in range(30))) for i in range(140)] + [(7, "other text of id seven")]
    assert found_by(spark, rows) == brute(rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1000, np.uint64)
    sign = minhash.Signatures()
    agree = [(sign(pool[i:i + 180]) == sign(pool[i + 20:i + 200])).mean() for i in range(0, 800, 10)]
    assert abs(np.mean(agree) - 160 / 200) < 0.03 and min(agree) * 128 > minhash.least_agreement(80, 128)
    assert minhash.similar(180, 20, 80) and not minhash.similar(179, 21, 80)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_star_components(spark, edges):
    out = {r["node"]: r["root"] for r in star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = roots(31, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert out == {n: label[n] for n in nodes}


def test_star_components_on_a_long_path(spark):
    path = list(range(300))
    random.Random(2).shuffle(path)
    out = star_components(spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")).collect()
    assert len(out) == 300 and {r["root"] for r in out} == {0}
