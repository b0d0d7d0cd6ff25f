"""Operators on documents against brute force, with hard cases and empty input."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarterlens.llm import line_dedup, mixing, packing, quality, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(t):
    return WORD.findall(t or "")


def test_sharding(edge_docs, no_docs):
    out = sharding.shard(edge_docs, 8, bucket_bytes=5000).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(tuple, (r["record"] for r in out)), key=str) == sorted(map(tuple, edge_docs.collect()), key=str)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(8))
    order = [r["record"]["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order, key=str)
    again = sharding.shard(edge_docs, 8, bucket_bytes=5000).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert sharding.shard(no_docs, 8).count() == 0


def targets(sizes):
    """Targets by the rule itself: share by weight, stop at three times the size, share again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in capped]
        if not open_:
            return capped
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 3.0 * sizes[s]
            left -= capped[s]


def test_mixing(edge_docs, no_docs):
    out = mixing.Mix(edge_docs, block_words=64).taken().collect()
    sizes = Counter()
    for r in edge_docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    want, taken = targets(sizes), Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(out) == edge_docs.count()
    assert all(abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]) for s in sizes)
    assert sorted(map(str, mixing.Mix(edge_docs, block_words=64).taken().collect())) == sorted(map(str, out))
    mixed = mixing.mixed_documents(edge_docs, block_words=64)
    assert mixed.columns == edge_docs.columns and mixed.count() > 0
    assert mixing.Mix(no_docs).taken().count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def brute_fingerprint(text):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = words(ws)
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i:i + 4]).encode(), seed=42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(marks):
    fps = sorted({f for _, f in marks})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    least = {}
    for d, f in marks:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for f in fps}


def test_simhash(edge_docs, no_docs):
    marks = [(r["doc_id"], brute_fingerprint(r["text"])) for r in edge_docs.collect()]
    want = brute_components(marks)
    out = simhash.near_duplicates(edge_docs).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in out) == Counter(marks)
    assert all(r["component_id"] == want[r["fp"] % (1 << 64)] for r in out)
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_simhash_links_on_dense_fingerprints(spark):
    """Chains and balls of close fingerprints, as one large group of near copies makes them."""
    import random
    rnd = random.Random(5)
    fps = set()
    for _ in range(6):
        f = rnd.getrandbits(64)
        for _ in range(120):
            g = f
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                g ^= 1 << b
            fps.add(g)
            if rnd.random() < 0.3:
                f = g
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"))
    from quarterlens.llm._graph import components
    got = {r["node"] % (1 << 64): r["root"] for r in components(links).collect()}
    want = brute_components([(i, f) for i, f in enumerate(sorted(fps))])
    groups = defaultdict(set)
    for f in fps:
        groups[want[f]].add(got.get(f, f if f < 1 << 63 else f - (1 << 64)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


PASSAGE = ("Shared words stand here in a row. They come back in other texts as well. Nobody wrote them twice by hand. "
           "The passage has more than fifty words so that it counts as a long one. It goes on for a while about "
           "nothing at all. Then it ends with a last sentence of some length to be safe.")


def test_line_dedup_removes_passages(spark):
    own = lambda i: f"Opening number {i} of its own. It has text {i * 7} only.\n"
    rows = [(i, own(i) + PASSAGE + f"\nClosing {i} words of document {i * 3}.") for i in range(12)]
    rows.append((90, "A clean text about other things.\nIt has two lines and no copy."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert out[0]["dedup"]["text"] == rows[0][1] and out[90]["dedup"]["text"] == rows[-1][1]
    for i in range(1, 12):
        assert out[i]["dedup"]["text"] == own(i) + f"Closing {i} words of document {i * 3}."
        assert "\n".join(out[i]["dedup"]["removed"]) == PASSAGE.replace(". ", ".\n")


def test_line_dedup_hard_cases(edge_docs, no_docs):
    out = line_dedup.line_dedup(edge_docs).collect()
    before = Counter((r["doc_id"], r["text"]) for r in edge_docs.collect())
    assert Counter((r["doc_id"], r["text"]) for r in out) == before
    first = {}
    for r in sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        assert (r["text"] is None) == (r["dedup"]["text"] is None)
        if not r["dedup"]["removed"]:
            assert r["dedup"]["text"] == r["text"]
    copies = [r for r in out if r["doc_id"] in (4, 5)]
    assert all((r["dedup"]["text"] == r["text"]) == (r["doc_id"] == 4) for r in copies)
    assert line_dedup.deduplicated(edge_docs).columns == edge_docs.columns
    assert line_dedup.line_dedup(no_docs).count() == 0


def test_line_chunks_are_whole_and_shift_resistant(edge_docs, spark):
    chunked = line_dedup.line_chunks(edge_docs.select("doc_id", "text"), ["doc_id", "text"], "text").collect()
    for r in chunked:
        assert "".join(r["pieces"]) == (r["text"] or "")
        assert [p for c in r["chunks"] for p in range(c["first"], c["first"] + c["count"])] == list(range(len(r["pieces"])))
    lines = [f"line {i * 37 % 101} text" for i in range(200)]
    pair = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["new"] * 3 + lines))], "doc_id long, text string")
    a, b = [{c["body"] for c in r["chunks"]} for r in
            line_dedup.line_chunks(pair, ["doc_id"], "text").orderBy("doc_id").collect()]
    assert len(a & b) >= 0.9 * len(a)


def brute_statistics(t):
    t = t or ""
    ws = words(t)
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_quality_statistics(edge_docs, no_docs):
    out = quality.judge(edge_docs, min_group=10, keep=["text"]).collect()
    assert len(out) == edge_docs.count()
    for r in out:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == brute_statistics(r["text"])
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert r["kept"] is not None and not (r["base_failed"] and r["kept"])
    assert quality.kept_documents(edge_docs, min_group=10).columns == edge_docs.columns
    assert quality.judge(no_docs).count() == 0


def test_quality_rejects_outliers(spark):
    import random
    rnd = random.Random(9)
    clean = lambda: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 9)))
                             for _ in range(rnd.randint(60, 400)))
    rows = [(i, clean(), "en", f"s{i % 2}") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in clean().split()), "en", "s0") for i in range(25)]
    out = quality.judge(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["kept"] == (r["doc_id"] < 1000) for r in out)
    assert math.isclose(quality.chi2_quantile(0.95, 5), 11.0705, rel_tol=1e-4)


def test_quality_estimate_matches_numpy(spark):
    """The last concentration step is the mean and scaled covariance of the nearest share."""
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) * [0.3, 0.4, 0.5, 0.6, 0.7]
    rows = [("g", *map(float, r)) for r in x]
    fit = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{f} double" for f in quality.FEATURES)).cache()
    start = quality._start(fit)
    got = quality._concentrate(fit, start, 1).first()
    p = start.first()
    d2 = sum(((x[:, i] - p[f"m{i}"]) / p[f"l{i}{i}"]) ** 2 for i in range(5))
    bins = np.floor(np.log2(d2 + 1e-6) * quality.BINS_PER_OCTAVE)
    order = np.sort(np.unique(bins))
    below = {b: (bins < b).sum() for b in order}
    near = x[[below[b] < 0.75 * 400 for b in bins]]
    wider = 0.75 / quality.chi2_cdf(quality.chi2_quantile(0.75, 5), 7)
    cov = np.cov(near.T, bias=True) * wider + np.diag(np.square(list(quality.FEATURES.values())))
    chol = np.linalg.cholesky(cov)
    assert np.allclose([got[f"m{i}"] for i in range(5)], near.mean(0), atol=1e-9)
    assert np.allclose([[got[f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)], chol, atol=1e-7)


def test_packing(edge_docs, no_docs):
    coder = Tokenizer.from_file(TOKENIZER)
    texts = [(r["doc_id"], r["text"] or "") for r in edge_docs.collect()]
    want = Counter()
    for d, t in texts:
        ids = coder.encode(t, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want[d, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    out = packing.pack(edge_docs, TOKENIZER).collect()
    assert Counter(tuple(r)[:5] for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "a b c " * 900), (2, "some words"), (3, None)], "doc_id long, text string")
    layout = packing.pack(docs, TOKENIZER)
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, layout, TOKENIZER).collect()}
    for r in layout.collect():
        part = got[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]


def test_best_two_fit_exchanges_the_smallest():
    # Greedy puts 6 + 3 into a bin of 10; two pieces of 2 fit its gap better than the 3.
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert [(p[0], p[2], p[3]) for p in plan if p[3] == 0] == [(6, 1, 0), (2, 2, 0)]


@pytest.mark.parametrize("text", ["ÀÉ Ÿ Ö×÷ µ ªº 'S don't I'LL", "<|endoftext|> x<|startoftext|>y 12a3", "日本 a　b ΣΑΣ ﬁ İ ẞ",
                                  "\x0b q\x0cq \x00 ~~ a'b' 's", "\x1c a\x1fb \x85 c\xa0d", ""])
def test_word_ids_equal_the_tokenizer(text):
    ids = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert packing.WordIds(TOKENIZER).encode([text])[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_toxicity(spark, edge_docs, no_docs):
    import random
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(3, 8)))
    rows, marks = [], []
    for i in range(400):
        ws = [word() for _ in range(rnd.randint(20, 120))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            ws[rnd.randrange(len(ws))] = rnd.choice(["blockhead", "vermin"])
        if not toxic and i % 3 == 0:
            ws.insert(3, "verminproof")
        if not toxic and i % 40 == 7:
            ws[5:5] = ["vermin", "control"]
        rows.append((i, " ".join(ws)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 2)
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, lexicon).collect()}
    assert all((out[i] >= 0.3) == bool(t) for i, t in marks)
    odd = ["you bl0ckhe4d and ｖｅｒｍｉｎ", "you bl\u043eckhead", "V\u00e9rmin here", "verminproof boxes, vermin control", "nothing", None, ""]
    scored = toxicity.score(spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string"), lexicon)
    hits = [r["toxic_hits"] for r in scored.orderBy("doc_id").collect()]
    assert hits == [2, 1, 1, 0, 0, 0, 0]
    scored = toxicity.score(edge_docs, lexicon)
    assert scored.count() == edge_docs.count() and scored.where("toxicity < 0 or toxicity > 1 or toxicity is null").count() == 0
    nothing = toxicity.fit(no_docs, labels, F.lit(True))
    assert toxicity.score(edge_docs, nothing).agg(F.max("toxicity")).first()[0] == 0
