"""Vectors and pages against brute force, with hard cases and empty input."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quarterlens.llm import ann, queries, url_filter, warc


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_nearest_recall_and_hard_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.5 * rng.normal(size=16)]) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(300)]            # one very common vector
    bad = [(6000, None), (6050, []), (6100, [0.0] * 16), (6150, [float("nan")] + [1.0] * 15),
           (6200, [None] + [1.0] * 15), (None, rows[3][1]), rows[0]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    out = ann.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=800).collect()
    found = {}
    for r in out:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = dict(rows)
    assert set(found) == {i for i in v if i % 50 == 0}
    ids = np.array(list(v))
    unit = np.array([v[i] for i in ids])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and q not in [g[1] for g in got]
        assert all(abs(g[2] - cosine(v[q], v[g[1]])) < 1e-12 for g in got)
        sims = np.round(unit @ unit[np.flatnonzero(ids == q)[0]], 12)
        sims[ids == q] = -9
        hit += len(set(ids[np.lexsort((ids, -sims))[:5]]) & {g[1] for g in got})
    assert hit / (5 * len(found)) >= 0.95
    assert [g[1] for g in found[5000]] == [7, 5001, 5002, 5003, 5004]
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0)
    assert few.count() == 2 and ann.nearest(df.where("false"), F.lit(True)).count() == 0


def pages(spark):
    rnd = random.Random(6)
    big = "<p>" + "é" * 800 + "</p>"
    rows = [(i, f"http://h{i}.example.org/{i}", "".join(rnd.choice("abc<>\n é") for _ in range(rnd.randint(0, 4000))))
            for i in range(120)]
    rows += [(200 + i, None, big) for i in range(40)] + [(300, "x\r\ny", "short"), (301, "", "short"), (302, None, None),
             (None, "http://a/", "<b>"), (None, None, big), (239, None, big), (310, "u", "z" * 3_000_000), (311, "u", "")]
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string")


def test_warc_round_trip(spark):
    df = pages(spark).repartition(3)
    for split in (700, 1 << 20):
        out = warc.round_trip(df, split_bytes=split).collect()
        assert len(out) == df.count()
        last = 239
        want = []
        for r in df.collect():
            body = (r["html"] or "").encode()
            copy = r["html"] is not None and r["html"].startswith("<p>") and r["page_id"] != last
            want.append((f"urn:page:{'' if r['page_id'] is None else r['page_id']}", len(body), hashlib.sha1(body).hexdigest(),
                         "revisit" if copy else "response", f"urn:page:{last}" if copy else None, None if copy else body))
        got = [(r["record_id"], r["payload_length"], r["payload_digest"], r["record_type"], r["refers_to"],
                None if r["payload"] is None else bytes(r["payload"])) for r in out]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_ranges_own_each_record_once(tmp_path):
    """Random payloads hold the gzip magic; every split finds each record exactly once."""
    rnd = random.Random(8)
    path, starts, data = tmp_path / "a.warc.gz", [], b""
    for i in range(40):
        body = bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 3000))) + warc.MAGIC * 5
        starts.append(len(data))
        data += warc.encode_record({"record_id": f"urn:{i}", "record_type": "response", "target": "t", "refers_to": None,
                                    "payload_length": len(body), "payload_digest": hashlib.sha1(body).hexdigest(), "payload": body})
    path.write_bytes(data)
    for split in (1, 97, 1000, 10 ** 9):
        if split == 1:
            ranges = [(s, s + 1) for s in [*starts, *range(5, 2000, 7)]]
        else:
            ranges = [(a, min(a + split, len(data))) for a in range(0, len(data), split)]
        found = [r["position"] for a, b in ranges for r in warc.read_range(str(path), a, b)]
        assert sorted(found) == starts


def brute_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules_and_verdicts(spark):
    rnd = random.Random(1)
    urls = [None, "", "no scheme", "http://", "HTTP://ORG/", "http://É.Example.ORG/es/x?y#z", "http://a.org?q=/es/", "x://example.org/en/1",
            "ftp://example.org/en/2://b", "http://notorg/", "http://com/fr/", "http://xcom/de/", "http://a.com/de/\nx", "http://a.org#f/es/"]
    urls += [f"http://{rnd.choice(['a.', 'b.c.', ''])}example.{rnd.choice(['com', 'org', 'net'])}/"
             f"{rnd.choice(['fr', 'de', 'es', 'en'])}/{rnd.randint(1, 300)}{rnd.choice(['', '?p=1&q=2', '#t', '.html'])}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = url_filter.judge(df, queries.URL_RULES).collect()
    assert len(out) == len(urls)
    for r in out:
        host, path, best = brute_rule(r["record"]["url"], queries.URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")
    free = [r for r in out if r["rule"] is None and "/de/" in r["path"]]
    kept = [r for r in out if r["rule"] is None and "/fr/" in r["path"]]
    assert free and kept
    assert url_filter.judge(df.where("false"), queries.URL_RULES).count() == 0
    only = url_filter.judge(df.where("url like '%.com/fr/%' or url like '%net%'"), queries.URL_RULES)
    assert {r["verdict"] for r in only.collect()} == {"allow"}
