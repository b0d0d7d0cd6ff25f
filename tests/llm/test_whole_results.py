"""Results stay whole: sources of single words in a mix, records with very long headers in an archive."""

import hashlib
import random
from collections import Counter

import pytest

from quarterlens.llm import mixing, warc


@pytest.mark.parametrize("tiny", [1, 60])
def test_every_source_meets_its_target(spark, tiny):
    rows = [(i, " ".join(["word"] * 500), f"big{i % 2}") for i in range(400)]
    rows += [(1000 + i, "single", f"s{i:03d}") for i in range(tiny)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=8)
    taken, target = Counter(), {}
    for r in mix.taken().collect():
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    slots = [r["slot"] for r in mix.segments.select("slot", "source_id").distinct().collect()]
    assert len(slots) == len(set(slots))


def test_schedule_without_surplus_is_completed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MIN_SLOTS", 1 << 40)
    sources = spark.createDataFrame([(1, 40), (2, 1), (3, 0), (4, 3), (5, 2000)], "source_id int, slots long")
    rows = mixing.schedule(sources, 5).collect()
    ranks = {k: sorted(r["rank"] for r in rows if r["source_id"] == k) for k in range(1, 6)}
    assert ranks == {1: list(range(40)), 2: [0], 3: [], 4: [0, 1, 2], 5: list(range(2000))}
    assert len({r["slot"] for r in rows}) == len(rows)


@pytest.mark.parametrize("length", [1 << 20, 2 << 20, 5 << 20])
def test_long_headers_are_read_on(tmp_path, length):
    rnd = random.Random(3)
    url = "http://x/" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(length))
    data, starts = b"", []
    for i, target in enumerate(("http://a/", url, "http://b/")):
        starts.append(len(data))
        data += warc.encode_record({"record_id": f"urn:{i}", "record_type": "response", "target": target, "refers_to": None,
                                    "payload_length": 4, "payload_digest": hashlib.sha1(b"body").hexdigest(), "payload": b"body"})
    path = tmp_path / "long.warc.gz"
    path.write_bytes(data)
    for cut in (starts[1] - 5, starts[1], starts[1] + 1, starts[2] - 1):
        found = [r for a, b in ((0, cut), (cut, len(data))) for r in warc.read_range(str(path), a, b)]
        assert sorted(r["position"] for r in found) == starts
        assert [r["target"] for r in found if r["position"] == starts[1]] == [url]
