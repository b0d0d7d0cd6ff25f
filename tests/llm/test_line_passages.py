"""Line dedup: passages of every length and layout, against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarterlens.llm import line_dedup


def brute_dedup(docs):
    """Kept text by doc_id (distinct ids): every run of two lines and 40 characters, and every line of 50 words."""
    split, where = {}, defaultdict(list)
    for d, text in sorted(docs):
        pieces = re.split(r"(?<=\n)|(?<=[.!?] )", text)
        lines = [(i, p.strip(" \t\n\x0b\x0c\r")) for i, p in enumerate(pieces)]
        split[d] = pieces, [x for x in lines if x[1]]
        bodies = [x[1] for x in split[d][1]]
        for i in range(len(bodies)):
            for j in range(i + 1, len(bodies) + 1):
                run = "\n".join(bodies[i:j])
                if (j > i + 1 and len(run) >= 40) or (j == i + 1 and len(run.split()) >= 50):
                    where[run].append((d, i, j))
    gone = defaultdict(set)
    for found in where.values():
        d0, i0, j0 = found[0]
        for d, i, j in found[1:]:
            if d != d0 or i >= j0:
                gone[d] |= set(range(i, j))
    out = {}
    for d, (pieces, lines) in split.items():
        drop = set()
        for k in gone[d]:
            # Blank lines between two lines that go, go as well.
            drop |= set(range(lines[k][0], lines[k + 1][0] if k + 1 in gone[d] else lines[k][0] + 1))
        out[d] = "".join(p for i, p in enumerate(pieces) if i not in drop)
    return out


def sentences(rnd, n, words):
    return [" ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(words)) + "." for _ in range(n)]


@pytest.mark.parametrize("n, words", [(1, 60), (2, 4), (2, 30), (5, 6), (7, 8), (10, 5)])
def test_passages_go_in_every_layout(spark, n, words):
    rnd = random.Random(n * words)
    passage, docs, want = sentences(rnd, n, words), [], {}
    for i in range(12):
        before, after = sentences(rnd, 4, 7), sentences(rnd, 4, 7)
        if i % 4 == 0:    # inside a paragraph
            text, rest = " ".join(before + passage + after), " ".join(before + after)
        elif i % 4 == 1:  # a line between short lines
            text, rest = "\n".join([*before, " ".join(passage), *after]), "\n".join(before + after)
        elif i % 4 == 2:  # several lines
            text, rest = "\n".join(before + passage + after), "\n".join(before + after)
        else:             # the last line, and nothing behind it
            text, rest = "\n".join([" ".join(before), " ".join(passage)]), " ".join(before) + "\n"
        docs.append((i, text))
        want[i] = rest if i else text
    out = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["dedup"]["text"] for r in out} == want
    assert all(r["dedup"]["removed"] == ["\n".join(passage)] and r["dedup"]["removed_lines"] == n for r in out if r["doc_id"])


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(12)
    pool = sentences(rnd, 25, 3) + ["le.", "im.", "A b.", "x", "Zu und.", "", "  "] + sentences(rnd, 3, 55)
    docs = [(i, "".join(rnd.choice(pool) + rnd.choice(["\n", " ", " ", "\n\n"]) for _ in range(rnd.randint(0, 25))))
            for i in range(60)] + [(90, "same line here\n" * 7), (91, "le.\n" * 40)]
    out = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["dedup"]["text"] for r in out} == brute_dedup(docs)


def test_runs_of_one_hash_are_told_apart_by_their_bytes(spark, monkeypatch):
    rnd, runs = random.Random(5), line_dedup.line_runs
    monkeypatch.setattr(line_dedup, "line_runs", lambda *a: runs(*a).withColumn("h", F.pmod("h", F.lit(5))))
    pool = sentences(rnd, 30, 4) + ["le.", "Zu und."]
    docs = [(i, "".join(rnd.choice(pool) + rnd.choice(["\n", " "]) for _ in range(rnd.randint(0, 12)))) for i in range(30)]
    out = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["dedup"]["text"] for r in out} == brute_dedup(docs)


def test_rows_repeated_many_times_count_once(spark):
    rnd = random.Random(6)
    passage = " ".join(sentences(rnd, 6, 5))
    docs = spark.createDataFrame([(1, passage + " First end of it."), (2, passage + " Second end of it.")],
                                 "doc_id long, text string").crossJoin(spark.range(400).select("id"))
    found = line_dedup._removals(line_dedup.repeated_runs(docs), "h").collect()
    assert sorted(len(r["held"]) for r in found) == [6, 6]  # five runs inside the passage, one at the end of each text
    out = line_dedup.line_dedup(docs).groupBy("doc_id", "dedup.text").count().collect()
    assert {(r["doc_id"], r["text"], r["count"]) for r in out} == {
        (1, passage + " First end of it.", 400), (2, "Second end of it.", 400)}
