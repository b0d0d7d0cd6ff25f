"""Lines found by replacing their ends are the trimmed pieces; words counted by blanks are the words."""
import glob
import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarterlens.functions import materialize as MZ
from quarterlens.llm import line_dedup as L


def test_lines_are_trimmed_pieces(spark):
    rnd = random.Random(6)
    signs = ["a", "Bc", "é", "日本", ".", "!", "?", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x00", ". ", "! ", "? ", ".\n"]
    usual = [s for s in signs if s not in "\t\r\x0b\x0c\x00"]
    texts = ["", " ", "\n", ". ", "a. ! b", "? ! . ", ".  x"] + [
        "".join(rnd.choice(usual if i % 2 else signs) for _ in range(rnd.randint(1, 40))) for i in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", L._lines(F.col("t"), L._odd_blanks(F.col("t"))).alias("lines")).collect():
        pieces = re.split("(?<=\n)|(?<=[.!?] )", r["t"])
        assert r["lines"] == [p for p in (x.strip(" \t\n\x0b\x0c\r") for x in pieces) if p], repr(r["t"])


def test_removed_words_are_counted_whatever_the_blanks(spark):
    passage = "One  passage with two blanks that is long enough. \tAnother sentence of it stands here. And a third one closes it."
    plain = "A plain passage of some length stands in here. Its second sentence follows the first. And a third one ends it."
    rows = [(i, f"Opening number {i} of {i * 7}.\n{passage if i % 2 else plain}\nClosing {i}.") for i in range(6)]
    for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = 0 if r["doc_id"] < 2 else len(re.findall("[^\x20\x09-\x0d]+", passage if r["doc_id"] % 2 else plain))
        assert r["dedup"]["removed_words"] == want


def test_long_lines_are_those_of_many_words(spark):
    rnd = random.Random(8)
    texts = []
    for n in (1, 30, 48, 49, 50, 51, 52, 80):
        for blanks in ([" "], [" ", "  "], [" ", "   "], [" ", "\t"], ["\x0b", " \r "]):
            for word in ("a", "ab", "\u65e5"):
                texts.append(word + "".join(rnd.choice(blanks) + word for _ in range(n - 1)))
    texts += [" " * 60 + "x" * 120, "x" * 99 + " " * 60, ("y" * 40 + " " * 49) * 3 + "z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    alone = {r["i"] for r in L.line_runs(df, ["i"], "t").where("at % 32 = 1").collect()}
    assert alone == {i for i, t in enumerate(texts) if len(re.findall("[^\x20\x09-\x0d]+", t)) >= L.LONG_WORDS}


def test_texts_are_searched_for_odd_blanks_once(spark):
    df = spark.createDataFrame([(1, "a. b")], "i int, t string")
    plan = L.line_runs(df, ["i"], "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", \x0b)") == 1


def test_no_dictionary_of_hashes_is_tried(spark):
    before = MZ.marked(spark)
    docs = spark.createDataFrame([(i, "One line of some length here. Another line that follows it.") for i in range(800)],
                                 "doc_id long, text string")
    L.repeated_runs(docs)
    folder = MZ._FOLDERS[spark.sparkContext.applicationId][before]
    files = [f for f in glob.glob(f"{folder.removeprefix('file:')}/*.parquet") if pq.read_metadata(f).num_rows]
    for f in files:
        group = pq.read_metadata(f).row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
        assert not any("DICTIONARY" in e for e in columns["h"])
    assert files
