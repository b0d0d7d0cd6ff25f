"""Line dedup by content-defined runs of lines [native].

A text is a sequence of lines; a line that wraps over several sentences is
taken sentence by sentence, so a passage is several lines whether it stands
in one paragraph or not.  Lines are compared without the blanks around them,
and blank lines don't count.

At every line a run starts: the shortest one of two lines or more with
``MIN_CHARS`` characters; and one ends there, taken the same way backwards.
Where runs start and end depends on their own lines alone, so every passage
of two lines and ``MIN_CHARS`` characters is made up of the runs inside it,
whatever stands around it.  A line of ``LONG_WORDS`` words is a run by itself.

Runs are grouped over all documents by a rolling hash over the hashes of their
lines, and the bytes of those that occur more than once are compared: if runs of
one hash differ, runs are grouped by their bytes instead.  Of a repeated run
only the first occurrence stays (smallest doc_id, then first in the document),
and the lines of all others go.  The first occurrence of a line always stays,
as a line goes only where an earlier run holds it.

``line_chunks`` cuts a text into disjoint chunks instead: a rolling hash over
two line hashes is compared with its neighbours, and a line at which it is
smallest among the two lines on either side ends a chunk.  A paragraph (a
physical line of three sentences or more) starts and ends a chunk, and its own
lines alone choose the boundaries inside it.

Defined results: null texts stay null and empty texts empty; occurrences that
overlap the first one in its own document stay; rows that share a doc_id are
one document with several texts, each of which keeps its first occurrence;
rows without doc_id come after all others and are known by their text; extra
columns are passed through.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import cut, marked, release, table_folder
from ._common import BLANK_CHARS, word_count

MIN_CHARS = 40    # of a run of several lines
LONG_WORDS = 50   # of a run of a single line
MOST_LINES = MIN_CHARS // 2 + 1  # lines of one character and their line feeds make MIN_CHARS
# A line ends after a line feed, or after the blank that follows the end of a sentence.
ENDS = ["\n", ". ", "! ", "? "]
LINE_END = "(?<=\\n)|(?<=[.!?] )"
MARK = "\x00"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _barrier(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``columns`` computed once per row: a generator keeps them from being inlined again."""
    made = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select(*keep, F.inline(F.array(made)))


def line_pieces(text: Column) -> Column:
    """Lines with their ends; joined they are the text."""
    marked = text
    for end in ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    # Marks are found without a regular expression, unless the text holds the mark itself.
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, LINE_END)).otherwise(F.split(marked, MARK))


def _odd_blanks(text: Column) -> Column:
    """Whether a text holds blanks other than spaces and line feeds, or the mark."""
    found = F.contains(text, F.lit(MARK))
    for c in BLANK_CHARS:
        if c not in " \n":
            found = found | F.contains(text, F.lit(c))
    return found


def _lines(text: Column, odd: Column) -> Column:
    """The lines that are not blank, without the blanks around them: ``line_pieces``, trimmed.

    Without odd blanks line ends are replaced by the mark, and spaces alone are trimmed.
    """
    marked = text
    for end in ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end.rstrip() + MARK))
    plain = F.transform(F.split(marked, MARK), lambda p: F.trim(p))
    other = F.transform(line_pieces(text), lambda p: F.btrim(p, F.lit(BLANK_CHARS)))
    return F.filter(F.when(odd, other).otherwise(plain), lambda l: l != F.lit(""))


def line_chunks(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns, ``pieces`` and ``chunks``: array of (first, count, body, h)."""
    df = _barrier(texts, keep, pieces=line_pieces(F.coalesce(F.col(text), F.lit(""))))
    df = _barrier(df, [*keep, "pieces"], ends=F.transform("pieces", lambda p: F.endswith(p, F.lit("\n"))),
                  hashes=F.transform("pieces", lambda p: F.xxhash64(F.btrim(p, F.lit(BLANK_CHARS)))))

    def at(name: str, i: Column) -> Column:
        return F.get(F.col(name), i)

    def inner(i: Column) -> Column:  # lines i, i+1, i+2 share a physical line
        return ((i >= 0) & (i + 2 < F.size("ends")) & ~F.coalesce(at("ends", i), F.lit(True))
                & ~F.coalesce(at("ends", i + 1), F.lit(True)))

    def in_paragraph(i: Column) -> Column:
        return inner(i) | inner(i - 1) | inner(i - 2)

    # A forced boundary: the end of a physical line next to a paragraph, and the end of the text.
    forced = F.transform("ends", lambda e, i: (i + 1 == F.size("ends")) | (
        e & (in_paragraph(i) | in_paragraph(i + 1))))
    df = _barrier(df, [*keep, "pieces", "hashes"], forced=forced)

    def rotated(h: Column) -> Column:
        return F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))

    rolling = F.transform("hashes", lambda h, i: F.when(
        (i == 0) | F.coalesce(at("forced", i - 1), F.lit(True)), h).otherwise(
        h.bitwiseXOR(rotated(at("hashes", i - 1)))))
    df = _barrier(df, [*keep, "pieces", "forced"], rolling=rolling)

    def least(h: Column, i: Column) -> Column:  # smallest of i-2..i+2, away from forced boundaries
        clear = ~(F.coalesce(at("forced", i - 2), F.lit(True)) | F.coalesce(at("forced", i - 1), F.lit(True))
                  | F.coalesce(at("forced", i + 1), F.lit(True)))
        return (i >= 2) & (h < at("rolling", i - 1)) & (h < at("rolling", i - 2)) & (
            h < at("rolling", i + 1)) & (h <= F.coalesce(at("rolling", i + 2), h)) & clear

    last = F.filter(F.transform("rolling", lambda h, i: F.when(
        F.coalesce(at("forced", i), F.lit(False)) | least(h, i), i)), lambda i: i.isNotNull())
    df = _barrier(df, [*keep, "pieces"], last=last)
    spans = F.transform("last", lambda e, k: F.struct(
        F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("last"), k - 1) + 1).alias("first"), e.alias("last")))
    df = _barrier(df, [*keep, "pieces"], spans=spans)
    # Chunks are compared without the blanks around their lines and without blank lines.
    bodies = F.transform("spans", lambda s: F.struct(
        s["first"].alias("first"), (s["last"] - s["first"] + 1).alias("count"),
        F.array_join(F.filter(F.transform(F.slice("pieces", s["first"] + 1, s["last"] - s["first"] + 1),
                                          lambda p: F.btrim(p, F.lit(BLANK_CHARS))),
                              lambda l: l != F.lit("")), "\n").alias("body")))
    df = _barrier(df, [*keep, "pieces"], bodies=bodies)
    chunks = F.transform("bodies", lambda c: F.struct(
        c["first"].alias("first"), c["count"].alias("count"), c["body"].alias("body"),
        F.xxhash64(c["body"]).alias("h")))
    return _barrier(df, [*keep, "pieces"], chunks=chunks)


def line_runs(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns, ``at`` and ``h`` of every run, with ``at`` = 32 * number of the first line + lines.

    Numbers count the lines that are not blank.  Hashes roll over the lines two by
    two: those of all pairs of lines make those of any run.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    df = _barrier(texts, keep, raw=raw, odd=_odd_blanks(raw))
    df = _barrier(df, [*keep, "odd"], lines=_lines(F.col("raw"), F.col("odd")))

    def is_long(l: Column) -> Column:  # words take LONG_WORDS - 1 blanks between them, and no more if all are single
        may_be = F.col("odd") | (
            F.octet_length(l) - F.octet_length(F.replace(l, F.lit(" "), F.lit(""))) >= LONG_WORDS - 1)
        return may_be & ((~F.col("odd") & ~F.contains(l, F.lit("  "))) | (word_count(l) >= LONG_WORDS))

    # A line counts with its line feed: a run has MIN_CHARS characters from MIN_CHARS + 1 on.
    df = _barrier(df, keep, s1=F.transform("lines", lambda l: F.char_length(l) + 1),
                  h1=F.transform("lines", lambda l: F.xxhash64(l)),
                  long=F.filter(F.transform("lines", lambda l, i: F.when(
                      (F.octet_length(l) >= 2 * LONG_WORDS - 1) & is_long(l), i)),
                      lambda i: i.isNotNull()))
    df = _barrier(df, [*keep, "s1", "long"], s2=F.transform("s1", lambda s, i: s + F.get("s1", i + 1)),
                  h2=F.transform("h1", lambda h, i: F.xxhash64(h, F.get("h1", i + 1))), h1=F.col("h1"))

    def size(i: Column, n: int) -> Column:  # of n lines from i on; null beyond the end
        parts = [F.get("s2", i + 2 * k) for k in range(n // 2)] + [F.get("s1", i + n - 1)] * (n % 2)
        return sum(parts[1:], parts[0])

    def shortest(s2: Column, i: Column) -> Column:  # lines of the shortest run from i on; s2 is null at the last line
        found = F.when(s2.isNull(), F.lit(None).cast("int")).when(s2 > MIN_CHARS, F.lit(2))
        for n in range(3, MOST_LINES + 1):
            found = found.when(size(i, n) > MIN_CHARS, F.lit(n))
        return found

    df = _barrier(df, [*keep, "h1", "long", "h2"], least=F.transform("s2", shortest))

    def made(i: Column, n: Column) -> Column:
        steps = [F.when(n >= 2 * k + 2, F.get("h2", i + 2 * k)) for k in range(1, MOST_LINES // 2)]
        h = F.when(n == 2, F.get("h2", i)).when(n == 1, F.xxhash64(n, F.get("h1", i)))
        for most in (4, 6, 8):  # the usual numbers of lines without the long list of pairs
            h = h.when(n <= most, F.xxhash64(n, *[F.get("h2", i + k) for k in range(0, most - 2, 2)], F.get("h2", i + n - 2)))
        h = h.otherwise(F.xxhash64(n, F.get("h2", i), *steps, F.get("h2", i + n - 2)))
        return F.struct((F.shiftleft(i.cast("long"), 5) + n).alias("at"), h.alias("h"))

    # The shortest run back from a line that ends after the run from line i and before that from line i + 1
    # starts at i, too: such runs are longer than the one from i.
    def reach(i: Column) -> Column:
        return F.coalesce(F.get("least", i + 1), F.size("h1") - i)

    runs = F.filter(F.transform("least", lambda n, i: F.when(n.isNotNull(), made(i, n))), lambda r: r.isNotNull())
    wider = F.filter(F.transform("least", lambda n, i: F.when(n < reach(i), i)), lambda i: i.isNotNull())
    more = F.flatten(F.transform(wider, lambda i: F.transform(
        F.sequence(F.get("least", i) + 1, reach(i)), lambda c: made(i, c))))
    alone = F.transform("long", lambda i: made(i, F.lit(1)))
    return df.select(*keep, F.inline(F.concat(runs, more, alone)))


def _key(docs: DataFrame) -> list[Column]:
    """(no id, key, tag) of a row: its doc_id, or a hash of its text where that is null; tag tells texts of a doc_id apart."""
    return [F.col("doc_id").isNull().cast("int").alias("no_id"),
            F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"),
            F.hash("text").alias("tag")]


def _held_twice(found: DataFrame, by: list[str]) -> DataFrame:
    """Runs of ``found`` that occur more than once, equal in ``by``, and whether their document is the first to hold them.

    Counted on the map side first, so a run that a third of all documents share
    is one row per task.
    """
    named, nameless = F.when(F.col("no_id") == 0, F.col("key")), F.when(F.col("no_id") == 1, F.col("key"))
    classes = cut(found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(named).alias("named"),
                                         F.min(nameless).alias("nameless"))
                  .where(F.col("n") > 1).drop("n"))
    first = F.when(F.col("named").isNotNull(), (F.col("no_id") == 0) & (F.col("key") == F.col("named"))).otherwise(
        F.col("key") == F.col("nameless"))
    # The classes, a row per hash, are hashed; the many runs need no sort.
    return found.join(classes.hint("shuffle_hash"), by).select("no_id", "key", "tag", "at", *by, first.alias("owner"))


def _written_runs(runs: DataFrame) -> DataFrame:
    """``runs`` as a table; most hashes are unlike, so no dictionary of them is tried."""
    path = table_folder(runs)
    runs.write.option("parquet.enable.dictionary#h", "false").parquet(path)
    return runs.sparkSession.read.parquet(path)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(no_id, key, tag, at, h, owner): the runs of every row whose hash occurs more than once."""
    return _held_twice(_written_runs(line_runs(docs.select(*_key(docs), "text"), ["no_id", "key", "tag"], "text")), ["h"])


def _removals(repeated: DataFrame, by: str) -> DataFrame:
    """(no_id, key, tag, gone, held): numbers of the lines that go, and every repeated run as (by, at).

    Equal rows (a doc_id that stands on one text many times) count once.
    """
    keys = ["no_id", "key", "tag"]
    line, count = (lambda at: F.shiftright(at, 5).cast("int")), (lambda at: at.bitwiseAND(31).cast("int"))
    runs = repeated.groupBy(*keys, F.col(by).alias("h"), "owner").agg(
        F.collect_set("at").alias("ats"), F.min("at").alias("first"))
    # Of the runs of a first holder those go that stand there again, without sharing lines with the first one.
    again = F.filter("ats", lambda at: line(F.col("first")) + count(F.col("first")) <= line(at))
    lists = runs.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("owner"), again).otherwise(F.col("ats"))).alias("gone"),
        F.collect_list(F.transform("ats", lambda at: F.struct(F.col("h"), at.alias("at")))).alias("held"))
    lists = _barrier(lists, [*keys, "held"], gone=F.flatten("gone"))
    gone = F.sort_array(F.array_distinct(F.flatten(F.transform("gone", lambda at: F.sequence(
        line(at), line(at) + count(at) - 1)))))
    return lists.select(*keys, gone.alias("gone"), F.flatten("held").alias("held"))


def _without(docs: DataFrame, removals: DataFrame) -> DataFrame:
    """``docs`` under names of their own, ``dedup``, their keys, and ``runs``: the bytes (h, at, body) of every repeated run.

    ``dedup.text`` is null where nothing goes, so that a text is not written twice.
    """
    # Columns travel under names of their own, so that no column of ``docs`` can clash.
    own_names = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    keys = ["no_id", "key", "tag"]
    held, body = [*own_names, *keys], F.col(f"__c{docs.columns.index('text')}")
    # Texts that hold no repeated run are not split again.
    touched = F.when(F.col("held").isNotNull(), body)
    joined = (docs.select(*_key(docs), *[F.col(f"`{c}`").alias(k) for k, c in own_names.items()])
              .join(removals.hint("shuffle_hash"), keys, "left").select(*held, "gone", "held", touched.alias("text")))
    split = _barrier(joined, [*held, "held"], gone=F.coalesce("gone", F.array().cast("array<int>")),
                     pieces=line_pieces(F.coalesce("text", F.lit(""))), odd=_odd_blanks(F.coalesce("text", F.lit(""))))
    split = _barrier(split, [*held, "pieces", "odd", "held", "gone"], trimmed=F.transform("pieces", lambda p: F.when(
        F.col("odd"), F.btrim(p, F.lit(BLANK_CHARS))).otherwise(F.trim(F.replace(p, F.lit("\n"), F.lit(""))))))
    # The lines that are not blank, and the numbers of their pieces.
    places = F.filter(F.transform("trimmed", lambda l, i: F.when(l != F.lit(""), i)), lambda i: i.isNotNull())
    # Stretches of lines that go, as (first, last) numbers of lines, then of pieces.
    edge = lambda side: F.filter("gone", lambda x, i: F.coalesce(
        F.get("gone", i + side) != x + side, F.lit(True)))
    split = _barrier(split, [*held, "pieces", "odd", "held"], lines=F.filter("trimmed", lambda l: l != F.lit("")),
                     places=places, firsts=edge(-1), lasts=edge(1))
    joined_lines = lambda first, count: F.array_join(F.slice("lines", first + 1, count), "\n")
    runs = F.transform("held", lambda r: F.struct(r["h"].alias("h"), r["at"].alias("at"), joined_lines(
        F.shiftright(r["at"], 5).cast("int"), r["at"].bitwiseAND(31).cast("int")).alias("body")))
    bodies = F.zip_with("firsts", "lasts", lambda a, z: joined_lines(a, z - a + 1))
    split = _barrier(split, [*held, "pieces", "odd"], runs=runs, removed=bodies, spans=F.zip_with(
        "firsts", "lasts", lambda a, z: F.struct(F.get("places", a).alias("first"), F.get("places", z).alias("last"))))
    # What stays: the pieces between the spans, before the first and after the last.
    bounds = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda k: F.struct(
        F.coalesce(F.get("spans", k - 1)["last"] + 1, F.lit(0)).alias("from"),
        F.coalesce(F.get("spans", k)["first"], F.size("pieces")).alias("to")))
    split = _barrier(split, [*held, "pieces", "odd", "spans", "runs", "removed"], bounds=bounds)
    kept = F.array_join(F.transform("bounds", lambda b: F.array_join(
        F.slice("pieces", b["from"] + 1, b["to"] - b["from"]), "")), "")
    text = F.when(F.size("removed") > 0, kept)  # null where nothing goes: the text as it was

    lines = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    # Where single blanks stand between words, there is one more word than blanks.
    blanks = lambda c: F.octet_length(c) - F.octet_length(
        F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda a, c: a + F.when(
        F.col("odd") | F.contains(c, F.lit("  ")), word_count(c)).otherwise(blanks(c) + 1))
    return split.select(*held, "runs", F.struct(
        text.alias("text"), lines.alias("removed_lines"), words.alias("removed_words"),
        F.col("removed")).alias("dedup"))


@contextmanager
def _shuffles_go_with_their_query(spark: SparkSession):
    """Shuffle files are removed when the query that made them has ended; later steps read written tables."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def _written_texts(texts: DataFrame) -> DataFrame:
    """``texts`` as a table; runs and stretches repeat what stands in the texts, so it is packed tighter than usual."""
    path = table_folder(texts)
    texts.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    return texts.sparkSession.read.parquet(path)


def _written_removals(docs: DataFrame, found, by: str) -> DataFrame:
    """``_removals`` of ``found()`` as a table; the larger tables that it came from are removed."""
    spark, path = docs.sparkSession, table_folder(docs)
    since = marked(spark)
    _removals(found(), by).write.parquet(path)
    release(spark, since)
    return spark.read.parquet(path)


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with struct column ``dedup``: text, removed_lines, removed_words, removed (stretches of lines)."""
    with _shuffles_go_with_their_query(docs.sparkSession):
        out = _written_texts(_without(docs, _written_removals(docs, lambda: repeated_runs(docs), "h")))
        # Byte comparison: runs of one hash must be one text.  If any are not, runs are told apart by their bytes.
        runs = out.select("no_id", "key", "tag", F.inline("runs"))
        texts = runs.groupBy("h", "body").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("n"))
        if texts.where(F.col("n") > 1).limit(1).count():
            out = _written_texts(_without(docs, _written_removals(docs, lambda: _held_twice(runs, ["body"]), "body")))
    text = F.coalesce("dedup.text", f"__c{docs.columns.index('text')}")
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)],
                      F.col("dedup").withField("text", text).alias("dedup"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` (and ``n_chars`` to match)."""
    out = line_dedup(docs).withColumn("text", F.col("dedup.text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
