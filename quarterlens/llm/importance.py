"""Importance resampling towards a target distribution, on hashed word runs.

A feature is a run of consecutive words; its bucket is the CRC-32 of its bytes
modulo the number of buckets.  CRC-32 is linear: the checksum of a span is the
XOR of one contribution per byte, which depends on the byte and its distance
from the span's end, and of a constant for the span's length.  A position
table holds the contributions for distances below ``REACH``.  The runs that
start at every k-th word cover the text without overlap, so one gather from the
table and one ``bitwise_xor.reduceat`` give the checksums of all of them.  Spans
of more than ``REACH`` bytes are cut into blocks from their end; a block's
checksum is advanced over the next block by the table's last four rows.

Corpus and target are counted per bucket in their tasks; a table of at most
``buckets`` rows comes out of that, whatever the corpus, and goes back to the
tasks as gains.  A document's weight is its features' floored mean gain; with
Gumbel noise added, the highest scores are a weighted sample without replacement.
Ranks come from a sample sort (range partitions and their sizes).

Defined results: null, empty and wordless texts have no features and weight 0;
a null doc_id takes the noise of the text ``7:`` and comes after all others on
ties; rows equal in score and doc_id are ranked in any order, without gaps; a
table without documents gives no rows, an empty target counts as all zeros.
Texts are worked through in steps of about ``STEP`` bytes, so a text of any
length needs bounded memory beyond itself.
"""

from __future__ import annotations

import zlib
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ..functions.ranking import sorted_positions
from ..session import ship_package

LONGEST_RUN = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
REACH = 64
STEP = 1 << 18

# Bytes of words stay (A-Z in lower case), all others become blanks; every byte of a character beyond ASCII stays.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def position_table(reach: int = REACH) -> np.ndarray:
    """Row d + 1: what each byte contributes at distance d from the end; row 0 (gaps) contributes nothing."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    rows = [np.zeros(256, np.uint32), one]
    for _ in range(reach - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ one[rows[-1] & np.uint32(255)])
    return np.stack(rows)


class SpanCrc:
    """CRC-32 of many spans of a byte array at once."""

    def __init__(self, reach: int = REACH):
        self.reach, self.table = reach, position_table(reach)
        self.flat = self.table.ravel()
        self.constants = np.array([zlib.crc32(bytes(n)) for n in range(reach + 1)], np.uint32)

    def _advanced(self, crc: np.ndarray) -> np.ndarray:
        """A checksum without its constant, after ``reach`` more bytes."""
        out = np.zeros_like(crc)
        for k in range(4):
            out ^= self.table[self.reach - k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Spans must be in order, without overlap and with at most one byte between neighbours."""
        length = ends - starts
        if length.max() <= self.reach:
            return self._blocks(data, starts, ends) ^ self.constants[length]
        blocks = -(-length // self.reach)
        first = np.cumsum(blocks) - blocks
        span = np.repeat(np.arange(len(starts)), blocks)
        left = blocks[span] - 1 - (np.arange(len(span)) - first[span])  # blocks of the span behind this one
        block_ends = ends[span] - left * self.reach
        crc = self._blocks(data, np.maximum(starts[span], block_ends - self.reach), block_ends)
        folded = crc[first]
        active = np.flatnonzero(blocks > 1)
        nth = 1
        while len(active):
            folded[active] = self._advanced(folded[active]) ^ crc[first[active] + nth]
            nth += 1
            active = active[blocks[active] > nth]
        short = length <= self.reach
        folded[short] ^= self.constants[length[short]]
        zeros = {int(n): zlib.crc32(bytes(int(n))) for n in np.unique(length[~short])}
        folded[~short] ^= np.array([zeros[int(n)] for n in length[~short]], np.uint32)
        return folded

    def _blocks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        reach = np.diff(np.append(starts, ends[-1]))  # bytes up to the next span
        row = np.repeat(ends, reach) - np.arange(starts[0], ends[-1])
        return np.bitwise_xor.reduceat(self.flat[(row << 8) + data[starts[0]:ends[-1]]], starts - starts[0])


def _parts(text: bytes, step: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """A folded text in parts of about ``step`` bytes, cut at blanks; each begins with up to ``carry`` words of the one before."""
    if len(text) <= step:
        yield text, 0
        return
    at, held = 0, b""
    while at < len(text):
        end = text.find(b" ", min(at + step, len(text)))
        end = len(text) if end < 0 else end
        part = held + text[at:end]
        yield part, len(held.split())
        held = b"".join(w + b" " for w in part.rsplit(None, carry)[-carry:] if b" " not in w) if carry else b""
        at = end


class Features:
    """Buckets of all runs of 1 to ``longest`` words."""

    def __init__(self, longest: int = LONGEST_RUN, buckets: int = BUCKETS, step: int = STEP, reach: int = REACH):
        self.longest, self.buckets, self.step, self.crc = longest, buckets, step, SpanCrc(reach)

    def chunks(self, texts: Sequence[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
        """Per chunk: document of each new word; and (document, bucket) of the features, for each run length."""
        parts, owners, carried, total = [], [], [], 0
        for doc, text in enumerate(texts):
            for part, held in _parts((text or b"").translate(_FOLD), self.step, self.longest - 1):
                parts.append(part)
                owners.append(doc)
                carried.append(held)
                total += len(part) + 1
                if total >= self.step:
                    yield self._chunk(parts, owners, carried)
                    parts, owners, carried, total = [], [], [], 0
        if parts:
            yield self._chunk(parts, owners, carried)

    def _chunk(self, parts: list[bytes], owners: list[int], carried: list[int]):
        raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        part_at = np.cumsum([1] + [len(p) + 1 for p in parts[:-1]])
        inside = raw != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin, length = edge[::2], edge[1::2] - edge[::2]
        if not len(begin):
            return np.empty(0, np.int64), []
        keep = inside.copy()
        keep[1:] |= inside[:-1]  # one blank after each word
        data = raw[keep]
        ends = np.cumsum(length + 1) - 1
        starts = ends - length
        part = np.searchsorted(part_at, begin, side="right") - 1
        first = np.searchsorted(part, np.arange(len(parts)))  # first word of each part
        fresh = first + np.array(carried)  # first word that no earlier part held
        owner = np.array(owners)
        word = np.arange(len(begin))
        found = []
        for n in range(1, self.longest + 1):
            for offset in range(min(n, max(0, len(begin) - n + 1))):
                i = word[offset:len(begin) - n + 1:n]
                crc = self.crc(data, starts[i], ends[i + n - 1])
                own = part[i]
                valid = (own == part[i + n - 1]) & (i + n > fresh[own])
                found.append((owner[own[valid]], crc[valid] % np.uint32(self.buckets)))
        return owner[part[word >= fresh[part]]], found


def feature_counts(df: DataFrame, text: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket."""
    ship_package(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in features.chunks(batch.column(0).to_pylist()):
                for _, bucket in found:
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    partial = df.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST_RUN,
          buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for all buckets: floored thousandths of the log ratio of target to corpus, counts plus one."""
    spark = docs.sparkSession
    dense = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for name, table in (("s", docs), ("t", target)):
        counted = feature_counts(table, text, longest, buckets).withColumnRenamed("n", name)
        dense = dense.join(counted, "bucket", "left").fillna(0, [name])
    dense = cut(dense)
    totals = dense.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    plus = lambda c, n: (F.col(c) + F.lit(n)).cast("double")
    ratio = plus("t", 1) * plus("all_s", buckets) / (plus("s", 1) * plus("all_t", buckets))
    return dense.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text",
             longest: int = LONGEST_RUN, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, record): ``record`` holds the columns ``carry``."""
    ship_package(docs.sparkSession)
    buckets = len(gain)
    record = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"),
                       record.alias("record"))
    kind = rows.schema["record"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_features", "weight", "record"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(longest, buckets)
        for batch in batches:
            n = batch.num_rows
            words, count, total = (np.zeros(n, np.int64) for _ in range(3))
            for owner, found in features.chunks(batch.column(1).to_pylist()):
                words += np.bincount(owner, minlength=n)
                for doc, bucket in found:
                    count += np.bincount(doc, minlength=n)
                    np.add.at(total, doc, gain[bucket])
            weight = total // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, count, weight)), batch.column(2)], names)

    return rows.mapInArrow(weigh, f"doc_id long, n_words long, n_features long, weight long, record {kind}")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, floored; from the first 32 bits of a SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + F.lit(0.5)) / F.lit(float(1 << 32)))) * -1000).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             longest: int = LONGEST_RUN, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id",
             text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank, record) for every row of ``docs``.

    ``rank`` counts from 1 among the drawn rows, by falling score, and is null
    for the others.  ``record`` holds the columns ``carry`` (None: all of ``docs``).
    """
    carry = docs.columns if carry is None else carry
    # One row per bucket, ``buckets`` of them, whatever the corpus.
    table = gains(docs, target, text, longest, buckets).collect()
    gain = np.zeros(buckets, np.int64)
    for r in table:
        gain[r["bucket"]] = r["gain"]
    rows = weighted(docs, gain, id_col, text, longest, carry)
    rows = cut(rows.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed),
                                 "row": F.monotonically_increasing_id()}))
    fit = F.col("n_words") >= least_words
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    ordered = sorted_positions(rows.where(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")],
                               "place")
    # place < floor(percent * N / 100), in whole numbers
    many = rows.where(fit).agg((F.count(F.lit(1)) * percent).alias("many"))
    drawn = ordered.crossJoin(F.broadcast(many)).select(
        *names, F.when((F.col("place") + 1) * 100 <= F.col("many"), F.col("place") + 1).alias("rank"), "record")
    rest = rows.where(~fit).select(*names, F.lit(None).cast("long").alias("rank"), "record")
    return drawn.unionByName(rest)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, with their columns."""
    return resample(docs, target, **options).where(F.col("rank").isNotNull()).select("record.*")
