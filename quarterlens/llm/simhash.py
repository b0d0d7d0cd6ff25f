"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints are mapped to the bit counts of their 32 two-bit segments.  The
Manhattan distance of two such vectors never exceeds the Hamming distance, so
fingerprints within ``max_bits`` lie within that distance in the integer
grid.  The vector is cut into two halves: if the distances of the halves sum
to at most 4, the first is at most 2 or the second at most 1.  Every distinct
fingerprint is sent to the grid cells around it (radius 1 on the first half;
on the second half radius 1 for odd vectors and 0 for even ones), which makes
every such pair meet in a cell; pairs that meet are verified exactly by their
differing bits.  Within a cell only a spanning forest of the links is kept
(linked fingerprints that are connected already are not compared again), so a
large group of near copies does not turn into all of its pairs.

Equal texts have equal fingerprints and are one grid point.  Defined results:
null and blank texts have fingerprint zero and are linked like any other; a
null doc_id never names a component unless all its ids are null; repeated
rows stay; empty input gives no rows.
"""

from __future__ import annotations

from itertools import repeat
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ..session import ship_package
from ._common import shuffle_partitions
from ._graph import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SMALL_CELL = 8
_STEP = 1 << 16  # shingles whose bits are counted at once

_EVEN_BITS = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the hashes of all word shingles, as an unsigned number."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII blanks, A-Z only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()[min(words, len(tokens)) - 1:]
    spans = (joined[s:e] for s, e in zip(starts, ends))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(SEED)), np.uint64, len(ends))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        part = hashes[i:i + _STEP].astype(">u8").view(np.uint8)
        counts += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, text: str = "text") -> Column:
    """Column of fingerprints as signed 64-bit numbers (the same bits)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return of(F.col(text))


def _cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint) for all grid cells that fingerprints are sent to."""
    packed = fp - ((fp >> np.uint64(1)) & _EVEN_BITS)  # bit counts of the two-bit segments
    cells, owners = [], []
    for half, shift in ((0, 32), (1, 0)):
        code = (packed >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
        index = np.arange(len(fp))
        cells.append(code | np.uint64(half << 32))
        owners.append(index)
        if half:  # neighbours differ in parity, so it is enough that odd vectors reach out
            total = sum((code >> np.uint64(2 * k)) & np.uint64(3) for k in range(16))
            index = index[(total & np.uint64(1)) == 1]
        for k in range(16):
            value = (code[index] >> np.uint64(2 * k)) & np.uint64(3)
            one = np.uint64(1 << (2 * k))
            for able, moved in ((value < 2, code[index] + one), (value > 0, code[index] - one)):
                cells.append(moved[able] | np.uint64(half << 32))
                owners.append(index[able])
    return np.concatenate(cells), np.concatenate(owners)


def send_to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp = pdf["fp"].to_numpy(np.int64)
        for i in range(0, len(fp), 2000):
            part = fp[i:i + 2000]
            cells, owners = _cells(part.view(np.uint64))
            yield pd.DataFrame({"cell": cells.view(np.int64), "fp": part[owners]})


def forest(fp: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links among one cell's fingerprints.

    Pairs that are connected already are not compared: each fingerprint of
    the smaller components is compared with those of other components.
    """
    label = np.arange(len(fp))
    for i in np.arange(len(fp)):
        others = np.flatnonzero(label != label[i])
        if not len(others):
            return
        # The largest component need not look out: the others look at it.
        if i and (label == label[i]).sum() > len(others):
            continue
        near = others[np.bitwise_count(fp[others] ^ fp[i]) <= max_bits]
        for j in near:
            if label[j] != label[i]:
                yield int(i), int(j)
                label[label == label[j]] = label[i]


def link_cells(max_bits: int):
    """Over rows sorted by cell: links between fingerprints that meet in a cell."""

    def links(cell: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[begin, len(cell)])
        bits = fp.view(np.uint64)
        a, b = [], []
        of = np.repeat(size, size)
        for d in range(1, SMALL_CELL):
            i = np.flatnonzero((cell[d:] == cell[:-d]) & (of[:-d] <= SMALL_CELL))
            i = i[np.bitwise_count(bits[i] ^ bits[i + d]) <= max_bits]
            a.append(fp[i])
            b.append(fp[i + d])
        for s, n in zip(begin[size > SMALL_CELL], size[size > SMALL_CELL]):
            group = fp[s:s + n]
            pairs = np.array(list(forest(bits[s:s + n], max_bits)), np.int64).reshape(-1, 2)
            a.append(group[pairs[:, 0]])
            b.append(group[pairs[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        return pairs.drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_cell, kept_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for pdf in batches:
            cell = np.concatenate([kept_cell, pdf["cell"].to_numpy(np.int64)])
            fp = np.concatenate([kept_fp, pdf["fp"].to_numpy(np.int64)])
            if not len(cell):
                continue
            last = np.searchsorted(cell, cell[-1])  # the last cell may go on in the next batch
            if last:
                yield links(cell[:last], fp[:last])
            kept_cell, kept_fp = cell[last:], fp[last:]
        if len(kept_cell):
            yield links(kept_cell, kept_fp)

    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp) within ``max_bits`` of each other."""
    if max_bits > 4:
        raise ValueError("the grid cells are laid out for at most 4 differing bits")
    parts = shuffle_partitions(distinct.sparkSession)
    cells = distinct.select("fp").mapInPandas(send_to_cells, "cell long, fp long")
    cells = cells.repartition(parts, "cell").sortWithinPartitions("cell", "fp")
    return cells.mapInPandas(link_cells(max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text: str = "text", row: Column | None = None) -> DataFrame:
    """(doc_id, fp, root, component_id): each row's fingerprint, the smallest fingerprint and the
    smallest id reachable over links; and column ``row``, if it is given."""
    also = [] if row is None else [row.alias("row")]
    ship_package(docs.sparkSession)
    marked = cut(docs.select(F.col(id_col).alias("doc_id"),
                             fingerprints(docs, words, text).alias("fp"), *also))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(cut(fingerprint_links(distinct, max_bits)))
    named = distinct.join(linked, F.col("fp") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "root", "component_id", *[F.col("row") for _ in also])


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the smallest id stays.

    Of the component's rows with that id one stays (by the hash of the row); an
    id that stands on texts of several components names a row in each.  A
    component whose ids are all null keeps one row.
    """
    columns = docs.columns
    record = F.struct(*[F.col(f"`{c}`") for c in columns])
    found = near_duplicates(docs, words, max_bits, row=F.xxhash64(record))
    keep = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id")
            .agg(F.min("row").alias("keep_row")).select(F.col("component_id").alias("keep_id"), "keep_row"))
    packed = docs.select("doc_id", F.xxhash64(record).alias("row"), record.alias("record"))
    # Rows equal in every column share the hash; the first of them stays.
    first = Window.partitionBy("doc_id", "row").orderBy(F.lit(1))
    return (packed.join(keep, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row")))
            .withColumn("nth", F.row_number().over(first)).where(F.col("nth") == 1).select("record.*"))
