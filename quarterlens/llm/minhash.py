"""Near duplicates by MinHash: many minima, banding, verification, components by star contraction.

A document is its set of distinct word shingles.  Documents with equal sets are
one node (the row of smallest number stands for them), so exact copies, however
many, cost nothing further.  Each node gets ``HASHES`` minima of universal hashes
(a*x + b mod 2^64, upper half; x: 32 bits of the shingle's XXH64), and ``BANDS``
bands of them.  At a similarity of 0.8 two sets share no band with a chance of
(1 - 0.8^4)^32, under 1e-7.

Nodes that share a band are candidates, without making all pairs of a band:

1. in every band the node with the smallest number is paired with all others;
2. pairs whose signatures agree too little are dropped (the cut lies seven
   standard deviations below the threshold), all others are decided exactly on
   the shingle sets of the whole texts;
3. links become components by alternating large-star and small-star;
4. a band whose nodes are in one component now is done.  In the others, nodes
   outside the band's largest component are compared with the band's nodes of
   other components, in cells of at most ``CELL`` by ``CELL`` nodes, so no band
   meets in one task; what passes the signatures is decided exactly, too.

Near copies of one text lie around it at all distances, so many of the last pairs
are close to the threshold.  Step 2 has told by which shingles each node differs from
the first node of its band; two nodes of a band differ by what only one of these two
lists holds, so such pairs are decided exactly from the short lists, without the texts.

Defined results: null, empty and wordless texts have an empty set and are linked
with nothing; with fewer words than a shingle the whole sequence is the one shingle;
a null doc_id names a component only if all its ids are null; rows of one id with
different texts are different documents; repeated rows stay; empty input gives no rows.
"""

from __future__ import annotations

import math
from itertools import repeat
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ..session import ship_package
from ._stars import star_components

SHINGLE_WORDS = 4
PERCENT = 80
HASHES = 128
BANDS = 32
CELL = 1000
SEED = 11
_STEP = 1 << 9  # shingles hashed at once


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII blanks, A-Z only
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    spans = map(joined.__getitem__, map(slice, (ends - lengths).tolist(), ends[min(words, len(tokens)) - 1:].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(SEED)), np.uint64)
    return np.unique(hashes)


class Signatures:
    """Minima of ``hashes`` universal hashes over a set."""

    def __init__(self, hashes: int = HASHES, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 1 << 63, (hashes, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, (hashes, 1), np.uint64) * np.uint64(2)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = shingles >> np.uint64(32)
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), _STEP):
            least = np.minimum(least, (self.a * x[None, i:i + _STEP] + self.b).min(1))
        return (least >> np.uint64(32)).astype(np.uint32)


def similar(size: int, changes: int, percent: int) -> bool:
    """100 * intersection >= percent * union, for sets of together ``size`` elements, ``changes`` of them in one only."""
    return (100 - percent) * size >= (100 + percent) * changes


def least_agreement(percent: int, hashes: int) -> int:
    """Agreeing minima that a linked pair has, but for a chance of about 1e-11."""
    p = percent / 100
    return max(0, math.floor(hashes * p - 7 * math.sqrt(hashes * p * (1 - p))))


def signed(docs: DataFrame, words: int = SHINGLE_WORDS, hashes: int = HASHES, bands: int = BANDS,
           id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_shingles, h1, h2, minima, bands): ``h1`` and ``h2`` identify the set."""
    ship_package(docs.sparkSession)
    per_band = hashes // bands
    names = ["doc_id", "text", "n_shingles", "h1", "h2", "minima", "bands"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature = Signatures(hashes)
        for batch in batches:
            sizes, sets, minima, keys = [], [], [], []
            for t in batch.column(1).to_pylist():
                shingles = shingle_hashes(t, words)
                sizes.append(len(shingles))
                sets.append(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8"))
                own = signature(shingles)
                minima.append(own.view(np.int32) if len(shingles) else None)
                keys.append([xxhash.xxh64_intdigest(own[i * per_band:(i + 1) * per_band].tobytes(), i) - (1 << 63)
                             for i in range(bands)] if len(shingles) else None)
            h = np.array(sets, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]),
                 pa.array(minima, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, text string, n_shingles long, h1 long, h2 long, minima array<int>, "
                                 "bands array<long>")


def _tagged(minima: Column) -> Column:
    """Minima with their places, so that common elements are agreeing places."""
    return F.transform(minima, lambda m, i: F.shiftleft(i.cast("long"), 32) + m)


def compared(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int, hashes: int) -> DataFrame:
    """(a, b, linked, changes) of pairs (a, b) whose signatures agree enough, from their whole shingle sets.

    ``changes``: the shingles that only one of both has.
    """
    side = lambda df, k, *cols: df.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in cols])
    near = cut(pairs.join(side(nodes, "a", "minima"), "a").join(side(nodes, "b", "minima"), "b")
               .where(F.size(F.array_intersect(_tagged(F.col("minima_a")), _tagged(F.col("minima_b"))))
                      >= least_agreement(percent, hashes)).select("a", "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            linked, changes = [], []
            for a, text_a, text_b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if a != last:
                    last, own = a, shingle_hashes(text_a, words)
                other = shingle_hashes(text_b, words)
                apart = np.setxor1d(own, other, assume_unique=True)
                linked.append(similar(len(own) + len(other), len(apart), percent))
                changes.append(apart.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()),
                                              pa.array(changes, pa.list_(pa.int64()))], ["a", "b", "linked", "changes"])

    both = near.join(side(texts, "b", "text"), "b").join(side(texts, "a", "text"), "a")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(
        check, "a long, b long, linked boolean, changes array<long>"))


def _unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Bands of several components: (band, a, node, root), ``most``: the root of most nodes, of which there are ``n`` of ``size``."""
    rooted = shared.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = (held.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("size"),
                                      F.count(F.lit(1)).alias("roots"), F.max("n").alias("n"))
             .where(F.col("roots") > 1))
    return rooted.join(mixed.select("band", "most", "size", "n"), "band").where(F.col("node") != F.col("a"))


def _cell_pairs(unsettled: DataFrame, stars: DataFrame, nodes: DataFrame, percent: int, hashes: int,
                cell: int) -> DataFrame:
    """(a, b, sure): pairs of one band in different components that are similar or, if not sure, may be.

    Rows ``u`` are outside the band's largest component; rows ``v`` are all.  Both
    are dealt to the cells of a grid by their hash, a cell holding about ``cell`` of each.
    """
    changes = stars.select("a", F.col("b").alias("node"), "changes")
    about = cut(unsettled.join(changes, ["a", "node"], "left").join(
        nodes.select("node", "n_shingles", _tagged(F.col("minima")).alias("tagged")), "node"))
    place = lambda n: F.pmod(F.xxhash64("node"), n)
    across = F.ceil(F.col("size") / F.lit(cell)).cast("long")
    down = F.ceil((F.col("size") - F.col("n")) / F.lit(cell)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "most", "n_shingles", "changes", "tagged")]
    u = about.where(F.col("root") != F.col("most")).select("band", place(down).alias("row"), each(across).alias("column"),
                                                           *side("u"))
    v = about.select("band", each(down).alias("row"), place(across).alias("column"), *side("v"))
    known = F.col("changes_u").isNotNull() & F.col("changes_v").isNotNull()
    room = (F.col("n_shingles_u") + F.col("n_shingles_v")) * (100 - percent)
    n_u, n_v = F.size("changes_u"), F.size("changes_v")
    exact = ((F.abs(n_u - n_v) * (100 + percent) <= room) & (
        (n_u + n_v - 2 * F.size(F.array_intersect("changes_u", "changes_v"))) * (100 + percent) <= room))
    agree = F.size(F.array_intersect("tagged_u", "tagged_v")) >= least_agreement(percent, hashes)
    met = u.join(v, ["band", "row", "column"]).where(
        # Of two nodes outside the largest component one order is enough.
        (F.col("root_u") != F.col("root_v")) & ((F.col("root_v") == F.col("most_v")) | (F.col("node_u") < F.col("node_v")))
        & F.when(known, exact).otherwise(agree))
    pairs = met.select(F.least("node_u", "node_v").alias("a"), F.greatest("node_u", "node_v").alias("b"), known.alias("sure"))
    return cut(pairs.groupBy("a", "b").agg(F.bool_or("sure").alias("sure")))


def links(nodes: DataFrame, rows: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, hashes: int = HASHES,
          cell: int = CELL) -> DataFrame:
    """Verified links (a, b) between nodes that hold the components of all links; ``rows`` has the nodes' texts."""
    bands = cut(nodes.select("node", F.explode("bands").alias("band")))
    first = bands.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = cut(bands.join(first.select("band", "a"), "band"))  # bands of one node are done
    met = cut(shared.select("node").distinct())
    nodes = cut(nodes.drop("bands").join(met, "node", "left_semi"))
    texts = cut(rows.select("node", "text").join(met, "node", "left_semi"))
    pairs = shared.where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    stars = compared(pairs, nodes, texts, words, percent, hashes)
    linked = stars.where("linked").select("a", "b")
    rest = _cell_pairs(_unsettled(shared, star_components(linked)), stars, nodes, percent, hashes, cell)
    open_ = compared(rest.where(~F.col("sure")).select("a", "b"), nodes, texts, words, percent, hashes)
    return linked.union(rest.where("sure").select("a", "b")).union(open_.where("linked").select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, hashes: int = HASHES,
                    bands: int = BANDS, cell: int = CELL, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = cut(signed(docs, words, hashes, bands, id_col, text).withColumn("node", F.monotonically_increasing_id()))
    sets = cut(rows.where(F.col("n_shingles") > 0).groupBy("h1", "h2").agg(
        F.min("node").alias("node"), F.min("doc_id").alias("least")))
    nodes = cut(rows.select("node", "n_shingles", "minima", "bands").join(sets.select("node"), "node", "left_semi"))
    roots = star_components(links(nodes, rows, words, percent, hashes, cell))
    named = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", "component_id")
    filled = rows.where(F.col("n_shingles") > 0).join(named, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id")
    empty = rows.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
