"""Approximate nearest neighbours: one small-world graph per shard.

Distinct vectors are dealt into shards; each shard's task builds a
hierarchical navigable small-world graph and stores it as flat arrays (node
levels, neighbour slots per layer, vectors, ids) in one row of an index
table.  A block of queries searches every shard, cosines of what it finds are
computed again from the original vectors in double precision, and the shard
results are merged.  Both the graph's construction and the search advance a
block of points at a time, so the inner loops are array operations.

Equal vectors are one node that carries the ids of its ``k + 1`` smallest
members, which is all that a search for k neighbours can return of them; a
vector held by a third of all rows is one node.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, take no part, nor do rows without id; vectors are
compared with those of the same dimension; equal rows count once; ties go to
the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ..session import ship_package

SHARD_ROWS = 8192      # distinct vectors in a shard, about
QUERY_BLOCK = 4096
M = 16                 # neighbour slots on upper layers; twice as many on the lowest
EF_BUILD, EF_SEARCH = 64, 128
STEP = 4               # candidates expanded at once
BATCH = 256
INDEX_SCHEMA = ("dim int, shard int, n int, layers int, vectors binary, levels binary, "
                "neighbours binary, members binary, member_ends binary")


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the k largest per row, largest first."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        part = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


class Graph:
    """Layers of neighbour slots over unit vectors; layer 0 holds all nodes."""

    def __init__(self, unit: np.ndarray, levels: np.ndarray, neighbours: list[np.ndarray]):
        self.unit, self.levels, self.neighbours = unit, levels, neighbours

    @staticmethod
    def build(unit: np.ndarray, seed: int = 1) -> "Graph":
        n = len(unit)
        draw = np.random.default_rng(seed).random(n)
        levels = np.minimum((-np.log(1.0 - draw) / math.log(M)).astype(np.int32), 6)
        top = int(levels.max()) if n else 0
        slots = [np.full((n, 2 * M if layer == 0 else M), -1, np.int32) for layer in range(top + 1)]
        g = Graph(unit, levels, slots)
        order = np.argsort(-levels, kind="stable")  # high nodes first: they are everyone's entry
        done, size = 1, 1
        while done < n:
            batch = order[done:done + min(size, BATCH)]
            g._insert(batch, order[:1])
            done += len(batch)
            size *= 2
        return g

    def _insert(self, batch: np.ndarray, entry: np.ndarray) -> None:
        q = self.unit[batch]
        found = np.repeat(entry[None, :], len(batch), 0)
        among = q @ q.T
        np.fill_diagonal(among, -2.0)
        for layer in range(len(self.neighbours) - 1, -1, -1):
            here = np.flatnonzero(self.levels[batch] >= layer)
            ef = EF_BUILD if len(here) else 1
            ids, sims = self._search(q, found, ef, layer)
            found = ids[:, :1] if not len(here) else ids[:, :min(8, ids.shape[1])]
            if not len(here):
                continue
            # Points of the same batch are candidates, too.
            mates = np.where(self.levels[batch][None, :] >= layer, among[here], -2.0)
            pick = _top(mates, min(16, len(batch)))
            mate_sims = np.take_along_axis(mates, pick, 1)
            mate_ids = np.where(mate_sims > -2.0, batch[pick], -1)
            self._connect(batch[here], np.concatenate([ids[here], mate_ids], 1),
                          np.concatenate([sims[here], mate_sims], 1), layer)

    def _connect(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        slots = self.neighbours[layer]
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = (ids >= 0) & (sims > -2.0)
        near = self.unit[np.maximum(ids, 0)]
        between = near @ near.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        # A candidate is linked unless one that is linked already lies nearer to it than the node does.
        for c in range(ids.shape[1]):
            shadow = ((between[:, c, :] > sims[:, c, None]) & chosen).any(1)
            chosen[:, c] = valid[:, c] & ~shadow & (chosen.sum(1) < M)
        # Free slots are filled with the nearest of the others.
        fill = valid & ~chosen & (np.cumsum(valid & ~chosen, 1) <= (M - chosen.sum(1))[:, None])
        chosen |= fill
        back: dict[int, list[int]] = {}
        for node, row, keep in zip(nodes.tolist(), ids, chosen):
            links = list(dict.fromkeys(row[keep].tolist()))
            have = slots[node][slots[node] >= 0].tolist()
            links = list(dict.fromkeys(links + have))[:slots.shape[1]]
            slots[node] = -1
            slots[node, :len(links)] = links
            for v in links:
                back.setdefault(v, []).append(node)
        for v, new in back.items():
            have = slots[v][slots[v] >= 0]
            every = np.unique(np.concatenate([have, np.array(new, np.int32)]))
            if len(every) > slots.shape[1]:
                every = self._diverse(v, every, slots.shape[1])
            slots[v] = -1
            slots[v, :len(every)] = every

    def _diverse(self, node: int, ids: np.ndarray, most: int) -> np.ndarray:
        sims = self.unit[ids] @ self.unit[node]
        ids = ids[np.argsort(-sims, kind="stable")]
        near, sims = self.unit[ids], np.sort(sims)[::-1]
        between = near @ near.T
        chosen: list[int] = []
        for c in range(len(ids)):
            if not chosen or (between[c, chosen] <= sims[c]).all():
                chosen.append(c)
        rest = [c for c in range(len(ids)) if c not in set(chosen)]
        return ids[(chosen + rest)[:most]]

    def _search(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), nearest first, of up to ``ef`` nodes per row of ``q``; -1 where fewer."""
        slots, rows = self.neighbours[layer], np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.unit)), bool)
        ids = np.sort(entry, axis=1)
        fresh = np.c_[np.ones((len(q), 1), bool), ids[:, 1:] != ids[:, :-1]] & (ids >= 0)
        seen[rows, np.maximum(ids, 0)] |= fresh
        sims = np.where(fresh, np.einsum("bkd,bd->bk", self.unit[np.maximum(ids, 0)], q), -3.0)
        ids = np.where(fresh, ids, -1)
        open_ = fresh.copy()
        step = min(STEP, ef)
        while True:
            waiting = np.where(open_, sims, -4.0)
            live = np.flatnonzero((waiting > -4.0).any(1))
            if not len(live):
                return ids, sims
            pick = _top(waiting[live], min(step, waiting.shape[1]))
            usable = np.take_along_axis(waiting[live], pick, 1) > -4.0
            at = live[:, None]
            open_[at, pick] = False
            source = np.where(usable, ids[at, pick], 0)
            new = np.where(usable[:, :, None], slots[source], -1).reshape(len(live), -1)
            new.sort(axis=1)
            ok = np.c_[np.ones((len(live), 1), bool), new[:, 1:] != new[:, :-1]] & (new >= 0)
            ok &= ~seen[at, np.maximum(new, 0)]
            # Columns without any new node are dropped before vectors are read.
            width = int(ok.sum(1).max())
            if not width:
                continue
            front = np.argsort(~ok, axis=1, kind="stable")[:, :width]
            new, ok = np.take_along_axis(new, front, 1), np.take_along_axis(ok, front, 1)
            r, c = np.nonzero(ok)
            seen[live[r], new[r, c]] = True
            new_sims = np.full(new.shape, -3.0, np.float32)
            new_sims[r, c] = np.einsum("nd,nd->n", self.unit[new[r, c]], q[live[r]])
            if width < 1 or (ids.shape[1] + width <= ef and len(live) == len(q)):
                ids, sims = np.c_[ids, np.where(ok, new, -1)], np.c_[sims, new_sims]
                open_ = np.c_[open_, ok]
                continue
            if ids.shape[1] < ef:  # room for the full beam
                pad = ef - ids.shape[1]
                ids = np.c_[ids, np.full((len(q), pad), -1, ids.dtype)]
                sims = np.c_[sims, np.full((len(q), pad), -3.0, sims.dtype)]
                open_ = np.c_[open_, np.zeros((len(q), pad), bool)]
            all_ids = np.c_[ids[live], np.where(ok, new, -1)]
            all_sims, all_open = np.c_[sims[live], new_sims], np.c_[open_[live], ok]
            best = _top(all_sims, ids.shape[1])
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1)

    def search(self, q: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Ids of up to k near nodes per query, nearest first; -1 where fewer."""
        ef = max(ef, k)
        found = np.full((len(q), 1), int(np.argmax(self.levels)), np.int64)
        for layer in range(len(self.neighbours) - 1, 0, -1):
            found = self._search(q, found, 4, layer)[0]
        ids, sims = self._search(q, found, ef, 0)
        return np.take_along_axis(ids, _top(sims, min(k, ids.shape[1])), 1)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest components to 0.5..1: cosines keep every bit,
    and no square runs over or under."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors of scaled ones."""
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them numbers, and not all zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows that take part, components in double precision."""
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("v")))
            # 0.0 and -0.0 are the same component.
            .withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))))


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(written index table, number of shards per dimension) over ``rows`` (vec_id, v)."""
    members = Window.partitionBy("v").orderBy("vec_id")
    nodes = (rows.distinct().withColumn("nth", F.row_number().over(members)).where(F.col("nth") <= k + 1)
             .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    nodes = cut(nodes.withColumn("dim", F.size("v")))
    shards = max(1, -(-nodes.count() // shard_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([ids[0] for ids in pdf["ids"]], kind="stable")]
        vectors = _scaled(np.stack(pdf["v"].to_list()).astype(np.float64))
        g = Graph.build(_unit(vectors))
        ends = np.cumsum([len(ids) for ids in pdf["ids"]])
        return pd.DataFrame([{
            "dim": vectors.shape[1], "shard": int(pdf["shard"].iloc[0]), "n": len(pdf), "layers": len(g.neighbours),
            "vectors": vectors.tobytes(), "levels": g.levels.tobytes(),
            "neighbours": b"".join(x.tobytes() for x in g.neighbours),
            "members": np.concatenate(pdf["ids"].to_list()).astype(np.int64).tobytes(),
            "member_ends": ends.astype(np.int64).tobytes()}])

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("dim", "shard").applyInPandas(build, INDEX_SCHEMA)), shards


def _load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])
    flat, layers, at = np.frombuffer(row["neighbours"], np.int32), [], 0
    for layer in range(row["layers"]):
        width = 2 * M if layer == 0 else M
        layers.append(flat[at:at + row["n"] * width].reshape(row["n"], width))
        at += row["n"] * width
    graph = Graph(_unit(vectors), np.frombuffer(row["levels"], np.int32), layers)
    return graph, vectors, np.frombuffer(row["members"], np.int64), np.frombuffer(row["member_ends"], np.int64)


def search(queries: DataFrame, index: DataFrame, shards: int, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest others per query (vec_id, v), over all shards."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if len(left) and len(right):
            graph, vectors, members, ends = _load(left.iloc[0])
            starts, norms = np.r_[0, ends[:-1]], np.linalg.norm(vectors, axis=1)
            ids, q = right["vec_id"].to_numpy(np.int64), _scaled(np.stack(right["v"].to_list()).astype(np.float64))
            for lo in range(0, len(q), BATCH):
                part, own = q[lo:lo + BATCH], ids[lo:lo + BATCH]
                found = graph.search(_unit(part), k + 1, ef)
                r, c = np.nonzero(found >= 0)
                node = found[r, c]
                cosine = np.einsum("nd,nd->n", vectors[node], part[r]) / (norms[node] * np.linalg.norm(part, axis=1)[r])
                count = ends[node] - starts[node]
                place = np.repeat(starts[node], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                vec, query = members[place], np.repeat(own[r], count)
                score = np.repeat(cosine, count)
                # Only the shard's k best per query leave the task.
                order = np.lexsort((vec, -score, query))
                order = order[vec[order] != query[order]]
                _, first, per = np.unique(query[order], return_index=True, return_counts=True)
                best = order[np.arange(len(order)) - np.repeat(first, per) < k]
                out = [np.r_[out[0], query[best]], np.r_[out[1], vec[best]], np.r_[out[2], score[best]]]
        return pd.DataFrame({"query_id": out[0], "vec_id": out[1], "score": out[2]})

    dealt = (queries.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)),
                                  "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))}))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["dim", "shard", "block"]
    hits = spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(
        find, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS,
            ef: int = EF_SEARCH, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest other rows of every row for which ``is_query`` (over vec_id) holds."""
    ship_package(vectors.sparkSession)
    rows = cut(clean_vectors(vectors, id_col, vector))
    index, shards = build_index(rows, k, shard_rows)
    return search(rows.where(is_query).distinct(), index, shards, k, ef)
