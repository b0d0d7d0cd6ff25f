"""Alignment of two tokenizers over the same bytes, and corpus counts of linked tokens.

Both tokenizers cover a blank plus the text.  The offsets at which tokens of
both end cut the tokens into groups; tokens link where their bytes overlap.
The ends are intersected by galloping: the shorter list of a text drives an
exponential and then a binary search into the longer one (all needles of a step
at once; every 16th gallops from the start of its text, the others from the one
before).  Found ends slice the groups, and the differences of neighbouring
ranks are the ranges of tokens that a token overlaps.

An id pair's count is the number of documents that hold it linked.  Tasks work
in blocks of about ``BLOCK`` bytes of text: a block writes its distinct pairs once,
with the number of its documents that hold each, and per document only places in
that list.  Counts are sums over blocks; they go back to the blocks by a
join on the pair, and to the documents inside their block.  So rows that move are
pairs per block, not links, and no table of pairs is broadcast.

Texts are cut into words only where neither tokenizer can join (checked against
the vocabularies), so a worker remembers the ids of words; texts beyond ``STEP``
bytes are worked through in steps, cut at such places.

Defined results: texts that are null, empty, or that a tokenizer doesn't give
back byte by byte have no tokens (zeros and an empty digest); a null doc_id is
kept and repeated rows count as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from itertools import chain, islice
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ..session import ship_package
from .packing import byte_letters

STEP = 1 << 18
BLOCK = 1 << 22
STRIDE = 16
MEMO_WORDS = 600_000
MEMO_CHARACTERS = 1 << 24
# The characters that are white space to the byte-level tokenizer.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{_BLANK}]) (?=[^{_BLANK}])")


# Fixed value: the published pattern by which the byte-level tokenizer cuts texts before merging.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level BPE (file of the ``tokenizers`` library)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = {letter: b for b, letter in byte_letters().items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.token_bytes = [b"" if n in special else bytes(byte_of[c] for c in n) for n in names]
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        """The same merges by rank, which is quicker, if ids follow the order of the merges."""
        import tiktoken
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {b: i for i, b in enumerate(self.token_bytes) if b}
        return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> list[list[int]]:
        if self.ranked:
            return list(map(self.ranked.encode_ordinary, words))
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


class Pieces:
    """A SentencePiece BPE with byte fallback, which puts a blank in front."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i).replace("▁", " ") for i in range(self.model.vocab_size())]
        if any(re.search("[^ ] |\n", p) for p in pieces):
            raise ValueError("pieces of this model reach over a blank or a line feed, so texts can't be cut there")
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else
                            b"" if self.model.is_control(i) or self.model.is_unknown(i) else
                            p.encode("utf-8") for i, p in enumerate(pieces)]

    def encode(self, words: list[str]) -> list[list[int]]:
        # Behind a line feed, which is always two tokens of its own here, nothing is put in front.
        return [ids[2:] for ids in self.model.encode(["\n" + w for w in words], num_threads=1)]


class Words:
    """Ids of words (blanks and what follows them) in both vocabularies; words met before are looked up."""

    # A word ends where a blank or a line feed follows; other white space may be joined to what stands before it.
    cut = re.compile(f"\n(?=[^{_BLANK}])|[{_BLANK}]*[^{_BLANK}]+(?:(?![ \n])[{_BLANK}]+[^{_BLANK}]*)*|[{_BLANK}]+")

    def __init__(self, path_a: str, path_b: str):
        self.sides = ByteLevel(path_a), Pieces(path_b)
        self.lengths = tuple(np.array([len(b) for b in s.token_bytes], np.int64) for s in self.sides)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = defaultdict(lambda: len(self.numbers))
        self.characters = 0
        self.lossy = np.empty(0, bool)
        self.ids = [np.empty(0, np.int64)] * 2
        self.counts = [np.empty(0, np.int64)] * 2

    def _learn(self, words: list[str]) -> None:
        lossy = np.zeros(len(words), bool)
        for k, side in enumerate(self.sides):
            coded = side.encode(words)
            lossy |= np.array([b"".join(map(side.token_bytes.__getitem__, ids)) != w.encode("utf-8")
                               for ids, w in zip(coded, words)], bool)
            self.ids[k] = np.append(self.ids[k], np.fromiter(chain.from_iterable(coded), np.int64))
            self.counts[k] = np.append(self.counts[k], np.fromiter(map(len, coded), np.int64, len(words)))
        self.lossy = np.append(self.lossy, lossy)
        self.characters += sum(map(len, words))

    def encode(self, parts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(parts that a tokenizer doesn't give back; ids of all parts; ids per part), the last two by side."""
        if len(self.numbers) > MEMO_WORDS or self.characters > MEMO_CHARACTERS:
            self.forget()
        words = list(map(self.cut.findall, parts))
        known, total = len(self.numbers), sum(map(len, words))
        number = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, total)
        self._learn(list(islice(self.numbers, known, None)))
        bounds = np.append(0, np.cumsum([len(w) for w in words], dtype=np.int64))
        ids, counts = [], []
        for k in range(2):
            many = self.counts[k][number]
            shift = (np.cumsum(self.counts[k]) - self.counts[k])[number] - (np.cumsum(many) - many)
            ids.append(self.ids[k][np.repeat(shift, many) + np.arange(many.sum())])
            counts.append(np.diff(np.append(0, np.cumsum(many))[bounds]))
        return np.diff(np.append(0, np.cumsum(self.lossy[number]))[bounds]) > 0, ids, counts


_CODERS: dict[tuple[str, str], Words] = {}


def coder(path_a: str, path_b: str) -> Words:
    """One per Python worker, so that words remembered outlast a task."""
    if (path_a, path_b) not in _CODERS:
        _CODERS[path_a, path_b] = Words(path_a, path_b)
    return _CODERS[path_a, path_b]


def gallop(needles: np.ndarray, hay: np.ndarray, low: np.ndarray) -> np.ndarray:
    """First place from ``low`` on where ``hay`` isn't below the needle; the last of ``hay`` is below none."""
    low, high, last = low.copy(), np.empty_like(low), len(hay) - 1
    active, probe, step = np.arange(len(needles)), low.copy(), 1
    while len(active):
        at = np.minimum(probe[active], last)
        below = hay[at] < needles[active]
        high[active[~below]] = at[~below]
        active = active[below]
        low[active] = at[below] + 1
        probe[active] = low[active] + step
        step *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        below = hay[middle] < needles[active]
        low[active[below]] = middle[below] + 1
        high[active[~below]] = middle[~below]
        active = active[low[active] < high[active]]
    return low


def ranks(needles: np.ndarray, hay: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rank of every needle in ``hay``; ``begin``: where in ``hay`` the needle's text begins."""
    leaders = gallop(needles[::STRIDE], hay, begin[::STRIDE])
    return gallop(needles, hay, np.repeat(leaders, STRIDE)[:len(needles)])


class Step:
    """Alignment of several texts at once, from their ids (one array per side, texts one after the other)."""

    def __init__(self, ids: Sequence[np.ndarray], counts: Sequence[np.ndarray],
                 lengths: Sequence[np.ndarray]):
        self.ids, self.counts = ids, counts
        # Both sides of a text have the same bytes, so running totals are offsets common to both.
        ends = [np.cumsum(n[i]) for n, i in zip(lengths, ids)]
        text = [np.repeat(np.arange(len(c)), c) for c in counts]
        shorter = counts[0] <= counts[1]
        stops, links = [[], []], [[], [], []]
        for drive, mask in ((0, shorter), (1, ~shorter)):
            follow = 1 - drive
            own = [np.flatnonzero(mask[t]) for t in text]
            if not len(own[drive]):
                continue
            needles, hay = ends[drive][own[drive]], ends[follow][own[follow]]
            size = np.where(mask, counts[follow], 0)
            of = text[drive][own[drive]]
            rank = ranks(needles, hay, (np.cumsum(size) - size)[of])
            common = hay[rank] == needles
            stops[drive].append(own[drive][common])
            stops[follow].append(own[follow][rank[common]])
            first = np.append(0, rank[:-1] + common[:-1])
            many = rank - first + 1
            begin = np.cumsum(many) - many
            other = np.arange(many.sum()) + np.repeat(first - begin, many)
            links[drive].append(np.repeat(own[drive], many))
            links[follow].append(own[follow][other])
            links[2].append(np.repeat(of, many))
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        #: Last token of every group, on both sides; linked tokens, on both sides, and their text.
        self.stops = [np.sort(join(s)) for s in stops]
        self.links = [join(x) for x in links]
        self.text = text

    def groups_per_text(self) -> np.ndarray:
        return np.bincount(self.text[0][self.stops[0]], minlength=len(self.counts[0]))

    def links_per_text(self) -> np.ndarray:
        return np.bincount(self.links[2], minlength=len(self.counts[0]))

    def written(self, digits: np.ndarray) -> list[bytes]:
        """Per text its groups as ``a,a|b;a|b;`` with decimal ids."""
        (a, b), (last_a, last_b) = self.ids, self.stops
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(last_b - size_b + 1, size_a)
        place_b = np.arange(len(b)) + np.repeat(last_a + 1, size_b)
        shown = np.empty((len(a) + len(b), digits.shape[1]), np.uint8)
        shown[place_a], shown[place_b] = digits[a], digits[b]
        shown[place_a[last_a], -1] = ord("|")
        shown[place_b[last_b], -1] = ord(";")
        used = shown != 0
        stop = np.append(0, np.cumsum(used.sum(1)))[np.append(0, np.cumsum(self.counts[0] + self.counts[1]))]
        data = shown[used].tobytes()
        return [data[i:j] for i, j in zip(stop, stop[1:])]


def decimal_table(size: int) -> np.ndarray:
    """Row n: the digits of n and a comma, right-aligned behind zero bytes."""
    wide = len(str(size - 1))
    rows = b"".join(str(n).encode().rjust(wide, b"\0") + b"," for n in range(size))
    return np.frombuffer(rows, np.uint8).reshape(size, wide + 1)


def segments(text: str, step: int = STEP) -> Iterator[str]:
    """A blank and the text, in parts of about ``step`` characters that no token crosses."""
    text, at = " " + text, 0
    while len(text) - at > step:
        found = _CUT.search(text, at + step)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:] if at else text


class Block:
    """What a run of documents holds: digests by document, and links by place in the list of distinct pairs."""

    def __init__(self, path_a: str, path_b: str):
        self.words = coder(path_a, path_b)
        self.sizes = tuple(map(len, self.words.lengths))
        self.digits = decimal_table(max(self.sizes))
        self.pair_bits = (self.sizes[0] * self.sizes[1]).bit_length()

    def align(self, texts: Sequence[str | None], step: int = STEP) -> Iterator[tuple[np.ndarray, Step]]:
        """Steps over all texts, each with the document of its parts; documents are coded together up to ``step``."""
        owners, parts, size = [], [], 0
        for doc, text in enumerate([*texts, None]):
            if text and "▁" not in text:  # that sign reads as a blank in pieces, so bytes would differ
                own = list(segments(text, step))
                parts += own
                owners += [doc] * len(own)
                size += len(text)
            if parts and (size >= step or doc == len(texts)):
                yield from self._steps(np.array(owners), parts, step)
                owners, parts, size = [], [], 0

    def _steps(self, owner: np.ndarray, parts: list[str], step: int) -> Iterator[tuple[np.ndarray, Step]]:
        lossy, ids, counts = self.words.encode(parts)
        lossy = np.isin(owner, owner[lossy])  # one such part takes the whole document out
        ids = [i[np.repeat(~lossy, c)] for i, c in zip(ids, counts)]
        owner, counts = owner[~lossy], [c[~lossy] for c in counts]
        ends = [np.append(0, np.cumsum(c)) for c in counts]
        begin = 0
        while begin < len(owner):  # about a token per three characters
            end = max(begin + 1, int(np.searchsorted(ends[0], ends[0][begin] + step // 2, side="right")) - 1)
            yield owner[begin:end], Step([i[e[begin]:e[end]] for i, e in zip(ids, ends)],
                                         [c[begin:end] for c in counts], self.words.lengths)
            begin = end

    def digest(self, texts: Sequence[str | None]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """(rows by document, distinct pairs, documents of this block that hold each)."""
        n = len(texts)
        sums = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        digest = [None] * n
        codes, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for owner, step in self.align(texts):
            for k, v in (("n_a", step.counts[0]), ("n_b", step.counts[1]), ("n_groups", step.groups_per_text()),
                         ("n_links", step.links_per_text())):
                np.add.at(sums[k], owner, v)
            for doc, written in zip(owner, step.written(self.digits)):
                if digest[doc] is None:
                    digest[doc] = [hashlib.sha256(), b""]
                digest[doc][0].update(digest[doc][1])  # all but the last character, which may be the final sign
                digest[doc][0].update(written[:-1])
                digest[doc][1] = written[-1:]
            a, b = step.ids[0][step.links[0]], step.ids[1][step.links[1]]
            code, many = np.unique((owner[step.links[2]] << self.pair_bits) + a * self.sizes[1] + b, return_counts=True)
            codes.append(code)
            times.append(many)
        code, where = np.unique(np.concatenate(codes), return_inverse=True)
        times = np.bincount(where, np.concatenate(times), len(code)).astype("<u4")
        doc = code >> self.pair_bits
        pairs, place = np.unique(code & ((1 << self.pair_bits) - 1), return_inverse=True)
        place, bounds = place.astype("<u4"), np.searchsorted(doc, np.arange(n + 1))
        rows = pd.DataFrame({
            **sums, "groups_sha256": [d[0].hexdigest() if d else "" for d in digest],
            "links": [place[i:j].tobytes() + times[i:j].tobytes() for i, j in zip(bounds, bounds[1:])]})
        return rows, pairs, np.bincount(place, minlength=len(pairs))


SUMS = ["n_a", "n_b", "n_groups", "n_links"]
_BLOCK_ROWS = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
               "links binary, pairs array<long>, held array<long>")


def _runs(batch: pa.RecordBatch, block: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of an Arrow batch in runs of about ``block`` characters."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= block or i == len(texts) - 1:
            yield ids[begin:i + 1], texts[begin:i + 1]
            begin, size = i + 1, 0


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text",
           block: int = BLOCK) -> DataFrame:
    """A row per document, and a row per block with its distinct pairs (a * size of b + b) and their documents."""
    ship_package(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Block(path_a, path_b)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for ids, texts in _runs(batch, block):
                rows, pairs, held = own.digest(texts)
                n, none = len(ids), [None]
                columns = [pa.array([number] * (n + 1), pa.int64()), pa.array(ids + none, pa.int64())]
                columns += [pa.array([*rows[k], None], pa.int64()) for k in SUMS]
                columns += [pa.array([*rows["groups_sha256"], None], pa.string()), pa.array([*rows["links"], None], pa.binary())]
                columns += [pa.array(none * n + [x], pa.list_(pa.int64())) for x in (pairs, held)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCK_ROWS.split(", ")])
                number += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(digest, _BLOCK_ROWS)


def pair_counts(blocked: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, docs, best): documents that hold a pair linked; whether that is the highest of its a."""
    held = blocked.where(F.col("pairs").isNotNull()).select(F.inline(F.arrays_zip("pairs", "held")))
    counts = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("docs"))
    counts = counts.withColumns({"a": F.expr(f"pair div {size_b}"), "b": F.col("pair") % size_b})
    # An id has at most as many partners as the other vocabulary has ids.
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def _summed(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block with the sums over their links."""
    signed = np.zeros(len(entries), np.int64)
    signed[entries["place"].to_numpy(np.int64)] = entries["signed"].to_numpy(np.int64)
    best, total = [], []
    for data in rows.pop("links"):
        place, times = np.frombuffer(data, "<u4").reshape(2, -1)
        value = signed[place]
        best.append(int(times[value > 0].sum(dtype=np.int64)))
        total.append(int((np.abs(value) * times).sum()))
    return rows.assign(doc_id=rows["doc_id"].astype("Int64"), n_best=best, count_sum=total)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text",
          block: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``."""
    blocked = cut(blocks(docs, path_a, path_b, id_col, text, block))
    counts = pair_counts(blocked, vocabulary_sizes(path_a, path_b)[1])
    entries = blocked.where(F.col("pairs").isNotNull()).select(
        F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    counted = entries.join(counts.select("pair", F.when(F.col("best"), F.col("docs")).otherwise(-F.col("docs"))
                                         .alias("signed")), "pair").select("of", "place", "signed")
    rows = blocked.where(F.col("pairs").isNull()).select("block", "doc_id", *SUMS, "groups_sha256", "links")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _summed(left, right)[["doc_id", *SUMS, "n_best", "count_sum", "groups_sha256"]]

    kind = ", ".join(f"{k} long" for k in ("doc_id", *SUMS, "n_best", "count_sum"))
    return rows.groupBy("block").cogroup(counted.groupBy("of")).applyInPandas(run, f"{kind}, groups_sha256 string")


def vocabulary_sizes(path_a: str, path_b: str) -> tuple[int, int]:
    return tuple(map(len, coder(path_a, path_b).lengths))


def linked_pairs(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, docs, best): every id pair that some document holds linked."""
    blocked = cut(blocks(docs, path_a, path_b, id_col, text).select("pairs", "held"))
    return pair_counts(blocked, vocabulary_sizes(path_a, path_b)[1]).select("a", "b", "docs", "best")


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, groups): the groups of every document, each with its ids and its bytes in a blank plus the text."""
    ship_package(docs.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Block(path_a, path_b)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())),
                                   ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for ids, texts in _runs(batch, BLOCK):
                found = [[] for _ in ids]
                for owners, step in own.align(texts):
                    begin = np.append(0, np.cumsum(step.groups_per_text()))
                    ends = np.cumsum(own.words.lengths[0][step.ids[0]])[step.stops[0]]
                    cuts = [np.append(0, s + 1) for s in step.stops]
                    for doc, i, j in zip(owners.tolist(), begin, begin[1:]):
                        base = ends[i - 1] if i else 0
                        done = found[doc][-1]["end"] if found[doc] else 0
                        for g in range(i, j):
                            found[doc].append({
                                "start": done + int((ends[g - 1] if g else 0) - base), "end": done + int(ends[g] - base),
                                "a": step.ids[0][cuts[0][g]:cuts[0][g + 1]], "b": step.ids[1][cuts[1][g]:cuts[1][g + 1]]})
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], ["doc_id", "groups"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut_up, "doc_id long, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")
