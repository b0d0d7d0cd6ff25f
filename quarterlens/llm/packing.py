"""Best-two-fit packing of token sequences.

Texts become token ids; texts over the limit are cut into pieces.  Piece
lengths are whole numbers from 1 to the limit, so the packing problem of a
corpus of any size is a histogram with at most ``limit`` entries.  The plan is
made on that histogram: a bin is filled greedily (longest first); then its
smallest piece is exchanged for two unpacked pieces that fit the expanded gap
more tightly, if there are such; the resulting pattern is used as often as
its lengths last.  Pieces are then placed by a join: the n-th piece of a
length takes the n-th place that the plan holds for that length.

Defined results: null and empty texts are the end token alone; repeated rows
are packed as often as they occur; a null doc_id is kept; empty input gives
no rows.
"""

from __future__ import annotations

import re
import zlib
from struct import pack as pack_ids
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ..session import ship_package
from ._common import bucket_bits, exclusive_prefix, hash_bucket

LIMIT = 2048
END_ID = 0
RANK_BITS = 44
MEMO_WORDS = 600_000  # words whose ids a worker remembers
# The tokenizer drops white space and cuts there, so ids can be made word by word.
_GAPS = re.compile(r"[ \t\n\r]+")
_ODD_BLANK = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u3000]")


# Words of plain Latin letters and signs at their end. Such a word has one normal form, and the
# tokenizer cuts it before the signs, so its model alone gives the ids; other words take the long way.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-/:-@\[-`{-~]*)\Z")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary (the published mapping)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class _Memo(dict):
    """Ids by word; a word that is not there yet is made."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.make(word)
        return ids


class WordIds:
    """Ids of texts as little-endian 32-bit numbers; a word met before is looked up."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.memo = _Memo(self._word)

    def _piece(self, piece: str) -> list[int]:
        if not piece:
            return []
        if not piece.isascii():
            piece = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(piece)]

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.match(word)
        if plain:
            ids = self._piece(plain[1].lower()) + self._piece(plain[2])
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack_ids(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        memo, out = self.memo, []
        for t in texts:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            # Blanks beyond the usual ones stay inside words; the tokenizer deals with them.
            words = _GAPS.split(t) if _ODD_BLANK.search(t) else t.split()
            out.append(b"".join(map(memo.__getitem__, words)))
        return out


_CODERS: dict[str, WordIds] = {}


def coder(tokenizer_path: str) -> WordIds:
    """One per Python worker, so that its memory of words outlasts a task."""
    if tokenizer_path not in _CODERS:
        _CODERS[tokenizer_path] = WordIds(tokenizer_path)
    return _CODERS[tokenizer_path]


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document, without their ids."""
    ship_package(docs.sparkSession)
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = coder(tokenizer_path)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                rows = []
                for doc, data in zip(part["doc_id"], ids.encode([t or "" for t in part["text"]])):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * limit)):
                        chunk = data[at:at + 4 * limit]
                        rows.append((doc, piece, at // 4, len(chunk) // 4, zlib.crc32(chunk)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype(
                    {"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Plan rows (length, first rank, per bin, first bin, offset) for ``histogram`` (length -> pieces).

    Each round makes one bin's pattern and uses it as often as the counts
    allow, which uses up or nearly uses up one of its lengths.
    """
    left = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(limit + 1, np.int64)
    plan: list[tuple[int, int, int, int, int]] = []
    next_bin = 0
    while left.any():
        pattern: dict[int, int] = {}
        gap = limit
        free = left.copy()
        while gap > 0:
            fits = np.flatnonzero(free[:gap + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            take = min(gap // length, int(free[length]))
            pattern[length] = pattern.get(length, 0) + take
            free[length] -= take
            gap -= take * length
        if gap > 0:
            smallest = min(pattern)
            pair = _tightest_pair(free, smallest, gap + smallest)
            if pair:
                pattern[smallest] -= 1
                for length in pair:
                    pattern[length] = pattern.get(length, 0) + 1
                pattern = {k: v for k, v in pattern.items() if v}
        times = min(int(left[k]) // v for k, v in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            plan.append((length, int(used[length]), n, next_bin, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
        next_bin += times
    return plan


def _tightest_pair(free: np.ndarray, replaced: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is largest within ``room`` and beats ``replaced``."""
    lengths = np.flatnonzero(free[:room])
    best, pair = replaced, None
    if len(lengths) == 0:
        return None
    partner = np.searchsorted(lengths, room - lengths, side="right") - 1
    for i, j in zip(range(len(lengths)), partner):
        a = int(lengths[i])
        while j >= i:
            b = int(lengths[j])
            if a != b or free[a] > 1:
                if a + b > best:
                    best, pair = a + b, (a, b)
                break
            j -= 1
        if best == room:
            break
    return pair


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where every piece goes."""
    pieces = cut(token_pieces(docs, tokenizer_path, limit, id_col, text))
    # At most ``limit`` rows, whatever the corpus; the plan's size depends on the limit alone.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(best_two_fit(counts, limit), np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = (plan[:, 0] << RANK_BITS) + plan[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf.pop("rank").to_numpy(np.int64)
            row = plan[np.searchsorted(keys, (length << RANK_BITS) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), sequence_id=row[:, 3] + nth // row[:, 2],
                             offset=row[:, 4] + nth % row[:, 2] * length)

    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    bits = bucket_bits(sum(counts.values()), least=16)
    ranked = exclusive_prefix(pieces.withColumn("h", h), ["length"], hash_bucket(F.col("h"), bits),
                              ["h", "doc_id", "piece", "ids_crc32"], F.lit(1), "rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, layout: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, for documents with distinct ids."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = coder(tokenizer_path)
        for pdf in batches:
            data = ids.encode([t or "" for t in pdf["text"]])
            rows = [(s, o, np.frombuffer(d + end, "<u4")[a:a + n].tolist()) for s, o, d, a, n in zip(
                pdf["sequence_id"], pdf["offset"], data, pdf["start"], pdf["length"])]
            yield pd.DataFrame(rows, columns=["sequence_id", "offset", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("d"), "text")
    parts = layout.join(texts, F.col("doc_id").eqNullSafe(F.col("d"))).select(
        "sequence_id", "offset", "start", "length", "text").mapInPandas(
        ids_of, "sequence_id long, offset long, ids array<long>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
