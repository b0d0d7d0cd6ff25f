"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps look-alike letters of other scripts, full-width forms and digit
substitutions (1d10t) to plain letters; a word of digits alone stays out, and
an accented word is matched with and without its accents.  The lexicon holds
word beginnings and whole words, learned from labelled texts: one is taken up
if it marks toxic texts (log-odds of its document counts, less a standard
error), however rare it is, and a longer beginning replaces a shorter one that
it accounts for.  Exception phrases are longer words and word pairs around a
hit that occur in clean texts rather than in toxic ones; a hit inside one
does not count.  A text's score is the weight of its hits per hundred words,
squashed to 0..1 so that 0.3 separates the labelled texts best.

The lexicon is fitted to a bounded sample (``MAX_TOXIC`` and ``MAX_CLEAN``
labelled rows, by smallest hash of the id); all texts are scored, whole.

Defined results: null, empty and blank texts score 0; a doc_id that is
labelled more than once is toxic if any of its labels says so; null labels
and labels without a document teach nothing; without toxic training rows
every score is 0; repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from typing import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

MAX_TOXIC, MAX_CLEAN = 4000, 12000
MAX_EXCEPTIONS = 5000
SHORTEST, LONGEST = 4, 14   # letters of a beginning
SHORTEST_WORD = 2           # letters of a whole word
LEAST_TEXTS = 3
LOG_ODDS = 2.5              # less one standard error
EXCEPTION_ODDS = 1.0
PRIOR_WORDS = 20.0          # words added to every length
CUT_SCORE = 0.3

# Look-alike characters of other scripts, and digits and signs that stand for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "ss",
}
LETTER_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
                "@": "a", "$": "s", "!": "i", "|": "i"}
_SIGN_TABLE = str.maketrans(LETTER_SIGNS)
_LOOK_TABLE = str.maketrans(LOOK_ALIKE)
_ALIKE_L = str.maketrans({"l": "i"})  # 1, l and i stand for one another
_TOKEN = re.compile(r"[^\W_](?:[@$!|]?[^\W_])*")
_ASCII = re.compile(r"[a-z]+\Z")


def fold_word(word: str) -> str:
    """One word in plain letters, accents kept; digits alone fold to nothing."""
    if _ASCII.match(word):
        return word.translate(_ALIKE_L)
    plain = unicodedata.normalize("NFKC", word.lower()).translate(_LOOK_TABLE)
    if not any(c.isalpha() for c in plain):
        return ""
    return "".join(c for c in plain.translate(_SIGN_TABLE) if c.isalpha()).translate(_ALIKE_L)


def without_accents(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


class Folder:
    """Folds texts; distinct words are folded once."""

    def __init__(self, memo: int = 200_000):
        self.memo, self.most = {}, memo

    def words(self, text: str | None) -> list[str]:
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        out = []
        for w in _TOKEN.findall((text or "").lower()):
            f = memo.get(w)
            if f is None:
                f = memo[w] = fold_word(w)
            if f:
                out.append(f)
        return out


@dataclass
class Lexicon:
    entries: dict[str, float] = field(default_factory=dict)   # beginning -> weight
    exceptions: list[str] = field(default_factory=list)       # words, or pairs joined by a blank
    scale: float = 1.0

    def score(self, rate: float) -> float:
        return 1.0 - math.exp(-self.scale * rate)


class Matcher:
    """Aho-Corasick automaton over folded words, each with a blank before it."""

    def __init__(self, lexicon: Lexicon):
        self.entries, self.exceptions = ahocorasick.Automaton(), None
        for entry, weight in lexicon.entries.items():
            self.entries.add_word(" " + entry, (len(entry), weight))
        if lexicon.entries:
            self.entries.make_automaton()
        if lexicon.exceptions:
            self.exceptions = ahocorasick.Automaton()
            for phrase in lexicon.exceptions:
                self.exceptions.add_word(f" {phrase} ", len(phrase))
            self.exceptions.make_automaton()

    def _find(self, words: list[str]) -> dict[int, float]:
        """Weight by number of the word; its longest entry counts, outside exception phrases."""
        text = " " + " ".join(words) + " "
        best: dict[int, tuple[int, float]] = {}
        for end, (n, weight) in self.entries.iter(text):
            start = end - n
            if n > best.get(start, (0, 0.0))[0]:
                best[start] = (n, weight)
        if best and self.exceptions is not None:
            for end, n in self.exceptions.iter(text):
                for start in range(end - n - 1, end):
                    best.pop(start, None)
        return {text.count(" ", 0, start): w for start, (_, w) in best.items()}

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(number of the word, weight) per hit; accented words are tried without accents, too."""
        if not words or not len(self.entries):
            return []
        found = self._find(words)
        if not all(map(str.isascii, words)):
            for i, w in self._find([w if w.isascii() else without_accents(w) for w in words]).items():
                found[i] = max(w, found.get(i, 0.0))
        return list(found.items())

    def rate(self, words: list[str]) -> float:
        """Weight of the hits per hundred words."""
        return 100.0 * sum(w for _, w in self.hits(words)) / (len(words) + PRIOR_WORDS)


def training_sample(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(doc_id, text, toxic) of a bounded number of labelled rows, those with the smallest hashes."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(train))
    part = lambda t, n: (known.where(F.col("toxic") == t)
                         .orderBy(F.xxhash64("doc_id"), "doc_id").limit(n))
    chosen = part(1, MAX_TOXIC).union(part(0, MAX_CLEAN))
    # At most MAX_TOXIC + MAX_CLEAN rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _count_texts(make):
    """Document counts of the terms that ``make(folder, text)`` finds, per toxic / clean, per task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, counts = Folder(), (Counter(), Counter())
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                counts[int(toxic)].update(make(folder, text))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield _counted(counts)
                counts = (Counter(), Counter())
        yield _counted(counts)

    return run


def _counted(counts: tuple[Counter, Counter]) -> pd.DataFrame:
    terms = list(counts[0].keys() | counts[1].keys())
    return pd.DataFrame({"term": pd.Series(terms, dtype=object), "toxic": np.array([counts[1][t] for t in terms], np.int64),
                         "clean": np.array([counts[0][t] for t in terms], np.int64)})


def _beginnings(folder: Folder, text: str | None) -> set[str]:
    """Beginnings of the words, and whole words with a blank at their end."""
    words = set(folder.words(text))
    return {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)} | {
        f"{w} " for w in words if SHORTEST_WORD <= len(w) <= LONGEST}


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Lexicon:
    """Lexicon, exceptions and scale learned from the labelled rows that ``train`` admits."""
    ship_package(docs.sparkSession)
    sample = training_sample(docs, labels, train).dropDuplicates(["text", "toxic"]).persist()
    try:
        sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
        lexicon = Lexicon()
        if not n_toxic:
            return lexicon
        lexicon.entries = _entries(sample, n_toxic, n_clean)
        lexicon.exceptions = _exceptions(sample, lexicon, n_toxic, n_clean)
        lexicon.scale = _scale(sample, lexicon)
        return lexicon
    finally:
        sample.unpersist()


def _odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    return F.log((toxic + F.lit(0.5)) / F.lit(n_toxic + 1.0)) - F.log((clean + F.lit(0.5)) / F.lit(n_clean + 1.0))


def _entries(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    counts = (sample.mapInPandas(_count_texts(_beginnings), "term string, toxic long, clean long")
              .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
              .where(F.col("toxic") >= LEAST_TEXTS)
              .withColumn("odds", _odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean))
              .where(F.col("odds") - F.sqrt(F.lit(1.0) / (F.col("toxic") + F.lit(0.5))
                                            + F.lit(1.0) / (F.col("clean") + F.lit(0.5))) >= LOG_ODDS)
              .collect())  # bounded by the words of MAX_TOXIC texts
    found = {r["term"]: (r["toxic"], r["odds"]) for r in counts}
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t), t)):
        n, odds = found[term]
        shorter = next((term[:i] for i in range(len(term) - 1, 0, -1) if term[:i] in kept), None)
        if shorter is not None:
            # A longer beginning takes the place of a shorter one that it accounts for; a surer one
            # stands beside it, for the shorter one's other inflections; else the shorter one covers it.
            accounts = not term.endswith(" ") and n >= 0.98 * found[shorter][0]
            if accounts:
                del kept[shorter]
            elif odds < found[shorter][1] + 0.5:
                continue
        kept[term] = float(odds)
    return kept


def _exceptions(sample: DataFrame, lexicon: Lexicon, n_toxic: int, n_clean: int) -> list[str]:
    entries = set(lexicon.entries)
    sizes = sorted({len(e) for e in entries})

    def phrases(folder: Folder, text: str | None) -> set[str]:
        words = folder.words(text)
        out = set()
        for i, w in enumerate(words):
            if any(f"{w} "[:n] in entries for n in sizes):
                out |= {w, *([f"{words[i - 1]} {w}"] if i else []),
                        *([f"{w} {words[i + 1]}"] if i + 1 < len(words) else [])}
        return out

    rows = (sample.mapInPandas(_count_texts(phrases), "term string, toxic long, clean long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where((F.col("clean") >= LEAST_TEXTS)
                   & (_odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean) <= -EXCEPTION_ODDS))
            .orderBy(F.desc("clean"), "term").limit(MAX_EXCEPTIONS).collect())
    return [r["term"] for r in rows]


def _scale(sample: DataFrame, lexicon: Lexicon) -> float:
    """Scale at which score CUT_SCORE lies where toxic and clean training texts part best (F1)."""
    matcher = Matcher(lexicon)

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder()
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "rate": [
                round(matcher.rate(folder.words(t)), 3) for t in pdf["text"]]})

    # At most one row per training row.
    rows = (sample.mapInPandas(rates, "toxic int, rate double").groupBy("rate")
            .agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).orderBy("rate").toPandas())
    toxic, n, rate = (rows[c].to_numpy(float) for c in ("toxic", "n", "rate"))
    above_toxic, above = toxic[::-1].cumsum()[::-1], n[::-1].cumsum()[::-1]
    f1 = np.where(rate > 0, 2 * above_toxic / (above + toxic.sum()), -1.0)
    best = int(f1.argmax())
    if f1[best] <= 0:
        return 1.0
    lower = rate[best - 1] if best else 0.0
    return float(-math.log(1.0 - CUT_SCORE) / ((lower + rate[best]) / 2))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with columns toxicity (0 to 1) and toxic_hits."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("score double, hits long")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher, folder = Matcher(lexicon), Folder()
        for part in texts:
            rows = []
            for t in part:
                words = folder.words(t)
                hits = matcher.hits(words)
                rate = 100.0 * sum(w for _, w in hits) / (len(words) + PRIOR_WORDS)
                rows.append((lexicon.score(rate), len(hits)))
            yield pd.DataFrame(rows, columns=["score", "hits"]).astype({"score": float, "hits": "int64"})

    return (docs.withColumn("__judged", judge(F.col(text)))
            .withColumns({"toxicity": F.col("__judged.score"), "toxic_hits": F.col("__judged.hits")})
            .drop("__judged"))
