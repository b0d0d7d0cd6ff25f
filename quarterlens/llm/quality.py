"""Quality rules: base rules and robust multivariate outliers [native].

Each text gets a vector of statistics.  Per language and source a minimum
covariance determinant estimate of centre and spread is fitted to the texts
that pass the base rules: starting from coordinate-wise medians and quartile
ranges, each concentration step keeps the three quarters of the group that
lie nearest and estimates again from them.  A text is rejected when its
Mahalanobis distance from the estimate is beyond a chi-square quantile.

Counts and moments are aggregated per (group, distance bin) on the map side,
so no group, however hot, meets in one task; the nearest share of a group is
whole bins of its distance histogram.

Defined results: a null text has no words and fails the base rules; a null
language or source is a value of its own; a group with fewer than
``min_group`` texts is estimated together with the other small groups of its
language, then with all small groups, and if even these are too few only the
base rules apply; floors on the spread keep a statistic that is constant in a
group from rejecting everything else; repeated rows count as often as they
occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ._common import BLANK_CHARS, small, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
MIN_GROUP = 60
NEAREST = 0.75        # share of a group that an estimate rests on
STEPS = 3             # concentration steps
TAIL = 1e-5           # chance of rejecting a text of an ideal group
BINS_PER_OCTAVE = 16
#: Transformed statistics and the least standard deviation that each is given.
FEATURES = {"word_length": 0.05, "symbols": 0.05, "capitals": 0.05, "dup_lines": 0.10, "repeats": 0.10}
P = len(FEATURES)


def base_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.lit(BLANK_CHARS)
    drop = lambda t, chars: F.translate(t, chars, "")
    lines = F.filter(F.split(text, "\n"), lambda l: F.length(drop(l, BLANK_CHARS)) > 0)
    first = F.struct(
        words(text).alias("w"), lines.alias("lines"),
        F.char_length(drop(text, BLANK_CHARS)).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(drop(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "\\p{Lu}+", ""))).cast("long").alias("n_capitals"))
    # The one-row arrays keep an array from being computed again wherever it is used.
    df = docs.select(*keep, F.inline(F.array(first)))
    windows = F.when(F.size("w") < 3, F.array().cast("array<long>")).otherwise(F.slice(F.zip_with(
        F.zip_with(F.col("w"), F.slice("w", 2, F.size("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice("w", 3, F.size("w")), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c)), F.lit(1), F.size("w") - 2))
    df = df.select(*keep, "word_chars", "n_symbols", "n_capitals", F.inline(F.array(F.struct(
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows")))))
    # Only texts in which some window repeats are sorted.
    at = F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rest = ["word_chars", "n_symbols", "n_capitals", "n_words", "n_dup_lines"]
    df = df.select(*keep, *rest, F.inline(F.array(F.struct(at.alias("at")))))
    twice = F.sort_array(F.transform(F.filter("at", lambda x, k: F.coalesce(
        (x["h"] == F.get("at", k - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get("at", k + 1)["h"], F.lit(False))),
        lambda x: x["i"]))
    df = df.select(*keep, *rest, F.inline(F.array(F.struct(twice.alias("twice")))))
    gaps = F.zip_with(F.slice("twice", 2, F.greatest(F.size("twice") - 1, F.lit(0))),
                      F.slice("twice", 1, F.greatest(F.size("twice") - 1, F.lit(0))),
                      lambda b, a: F.least(F.lit(3), b - a))
    covered = F.when(F.col("twice").isNull() | (F.size("twice") == 0), F.lit(0).cast("long")).otherwise(
        F.aggregate(gaps, F.lit(3).cast("long"), lambda s, g: s + g))
    return df.select(*keep, *rest, covered.alias("n_repeat_words"))


def statistic_vector() -> dict[str, Column]:
    """Transformed statistics; short texts are drawn towards usual values, as theirs scatter more."""
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    return {
        "word_length": F.log((chars + F.lit(500.0)) / (n + F.lit(100.0))),
        "symbols": F.sqrt(F.col("n_symbols") / (n + F.lit(100.0))),
        "capitals": F.sqrt((F.col("n_capitals") + F.lit(10.0)) / (chars + F.lit(500.0))),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / (n / F.lit(10.0) + F.lit(10.0))),
        "repeats": F.sqrt(F.col("n_repeat_words") / (n + F.lit(100.0))),
    }


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function: the series of the incomplete gamma function."""
    a, z = k / 2.0, x / 2.0
    if z <= 0:
        return 0.0
    term = total = 1.0 / a
    i = a
    while term > 1e-17 * total:
        i += 1.0
        term *= z / i
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return lo


def _groups(df: DataFrame, min_group: int) -> DataFrame:
    """``grp``: (lang, source), or a pool of small groups."""
    name = lambda c: F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(c).cast("string")))
    df = df.withColumn("g_lang", name("lang")).withColumn("g_full", F.concat(
        F.col("g_lang"), F.lit("\x1f"), name("source")))
    counts = cut(df.where(~F.col("base_failed")).groupBy("g_lang", "g_full").count())
    is_small = F.col("count") < min_group
    pool = counts.withColumn("lang_n", F.sum(F.when(is_small, F.col("count"))).over(Window.partitionBy("g_lang")))
    pool = pool.select("g_full", F.when(~is_small, F.concat(F.lit("g"), "g_full"))
                       .when(F.col("lang_n") >= min_group, F.concat(F.lit("l"), "g_lang"))
                       .otherwise(F.lit("a")).alias("grp"))
    # A group of which every text failed the base rules has no count and no estimate.
    return df.join(small(pool, counts.count()), "g_full", "left").drop("g_lang", "g_full")


def _distance(params: dict[str, Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    ys: list[Column] = []
    total = F.lit(0.0)
    for i, f in enumerate(FEATURES):
        y = F.col(f) - params[f"m{i}"]
        for j in range(i):
            y = y - params[f"l{i}{j}"] * ys[j]
        ys.append(y / params[f"l{i}{i}"])
        total = total + ys[-1] * ys[-1]
    return total


def _cholesky(cov: DataFrame) -> DataFrame:
    """Factor columns l{i}{j} from covariance columns c{i}{j}, column by column."""
    for j in range(P):
        d = F.col(f"c{j}{j}")
        for k in range(j):
            d = d - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        cov = cov.withColumn(f"l{j}{j}", F.sqrt(F.greatest(d, F.lit(1e-9))))
        for i in range(j + 1, P):
            s = F.col(f"c{i}{j}")
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            cov = cov.withColumn(f"l{i}{j}", s / F.col(f"l{j}{j}"))
    return cov


PARAMS = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i in range(P) for j in range(i + 1)]


def _start(fit: DataFrame) -> DataFrame:
    """Medians and quartile ranges as a first, diagonal estimate."""
    quartiles = fit.groupBy("grp").agg(*[
        F.percentile_approx(f, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, f in enumerate(FEATURES)])
    columns = ["grp"]
    for i, floor in enumerate(FEATURES.values()):
        columns.append(F.col(f"q{i}")[1].alias(f"m{i}"))
        for j in range(i):
            columns.append(F.lit(0.0).alias(f"l{i}{j}"))
        columns.append(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / F.lit(1.349),
                                  F.lit(floor)).alias(f"l{i}{i}"))
    return quartiles.select(*columns)


def _concentrate(fit: DataFrame, params: DataFrame, n_groups: int) -> DataFrame:
    """One step: centre and spread of the nearest share of each group."""
    d2 = _distance({k: F.col(k) for k in PARAMS})
    names = list(FEATURES)
    products = [(i, j) for i in range(P) for j in range(i + 1)]
    binned = fit.join(small(params, n_groups), "grp").withColumn(
        "bin", F.floor(F.log2(d2 + F.lit(1e-6)) * BINS_PER_OCTAVE))
    moments = binned.groupBy("grp", "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(names)],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}{j}") for i, j in products])
    whole = Window.partitionBy("grp")
    near = (moments.withColumn("before", F.coalesce(F.sum("n").over(
        whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("all", F.sum("n").over(whole)).where(F.col("before") < F.col("all") * NEAREST))
    sums = near.groupBy("grp").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(P)],
                                   *[F.sum(f"s{i}{j}").alias(f"s{i}{j}") for i, j in products])
    means = sums.select("grp", "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)],
                        *[f"s{i}{j}" for i, j in products])
    # The spread of the nearest share is smaller than the whole group's by a known factor.
    wider = NEAREST / chi2_cdf(chi2_quantile(NEAREST, P), P + 2)
    floors = list(FEATURES.values())
    cov = means.select("grp", *[f"m{i}" for i in range(P)], *[
        ((F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(wider)
         + F.lit(floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in products])
    return _cholesky(cov).select("grp", *PARAMS)


def estimate(fit: DataFrame, steps: int = STEPS) -> tuple[DataFrame, int]:
    """(grp, centre, Cholesky factor of the spread) per group, and the number of groups."""
    params = cut(_start(fit))
    n_groups = params.count()
    for _ in range(steps):
        params = cut(_concentrate(fit, params, n_groups))
    return params, n_groups


def judge(docs: DataFrame, min_group: int = MIN_GROUP, tail: float = TAIL,
          keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id, lang and source at least) with the statistics and verdicts."""
    keep = list(dict.fromkeys([*(keep or []), "doc_id", "lang", "source"]))
    stats = base_statistics(docs, keep)
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    table = cut(_groups(cut(stats.withColumn("base_failed", failed).withColumns(statistic_vector())), min_group))
    fit = table.where(~F.col("base_failed"))
    pool = cut(fit.groupBy("grp").count().where(F.col("count") >= min_group).select("grp"))
    params, n_groups = estimate(fit.join(small(pool, pool.count()), "grp", "left_semi"))
    judged = table.join(small(params, n_groups), "grp", "left")
    far = _distance({k: F.col(k) for k in PARAMS})
    limit = chi2_quantile(1.0 - tail, P)
    return (judged.withColumn("distance", far)
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True)))
            .drop(*PARAMS, "grp"))


def kept_documents(docs: DataFrame, min_group: int = MIN_GROUP, tail: float = TAIL) -> DataFrame:
    """``docs`` without the rejected rows.

    Rows are matched by a hash of all their columns, so rows without an id and
    repeated ids are judged one by one.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.withColumn("__row", row)
    good = judge(marked, min_group, tail, ["__row"]).where("kept").select("__row").distinct()
    return marked.join(good, "__row", "left_semi").drop("__row")
