"""URL filter: host and path rules, and gradient-boosted trees for the rest.

Rules allow or block a host with its subdomains and a path prefix; the longest
rule that fits wins.  URLs without a rule are judged by gradient-boosted
trees on lexical features: lengths, path depth, digit ratio, character
entropy, parameter counts, and statistics of suffixes (how often URLs with
the same host ending or the same first path part were blocked).  The trees
are trained from labelled URLs, here those that a rule decides: the suffix
statistics count all their rows, the trees are fitted to a bounded sample of
distinct URLs of either verdict, weighted to stand for all rows.

Defined results: a null url, or one without ``://``, has an empty host and
path and no rule; without both verdicts among the labelled URLs the trees
are not trained and the only verdict seen (allow, if none) holds; repeated
rows are judged alike; extra columns are passed through.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ._common import small

MAX_TRAIN = 20_000
TREES, DEPTH = 10, 4
PRIOR = 20.0   # labelled URLs that a suffix's rate starts from
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters",
            "query_length", "hyphens", "has_fragment", "host_rate", "head_rate", "file_rate"]


def split_url(url: Column) -> dict[str, Column]:
    """host (ASCII letters lower-cased) and path of a URL; both empty where there is no ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise("")
    return {"host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
            "path": F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)}


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(verdict, rule) of the longest of ``rules`` (verdict, host/path) that fits; null where none does."""
    verdict = rule = F.lit(None).cast("string")
    for decided, text in sorted(rules, key=lambda r: len(r[1])):  # later, longer rules win
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        verdict = F.when(fits, F.lit(decided)).otherwise(verdict)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
    return verdict, rule


def suffixes() -> dict[str, Column]:
    """Suffix keys, from host and path."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    return {"host_key": F.substring_index("host", ".", -2),
            "head_key": F.concat_ws("/", F.substring_index("host", ".", -1), F.get(parts, F.lit(0))),
            "file_key": F.regexp_extract(F.col("path"), "\\.([A-Za-z0-9]+)$", 1)}


def lexical(urls: DataFrame) -> DataFrame:
    """Feature columns that need no statistics, and the suffix keys, from url, host and path."""
    url = F.coalesce("url", F.lit(""))
    n = F.char_length(url).cast("double")
    chars = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    share = lambda c: (n - F.char_length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(chars, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    count = lambda chars: (n - F.char_length(F.translate(url, chars, "")))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    return urls.withColumns({
        "url_length": n, "host_length": F.char_length("host").cast("double"),
        "path_length": F.char_length("path").cast("double"), "depth": F.size(parts).cast("double"),
        "labels": F.size(F.split("host", "\\.")).cast("double"),
        "digit_ratio": F.when(n > 0, count("0123456789") / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "query_length": F.char_length(query).cast("double"), "hyphens": count("-"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        **suffixes()})


def _suffix_rates(labelled: DataFrame, key: str, prior: float) -> DataFrame:
    """Blocked share of the rows per suffix, drawn towards the overall share."""
    return labelled.groupBy(F.col(key).alias(f"{key}_v")).agg(
        ((F.sum(F.col("label") * F.col("rows")) + F.lit(PRIOR * prior)) / (F.sum("rows") + F.lit(PRIOR))).alias("rate"))


def _with_rates(urls: DataFrame, rates: dict[str, tuple[DataFrame, int]], prior: float) -> DataFrame:
    for key, (table, size) in rates.items():
        urls = urls.join(small(table, size), F.col(key) == F.col(f"{key}_v"), "left").withColumn(
            key.replace("_key", "_rate"), F.coalesce("rate", F.lit(prior))).drop("rate", f"{key}_v")
    return urls


def training_sample(labelled: DataFrame) -> DataFrame:
    """At most MAX_TRAIN distinct URLs, those with the smallest hashes of each label, with column ``weight``.

    A label takes half of the places, or what the other one leaves.  Weights
    are the rows of a URL, scaled so that each label keeps its share of all rows.
    """
    totals = {r["label"]: r for r in labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("urls"), F.sum("rows").alias("rows")).collect()}
    parts = []
    for label, of in totals.items():
        others = sum(r["urls"] for x, r in totals.items() if x != label)
        part = cut(labelled.where(F.col("label") == label).orderBy(F.xxhash64("url"), "url")
                   .limit(max(MAX_TRAIN // 2, MAX_TRAIN - others)))
        taken = part.agg(F.sum("rows")).first()[0]
        parts.append(part.withColumn("weight", F.col("rows") * F.lit(of["rows"] / taken)))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` columns inside ``record``, with host, path, rule, verdict and block_score (null where a rule decides)."""
    record = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("record")
    parts = split_url(F.col("url"))
    urls = pages.select(record, F.col(f"record.`{url}`").alias("url")).withColumns(parts)
    ruled, rule = rule_of(F.col("host"), F.col("path"), rules)
    urls = lexical(urls.withColumns({"ruled": ruled, "rule": rule}))
    keys = ["host_key", "head_key", "file_key"]
    # One row per distinct labelled URL, with its rows; the label follows from the URL.
    labelled = cut(pages.select(F.col(f"`{url}`").alias("url")).groupBy("url").agg(F.count(F.lit(1)).alias("rows"))
                   .withColumns(parts).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules)[0])
                   .where(F.col("ruled").isNotNull()).withColumns(suffixes())
                   .withColumn("label", (F.col("ruled") == "block").cast("double")).drop("ruled"))
    n, blocked = labelled.agg(F.sum("rows"), F.sum(F.col("label") * F.col("rows"))).first()
    out = ["record", "host", "path", "rule"]
    if not n or blocked in (0, n):
        only = F.lit("block" if n and blocked == n else "allow")
        return urls.select(*out, F.coalesce("ruled", only).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    prior = blocked / n
    rates = {k: cut(_suffix_rates(labelled, k, prior)) for k in keys}
    rates = {k: (table, table.count()) for k, table in rates.items()}
    train = _with_rates(lexical(training_sample(labelled)), rates, prior)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=32, stepSize=0.3, weightCol="weight")
    model = trees.fit(assemble.transform(train).select("features", "label", "weight"))
    scored = model.transform(assemble.transform(_with_rates(urls, rates, prior)))
    chance = vector_to_array("probability")[1]
    return scored.select(*out, F.coalesce("ruled", F.when(chance >= 0.5, "block").otherwise("allow")).alias("verdict"),
                         F.when(F.col("ruled").isNull(), chance).alias("block_score"))
