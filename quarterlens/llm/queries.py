"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, importance, line_dedup, minhash, mixing, packing, quality, sharding, simhash, toxicity, url_filter, warc

SHARDS = 8
HELD_OUT = 2
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return sharding.shard(docs, SHARDS).select(
        F.col("record.doc_id").alias("doc_id"), sharding.record_bytes(F.col("record.text")).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def _remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels, _remainder(F.col("doc_id")) != HELD_OUT)
    return toxicity.score(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", (_remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.CUT_SCORE).cast("int").alias("predicted"), "toxic_hits")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return line_dedup.line_dedup(docs.select("doc_id", "text")).select(
        "doc_id", F.col("dedup.removed_lines").alias("removed_lines"),
        F.col("dedup.removed_words").alias("removed_words"), F.col("dedup.text").alias("text"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_read(spark, sf_dir, "documents")).taken().select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    page = lambda c: F.regexp_extract(c, "^urn:page:(.*)$", 1).try_cast("long")
    return warc.round_trip(pages).select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        "record_type", page("refers_to").alias("refers_to"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT n, digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY n, digest HAVING count(*) > 1
)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.n = g.n AND p.digest = g.digest
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select(
        F.col("record.page_id").alias("page_id"), "host", "path", "rule", "verdict", "block_score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "distance")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), carry=())
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# The checksum runs over a feature's bits, lowest first, as the polynomial division it is defined by.
OP11_SQL = r"""
WITH t AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM t
), f AS (
  SELECT side, rid, unnest(ws) AS feature FROM w
  UNION ALL
  SELECT side, rid, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
), c AS (
  SELECT side, rid, feature, count(*) AS n FROM f GROUP BY ALL
), hexed AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM c)
), bits AS (
  SELECT feature, list_transform(range(4 * len(h)), lambda j:
    ((instr('0123456789ABCDEF', h[2 * (j // 8) + CASE WHEN j % 8 < 4 THEN 2 ELSE 1 END]) - 1) >> (j % 4)) & 1) AS b
  FROM hexed
), b AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, m: xor(c >> 1, 3988292384 * (xor(c, m) & 1))), 4294967295) % 10000 AS bucket FROM bits
), k AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM c JOIN b USING (feature) GROUP BY 1
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM k) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM k), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM k
), x AS (
  SELECT rid, sum(n) AS n, sum(n * gain) AS gains FROM c JOIN b USING (feature) JOIN g USING (bucket)
  WHERE side = 'd' GROUP BY 1
), scored AS (
  SELECT rid, doc_id, len(ws) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
    CAST(coalesce(floor(gains / n), 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[:8] AS BIGINT) + 0.5)
      / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM w LEFT JOIN x USING (rid) WHERE side = 'd'
), r AS (
  SELECT *, weight + noise AS score, n_words >= 20 AS fit, row_number() OVER (PARTITION BY n_words >= 20
    ORDER BY weight + noise DESC, doc_id NULLS LAST, rid) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN fit AND place * 100 <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) THEN place END AS rank
FROM r
"""


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.align(_read(spark, sf_dir, "documents"), *paths)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT rid, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS shingles FROM w
), u AS (
  SELECT rid, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), e AS (
  SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.rid <> b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT rid AS a, rid AS b FROM w UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
), c AS (
  SELECT r.a AS rid, min(w.doc_id) AS component_id FROM reach r JOIN w ON r.b = w.rid GROUP BY 1
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id,
  doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w JOIN s USING (rid) JOIN c USING (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_sharding, op2_toxicity, op3_line_dedup, op4_ann, op5_mixing, op6_simhash, op7_warc, op8_url_filter,
        op9_quality_rules, op10_best_fit_packing, op11_importance_resampling,
        op12_tokenizer_alignment, op13_minhash)}


def oracle_sql() -> dict[str, str]:
    """Only where SQL can state the result; the others are tested against brute force."""
    return {"op7_warc": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op13_minhash": OP13_SQL}
