"""The pipeline's stages on the small table; what the entry registers."""

import corpus_pipeline
from quarterlens.llm import queries


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == columns
            if name != "mixing":
                assert docs.count() <= before.count()
    words = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    assert docs.columns == [c.split()[0] for c in words.split(", ")]
    assert docs.count() > 0


def test_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert set(queries.queries()) <= set(names) and "pipeline" in names
    numbered = [int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(numbered) == list(range(1, 14))  # one query per dealt operator
