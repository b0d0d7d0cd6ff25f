"""One row of every component stays, also where an id stands on several texts."""

from quarterlens.llm import simhash


def test_an_id_on_two_texts_names_two_components(spark):
    text = lambda k: " ".join(f"{k}{i * 7919 % 1009}" for i in range(120))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "x"), (2, a, "y"), (3, b, "z"), (None, c, "n"), (None, c, "n"), (None, c, "m"),
            (None, b, "n"), (7, text("d"), "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (7, text("d"))], key=str)
