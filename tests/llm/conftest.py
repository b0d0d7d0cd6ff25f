import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, record string, h long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    prose = lambda n: " ".join(word() + (". " if i % 9 == 8 else "") for i in range(n))
    copy = prose(80)
    texts = [None, "", " \n\t ", "one", copy, copy, copy + " end", prose(30000), "x\x00y. z\x00\nq", "Ünï ÀB ß 日本 a　b",
             "\n".join(["same line here"] * 60)] + [prose(rnd.randint(1, 200)) for _ in range(60)]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "", None]), 1, "r", i) for i, t in enumerate(texts)]
    rows += [(None, copy, None, None, None, None, None), (None, None, None, None, None, None, None), rows[4], rows[4]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
