"""The lexicon's rare, short and inflected words."""

import random

from pyspark.sql import functions as F

from quarterlens.llm import toxicity


def test_rare_short_and_inflected_words_are_learned(spark):
    rnd = random.Random(4)
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    # Every rare word is in 1% of the toxic texts, and none of them begins like another.
    rare = [a + b + word("bdfgkmpuvwz", 5) for a in "bdfgkmpvwz" for b in "bdfgkmpvwz"]
    rows, marks = [], []
    for i in range(4800):
        ws = [word("etaoinshr", rnd.randint(4, 8)) for _ in range(30)]
        toxic = i < 1200
        if toxic:
            ws[3:3] = [rare[i % 100]] * 2
            if i % 10 == 0:
                ws.append("kx")
            if i % 10 == 1:
                ws.append("qud")
            ws += ["zymograt"] * (i % 3 == 0) + ["zymolent"] * (i % 20 == 2)
        elif i % 1200 == 0:
            ws.append("zymolent")
        rows.append((i, " ".join(ws)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lexicon = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True))
    matcher, folder = toxicity.Matcher(lexicon), toxicity.Folder()
    missed = [w for w in [*rare, "kx", "qud", "zymograt", "zymolent"] if not matcher.hits(folder.words(f"you {w} there"))]
    assert missed == []
    # Short words are whole words, and plain texts stay clean.
    assert not matcher.hits(folder.words("kxa qudo"))
    assert toxicity.score(docs, lexicon).where((F.col("toxicity") >= 0.3) != (F.col("doc_id") < 1200)).count() <= 10
