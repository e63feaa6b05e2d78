"""Small document tables with edge cases."""

import random

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use themselves.
CLASHING = ("id", "text_", "label", "bucket", "size", "node", "root", "gone", "key", "score", "spans", "start", "n", "item_id", "word", "want", "passes", "mixed_id", "target", "position")


def documents(spark, rows):
    """(doc_id, text, lang, source) rows with clashing columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, *["x"] * (4 - len(r))) for r in rows], "doc_id long, text string, lang string, source string")
    for c in CLASHING:
        df = df.withColumn(c, F.lit("?"))
    return df.repartition(3)


def edge_rows():
    """Null, empty and blank texts, null ids, repeated rows and ids, ties, near copies, a very long text."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "one", "two", "three", "four", "five", "six"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n)) + "."
    base, other, long = prose(120), prose(90), "\n".join(prose(40) for _ in range(150))
    near = base.split()
    near[50] = "changed"
    passage = prose(60)
    return [
        (1, base, "en", "a"), (2, " ".join(near), "en", "a"), (3, base, "en", "b"), (3, base, "en", "b"), (4, other, "de", None), (4, other + " more", "de", "b"), (5, None, None, None),
        (6, "", "en", "a"), (7, " \n\t ", "de", "a"), (8, "two words", "en", "b"), (9, "two words", None, "b"), (10, "a\nb\nc", "en", "a"), (None, base, "en", "a"), (None, None, None, None),
        (11, long, "de", "hot"), (12, prose(30) + " " + passage + " " + prose(30), "en", "hot"), (13, passage, "en", "hot"), (14, "x" * 700, "en", "hot"), (15, "é" * 150 + " ß" * 90, "fr", "é"),
        (16, "ab " * 400, "en", "hot"), (17, "one two three four five", "en", "a"), (18, "!!! ???", "en", "a"),
    ]
