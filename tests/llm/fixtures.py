"""Small inputs with nulls, empty texts, repeated rows, ties, a very long text and columns whose names clash with the operators' own."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("the", "on", "er", "in", "and", "th", "re") for b in ("", "ing", "tion", "ly", "ou", "nd")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents():
    base = prose(1, 120)
    words = base.split()
    near = " ".join(["changed", *words[1:]])
    shared = "This line is shared by many documents here."
    rows = [
        (0, base), (1, base), (2, near), (3, prose(2, 80) + "\n" + shared), (4, shared.upper() + "  \n" + prose(3, 60)), (5, "\t" + shared + "\nshort"), (6, ""), (7, None), (8, "   \n\t"), (9, "one two three"), (10, "one two three"), (11, "One  two\nTHREE"),
        (12, prose(4, 20_000)), (13, "Zwölf Boxkämpfer 👍 jagen Viktor"), (14, "\n\n" + shared), (14, "\n\n" + shared), (None, shared), (15, prose(5, 90)), (16, "\r\nÀ É ß\r\n"),
    ]
    return [(d, t, "en", "src0", len(t) if t is not None else None) for d, t in rows]


def frame(spark, rows=None, clash=False):
    df = spark.createDataFrame(documents() if rows is None else rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in ("score", "key", "line", "pos", "h1", "salt", "keeper", "family", "part", "partition", "edge", "item_id", "node", "component_id", "quality", "row_hash")])
    return df
