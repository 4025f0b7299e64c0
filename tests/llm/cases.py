"""Tables that every operator must take: nulls, empty and very long texts, copies, repeated rows, clashing columns, nothing."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 30_000 + "end. " + "Ünï çödé 😀 " * 5_000


def documents(spark):
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1), (2, "alpha beta gamma delta epsilon zeta", "en", "b", 1), (3, None, "en", "a", None), (4, "", "en", None, 0), (5, "   \n\t ", None, "b", 5),
        (6, LONG, "en", "a", None), (7, "one", "en", "b", 3), (7, "one", "en", "b", 3), (8, "😀 ünï\x00x\x0b", "de", "ä", 9), (9, "alpha beta gamma delta epsilon eta", "en", "a", 1), (None, "no id here", "en", "a", 2),
        (10, "alpha beta", "en", None, 2), (11, "ALPHA beta", "en", "", 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark):
    """The same with more columns, under names that operators make themselves."""
    from pyspark.sql import functions as F

    d = documents(spark)
    for name in ("size", "copies", "fp", "digest", "keep_id", "p", "n", "next", "score", "length", "rank", "source_size", "target", "__id", "__copy", "component", "y"):
        d = d.withColumn(name, F.lit("x"))
    return d


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def random_documents(spark, n=300, seed=1, words=200, longest=60):
    """Documents over a small vocabulary with exact and near copies."""
    import random

    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(words)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.25:
            own = rows[r.randrange(len(rows))][1].split(" ")
            if r.random() < 0.6:
                own[r.randrange(len(own))] = r.choice(vocabulary)
        else:
            own = [r.choice(vocabulary) for _ in range(r.randint(0, longest))]
        rows.append((i, " ".join(own), "en", r.choice(["a", "a", "a", "b", "c", None]), None))
    return spark.createDataFrame(rows, SCHEMA)
