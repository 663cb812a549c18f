"""Small documents with the hard cases: nulls, empty, long, repeated rows, ties, clashing extra columns, one of them with a dot."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, h string, size string"


def documents(n=60, seed=3):
    rng = random.Random(seed)
    words = [a + b for a in ("the", "on", "éau", "über", "ñez", "qu") for b in ("", "ing", "tion", "!!", ",")]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6)))
        rows.append((i * 7 % 1009, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", None]), len(text), "x", "y", "z"))
    rows += [(2000, None, None, "a", None, None, None, None), (2001, "", "en", "b", 0, "x", "y", "z"), (2002, " \t\n", "en", None, 3, "x", "y", "z")]
    rows += [(2003, rows[0][1], "en", "a", 1, "x", "y", "z"), (2004, rows[0][1].upper(), "en", "a", 1, "x", "y", "z"), rows[1], rows[1]]
    rows += [(2005, "word " * 30_000, "en", "e", 1, "x", "y", "z"), (None, rows[2][1], "en", "a", 1, "x", "y", "z"), (None, None, None, None, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).withColumn("meta.len", F.length("lang"))
