"""Small tables with the awkward cases, and plain versions of the operators."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n)]


def awkward(seed=0, n=40):
    """Random texts, copies, shared passages, nulls, empties, a long text, ties
    and repeated rows."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    rows = [(k, " ".join(words(rng, rng.randrange(1, 120))), "en") for k in range(n)]
    rows += [(n + 1, rows[3][1], None), (n + 2, rows[3][1], "en"), (n + 2, rows[3][1], "en")]
    rows += [(n + 3, f"{' '.join(words(rng, 9))}\n\n{passage}  end", "fr"), (n + 4, f"start\t{passage}", "fr"), (None, passage, "fr")]
    rows += [(n + 5, None, "en"), (n + 6, "", "en"), (n + 7, " \n\t ", "en"), (n + 8, None, None), (n + 9, " ".join(words(rng, 9000, 5000)), "de")]
    rows += [(n + 10, "same " * 70, "en"), (n + 11, "\u2003odd\u00a0space x\x1cy", "en")]
    rng.shuffle(rows)
    return rows


def split(text):
    return (text or "").encode().split()
