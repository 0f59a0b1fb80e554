"""Small tables with all the odd cases: nulls, empty texts, ties, repeated rows, clashing names."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, `a.b` string"


def documents(spark, rows):
    """rows: (doc_id, text, source); further columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None, "k", "s", "dot") for i, t, s in rows], SCHEMA)


WORDS = "the of and to in that is was for on with as his they at be this have from or one had by word but not what all were".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def odd_rows():
    long = prose(1, 3000)
    return [
        (1, prose(2, 80), "a"), (2, prose(2, 80), "b"), (3, prose(2, 80) + " extra", "a"), (4, None, None), (5, "", "a"), (6, " \t\n ", "b"),
        (None, "no id here", "a"), (None, prose(2, 80), "a"), (7, long, "c"), (8, long + " tail", "c"), (9, "one", "a"), (9, "one", "a"), (9, "two", None), (10, "ünï çødé ✓ 😀", "b"),
    ]
