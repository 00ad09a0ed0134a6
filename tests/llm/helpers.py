"""Small tables with every awkward case."""

from __future__ import annotations

import random

SF_SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def awkward(spark):
    """Null and empty texts, null ids, repeated rows, ties, a long text, columns named like internal ones."""
    long = words(30_000, 1)
    base = words(60, 2)
    near = base.rsplit(" ", 1)[0] + " changed"
    rows = [
        (1, base, "en", "src1"), (2, base, "en", "src1"), (3, near, "en", None), (4, None, None, "src2"), (5, "", "de", "src2"),
        (6, "   \t\n", "de", "x"), (7, long, "fr", "src3"), (8, long, "fr", "src3"), (9, words(60, 3), "es", "src9"), (9, words(60, 3), "es", "src9"),
        (10, "one two", "en", "src0"), (11, "ONE two", "en", "src0"), (None, words(20, 4), "en", "src1"), (None, None, None, None),
        (12, "mail ann@example.com and 10.0.0.1 😀 +1 (212) 555-0100", "en", "src1"),
    ]
    schema = DOCUMENTS + ", id long, n long, score double, label string, key long, uid long, __id string, row long, sig string"
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 1, 2, 0.5, "l", 3, 4, "u", 5, "s") for i, t, la, s in rows], schema)


def no_rows(df):
    return df.where("1 = 0")


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
