import random

import pytest

WORDS = "harbor silver canyon market garden winter engine paper bridge copper valley thunder orange planet window forest pencil rocket island velvet".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words, the same for a seed."""

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        out = []
        for i in range(n):
            w = r.choice(WORDS) + str(r.randrange(50))
            out.append(w + ("." if i % 9 == 8 else ""))
        return " ".join(out)

    return make


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Rows with nulls, empty and long texts, repeated rows, and extra columns whose names clash with those that operators add."""
    long = prose(1, 6000)
    rows = [
        (1, prose(2, 40), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, "   \n\t ", "en", "b", 6), (5, long, "en", "a", len(long)),
        (6, prose(2, 40), "en", "a", 1), (7, "x", "en", None, 1), (8, "naïve ☃ café", "fr", "c", 12), (8, "naïve ☃ café", "fr", "c", 12), (None, "no id here", "en", "c", 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("id", "size", "shard", "slot", "score", "spans", "row", "rep", "bucket", "cut_starts", "__x")})
