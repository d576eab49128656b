"""A small corpus with the awkward rows that every operator must take."""

import pytest

ODD = [(None, "a text without a key", "en", "s", 20), (90, None, "en", "s", None), (91, "", None, None, 0), (92, " \n\t", "en", "s", 3), (93, "one", "en", "s", 3), (93, "one", "en", "s", 3)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def prose():
    import random

    r = random.Random(3)
    words = ["".join(r.choice(["ka", "to", "mi", "ru", "sen", "lo", "pa"]) for _ in range(r.randint(1, 4))) for _ in range(900)]

    def text(seed, n):
        q = random.Random(seed)
        return " ".join(q.choice(words) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def odd(spark):
    return lambda rows=(): spark.createDataFrame([*ODD, *rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing():
    """The same table with columns whose names operators use themselves."""

    def add(df):
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(7) for c in ("k", "x", "slot", "h", "c0", "__key", "p_good", "ids", "gone", "__new", "__drop", "island")})

    return add
