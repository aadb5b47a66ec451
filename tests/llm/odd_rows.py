import random

import pytest

SF = "/root/testdata/sf0.001"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.expovariate(1 / 60)), vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns named like results."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (1, base, "a"), (2, base, "a"), (3, " ".join(edited), "b"), (4, "", None), (5, None, "b"), (6, long, "a"),
        (7, long + " tail", "a"), (8, "one two", "c"), (9, "One  TWO", "c"), (10, "x", None), (11, "\n\t \r", "c"),
        (12, "naïve Ünïcode ßtraße here <|endoftext|> </s> it's 123", "d"), (12, "naïve Ünïcode ßtraße here <|endoftext|> </s> it's 123", "d"),
        (None, "no id at all but some words in a row", "d"), (None, None, None), (13, prose(rng, 50), "e"), (13, prose(rng, 50), "e"),
    ] + [(100 + i, prose(rng, rng.randrange(5, 90)), rng.choice("abc")) for i in range(40)]
    data = [(i, t, s, "en", len(t or ""), "clash", 7) for i, t, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long, kept string, shard int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("1 = 0")


def ordered(df, *cols):
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))
