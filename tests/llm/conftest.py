import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def text(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, set string, prefix string, shard int"


def rows():
    """Nulls in every column, empty and blank texts, long ones, repeated rows, equal texts."""
    out = [(i, text(i, 30 + i), "en", f"s{i % 3}", 1) for i in range(40)]
    out += [(100, None, "en", "s1", None), (101, "", None, "s1", 0), (102, " \n\t ", "en", None, 3), (103, "one", "en", None, 3), (104, "one two three", "en", "s2", 3)]
    out += [(None, text(7, 50), "en", "s1", 1), (None, None, None, None, None), (5, text(5, 35), "en", "s2", 1), (5, text(5, 35), "en", "s2", 1), (6, text(99, 40), "en", "s2", 1)]
    out += [(200 + i, text(3, 33), "de", "s0", 1) for i in range(5)]  # copies
    out += [(300 + i, text(3, 33) + f" extra{i}", "de", "s0", 1) for i in range(5)]  # near copies
    out += [(400, text(1, 6000), "fr", "s1", 1), (401, "é ü 'quoted' it's   spaced\n\nout\r\nİß <|endoftext|> a", "fr", "s1", 1)]
    return [(*r, 0.5, 7, "x", "y", 3) for r in out]  # columns whose names the operators use inside


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
