import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, blank and long texts, copies, near copies, a repeated row, a column whose name clashes."""
    base = prose(1, 200)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, base, "a", "x"), (2, base, "a", "x"), (3, " ".join(near), "b", None), (4, None, "b", "x"), (5, "", None, "x"), (6, " \n\t ", "a", "x"),
        (7, prose(2, 4000), "a", "x"), (8, "two words", "c", "x"), (8, "two words", "c", "x"), (None, prose(3, 80), "c", "x"), (9, "Two  WORDS\n", "a", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
