import random

import pytest


def words(rng, n, size=400):
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, and the odd cases."""
    rng = random.Random(11)
    passage, base = words(rng, 60), words(rng, 120)
    out = [(1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"), (9, "a " * 300), (10, "é日本 " * 40), (11, "x" * 5000), (12, passage + " " + passage)]
    for i in range(40):
        w = base.split()
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 99)}"
        out.append((20 + i, " ".join(w)))
    for i in range(40):
        cut = rng.randint(0, 150)
        out.append((100 + i, words(rng, rng.randint(0, 20)) + " " + passage[cut : cut + rng.randint(0, 250)] + "\n" + words(rng, rng.randint(0, 20))))
    out += [(200 + i, words(rng, rng.randint(1, 30), 5)) for i in range(40)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The documents in a table whose other columns clash with names that operators use."""
    return spark.createDataFrame([(d, t, None, "src0", 1, 2, "k") for d, t in rows], "doc_id long, text string, lang string, source string, n_tokens long, starts long, key string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
