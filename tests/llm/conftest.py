import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q string, cls long, size long, blob string, unit long, bucket int, _d string, path string"


def words(rng, n, vocabulary=60):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(1 + k % 5)) for k in (rng.randrange(vocabulary) for _ in range(n)))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts: prose, copies, near copies, nulls, empties, blanks, ties and a very long one."""
    rng, out = random.Random(7), []
    for k in range(120):
        kind = k % 12
        if kind == 0:
            t = None
        elif kind == 1:
            t = rng.choice(["", " \n\t", "one", "Two words"])
        elif kind in (2, 3) and out:
            t = rng.choice([x for _, x in out if x] or ["x"])
        elif kind == 4 and out:
            w = (rng.choice([x for _, x in out if x and len(x) > 50] or ["a b c d e f"])).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        else:
            t = words(rng, rng.randrange(3, 150), 100000) + rng.choice(["", ".", "\nline one\nline one\n"])
        out.append((k, t))
    return [*out, (500, words(rng, 6000, 100000)), (501, "ab" * 3000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with extra columns whose names operators use inside."""
    rows = [(i, t, None, None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "x", 1, 2, "b", 3, 4, "d", "p") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and repeated rows."""
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (2, None), (None, None)]
    return spark.createDataFrame([(i, t, "en", None, 1, "x", 1, 2, "b", 3, 4, "d", "p") for i, t in rows], SCHEMA)
