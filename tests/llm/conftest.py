import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, data int, n int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_texts():
    """Nulls, empties, short and long texts, exact and near copies, shared passages, odd white space."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(30, 160)) for _ in range(24)]
    passage = words(rng, 60, 5000)
    out = list(base)
    out += [base[0], base[0], base[1].upper(), base[2].replace(" ", "\n\t ")]  # copies
    for k in range(6):  # near copies
        w = base[3].split()
        w[rng.randrange(len(w))] = f"x{k}"
        out.append(" ".join(w))
    out += [f"{words(rng, 20)} {passage} {words(rng, 15)}" for _ in range(5)]
    out += [None, "", "   \n", "one", "Two words", "é ü ñ ß ça", "a" * 3000, "ab " * 900, words(rng, 6000, 50)]
    return out


@pytest.fixture(scope="session")
def texts():
    return list(enumerate(edge_texts()))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], "src", 0 if t is None else len(t), "s", i, i) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and repeated rows."""
    t = " ".join(f"t{i}" for i in range(60))
    rows = [(5, t), (5, t), (None, t), (None, None), (3, None), (9, t + " tail")]
    return spark.createDataFrame([(i, x, "en", "src", 0, None, None, None) for i, x in rows], SCHEMA)
