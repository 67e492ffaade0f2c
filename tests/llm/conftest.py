import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, sig string, part int"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, short, empty and null texts, a very long one, and odd characters."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    out = [None, "", " \n\t ", "a", "b c", "a", "One two. three four", "ONE two. three four", "!!! ...", "é", "naïve Ünïcode ß ’s don't 12 ½"]
    passage = prose(rng, 30, words)
    for _ in range(25):
        out.append(prose(rng, rng.randrange(5, 120), words))
    for k in range(12):
        base = out[11 + k].split()
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
        out.append(f"{prose(rng, 20, words)} {passage}\n{prose(rng, 5, words)}")
    out += [out[11]] * 4 + ["To " * 60, "long " + prose(rng, 20_000, words)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names operators use inside; two rows are repeated whole."""
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t else None, i, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[12:14], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
