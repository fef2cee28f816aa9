import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, component string"


def texts(n: int = 60, seed: int = 3) -> list[str]:
    """Invented texts with copies, near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeghiost", k=rng.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    line = " ".join(rng.choices(vocabulary, k=9))
    out: list[str] = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([3, 12, 40, 90]))
        t = "\n".join(" ".join(words[k : k + 11]) for k in range(0, len(words), 11))
        if i % 5 == 1:
            t = out[rng.randrange(len(out))]
        if i % 5 == 2:
            w = out[rng.randrange(len(out))].split(" ")
            w[rng.randrange(len(w))] = "Changed"
            t = " ".join(w)
        if i % 7 == 3:
            t += "\n" + passage
        if i % 4 == 0:
            t += "\n" + line
        if i % 8 == 0:
            t += "\n" + line.replace(line.split()[3], "other", 1)
        out.append(t)
    return out


EDGES = [(None, None), (1000, None), (1001, ""), (1002, "   \n\t "), (1003, "12 34 ### !!"), (1004, "ä" * 60 + " éé ñ 漢字 " * 9), (1005, "a"), (1006, "x y " * 4000), (1007, "x y " * 4000), (None, "x y " * 40), (1008, "\n\n\n")]


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Rows of documents with every edge case, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", "b", None)[i % 4], len(t), 1, "c") for i, t in enumerate(texts())]
    rows += [(i, t, "en", "a", None, None, None) for i, t in EDGES]
    return rows + rows[4:6]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts_by_id(corpus) -> dict[int, str]:
    return {r[0]: r[1] or "" for r in corpus if r[0] is not None}
