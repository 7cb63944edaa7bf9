import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string, h string, _salt int, gone string, _gone int, _pii string"


def make_words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Documents with nulls, empty and very long texts, repeated rows, copies, near copies, extra columns."""
    rng = random.Random(3)
    long = " ".join(make_words(rng, 30000, 5000))
    base = make_words(rng, 200)
    near = list(base)
    near[20] = "changed"
    far = [w if rng.random() > 0.3 else "other" for w in base]
    texts = [
        (0, " ".join(base)), (1, " ".join(near)), (2, " ".join(base).upper()), (3, " ".join(far)), (4, None), (5, ""), (6, " \t\n "), (7, "12 !! --"), (8, "one"), (9, "One"), (10, "two words"),
        (11, long), (12, long + " tail"), (13, "a" * 5000), (14, "é ñ ß 你好 <|endoftext|> it's 3.14"), (15, " ".join(base)), (15, " ".join(base)), (None, "no id here at all"), (None, None), (16, " ".join(make_words(rng, 60))),
    ]
    texts += [(20 + i, " ".join(make_words(rng, rng.randrange(1, 80), 3000))) for i in range(40)]
    return [(d, t, "en" if d is None or d % 3 else None, "src", None if t is None else len(t), "x", "y", "z", 1, "g", 2, "p") for d, t in texts]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
