import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h long, gram string, score string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice(['ra', 'ti', 'lo', 'n', 's', 'ß', 'é'])}" for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """Texts with copies, near copies, shared passages, short, empty and null ones, odd white space and a repeated row."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "ANDERS"
    passage = text(70)
    docs = [(0, base), (1, base), (2, base.upper()), (3, " ".join(near)), (4, None), (5, ""), (6, "  \t\n "), (7, "kurz"), (8, "Kurz"), (9, "a b c d"), (10, "a b c d e"), (11, "a b c d e")]
    docs += [(20 + i, f"{text(40)} {passage} {text(15)}") for i in range(4)]
    docs += [(30, f"{passage}\n{passage}"), (31, "é" * 150 + " " + "é" * 150), (32, "x" * 900), (33, text(3000)), (34, base[:700]), (35, " a b \x1c c"), (36, "\U0001f600 𝔘 ß Σας İ ǅ")]
    docs += [(40 + i, text(rng.randrange(1, 90))) for i in range(20)]
    return docs + [(1, base)]


@pytest.fixture(scope="session")
def frame(spark, corpus):
    """The corpus with columns whose names the operators use inside."""
    rows = [(d, t, "en", "s", len(t or ""), "x", 1, "y", "z") for d, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
