import random

import pytest

WORDS = "the of and in that river stone light paper house garden winter market window bridge morning silver copper forest letter music engine planet harbor".split()


@pytest.fixture
def prose():
    def make(n, seed, words=WORDS):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(n))

    return make


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text) rows, with extra columns whose names clash with results."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, ids string, score double")

    return make
