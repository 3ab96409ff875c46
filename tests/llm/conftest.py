import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, text_hash long, th long, sig long, id long, label int, votes int, component_id long"


def prose(rng: random.Random, n: int, words: int = 300) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text, lang, source), with further columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), 0.5, 7, 7, 7, 7, 1, 1, 7) for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Null, empty, blank and very long texts, null ids and sources, repeated rows."""
    rng = random.Random(4)
    long = prose(rng, 20_000)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "b"), (4, long, "en", "a"), (5, "one", "en", None), (6, prose(rng, 40), "en", "a"), (6, prose(random.Random(9), 40), "en", "a"), (None, prose(rng, 30), "en", "b"), (None, None, None, None)]
    return frame(rows + rows[3:6])
