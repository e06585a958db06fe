"""Small tables with every awkward row the operators promise to handle."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp int, score array<int>, tid string, h double"


def sentence(rng: random.Random, words: int) -> str:
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


def rows(texts: list) -> list[tuple]:
    """(doc_id, text, ...) from texts or (doc_id, text, source); the last five columns clash with inner names."""
    out = []
    for k, x in enumerate(texts):
        doc_id, text, source = x if isinstance(x, tuple) else (k, x, f"src{k % 3}")
        out.append((doc_id, text, "en", source, len(text or ""), "x", 1, [1], "y", 0.5))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    def make(texts: list):
        return spark.createDataFrame(rows(texts), SCHEMA)
    return make


@pytest.fixture(scope="session")
def awkward() -> list:
    """Null, empty, blank and very long texts, exact copies, a repeated row, a null source and a null doc_id."""
    rng = random.Random(4)
    long = sentence(rng, 30_000)
    plain = [sentence(rng, rng.randint(1, 150)) for _ in range(40)]
    return [*plain, None, "", " \t\n", long, plain[0], plain[0], (100, plain[1], None), (100, plain[1], None), (None, plain[2], "src1"), (102, "é中文 \U0001f600 <|endoftext|>", "src0")]
