from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text) pairs, with the other columns filled in."""

    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def prose():
    """Reproducible texts of invented words."""
    import random

    def make(seed: int, n: int, vocabulary: int = 5000) -> str:
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))

    return make
