import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """A function of (seed, words) giving text of made-up words in sentences and lines."""
    parts = "an ber cor dal en fir gol hes in jor kel lun mor nes or pel ras sen tol ul ver wen".split()

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        words = ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n)]
        out = []
        for i, w in enumerate(words):
            out.append(w + (".\n" if i % 23 == 22 else ". " if i % 9 == 8 else " "))
        return "".join(out).strip()

    return make


@pytest.fixture(scope="session")
def docs(spark):
    """A function of rows (doc_id, text) giving documents with columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, x, "en", "s", len(x or ""), 1, "t", 2.0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long, id long, rep string, score double")

    return make
