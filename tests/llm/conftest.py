import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w long, n long, key string, hash string, id long, part int"


def rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t), 1, 2, "k", "h", 3, 4) for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text), with more columns whose names the operators use inside."""
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def messy():
    """Null, empty, blank and very long texts, a null id, repeated rows, near copies."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "po", "ru") for b in ("st", "ver", "n", "ing", "ß", "la")]
    line = lambda n: " ".join(rng.choices(words, k=n))
    base = [line(60) for _ in range(8)]
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, "..."), (None, base[0]), (None, None), (5, base[0]), (5, base[0])]
    for k, t in enumerate(base):
        texts.append((10 + k, t))
        w = t.split()
        w[20] = "edited"
        texts.append((30 + k, " ".join(w)))
        texts.append((50 + k, "\n".join([line(12), t, line(3), line(12)])))
    texts.append((99, " ".join(base) * 40))
    texts += [(200 + k, " ".join(base[0].split()[: 40 + k] + [line(1)] * 2)) for k in range(15)]
    return texts
