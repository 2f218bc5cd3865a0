import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, fp long, rid string, evidence string, `n` int"


def documents(spark, texts, langs=None, sources=None, ids=None):
    """Documents with extra columns whose names the operators use inside or give out."""
    rows = [((ids[k] if ids else k), t, (langs[k] if langs else "en"), (sources[k] if sources else "s"), len(t) if t is not None else None, 9.5, "x", 7, "r", "e", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma", "delta,", "tin", "OAK", "pine", "éclair", "#x", "key"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    passage = " ".join(f"{rng.choice(words)}{rng.randrange(99)}" for _ in range(120))
    texts = [None, "", " \n\t ", "one", long, long, passage, f"start {passage} end", f"other {passage}", "same words here now", "same words here now", "x" * 3000, "ab " * 400, None, "last, doc with token = \"abcdef123456\" in it"]
    ids = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 11, 12, 13, None]
    sources = ["a", None, "a", "b", "a", "a", None, "b", "c", "c", "c", "a", "a", "a", "b"]
    langs = ["en", None, "fr", "de", "en", "fr", "en", "de", None, "en", "en", "fr", "en", None, "de"]
    return documents(spark, texts, langs, sources, ids)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
