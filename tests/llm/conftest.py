import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, row string, n int, _text string"


def frame(spark, texts, ids=None, langs=None):
    """Documents with columns whose names the operators use within."""
    rows = [((ids or range(len(texts)))[i], t, (langs or ["en"] * len(texts))[i], "s", 0, "k", 0.5, "r", 1, "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda *a, **k: frame(spark, *a, **k)


PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the old stone tower by the river"
#: Nulls, empty and blank texts, ties, one very long text, one without white space, characters of all kinds.
ODD = [None, "", "   \n\t ", PROSE, PROSE, PROSE.upper(), PROSE.replace(" ", "  \n"), "short", "x" * 5000, "a b " * 20000, "Ünïcödé 日本語 😀 ΣΊΣΥΦΟΣ", PROSE + " and more words follow here today", "<|endoftext|> \x00 \x1c z"]


@pytest.fixture(scope="session")
def odd(make):
    return make([*ODD, None, PROSE], ids=[*range(len(ODD)), None, None])
