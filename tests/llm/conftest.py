import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, salt int, m string, fp long, label string, file string, key string, later string"

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a jug of strong purple ink near the old stone bridge and nobody minds the noise at all because winter evenings are long here and stories help to pass the time until the kettle sings again on the iron stove"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"{w}{i % 97}" for i in range(4000) for w in ("alpha", "beta", "gamma"))
    texts = [PROSE, PROSE, "", None, "x", long_text, "y" * 20_000, PROSE.replace("fox", "cat"), "\n\n \t", "#*$ " * 80, "é ü ß ñ İ Σ", "repeat me " * 100]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "h", i, "m", 5, "l", "f", "k", "z") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, PROSE, None, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
