import pytest

WORDS = "river stone lamp window garden winter paper silver copper morning harbour engine market letter forest bridge candle music island summer".split()


def prose(seed: int, n: int) -> str:
    """n words of invented prose, the same for the same seed."""
    import numpy as np

    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 40, n)))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = prose(1, 30_000)
    rows = [
        (1, None, "en", "a", 0, 7, "x"),
        (2, "", None, "a", 0, None, None),
        (3, " \n\t ", "en", None, None, 1, "x"),
        (4, long, "en", "a", 1, 1, "x"),
        (5, long.upper(), "de", "a", 1, 1, "x"),
        (6, prose(2, 80), "en", "a", 1, 1, "x"),
        (6, prose(2, 80), "en", "a", 1, 1, "x"),
        (7, prose(2, 80), "fr", "b", 1, 1, "x"),
        (None, prose(3, 60), "en", "a", 1, 1, "x"),
        (None, None, None, None, None, None, None),
        (8, "one", "en", "a", 1, 1, "x"),
        (9, "</s> <|endoftext|> <|im_end|> \\ émigré 日本", "en", "a", 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, fp string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
