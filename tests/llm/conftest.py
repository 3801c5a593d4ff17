import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, short texts, odd white space."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["The", "of", "élan", "İx", "Straße", "a|b", "##", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(120)
    rows = [
        (1, None, "en", "s1", None), (2, "", None, "s1", 0), (3, "   \n\t ", "en", None, 5), (None, base, "en", "s2", 3), (None, None, None, None, None),
        (4, base, "en", "s1", 1), (5, base, "en", "s1", 1), (5, base, "en", "s1", 1), (6, base + " tail", "en", "s2", 1),
        (7, "one two three", "en", "s2", 1), (8, text(3000), "en", "s3", 1), (9, " nbsp  word", "en", "s3", 1),
        (10, "line a b c\nline a b c\n\nline a b c\r\n" * 12, "en", "s3", 1), (11, "spam " * 90, "en", "s1", 1), (12, text(60).replace(" ", "\x0b"), "en", "s1", 1),
    ]
    rows += [(k, text(rng.randint(1, 160)) + ("\n" + text(70)) * rng.randint(0, 2), "de", rng.choice(["s1", "s2", None, "Z"]), k) for k in range(20, 110)]
    rows += [(k, base.replace("w1 ", "w2 ", k % 3) + f" x{k % 7}", "fr", "s9", k) for k in range(200, 215)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
