import random

import pytest
from pyspark.sql import functions as F

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, words string, key long, nid long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, near copies, shared passages, clashing column names."""
    rng = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in ("ta", "ré", "ñu", "x", "日") for b in ("lo", "m1", "ss") for c in ("", "k", "'s", "!", "İ")]
    text = lambda n: " ".join(rng.choice(vocab) + str(rng.randrange(40)) for _ in range(n))
    base, passage = text(120), text(50)
    texts = [None, "", " \t\n\x0b ", "one", "one two three four", base, base, base + " tail", "head " + base, text(30) + "\n" + passage + " " + text(9), passage + " " + text(40)]
    texts += ["a " * 90, "a b " * 40 + text(3), text(34), passage[:-4], text(3000) + " " + passage, "<|endoftext|> it's\x1c 12  \n\n x", "\U0001f600 é" * 3]
    rows = [(i, t, "en" if i % 3 else None, None, None, "f", "w", 1, None) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, None, "s", 1, None, None, None, 5), (None, None, None, None, None, None, None, None, None), (5, "another text under an old id", "en", "s", 3, "", "", 0, 0)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where(F.lit(False))


def rows_of(df, *cols):
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
