import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows and ids, odd white space, other scripts."""
    rng = random.Random(5)
    passage = words(rng, 60)
    rows = [
        (1, None, None, None, None), (None, "no id here", "en", "a", 10), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", None, 5), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3),
        (5, "the same text in two rows", "en", "b", 25), (6, "the same text in two rows", "en", "b", 25), (7, "é日本😀 \u3000wide\u00a0space #$% | <x>\nline\nline\n\nline", "xx", "é", 9),
        (8, "Orre " * 3000, "en", "b", 15000), (9, words(rng, 50) + " " + passage + " " + words(rng, 30), "en", "c", 900), (10, words(rng, 20) + " " + passage + "  \n" + words(rng, 70), "de", "c", 900),
        (11, passage + " " + words(rng, 5) + " " + passage, "de", "c", 900), (12, "a<|endoftext|>b  it's I'LL x\u0085y", "en", "d", 20), (13, words(rng, 300) + " idiot " + words(rng, 20), "en", "d", 2000),
    ]
    long = words(rng, 200).split()
    rows += [(100 + k, " ".join(w if (j * 7 + k) % 190 else f"edit{k}" for j, w in enumerate(long)), "en", "b", 1200) for k in range(12)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    """The rows with more columns, some of whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("h", "size", "bucket", "key", "row", "fp", "spans", "tkey", "_mask", "kept_words")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
