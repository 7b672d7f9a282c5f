import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly boxed many jars of liquid".split()


def prose(seed, n):
    import random
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n))


#: Nulls, empty and very long texts, repeated rows, ties and equal ids with different texts.
ODD = [
    (1, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "a"), (3, None, "en", "a"),
    (4, "", None, None), (None, prose(2, 60), "en", "b"), (None, prose(2, 60), None, "b"), (5, "12 34 !!", "de", "b"),
    (6, prose(3, 30000), "en", "b"), (7, "x" * 20000, "en", None), (8, "\n\n \t\n", "en", "a"),
    (9, prose(1, 80) + " tail", "en", "a"), (3, "another text under an id that is taken", "fr", "a"),
    (10, "ein kurzer Text über nichts", "de", "c"), (11, "Ünïcode 🙂 ▁ and ￾ too", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Extra columns whose names the operators might use themselves.
CLASHES = ("kept_id", "dirty_id", "dirty_key", "boilerplate_host", "boilerplate_lines", "print", "fingerprint", "key",
           "found", "spans", "list", "record", "host", "row_id", "n", "base")


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, SCHEMA)
    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
