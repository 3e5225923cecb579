import pytest

TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 34), (2, "", "en", "s", 0), (3, None, None, None, None),
    (4, "word " * 3000, "en", "s", 15000), (5, "x" * 200_000, "en", "s", 200_000), (6, "é 日本語 😀\t\n mixed  spaces", "fr", "s", 20),
    (7, "alpha beta gamma delta epsilon zeta", "en", "s", 34), (7, "alpha beta gamma delta epsilon zeta", "en", "s", 34),
    (None, "no id here but some words follow", "en", None, 10), (8, "ALPHA Beta gamma delta epsilon zeta", "en", "s", 34),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """Extra columns named like outputs of the operators."""
    from pyspark.sql import functions as F

    names = ("ids", "n_tokens", "n_words", "n_hit", "items", "matches", "score", "pii", "n", "id", "doc", "mark", "kept", "key")
    return odd_docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
