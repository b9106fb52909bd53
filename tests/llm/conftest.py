import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank, long, repeated and odd texts, and columns named as results."""
    long = " ".join(f"w{i % 997} x{i}" for i in range(20000))
    texts = [None, "", " \n\t ", "a", "A b", "a B", long, long, "the same text twice over " * 6, "ünïcödé 中文字 \U0001f600 end", "x" * 30000, None, "a\x00b", "line\nline\nother\nline"]
    rows = [(i, t, f"s{i % 2}" if i else None, "en", 7, "old", 1.5) for i, t in enumerate(texts)] + [(13, texts[13], "s1", "en", 7, "old", 1.5), (None, "no key at all", "s1", None, 7, "old", 1.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words int, kept string, score double")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where(F.lit(False))
