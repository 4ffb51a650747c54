import pytest


@pytest.fixture(scope="session")
def tiny(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    line = "one two three four five six seven eight nine ten"
    rows = [
        (1, "", "en", "a", 0),
        (2, None, None, None, None),
        (None, f"no id\n{line}", "en", "a", 5),
        (None, None, "en", None, 5),
        (3, long, "en", "b", len(long)),
        (4, long, "en", "b", len(long)),
        (5, f"{line}\nand more", "fr", "c", 9),
        (5, f"{line}\nand more", "fr", "c", 9),
        (6, f"{line.replace('four', 'vier')}\n\n \t\n{line}", "fr", "c", 9),
        (7, " \t\n", "fr", "", 3),
        (8, "▁ mark \U0001f600 é \x00   x", "fr", "", 3),
        (9, "ab ab ab ab ab ab ab ab " * 60, "fr", "z", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("fp", "rid", "at", "key", "removed", "size", "label", "score", "block", "copies", "grade", "whole"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
