import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd signs, and columns whose names clash."""
    long = "w1 w2 w3 w4 w5 w6 " * 3000 + "x" * 50_000
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, "one two three", None, "s", 13), (5, "one  two\nthree", "en", "s", 14),
        (6, long, "en", "s", len(long)), (7, "a\u0001b é 😀 \x1c x y 中文字 <|endoftext|> don't", "fr", "t", 1), (8, "one two three", "en", "s", 13), (8, "one two three", "en", "s", 13),
        (None, "no id here at all, none", "en", "s", 20), (9, "call +1 (555) 123-4567 or a@b.c_d@e.f at 1.2.3.4.5.6.7.8", "en", "s", 1),
        (10, "1" * 3000 + " " + "a" * 3000 + "@", "en", "s", 1), (-5, "A b C d E f g h i j k l", "en", "s", 1), (11, "a B c d e f g h i j k L", "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 AS n_words", "'x' AS kept", "2 AS size", "3 AS piece", "4 AS keep_id", "5 AS n", "6 AS score", "7 AS digest", "8 AS shard")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
