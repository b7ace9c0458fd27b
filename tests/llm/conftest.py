import pytest

#: Cases that every operator must take: nulls in any column, empty and blank texts, repeated rows, a long text.
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta " * 3, "en", "s", 1),
    (1, "alpha beta gamma delta " * 3, "en", "s", 1),
    (2, None, "en", "s", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "en", "s", 4),
    (None, "no id at all but several words", "en", "s", 5),
    (None, None, None, None, None),
    (5, LONG, "en", "s", len(LONG)),
    (6, "Ünïcödé 日本語テキスト 🎉 !!! ???", "xx", "s", 30),
    (7, "one", "en", "s", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside
CLASH = ("id", "key", "node", "f0", "anchor", "frag", "at", "size", "n", "gone", "GONE_", "cuts", "cut_id", "toxicity", "quality", "y", "text_", "rank", "piece")


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit(9).alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
