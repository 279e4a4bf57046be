import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

DOC = "doc_id bigint, text string, lang string, score double, digest string, n bigint, code string, ids string, node bigint, `start` bigint"


def p(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.fixture(scope="session")
def texts():
    base = "the cat sat on the mat and looked at 12 birds, then it slept for hours near the old Warm stove"
    return [
        (1, base),
        (2, base),
        (3, base.replace("birds", "dogs") + " " + " ".join(f"w{i}" for i in range(200))),
        (4, base.replace("birds", "dogs") + " " + " ".join(f"w{i}" for i in range(200)) + " end"),
        (5, ""),
        (6, None),
        (7, "one two"),
        (8, "  double  spaces\n\nand\ttabs <|endoftext|> ünï 中文 ​ x y "),
        (9, " ".join(f"word{i % 977}" for i in range(60_000))),
        (None, "a row without an id, kept all the same"),
        (10, "repeated row of some words"),
        (10, "repeated row of some words"),
        (11, "line\n" * 50),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", 0.5, "x", 7, "c", "i", 3, 9) for i, t in texts]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
