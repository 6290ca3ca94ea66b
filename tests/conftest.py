import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, n long, key string, score string, places string"


@pytest.fixture
def odd_documents(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, and columns whose names the operators use inside."""
    long_ = "the quick brown fox jumps over the lazy dog again " * 4000
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "src1"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "src1"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "src1"), (3, "", None, None), (4, None, None, "src2"), (5, " \n\t ", "fr", "src3"), (6, "1234 5678", "fr", "src3"),
        (7, long_, "en", "src4"), (8, long_, None, "src4"), (9, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 4785380592391140 ok', "en", "src5"), (10, "é", "fr", "src6"), (None, "a text without an id that has some words", "en", None),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 7, 7, "k", "s", "p") for r in rows], DOCS)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
