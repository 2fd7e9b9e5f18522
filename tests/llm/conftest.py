import pytest

#: A table's usual columns, and others whose names clash with those that operators make.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, fp string, word string"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, repeat=1):
        """rows: (doc_id, text); all other columns hold something unfit for the operators' own."""
        return spark.createDataFrame([(i, t, None, None, None, -1.0, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def sf_labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
