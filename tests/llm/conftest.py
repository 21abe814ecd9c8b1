import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a table of documents from (doc_id, text) pairs or whole rows."""

    def make(found, **extra):
        full = [
            row if len(row) == 5 else (*row, "en", "src1", None if row[1] is None else len(row[1]))
            for row in found
        ]
        df = spark.createDataFrame(full, DOCUMENTS)
        for name, value in extra.items():
            df = df.selectExpr("*", f"{value} AS {name}")
        return df

    return make


@pytest.fixture
def vectors(spark):
    def make(found):
        return spark.createDataFrame(found, "vec_id long, embedding array<float>, label int")

    return make
