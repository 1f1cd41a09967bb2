import pytest


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return docs


DOCS = "/root/testdata/sf0.001"
EMPTY = [(1, None), (2, ""), (3, " \n\t "), (None, "an id that is null"), (5, "x"), (5, "x")]
