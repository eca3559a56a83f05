import pytest


@pytest.fixture
def docs(spark):
    """A maker of document tables, with columns whose names clash with those that the operators use inside."""

    def make(rows, partitions=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long, n_shingles long, rep long, row long, value long, first long"
        full = [(i, t, None, "s", None if t is None else len(t), 1, 2, 3, 4, 5) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
