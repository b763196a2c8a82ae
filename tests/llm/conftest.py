import pytest


@pytest.fixture
def docs(spark):
    def make(rows):
        """Documents from (doc_id, text), with columns whose names clash with the operators' own."""
        full = [(i, t, "en", "src0", None if t is None else len(t), "x", 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, node string, grp int")

    return make
