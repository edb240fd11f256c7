"""A fixture of the tests in this folder; their modules import it by name."""

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text) rows, with further columns of clashing names."""
    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F
            clash = ["id", "node", "h", "score", "rule", "host", "removed", "clean_text", "d", "x", "key", "u", "v", "y", "root", "token", "value"]
            df = df.withColumns({c: F.lit("clash") for c in clash})
        return df
    return make
