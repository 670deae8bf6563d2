import pytest
from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table of ``(doc_id, text)`` or longer rows, with columns that clash with
    every result column."""
    def make(rows, clash=True):
        full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        if clash:
            for name in ("key", "row", "size", "shard", "ids", "score", "kept", "host", "token",
                         "position", "before", "taken", "n_words", "component_id", "c", "nk"):
                df = df.withColumn(name, F.lit("clash"))
        return df
    return make


HARD_TEXTS = [None, "", " \n\t", "a", "A a", "x " * 3000, "w" * 40_000, "é" * 500 + "\n" * 300,
              "same text here", "same text here", "mixed \x0b\x0c\r blanks", "日本語 текст ñandú"]
