import public_tokenizers
import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, numbered from 0 unless (doc_id, text) pairs are given."""

    def make(texts, **extra):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        for name, value in extra.items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return make


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, a repeated row, a null id, odd characters and a long text."""
    return [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (3, "one two"), (None, "no id"), (5, "\x01 a\u0000b \U0001f600 é" * 3), (6, "word " * 30_000), (7, "x" * 5000)]


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, T.StructType.fromDDL("doc_id long, quality int, toxic int"))

    return make
