"""Fixtures of these tests; imported by name, as the folder above has a conftest of its own."""

import random

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs; source by doc_id, one extra column with a clashing name."""
    def make(rows, extra=()):
        data = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(data, DOC_SCHEMA)
        for name in extra:
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit(7))
        return df
    return make


@pytest.fixture
def rng():
    return random.Random(5)


