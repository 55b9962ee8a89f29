import pytest


@pytest.fixture(scope="module")
def rows(spark):
    """Small documents frames: rows(schema, [(...), ...])."""
    def make(data, schema="doc_id long, text string"):
        return spark.createDataFrame(data, schema)
    return make


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
