"""Every query of the engine proper against its SQL."""

import pytest

from eventloom.plans import checks, queries, stateful  # noqa: F401
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        same(df, con, queries.ORACLE_SQL[name])
    else:
        # Held against batch results below.
        assert name in ("stream_pipeline", "stream_dedup")


def test_stream_equals_batch(spark):
    from pyspark.sql import functions as F

    from eventloom.functions import rules
    from eventloom.plans import fixtures

    docs = fixtures.table(spark, SF, "documents")
    batch = docs.where(rules.is_candidate(F.col("text"), 3.0, queries._WORDS)).select("doc_id")
    stream = queries.stream_pipeline(spark, SF).select("doc_id")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))
    from eventloom.functions.text import content_hash

    distinct = docs.select(content_hash(F.coalesce("text", F.lit("")), F.lit(None).cast("date"))).distinct()
    assert sorted(map(tuple, queries.stream_dedup(spark, SF).collect())) == sorted(map(tuple, distinct.collect()))


def test_stream_dedup_hashes_whole_texts(spark, tmp_path):
    from pyspark.sql import functions as F

    from eventloom.functions.text import content_hash

    texts = ["a" * 600 + " one", "a" * 600 + " two", "a" * 600 + " two", "short", "Short!", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = [r.content_hash for r in queries.stream_dedup(spark, str(tmp_path)).collect()]
    want = docs.select(content_hash(F.coalesce("text", F.lit("")), F.lit(None).cast("date"))).distinct().collect()
    assert len(found) == 4 and sorted(found) == sorted(r[0] for r in want)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
