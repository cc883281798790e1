"""Registered queries: those with SQL against it, the pipeline against its parts."""

import pytest
from pyspark.sql import functions as F

from karst.llm import queries as registered
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, tables, duck, name):
    same_rows(registered.queries()[name](spark, tables).toPandas(), duck.execute(registered.oracle_sql()[name]).df())


def test_pipeline(spark, tables):
    import corpus_pipeline as cp
    from karst.llm.common import Workspace

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    work, sizes = Workspace(spark, "test"), [docs.count()]
    for name, stage in cp.STAGES:
        out = work.keep(stage(spark, docs, tables), name)
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name == "near_dedup":
            assert out.select("doc_id").distinct().count() == out.count() < sizes[-1]
        if name == "pii":
            assert out.count() == sizes[-1] and out.where(F.col("text").rlike("[a-z]@[a-z]+[0-9]*[.]example")).count() == 0
        sizes.append(out.count())
        docs = out
    assert docs.agg(F.max("sequence_id")).first()[0] == (docs.agg(F.sum("length")).first()[0] - 1) // 4096
