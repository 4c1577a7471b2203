"""Queries of the graph runtime, sources and sinks against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tideflow.operators import with_scalars
from tideflow.plans import catalogue, runtime_queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "documents")


def normal(rows):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", [*runtime_queries.QUERIES, "fanout_two_consumers", "key_byte_order", "wordcount", "flatmap_tokens", "cogroup_anti", "cogroup_semi", "cogroup_left_outer"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    module = runtime_queries if name in runtime_queries.QUERIES else catalogue
    got = module.QUERIES[name](spark, SF)
    want = con.execute(module.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert normal(got.select(*names).collect()) == normal(want.fetchall())


def test_scalars(spark):
    df, two = spark.range(3), spark.range(2).withColumnRenamed("id", "s")
    assert with_scalars(df, two.limit(1)).count() == 3
    assert [r.s for r in with_scalars(df, two.limit(0)).collect()] == [None] * 3
    with pytest.raises(Exception, match="more than one row"):
        with_scalars(df, two).where(F.col("s") >= 0).collect()
