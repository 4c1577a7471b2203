"""Operators against plain Python, their plans, sources and sinks, and all queries against their SQL."""

import os
import random
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideflow import operators as ops
from tideflow import sources
from tideflow.functions import int32_wrap, tokens
from tideflow.plans import catalogue
from tideflow.streaming import stream_word_count

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else (list(r[i]) if isinstance(r[i], list) else r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = oracle.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, want.fetchall())


@pytest.mark.parametrize("keys, n", [(10, 0), (1, 50), (20, 1000), (500, 500)])
def test_grouping(spark, keys, n):
    rng = random.Random(n)
    data = [(rng.randrange(keys), rng.randrange(1 << 31)) for _ in range(n)]
    # empty, but not so that the optimizer knows it
    df = spark.createDataFrame(data or [(-1, 0)], "k int, v int").where("k >= 0")
    groups = defaultdict(list)
    for k, v in data:
        groups[k].append(v)
    assert dict(ops.reduce_by_key(df, "k", v=F.sum("v")).collect()) == {k: sum(v) for k, v in groups.items()}
    wrapped = {k: (sum(v) + 2**31) % 2**32 - 2**31 for k, v in groups.items()}
    assert dict(ops.reduce_by_key(df, "k", v=int32_wrap(F.sum("v"))).collect()) == wrapped
    assert dict(ops.value_sort(df, "k", "v").collect()) == {k: sorted(v) for k, v in groups.items()}
    xor = ops.fold_by_key(df, "k", "v", F.lit(0), lambda a, x: a.bitwiseXOR(x), "x")
    assert all(r.x is not None for r in xor.collect())
    seen = ops.per_partition(df, "k", 6, lambda batches: iter([pa.record_batch({"n": [sum(b.num_rows for b in batches)]})]), "n bigint").collect()
    assert len(seen) == (6 if n else len(seen)) and sum(r.n for r in seen) == n


def test_joins_and_nulls(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, x string")
    b = spark.createDataFrame([(1, 5), (1, 3), (3, 9), (None, 7)], "k int, y int")
    count = lambda df: df.count()
    assert count(ops.broadcast_join(a, b, "k")) == count(ops.sort_join(a, b, "k")) == 4
    assert count(ops.sort_join(a, b, "k", null_safe=True)) == 5
    assert sorted((r.x, r.y) for r in ops.lookup_join(a, b, "k", ["y"]).collect()) == [("a", 3), ("b", 3)]
    assert count(ops.anti_join(a, b, "k")) == 2 and count(ops.semi_join(a, b, "k", null_safe=True)) == 3
    assert count(ops.outer_join(a, b, "k", "full")) == 8
    assert count(ops.duplicate(a, 3)) == 12 and count(ops.duplicate(a, 0)) == 0


def test_plans(spark):
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    lines = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    assert "BroadcastHashJoin" in plan(ops.broadcast_join(lines, orders, "o_orderkey"))
    assert "SortMergeJoin" in plan(ops.broadcast_join(lines, orders, "o_orderkey", limit=0).hint("merge")) or "Join" in plan(ops.broadcast_join(lines, orders, "o_orderkey", limit=0))
    assert "SortMergeJoin" in plan(ops.sort_join(orders, lines, "o_orderkey"))
    assert "partial_" in plan(ops.reduce_by_key(lines, "l_suppkey", n=F.count("*")))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan(catalogue.QUERIES["one_to_one_filter"](spark, SF))


def test_text_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_bytes("b A\rb\nK x1y\n\nb".encode())
    lines = sources.scan_text_lines(spark, str(path))
    assert lines.count() == 4
    counts = ops.reduce_by_key(ops.flat_map(lines, tokens("value"), "w"), "w", n=F.count("*"))
    assert dict(counts.collect()) == {"b": 3, "a": 1, "x": 1, "y": 1}
    sources.write_text_single(counts.orderBy("w"), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) == 1 and files[0].read_text() == "a 1\nb 3\nx 1\ny 1\n"
    made = sources.generate(spark, 7, lambda i: iter([pa.record_batch({"x": pa.array([i] * i, pa.int64())})]), "x bigint")
    assert made.count() == 21 and sources.generate(spark, 0, lambda i: iter(()), "x bigint").count() == 0
    assert sources.collect_groups(sources.scan_rows(spark, [(1, 2), (1, 3)], "k int, v int", 2), "k", "v").keys() == {1}


def test_streaming_word_count(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text("one two\nTwo")
    stream = spark.readStream.text(str(tmp_path / "s"))
    query = stream_word_count(stream).writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    assert dict(spark.sql("select word, n from streamed").collect()) == {"one": 1, "two": 2}
