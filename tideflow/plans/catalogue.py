"""Registered queries over the star-schema tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import int32_wrap, letter_runs
from ..operators import (
    anti_join, broadcast_join, cogroup, demultiplex, distinct_keys, duplicate, filter_rows, flat_map, gather,
    group_values, lookup_join, outer_join, per_partition, project, reduce_by_key, running, semi_join, sort_join,
    throttle, top_k, unite, value_sort, with_scalars,
)
from ..sources import scan_parquet
from .compiler import Compiler
from .graph import FlowGraph
from .ports import InputPort, Movement, OutputPort
from .processor import ArrowProcessor, Processor

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: scan_parquet(spark, sf_dir, name))
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def total(column: str | Column) -> Column:
    return F.sum(column).cast("bigint")


@query("select w, count(*) n from (select lower(unnest(regexp_extract_all(text,'[A-Za-z]+'))) w from documents) group by 1")
def wordcount(t):
    words = flat_map(t("documents"), letter_runs("text"), "w")
    return reduce_by_key(words.select(F.lower("w").alias("w")), "w", n=F.count("*"))


@query("select l_orderkey,l_linenumber,l_quantity from lineitem")
def scan_project(t):
    return project(t("lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


@query("select o_orderkey,o_totalprice from orders where o_orderstatus='F'")
def one_to_one_filter(t):
    return project(filter_rows(t("orders"), F.col("o_orderstatus") == "F"), "o_orderkey", "o_totalprice")


@query("select doc_id, lower(unnest(regexp_extract_all(text,'[A-Za-z]+'))) w from documents")
def flatmap_tokens(t):
    return flat_map(t("documents"), letter_runs("text"), "w", "doc_id").withColumn("w", F.lower("w"))


@query("select case when o_totalprice>=100000 then 'hi' else 'lo' end port, o_orderkey from orders")
def split_branches(t):
    high = F.col("o_totalprice") >= 100000
    return demultiplex(t("orders"), {"hi": high, "lo": ~high}).select("port", "o_orderkey")


@query("""select 'sum' tag,l_returnflag k,cast(sum(l_quantity) as bigint) v from lineitem group by 2
union all select 'max',l_returnflag,cast(max(l_quantity) as bigint) from lineitem group by 2""")
def fanout_two_consumers(t):
    """One output port with two consumers, whose results a third united."""
    g = FlowGraph()
    scan = g.add_vertex("scan", Processor(outputs=[OutputPort("out", key="k")], fn=lambda: t("lineitem").select(F.col("l_returnflag").alias("k"), "l_quantity")))
    both = g.add_vertex("both", Processor([InputPort("x", Movement.ONE_TO_ONE)], [OutputPort("out")], fn=lambda x: x))
    for tag, column in (("sum", total("l_quantity")), ("max", F.max("l_quantity").cast("bigint"))):
        def one(x, tag=tag, column=column):
            return x.agg(v=column).select(F.lit(tag).alias("tag"), "k", "v")
        v = g.add_vertex(tag, Processor([InputPort("x", Movement.SCATTER_GATHER)], [OutputPort("out")], fn=one))
        g.add_edge(scan.output_port(0), v.input_port(0))
        g.add_edge(v.output_port(0), both.input_port(0))
    return Compiler(SparkSession.active(), g).compile().frames[both.id, 0]


@query("select o_orderkey k from orders union all select l_orderkey from lineitem")
def unite_ports(t):
    return unite(t("orders").select(F.col("o_orderkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k")))


@query("select c_name n from customer union all select s_name from supplier")
def builtin_unite(t):
    g = FlowGraph()
    out = (OutputPort("out"),)
    a = g.add_vertex("customers", Processor(outputs=out, fn=lambda: t("customer").select(F.col("c_name").alias("n"))))
    b = g.add_vertex("suppliers", Processor(outputs=out, fn=lambda: t("supplier").select(F.col("s_name").alias("n"))))
    c = g.add_vertex("copy", Processor([InputPort("x", Movement.ONE_TO_ONE)], out, fn=lambda x: x))
    for v in (a, b):
        g.add_edge(v.output_port(0), c.input_port(0))
    return Compiler(SparkSession.active(), g).compile().frames[c.id, 0]


@query("select n_nationkey,n_name from nation union all select n_nationkey,n_name from nation")
def duplicate_edge(t):
    g = FlowGraph()
    a = g.add_vertex("scan", Processor(outputs=[OutputPort("out")], fn=lambda: t("nation").select("n_nationkey", "n_name")))
    c = g.add_vertex("copy", Processor([InputPort("x", Movement.ONE_TO_ONE)], [OutputPort("out")], fn=lambda x: x))
    for _ in range(2):
        g.add_edge(a.output_port(0), c.input_port(0))
    return Compiler(SparkSession.active(), g).compile().frames[c.id, 0]


@query("select l_suppkey k,cast(sum(l_quantity) as bigint) v from lineitem group by 1")
def reduce_by_key_sum(t):
    return reduce_by_key(t("lineitem").withColumnRenamed("l_suppkey", "k"), "k", v=total("l_quantity"))


@query("select l_suppkey k,cast(((sum(l_orderkey*1000000)::bigint+2147483648)&4294967295)-2147483648 as integer) v from lineitem group by 1")
def reduce_int32_wrap(t):
    return reduce_by_key(t("lineitem").withColumnRenamed("l_suppkey", "k"), "k", v=int32_wrap(F.sum(F.col("l_orderkey") * 1000000)))


@query("""select k,cast(sum(v) as bigint) v from (select o_custkey k,1 v from orders where o_orderstatus='F'
union all select o_custkey,10 from orders where o_orderstatus<>'F') group by k""")
def united_reduce_by_key(t):
    done, key = F.col("o_orderstatus") == "F", F.col("o_custkey").alias("k")
    a = t("orders").where(done).select(key, F.lit(1).alias("v"))
    b = t("orders").where(~done).select(key, F.lit(10).alias("v"))
    return reduce_by_key(unite(a, b), "k", v=total("v"))


@query("select l_suppkey k,list(l_linenumber order by l_linenumber) vs from lineitem group by 1")
def group_values_sorted(t):
    grouped = group_values(t("lineitem").withColumnRenamed("l_suppkey", "k"), "k", "l_linenumber")
    return grouped.select("k", F.array_sort("vs").alias("vs"))


@query("select l_suppkey k,list(cast(l_quantity as bigint) order by l_quantity desc) vs from lineitem group by 1")
def value_sort_desc(t):
    return value_sort(t("lineitem").withColumnRenamed("l_suppkey", "k"), "k", F.col("l_quantity").cast("bigint"), descending=True)


@query("select c_nationkey k,list(c_name order by length(c_name), c_name) vs from customer group by 1")
def value_sort_comparator(t):
    def shorter(a: Column, b: Column) -> Column:
        by_length = F.length(a) - F.length(b)
        return F.when(by_length != 0, by_length).when(a < b, -1).when(a > b, 1).otherwise(0)
    return value_sort(t("customer").withColumnRenamed("c_nationkey", "k"), "k", "c_name", comparator=shorter)


@query("""select k,v from (select l_suppkey k,l_extendedprice v,
row_number() over (partition by l_suppkey order by l_extendedprice desc) rn from lineitem) where rn<=3""")
def top3_per_group(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("v"))
    return top_k(rows, "k", [F.desc("v")], 3)


@query("""select user_id,event_id,cast(count(*) over (partition by user_id order by ts,event_id rows unbounded preceding) as bigint) n
from events""")
def group_running_count(t):
    return running(t("events"), "user_id", ["ts", "event_id"], n=F.count("*")).select("user_id", "event_id", "n")


@query("select distinct l_shipdate k from lineitem")
def distinct_ship_dates(t):
    return distinct_keys(t("lineitem").withColumnRenamed("l_shipdate", "k"), "k")


@query("select l_orderkey k,l_quantity,s_name from lineitem join supplier on l_suppkey=s_suppkey")
def broadcast_hash_join(t):
    build = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return broadcast_join(t("lineitem"), build, "l_suppkey").select(F.col("l_orderkey").alias("k"), "l_quantity", "s_name")


@query("""select o_orderkey k,m.q from orders join
(select l_orderkey,cast(min(l_quantity) as bigint) q from lineitem group by 1) m on o_orderkey=l_orderkey""")
def lookup_join_first(t):
    build = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("bigint").alias("q"))
    return lookup_join(t("orders").select(F.col("o_orderkey").alias("k")), build, "k", ["q"])


@query("""select a.user_id k,a.event_id x,b.event_id y from events a join events b on a.user_id=b.user_id
where a.event_type='click' and b.event_type='error'""")
def sort_join_mn(t):
    one = lambda kind, name: t("events").where(F.col("event_type") == kind).select(F.col("user_id").alias("k"), F.col("event_id").alias(name))
    return sort_join(one("click", "x"), one("error", "y"), "k")


@query("""select coalesce(a.k,b.k) k,coalesce(n0,0) n0,coalesce(n1,0) n1 from (select o_orderkey k,count(*) n0 from orders group by 1) a
full join (select l_orderkey k,count(*) n1 from lineitem group by 1) b on a.k=b.k""")
def cogroup_counts(t):
    sides = {"orders": t("orders").withColumnRenamed("o_orderkey", "k"), "lines": t("lineitem").withColumnRenamed("l_orderkey", "k")}
    counted = cogroup(sides, "k", {"orders": {"n0": F.count("*")}, "lines": {"n1": F.count("*")}})
    return counted.fillna(0, ["n0", "n1"])


def _order_keys(t):
    return t("orders").select(F.col("o_orderkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k"))


@query("select o_orderkey k from orders anti join lineitem on o_orderkey=l_orderkey")
def cogroup_anti(t):
    return anti_join(*_order_keys(t), "k")


@query("select o_orderkey k from orders semi join lineitem on o_orderkey=l_orderkey")
def cogroup_semi(t):
    return semi_join(*_order_keys(t), "k")


@query("select o_orderkey k,l_linenumber from orders left join lineitem on o_orderkey=l_orderkey")
def cogroup_left_outer(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return outer_join(t("orders").select(F.col("o_orderkey").alias("k")), lines, "k", "left")


@query("select l_orderkey k,o_orderstatus from (select * from orders where o_orderstatus='F') right join lineitem on o_orderkey=l_orderkey")
def cogroup_right_outer(t):
    done = t("orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return outer_join(done, t("lineitem").select(F.col("l_orderkey").alias("k")), "k", "right").select("k", "o_orderstatus")


@query("""select n_nationkey k,coalesce(c.n,0) nc,coalesce(p.n,0) ns from nation
left join (select c_nationkey k,count(*) n from customer group by 1) c on n_nationkey=c.k
left join (select s_nationkey k,count(*) n from supplier group by 1) p on n_nationkey=p.k""")
def cogroup_three_way(t):
    sides = {
        "nation": t("nation").withColumnRenamed("n_nationkey", "k"),
        "customer": t("customer").withColumnRenamed("c_nationkey", "k"),
        "supplier": t("supplier").withColumnRenamed("s_nationkey", "k"),
    }
    out = cogroup(sides, "k", {"nation": {"there": F.count("*")}, "customer": {"nc": F.count("*")}, "supplier": {"ns": F.count("*")}})
    return out.where("there is not null").drop("there").fillna(0, ["nc", "ns"])


@query("select o_orderkey k from orders except select l_orderkey from lineitem")
def except_keys(t):
    return _order_keys(t)[0].subtract(_order_keys(t)[1])


@query("select o_orderkey k from orders intersect select l_orderkey from lineitem")
def intersect_keys(t):
    return _order_keys(t)[0].intersect(_order_keys(t)[1])


@query("select cast(t.range as bigint) task_id,n_nationkey from nation cross join range(7) t")
def broadcast_duplicate(t):
    return duplicate(t("nation").select("n_nationkey"), 7)


@query("select o_orderkey from orders where o_totalprice>(select round(avg(o_totalprice), 2) from orders)")
def broadcast_scalar_filter(t):
    mean = t("orders").agg(F.round(F.avg("o_totalprice"), 2).alias("_mean"))
    return with_scalars(t("orders"), mean).where("o_totalprice > _mean").select("o_orderkey")


@query("""select l_returnflag k,cast(sum(l_quantity) as bigint) part,cast(max(t.total) as bigint) total
from lineitem cross join (select sum(l_quantity) total from lineitem) t group by 1""")
def broadcast_plus_group(t):
    parts = reduce_by_key(t("lineitem").withColumnRenamed("l_returnflag", "k"), "k", part=total("l_quantity"))
    return with_scalars(parts, t("lineitem").agg(total("l_quantity").alias("total")))


@query("select n,count(*) c from (select l_orderkey,count(*) n from lineitem group by 1) group by n")
def multi_stage_counts(t):
    return reduce_by_key(reduce_by_key(t("lineitem"), "l_orderkey", n=F.count("*")), "n", c=F.count("*"))


@query("""select a.k,a.s,b.m from (select l_suppkey k,cast(sum(l_quantity) as bigint) s from lineitem group by 1) a
join (select l_suppkey k,cast(max(l_quantity) as bigint) m from lineitem group by 1) b on a.k=b.k""")
def diamond_dag(t):
    """Source, two grouped consumers of one output, and a co-grouped join of both, as a flow graph."""
    by = lambda name: InputPort(name, Movement.SCATTER_GATHER)
    g = FlowGraph()
    scan = g.add_vertex("scan", Processor(outputs=[OutputPort("out", key="k")], fn=lambda: t("lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity")))
    sums = g.add_vertex("sum", Processor([by("x")], [OutputPort("out", key="k")], fn=lambda x: x.agg(s=total("l_quantity"))))
    tops = g.add_vertex("max", Processor([by("x")], [OutputPort("out", key="k")], fn=lambda x: x.agg(m=F.max("l_quantity").cast("bigint"))))
    both = g.add_vertex("join", Processor([by("a"), by("b")], [OutputPort("out")], fn=lambda a, b: a.join(b)))
    for v in (sums, tops):
        g.add_edge(scan.output_port(0), v.input_port(0))
    g.add_edge(sums.output_port(0), both.input_port("a"))
    g.add_edge(tops.output_port(0), both.input_port("b"))
    return Compiler(SparkSession.active(), g).compile().frames[both.id, 0]


@query("select c_nationkey g, hex(encode(c_name)) k, row_number() over (partition by c_nationkey order by encode(c_name), c_custkey) r from customer")
def key_byte_order(t):
    """Keys in the order of their bytes."""
    key = F.encode("c_name", "utf-8")
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(key, "c_custkey"))
    return t("customer").select(F.col("c_nationkey").alias("g"), F.hex(key).alias("k"), rank.cast("bigint").alias("r"))


@query("select n_nationkey from nation")
def gather_single(t):
    return gather(t("nation").select("n_nationkey"))


@query("select o_orderkey from orders")
def max_concurrency_sink(t):
    return throttle(t("orders").select("o_orderkey"), 2)


@query("select cast(sum(n) as bigint) rows_seen, cast(8 as bigint) runs from (select count(*) n from lineitem)")
def per_partition_emit(t):
    def run(batches):
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(b.num_rows for b in batches)], pa.int64())})

    counts = per_partition(t("lineitem").select("l_suppkey"), "l_suppkey", 8, run, "n bigint", ordered=False)
    return counts.agg(total("n").alias("rows_seen"), F.count("*").alias("runs"))


class _Tally(ArrowProcessor):
    """Rows and distinct keys of each partition; the lifecycle hooks must have run in the worker."""

    def __init__(self):
        super().__init__([InputPort("x", Movement.SCATTER_GATHER)], [OutputPort("out", schema="n bigint, keys bigint")])

    def thread_local_initialize(self):
        self.ready = True

    def run(self, task):
        rows = task.input("x")
        if not self.ready:
            raise RuntimeError("not initialised")
        task.output("out").append([{"n": rows.num_rows, "keys": len(rows["k"].unique())}])


@query("select count(*) n, cast(count(distinct l_suppkey) as bigint) keys from lineitem")
def lifecycle_udf(t):
    g = FlowGraph()
    scan = g.add_vertex("scan", Processor(outputs=[OutputPort("out", key="k")], fn=lambda: t("lineitem").select(F.col("l_suppkey").alias("k"))))
    tally = g.add_vertex("tally", _Tally())
    g.add_edge(scan.output_port(0), tally.input_port(0))
    return Compiler(SparkSession.active(), g).compile().frames[tally.id, 0].agg(total("n").alias("n"), total("keys").alias("keys"))


@query("""select l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) qty, count(*) n from lineitem
group by cube(l_returnflag, l_linestatus)""")
def cube_totals(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(total("l_quantity").alias("qty"), F.count("*").alias("n"))


@query("""select user_id, event_id, cast(rank() over (partition by user_id order by ts) as bigint) r from events""")
def window_rank(t):
    return t("events").select("user_id", "event_id", F.rank().over(Window.partitionBy("user_id").orderBy("ts")).cast("bigint").alias("r"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["wordcount"](spark, sf_dir)
