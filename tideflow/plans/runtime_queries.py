"""Registered queries that exercise the graph runtime, sources and sinks; each with SQL for the same rows."""

from __future__ import annotations

import io
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import logger
from ..errors import ProcessorDefinitionError, RoutingError
from ..operators import gather
from ..sources import collect_groups, collect_rows, generate, scan_parquet, scan_rows, scan_text_lines, scratch_dir, write, write_text_single
from .compiler import Compiler
from .context import Configuration, Context, ThreadObserver
from .graph import FlowGraph
from .ports import InputPort, Movement, OutputPort
from .processor import ArrowProcessor, Processor, StreamProcessor, Write

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
ONE, GROUPED, BROADCAST = Movement.ONE_TO_ONE, Movement.SCATTER_GATHER, Movement.BROADCAST


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(spark, lambda name: scan_parquet(spark, sf_dir, name))
        ORACLE[fn.__name__] = sql
        return fn
    return add


def _path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/runtime-{uuid.uuid4().hex[:12]}"


def _source(df: DataFrame, key=()) -> Processor:
    return Processor(outputs=[OutputPort("out", key)], fn=lambda: df)


def _raised(*calls) -> list[str]:
    """Names of the exceptions that the calls raise, or 'none'."""
    out = []
    for call in calls:
        try:
            call()
            out.append("none")
        except Exception as e:  # noqa: BLE001
            out.append(type(e).__name__)
    return out


@query("select * from (values (1, 'a'), (2, 'b'), (2, 'b'), (3, null)) t(k, v)")
def scan_in_memory(spark, t):
    return scan_rows(spark, [(1, "a"), (2, "b"), (2, "b"), (3, None)], "k int, v string", fragments=3)


@query("select c_custkey || ' ' || c_name || ' ' || c_nationkey as \"value\" from customer")
def text_sink_and_lines(spark, t):
    """A graph whose sink writes one text file; the file is read back line by line."""
    path, g = _path(spark), FlowGraph()
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("c_custkey", "c_name", "c_nationkey")])
    scan = g.add_vertex("scan", _source(t("customer")))
    sink = g.add_vertex("sink", Processor([InputPort("x", ONE)], fn=lambda x: Write(gather(x.select(line.alias("value"))), path, "text")))
    g.add_edge(scan.output_port(0), sink.input_port(0))
    Context(spark).set_flow_graph(g).execute().wait()
    return scan_text_lines(spark, path)


@query("select s_suppkey || '|' || s_name as \"value\" from supplier")
def text_single_file(spark, t):
    path = _path(spark)
    write_text_single(t("supplier"), path, "s_suppkey", "s_name", sep="|")
    return scan_text_lines(spark, path)


@query("select o_orderkey, o_orderstatus from orders")
def partitioned_sink(spark, t):
    path = _path(spark)
    write(t("orders").select("o_orderkey", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@query("select n_nationkey, n_name from nation")
def collect_sink(spark, t):
    return spark.createDataFrame(collect_rows(t("nation").select("n_nationkey", "n_name")), "n_nationkey int, n_name string")


@query("select n_regionkey k, list(n_nationkey order by n_nationkey) vs from nation group by 1")
def grouped_collect(spark, t):
    groups = collect_groups(t("nation"), "n_regionkey", "n_nationkey")
    return spark.createDataFrame([(k, sorted(vs)) for k, vs in groups.items()], "k int, vs array<int>")


@query("select cast(i as bigint) task, cast(i * 10 + j as bigint) v from range(6) a(i), range(3) b(j)")
def source_tasks(spark, t):
    """A source of six runs, each emitting three rows in buffers of two at most."""

    class Numbers(ArrowProcessor):
        def run(self, task):
            i = task.physical_task_id
            task.output("out").append([{"task": i, "v": i * 10 + j} for j in range(3)])

    g = FlowGraph()
    g.add_vertex("numbers", Numbers(outputs=[OutputPort("out", schema="task bigint, v bigint")], task_count=6))
    c = Context(spark).set_flow_graph(g).set_configuration(Configuration().default_records_per_buffer(2))
    return c.compile().frames[0, 0]


@query("select cast(range as bigint) i from range(5)")
def generated_source(spark, t):
    import pyarrow as pa

    return generate(spark, 5, lambda i: [pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64())})], "i bigint")


@query("""select * from (values (0, 'ProcessorDefinitionError'), (1, 'ProcessorDefinitionError'), (2, 'ProcessorDefinitionError'),
(3, 'ProcessorDefinitionError'), (4, 'ValueError'), (5, 'IndexError'), (6, 'ValueError'), (7, 'RoutingError'), (8, 'none')) t(i, error)""")
def definition_errors(spark, t):
    """Undefined movement, mixed movements, task_count of a consumer, equal names, a limit of 0, an unknown port, a group without key, a cycle."""
    g = FlowGraph()
    a, b = (g.add_vertex(n, Processor([InputPort("x", ONE)], [OutputPort("out")], fn=lambda x: x)) for n in "ab")
    by_key = g.add_vertex("k", Processor([InputPort("x", GROUPED)], fn=lambda x: x.values()))

    def cycle():
        g.add_edge(a.output_port(0), b.input_port(0))
        g.add_edge(b.output_port(0), a.input_port(0))
        g.order()

    errors = _raised(
        lambda: InputPort("x"), lambda: Processor([InputPort("a", ONE), InputPort("b", GROUPED)]), lambda: Processor([InputPort("a", ONE)], task_count=2),
        lambda: Processor([InputPort("a", ONE), InputPort("a", ONE)]), lambda: Processor(max_concurrency=0), lambda: a.output_port(1),
        lambda: g.add_edge(a.output_port(0), by_key.input_port(0)), cycle, lambda: Context(spark).execute().wait())
    assert {ProcessorDefinitionError.__name__, RoutingError.__name__} <= set(errors)
    return spark.createDataFrame(list(enumerate(errors)), "i int, error string")


@query("""select 'sum' tag, l_returnflag k, cast(sum(l_quantity) as bigint) v from lineitem group by 2
union all select 'max', l_returnflag, cast(max(l_quantity) as bigint) from lineitem group by 2""")
def fanout_sinks(spark, t):
    """One producer, two consumers, each with a sink that writes: the producer is kept and the sinks run side by side."""
    g, path = FlowGraph(), _path(spark)
    scan = g.add_vertex("scan", _source(t("lineitem").select(F.col("l_returnflag").alias("k"), "l_quantity"), "k"))
    for tag, column in (("sum", F.sum("l_quantity")), ("max", F.max("l_quantity"))):
        def one(x, tag=tag, column=column):
            return Write(x.agg(v=column.cast("bigint")).select(F.lit(tag).alias("tag"), "k", "v"), f"{path}/{tag}")
        sink = g.add_vertex(tag, Processor([InputPort("x", GROUPED)], fn=one))
        g.add_edge(scan.output_port(0), sink.input_port(0))
    Context(spark).set_flow_graph(g).execute().wait()
    return spark.read.parquet(f"{path}/sum", f"{path}/max")


@query("select n_regionkey k, cast(count(*) as bigint) n, cast(3 as bigint) partitions from nation group by 1")
def configured_execution(spark, t):
    """Results by port of an asynchronous execution with three partitions."""
    g = FlowGraph()
    scan = g.add_vertex("scan", _source(t("nation").select(F.col("n_regionkey").alias("k")), "k"))

    def counted(x):
        dealt = x.sorted_partitions()
        return dealt.groupBy("k").agg(F.count("*").alias("n")).withColumn("partitions", F.lit(dealt.rdd.getNumPartitions()).cast("bigint"))

    count = g.add_vertex("count", Processor([InputPort("x", GROUPED)], [OutputPort("out")], fn=counted))
    g.add_edge(scan.output_port(0), count.input_port(0))
    c = Context(spark).set_flow_graph(g).set_configuration(Configuration().partition_count(3))
    c.execute().wait()
    return c.results["count", "out"]


@query("""select * from (values (0, 'observer 1 starts'), (1, 'observer 2 starts'), (2, 'initialized'), (3, 'finalized'),
(4, 'observer 2 stops'), (5, 'observer 1 stops')) t(i, event)""")
def lifecycle_order(spark, t):
    seen: list[str] = []

    class Watch(ThreadObserver):
        def __init__(self, n):
            self.n = n

        def on_initialize(self):
            seen.append(f"observer {self.n} starts")

        def on_finalize(self):
            seen.append(f"observer {self.n} stops")

    class Sink(Processor):
        def global_initialize(self, broadcasts):
            seen.append("initialized")

        def global_finalize(self, cancelled):
            seen.append("cancelled" if cancelled else "finalized")

    g = FlowGraph()
    g.add_vertex("sink", Sink(fn=lambda: t("region")))
    Context(spark).set_flow_graph(g).add_thread_observer(Watch(1)).add_thread_observer(Watch(2)).execute().wait()
    return spark.createDataFrame(list(enumerate(seen)), "i int, event string")


@query("select * from (values (0, 'PythonException'), (1, 'cancelled'), (2, 'RuntimeError'), (3, 'RuntimeError')) t(i, what)")
def failure_and_cancellation(spark, t):
    """A failing run is raised by wait, its processor is finalised as cancelled; so is what cancel() stops; wait needs execute."""
    seen: list[str] = []

    class Bad(ArrowProcessor):
        def run(self, task):
            raise ValueError("on purpose")

        def global_finalize(self, cancelled):
            seen.append("cancelled" if cancelled else "finalized")

    g = FlowGraph()
    scan = g.add_vertex("scan", _source(t("region")))
    bad = g.add_vertex("bad", Bad([InputPort("x", ONE)], [OutputPort("out", schema="v int")]))
    g.add_edge(scan.output_port(0), bad.input_port(0))
    first = _raised(lambda: Context(spark).set_flow_graph(g).execute().wait())
    gate, h = threading.Event(), FlowGraph()
    h.add_vertex("wait", Processor(fn=lambda: gate.wait(60) and t("region")))
    c = Context(spark).set_flow_graph(h).execute()
    c.cancel()
    gate.set()
    return spark.createDataFrame(list(enumerate(first + seen + _raised(c.wait, Context(spark).wait))), "i int, what string")


@query("select * from (values ('a', 1, 1), ('b', 1, 2), ('a', 2, 1), ('b', 2, 2)) t(vertex, run, seen)")
def processor_copies(spark, t):
    """Neither a second run nor the caller's later changes see or reach what a run leaves in its processor."""
    rows: list[tuple] = []

    class Counting(Processor):
        def __init__(self, name, n):
            super().__init__(fn=lambda: t("region"))
            self.name, self.n = name, n

        def global_initialize(self, broadcasts):
            self.n += 1

        def global_finalize(self, cancelled):
            rows.append((self.name, self.n))

    g, first = FlowGraph(), Counting("a", 0)
    g.add_vertex("a", first)
    g.add_vertex("b", Counting("b", 1))
    first.n = 100
    c = Context(spark).set_flow_graph(g)
    out = []
    for run in (1, 2):
        rows.clear()
        c.execute().wait()
        out += [(name, run, n) for name, n in rows]
    return spark.createDataFrame(out, "vertex string, run int, seen int")


@query("""select * from (values ('compile'), ('execution a'), ('execution b'), ('task a'), ('task b'), ('task src'), ('task (src.out).shuffle'),
('edge 0 3'), ('edge 3 1'), ('edge 3 2')) t(line)""")
def profile_log(spark, t):
    """The profile's tasks, edges and kinds of events."""
    from urllib.parse import urlparse
    import json
    import os
    import tempfile

    g = FlowGraph()
    src = g.add_vertex("src", _source(t("region").select(F.col("r_regionkey").alias("k")), "k"))
    for name in ("a", "b"):
        sink = g.add_vertex(name, Processor([InputPort("x", GROUPED)], fn=lambda x: x.values()))
        g.add_edge(src.output_port(0), sink.input_port(0))
    fd, path = tempfile.mkstemp(suffix=".json")  # the driver writes and reads it
    os.close(fd)
    Context(spark).set_flow_graph(g).set_configuration(Configuration().profile_log(urlparse(path).path)).execute().wait()
    with open(path) as f:
        p = json.load(f)
    os.remove(path)
    names = {x["task_id"]: x["task_name"] for x in p["logical_tasks"]}
    lines = [f"task {n}" for n in names.values()] + [f"edge {e['producer']['id']} {e['consumer']['id']}" for e in p["logical_dependencies"]]
    events = [e for thread in p["events"].values() for e in thread if e["event"] != "finalize"]
    lines += [e["event"] if e["task_id"] is None else f"{e['event']} {names[e['task_id']]}" for e in events]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("select * from (values ('WARNING', 'second'), ('ERROR', 'third')) t(level, message)")
def log_destination(spark, t):
    """A destination gets the messages of its level and above until it is removed."""
    out = io.StringIO()
    handle = logger.add_destination_stream(out, "WARNING")
    for level, message in (("INFO", "first"), ("WARNING", "second"), ("ERROR", "third")):
        logger.log(level, message)
    logger.remove_destination(handle)
    logger.log("ERROR", "fourth")
    rows = [(line.split("] [")[2].split("]")[0], line.rsplit(" ", 1)[1]) for line in out.getvalue().splitlines()]
    return spark.createDataFrame(rows, "level string, message string")


class _Spans(StreamProcessor):
    """Per key the rows of both ports, and the first and last of the second port's values in its order."""

    def __init__(self):
        ports = [InputPort("a", GROUPED), InputPort("b", GROUPED, [-F.col("v")])]
        super().__init__(ports, [OutputPort("out", schema="k bigint, a_rows bigint, b_rows bigint, high bigint, low bigint")])

    def stream(self, pieces, task):
        one = None
        for port, table in pieces:
            done = []
            for k, v in zip(table["k"].to_pylist(), table["v"].to_pylist(), strict=True):
                if one is None or k != one["k"]:
                    if one is not None:
                        done.append(one)
                    one = {"k": k, "a_rows": 0, "b_rows": 0, "high": None, "low": None}
                one[f"{port}_rows"] += 1
                if port == "b":
                    one["high"], one["low"] = v if one["high"] is None else one["high"], v
            yield "out", done
        if one is not None:
            yield "out", [one]


@query("""select k, count(*) filter (s = 'a') a_rows, count(*) filter (s = 'b') b_rows, max(v) filter (s = 'b') high, min(v) filter (s = 'b') low
from (select c_custkey k, c_custkey v, 'a' s from customer union all select o_custkey, o_orderkey, 'b' from orders) group by k""")
def streamed_groups(spark, t):
    """Opaque code that reads two co-grouped ports as a stream."""
    g = FlowGraph()
    long = lambda c, name: F.col(c).cast("bigint").alias(name)
    a = g.add_vertex("a", _source(t("customer").select(long("c_custkey", "k"), long("c_custkey", "v")), "k"))
    b = g.add_vertex("b", _source(t("orders").select(long("o_custkey", "k"), long("o_orderkey", "v")), "k"))
    spans = g.add_vertex("spans", _Spans())
    g.add_edge(a.output_port(0), spans.input_port("a"))
    g.add_edge(b.output_port(0), spans.input_port("b"))
    return Compiler(spark, g).compile().frames[spans.id, 0]
