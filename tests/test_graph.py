"""Flow graphs: validation, movements, lifecycle, asynchronous execution and cancellation."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from tideflow import (
    ArrowProcessor, Configuration, Context, FlowGraph, InputPort, Movement, OutputPort, Processor, ProcessorDefinitionError, RoutingError, StreamProcessor,
    ThreadObserver,
)
from tideflow import logger
from tideflow.plans.compiler import Compiler

ONE, SG, BC = Movement.ONE_TO_ONE, Movement.SCATTER_GATHER, Movement.BROADCAST


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def source(df, key=()):
    return Processor(outputs=[OutputPort("out", key)], fn=lambda: df)


def copy(key=()):
    return Processor([InputPort("x", ONE)], [OutputPort("out", key)], fn=lambda x: x)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i % 5, i) for i in range(50)], "k int, v int")


def test_definitions():
    with pytest.raises(ProcessorDefinitionError):
        InputPort("x")
    with pytest.raises(ProcessorDefinitionError):
        Processor([InputPort("a", ONE), InputPort("b", SG)])
    with pytest.raises(ProcessorDefinitionError):
        Processor([InputPort("a", ONE)], task_count=2)
    with pytest.raises(ValueError):
        Processor(max_concurrency=0)
    Processor([InputPort("a", BC)], task_count=3)


def test_edges_and_cycles(pairs):
    g, other = FlowGraph(), FlowGraph()
    a, b, c = (g.add_vertex(n, copy("k")) for n in "abc")
    plain = g.add_vertex("plain", copy())
    grouped = g.add_vertex("grouped", Processor([InputPort("x", SG)], [], fn=lambda x: x.values()))
    foreign = other.add_vertex("f", copy())
    with pytest.raises(IndexError):
        a.output_port(1)
    with pytest.raises(ValueError):
        g.add_edge(foreign.output_port(0), a.input_port(0))
    with pytest.raises(ValueError):
        g.add_edge(plain.output_port(0), grouped.input_port(0))
    g.add_edge(a.output_port(0), b.input_port(0))
    g.add_edge(b.output_port(0), c.input_port(0))
    assert [v.name for v in g.order()][0] == "a"
    g.add_edge(c.output_port(0), a.input_port(0))
    with pytest.raises(RoutingError):
        g.order()


def test_two_straight_ports_are_a_union(spark, pairs):
    g = FlowGraph()
    a, b = g.add_vertex("a", source(pairs)), g.add_vertex("b", source(pairs.limit(3)))
    both = g.add_vertex("u", Processor([InputPort("x", ONE), InputPort("y", ONE)], [OutputPort("out")], fn=lambda x, y: x if y is None else y))
    g.add_edge(a.output_port(0), both.input_port("x"))
    g.add_edge(b.output_port(0), both.input_port("y"))
    assert Compiler(spark, g).compile().frames[both.id, 0].count() == 53


def test_opaque_processors(spark, pairs):
    class Numbers(ArrowProcessor):
        def __init__(self):
            super().__init__([InputPort("side", BC)], [OutputPort("out", "k", "k int, v int")], task_count=4)

        def run(self, task):
            task.output("out").append([{"k": 1, "v": task.input("side").num_rows}])

    class Sums(ArrowProcessor):
        def __init__(self):
            super().__init__([InputPort("a", SG), InputPort("b", SG, ["v"])], [OutputPort("sums", schema="a int, b int"), OutputPort("sorted", schema="ok boolean")])

        def run(self, task):
            a, b = task.input("a").to_pydict(), task.input("b").to_pydict()
            task.output("sums").append([{"a": sum(a["v"]), "b": sum(b["v"])}])
            by_key = list(zip(b["k"], b["v"]))
            task.output("sorted").append([{"ok": by_key == sorted(by_key)}])
            with pytest.raises(IndexError):
                task.input("c")

    g = FlowGraph()
    side = g.add_vertex("side", source(pairs))
    numbers, sums = g.add_vertex("numbers", Numbers()), g.add_vertex("sums", Sums())
    keyed = g.add_vertex("keyed", source(pairs, "k"))
    g.add_edge(side.output_port(0), numbers.input_port(0))
    g.add_edge(numbers.output_port(0), sums.input_port("a"))
    g.add_edge(keyed.output_port(0), sums.input_port("b"))
    frames = Compiler(spark, g, partitions=3).compile().frames
    assert rows(frames[numbers.id, 0]) == [(1, 50)] * 4
    got = frames[sums.id, 0].collect()
    assert len(got) == 3 and sum(r.a for r in got) == 200 and sum(r.b for r in got) == sum(range(50))
    assert all(r.ok for r in frames[sums.id, 1].collect())


def test_streams(spark):
    """A key of more rows than a batch arrives in order in several pieces; empty partitions run; a stream needs groups."""
    class Pieces(StreamProcessor):
        def __init__(self):
            super().__init__([InputPort("x", SG, ["v"])], [OutputPort("sizes", schema="n int"), OutputPort("ok", schema="ok boolean")])

        def stream(self, pieces, task):
            before, n = (-1, -1), 0
            for port, table in pieces:
                now = list(zip(table["k"].to_pylist(), table["v"].to_pylist(), strict=True))
                yield "ok", [{"ok": port == "x" and [before, *now] == sorted([before, *now])}]
                before, n = now[-1], n + 1
                yield "sizes", [{"n": table.num_rows}]
            if not n:
                yield "sizes", [{"n": 0}]

    g = FlowGraph()
    src = g.add_vertex("src", source(spark.range(25_000).select(F.lit(1).alias("k"), F.col("id").alias("v")), "k"))
    p = g.add_vertex("p", Pieces())
    g.add_edge(src.output_port(0), p.input_port(0))
    frames = Compiler(spark, g, partitions=3).compile().frames
    sizes = sorted(r.n for r in frames[p.id, 0].collect())
    assert sizes[:2] == [0, 0] and len(sizes) > 3 and sum(sizes) == 25_000
    assert all(r.ok for r in frames[p.id, 1].collect())
    with pytest.raises(ProcessorDefinitionError):
        StreamProcessor([InputPort("x", ONE)])


def test_context_runs_sinks_and_profiles(spark, pairs, tmp_path):
    calls = []

    class Watch(ThreadObserver):
        def __init__(self, name):
            self.name = name

        def on_initialize(self):
            calls.append(("start", self.name))

        def on_finalize(self):
            calls.append(("stop", self.name))

    class Sink(Processor):
        def global_initialize(self, broadcasts):
            calls.append("init")

        def global_finalize(self, cancelled):
            calls.append(("final", cancelled))

    g = FlowGraph()
    a = g.add_vertex("a", source(pairs, "k"))
    s = g.add_vertex("sink", Sink([InputPort("x", SG, ["v"])], fn=lambda x: x.values()))
    g.add_edge(a.output_port(0), s.input_port(0))
    path = str(tmp_path / "profile.json")
    c = Context(spark).set_flow_graph(g).set_configuration(Configuration().partition_count(2).profile_log(path))
    c.add_thread_observer(Watch(1)).add_thread_observer(Watch(2))
    with pytest.raises(RuntimeError):
        c.wait()
    c.execute()
    with pytest.raises(RuntimeError):
        c.execute()
    c.wait()
    assert calls == [("start", 1), ("start", 2), "init", ("final", False), ("stop", 2), ("stop", 1)]
    profile = json.load(open(path))
    assert [t["task_name"] for t in profile["logical_tasks"]] == ["a", "sink", "(a.out).shuffle", "sink.x.value_sort"]
    assert set(profile) == {"configuration", "logical_tasks", "logical_dependencies", "events"}
    Context(spark).execute().wait()


def test_first_failure_is_raised(spark, pairs):
    final = []

    class Bad(ArrowProcessor):
        def run(self, task):
            raise ValueError("broken run")

        def global_finalize(self, cancelled):
            final.append(cancelled)

    g = FlowGraph()
    a = g.add_vertex("a", source(pairs))
    b = g.add_vertex("b", Bad([InputPort("x", ONE)], [OutputPort("out", schema="v int")]))
    g.add_edge(a.output_port(0), b.input_port(0))
    with pytest.raises(Exception, match="broken run"):
        Context(spark).set_flow_graph(g).execute().wait()
    assert final == [True]


def test_configuration_and_logger(tmp_path):
    c = Configuration()
    n = c.get("partition_count")
    assert c.max_concurrency(2).get("partition_count") == n
    with pytest.raises(ValueError):
        c.partition_count(0)
    with pytest.raises(ValueError):
        c.affinity("X")
    handle = logger.add_destination_text_file(str(tmp_path / "log"), "WARNING")
    logger.log("INFO", "quiet")
    logger.log("ERROR", "loud")
    logger.remove_destination(handle)
    logger.log("ERROR", "later")
    text = (tmp_path / "log").read_text()
    assert "loud" in text and "quiet" not in text and "later" not in text
    assert isinstance(handle, logging.Handler)
