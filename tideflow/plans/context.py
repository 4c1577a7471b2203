"""Configuration and asynchronous execution of a flow graph."""

from __future__ import annotations

import json
import logging
import os
import threading
import time
import uuid
from collections import defaultdict, deque
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from .compiler import Compiled, Compiler
from .graph import FlowGraph
from .ports import Movement
from .processor import Write

log = logging.getLogger("tideflow")


@dataclass
class Configuration:
    """Settings of an execution. Each setter returns the configuration.

    ``partition_count`` follows the number of processing units at construction, not later changes
    of ``max_concurrency``, which limits how many sinks run at once. ``default_records_per_buffer`` and
    ``default_output_buffer_size`` bound the batches that opaque code emits. ``affinity`` is accepted and has
    no effect: Spark places tasks.
    """

    def __post_init__(self):
        units = os.cpu_count() or 1
        self._values: dict[str, Any] = {
            "max_concurrency": units, "partition_count": 8 * units, "default_output_buffer_size": 4 << 20,
            "default_records_per_buffer": (4 << 20) // 8, "affinity": "NONE", "profile_log": "",
        }

    def get(self, name: str) -> Any:
        return self._values[name]

    def _set(self, name: str, value: Any) -> Configuration:
        if isinstance(value, int) and value < 1:
            raise ValueError(f"{name} is 1 or more")
        self._values[name] = value
        return self

    def max_concurrency(self, n: int) -> Configuration:
        return self._set("max_concurrency", n)

    def partition_count(self, n: int) -> Configuration:
        return self._set("partition_count", n)

    def default_output_buffer_size(self, n: int) -> Configuration:
        return self._set("default_output_buffer_size", n)

    def default_records_per_buffer(self, n: int) -> Configuration:
        return self._set("default_records_per_buffer", n)

    def affinity(self, name: str) -> Configuration:
        if name not in ("NONE", "COMPACT", "SCATTER"):
            raise ValueError("affinity is NONE, COMPACT or SCATTER")
        return self._set("affinity", name)

    def profile_log(self, path: str) -> Configuration:
        return self._set("profile_log", path)

    def copied(self) -> Configuration:
        out = Configuration()
        out._values = dict(self._values)
        return out

    def as_dict(self) -> dict[str, Any]:
        return {k: v for k, v in self._values.items() if k not in ("affinity", "profile_log")}


class ThreadObserver:
    """Hooks around an execution's driver thread; initialised in order, finalised in reverse."""

    def on_initialize(self) -> None: ...

    def on_finalize(self) -> None: ...


class Context:
    """Runs a flow graph on a background thread under a job group of its own."""

    def __init__(self, spark: SparkSession):
        self.spark, self._graph, self._conf = spark, FlowGraph(), Configuration()
        self._observers: list[ThreadObserver] = []
        self._thread: threading.Thread | None = None
        self._error: BaseException | None = None
        self._group, self._cancelled = "", False
        self.results: dict[tuple[str, str], DataFrame] = {}

    def set_flow_graph(self, graph: FlowGraph) -> Context:
        """A copy of the graph: later changes of it or of its processors do not reach this context."""
        graph.order()
        self._graph = graph.copied()
        return self

    def set_configuration(self, conf: Configuration) -> Context:
        self._conf = conf.copied()
        return self

    def add_thread_observer(self, observer: ThreadObserver) -> Context:
        self._observers.append(observer)
        return self

    def compile(self) -> Compiled:
        """The graph's lazy DataFrames, without running its sinks."""
        return self._compiler().compile()

    def _compiler(self, actions: bool = False) -> Compiler:
        """Each execution has copies of the processors, so none sees what another has left in them."""
        value = self._conf.get
        return Compiler(self.spark, self._graph.copied(), value("partition_count"), value("default_records_per_buffer"), value("default_output_buffer_size"), actions)

    def execute(self) -> Context:
        if self._thread is not None:
            raise RuntimeError("execute was called again before wait")
        self._error, self._cancelled, self._group = None, False, f"tideflow-{uuid.uuid4()}"
        self._thread = InheritableThread(target=self._run, session=self.spark)
        self._thread.start()
        return self

    def cancel(self) -> None:
        """Stop the running execution; wait() raises."""
        self._cancelled = True
        self.spark.sparkContext.cancelJobGroup(self._group)

    def wait(self) -> None:
        """Until the execution has ended; the first exception of it is raised here."""
        if self._thread is None:
            raise RuntimeError("wait was called without execute")
        self._thread.join()
        self._thread = None
        if self._error is not None:
            raise self._error

    def _fail(self, error: BaseException) -> None:
        if self._error is None:
            self._error = error
        else:
            log.error("suppressed after the first failure: %s", error)

    def _run(self) -> None:
        sc, events, begun = self.spark.sparkContext, defaultdict(list), []
        compiler = self._compiler(actions=True)

        def timed(event: str, vertex: int | None, work) -> None:
            at = time.time()
            try:
                work()
            finally:
                events[threading.current_thread().name].append({"task_id": vertex, "event": event, "begin_us": int(at * 1e6), "end_us": int(time.time() * 1e6)})

        try:
            sc.setJobGroup(self._group, "tideflow execution", interruptOnCancel=True)
            for observer in self._observers:
                observer.on_initialize()
                begun.append(observer)
            timed("compile", None, compiler.compile)
            compiled = compiler.out
            read = {s for sources in self._graph.edges.values() for s in sources}
            leaves = [(v, compiled.frames[v.id, i]) for v in self._graph.vertices for i in range(len(v.processor.outputs)) if (v.id, i) not in read and (v.id, i) in compiled.frames]
            self._run_all([*compiled.sinks, *leaves], timed)
            self.results = {(self._graph.vertices[v].name, self._graph.vertices[v].processor.outputs[i].name): df for (v, i), df in compiled.frames.items()}
            if self._cancelled:
                raise RuntimeError("the execution was cancelled")
        except BaseException as e:  # noqa: BLE001 - wait() raises it
            self._fail(e)
        finally:
            for processor in compiler.out.initialized:
                try:
                    timed("finalize", None, lambda p=processor: p.global_finalize(self._error is not None))
                except Exception as e:  # noqa: BLE001
                    self._fail(e)
            for observer in reversed(begun):
                try:
                    observer.on_finalize()
                except Exception as e:  # noqa: BLE001
                    self._fail(e)
            for df in compiler.out.persisted:
                df.unpersist()
        if self._error is None and self._conf.get("profile_log"):
            with open(self._conf.get("profile_log"), "w") as f:
                json.dump(self.profile(events), f, indent=1)

    def _run_all(self, actions: list, timed) -> None:
        """Runs sinks and unread outputs side by side, as many as ``max_concurrency`` lets; the first failure cancels the others."""
        sc, todo, lock = self.spark.sparkContext, deque(actions), threading.Lock()
        first: list[BaseException] = []

        def one(vertex, what) -> None:
            sc.setJobDescription(vertex.name)
            work = what.run if isinstance(what, Write) else what.write.format("noop").mode("overwrite").save
            timed("execution", vertex.id, work)

        def worker() -> None:
            while True:
                with lock:
                    if not todo or first or self._cancelled:
                        return
                    action = todo.popleft()
                try:
                    one(*action)
                except BaseException as e:  # noqa: BLE001 - wait() raises it
                    with lock:
                        first.append(e)
                    sc.cancelJobGroup(self._group)

        threads = [InheritableThread(target=worker, session=self.spark, name=f"tideflow-sink-{i}") for i in range(min(len(actions), self._conf.get("max_concurrency")))]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        if self._cancelled:
            raise RuntimeError("the execution was cancelled")
        for late in first[1:]:
            log.error("suppressed after the first failure: %s", late)
        if first:
            raise first[0]

    def profile(self, events: dict[str, list[dict]]) -> dict:
        """Configuration, logical tasks (processors, then the shuffles, gathers and value sorts between them), their edges and timings."""
        g = self._graph
        tasks = [{"task_id": v.id, "task_name": v.name} for v in g.vertices]
        edges, made = [], {}

        def node(name: str, key) -> int:
            if key not in made:
                made[key] = len(tasks)
                tasks.append({"task_id": len(tasks), "task_name": name})
            return made[key]

        def edge(p, pp, c, cp):
            edges.append({"producer": {"id": p, "port": pp}, "consumer": {"id": c, "port": cp}})

        for (v, i), sources in sorted(g.edges.items()):
            port = g.vertices[v].processor.inputs[i]
            if port.movement is Movement.ONE_TO_ONE:
                for s, sp in sources:
                    edge(s, sp, v, i)
                continue
            label = "+".join(f"{g.vertices[s].name}.{g.vertices[s].processor.outputs[sp].name}" for s, sp in sources)
            what = "shuffle" if port.movement is Movement.SCATTER_GATHER else "gather"
            fresh = (what, tuple(sorted(sources))) not in made
            mid = node(f"({label}).{what}", (what, tuple(sorted(sources))))
            if fresh:
                for s, sp in sources:
                    edge(s, sp, mid, 0)
            if port.order_by:
                by = node(f"{g.vertices[v].name}.{port.name}.value_sort", ("sort", v, i))
                edge(mid, 0, by, 0)
                mid = by
            edge(mid, 0, v, i)
        return {"configuration": self._conf.as_dict(), "logical_tasks": tasks, "logical_dependencies": edges, "events": dict(events)}
