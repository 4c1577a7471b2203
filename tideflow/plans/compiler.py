"""Lowering of a flow graph to lazy DataFrames."""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import ProcessorDefinitionError
from ..operators.joins import checked_broadcast, estimated_bytes
from ..operators.narrow import unite
from .graph import FlowGraph, Vertex
from .ports import Grouped, Movement, same_schema
from .processor import ArrowProcessor, Processor, StreamProcessor, Task, Write, emit

#: Opaque code gets a BROADCAST port as an Arrow table; beyond this many estimated bytes it is refused.
OPAQUE_BROADCAST_LIMIT = 512 << 20


@dataclass
class Compiled:
    """DataFrames by (vertex id, output port index); sinks: what an execution must run."""

    frames: dict[tuple[int, int], DataFrame] = field(default_factory=dict)
    sinks: list[tuple[Vertex, DataFrame | Write]] = field(default_factory=list)
    persisted: list[DataFrame] = field(default_factory=list)
    initialized: list[Processor] = field(default_factory=list)


class Compiler:
    """``records`` and ``size`` bound the batches that opaque code emits. With ``actions`` the graph's sinks and unread
    outputs are run one by one, so what several of them read is kept; else the caller's one action shares exchanges."""

    def __init__(self, spark: SparkSession, graph: FlowGraph, partitions: int | None = None, records: int | None = None, size: int | None = None, actions: bool = False):
        self.spark, self.graph, self.partitions, self.records, self.size, self.out = spark, graph, partitions, records, size, Compiled()
        self.consumers, self.actions = graph.consumers(), actions
        self.reached = self._reached()

    def _reached(self) -> dict[tuple[int, int], set]:
        """For each output the actions (sinks and unread outputs) that read it."""
        after: dict[int, set] = {}
        out: dict[tuple[int, int], set] = {}
        for vertex in reversed(self.graph.order()):
            own = set() if vertex.processor.outputs else {vertex.id}
            for i in range(len(vertex.processor.outputs)):
                readers = self.consumers.get((vertex.id, i), [])
                out[vertex.id, i] = set().union(*[after[v] for v, _ in readers]) if readers else {(vertex.id, i)}
                own |= out[vertex.id, i]
            after[vertex.id] = own
        return out

    def compile(self) -> Compiled:
        for vertex in self.graph.order():
            self._vertex(vertex)
        return self.out

    def _united(self, vertex: int, port: int) -> DataFrame | None:
        frames = [self.out.frames[s] for s in self.graph.sources(vertex, port)]
        if not frames:
            return None
        if not same_schema(frames):
            raise ProcessorDefinitionError("the sources of one port differ in their columns")
        return unite(*frames)

    def _vertex(self, vertex: Vertex) -> None:
        processor, ports = vertex.processor, {}
        for i, port in enumerate(vertex.processor.inputs):
            df = self._united(vertex.id, i)
            if port.movement is Movement.SCATTER_GATHER and df is not None:
                producer, at = self.graph.sources(vertex.id, i)[0]
                key = self.graph.vertices[producer].processor.outputs[at].key
                ports[port.name] = Grouped(df, key, port.order_by, self.partitions)
            elif port.movement is Movement.BROADCAST and df is not None and not isinstance(processor, ArrowProcessor):
                ports[port.name] = checked_broadcast(df)
            else:
                ports[port.name] = df
        broadcasts = {p.name: ports[p.name] for p in processor.inputs if p.movement is Movement.BROADCAST}
        if isinstance(processor, ArrowProcessor):
            broadcasts = {name: self._table(name, df) for name, df in broadcasts.items()}
        self.out.initialized.append(processor)
        processor.global_initialize(broadcasts)
        run = self._opaque if isinstance(processor, ArrowProcessor) else self._declared
        for i, df in enumerate(run(vertex, ports, broadcasts)):
            if df is None:
                continue
            port = processor.outputs[i]
            if missing := set(port.key) - set(df.columns):
                raise ProcessorDefinitionError(f"{vertex.name}.{port.name}: no key column {', '.join(sorted(missing))}")
            self.out.frames[vertex.id, i] = self._shared(vertex, i, df)

    def _shared(self, vertex: Vertex, port: int, df: DataFrame) -> DataFrame:
        """Results that are read more than once are kept: of opaque code for each port, of others for each action."""
        readers = self.consumers.get((vertex.id, port), [])
        forks = len({v for v, _ in readers}) > 1 and len(self.reached[vertex.id, port]) > 1
        if len(readers) > 1 and isinstance(vertex.processor, ArrowProcessor) or self.actions and forks:
            df = df.persist(StorageLevel.DISK_ONLY)
            self.out.persisted.append(df)
        return df

    def _table(self, name: str, df: DataFrame | None) -> pa.Table | None:
        if df is None:
            return None
        if df.isEmpty():
            return df.limit(0).toArrow()
        n = estimated_bytes(df)
        if n > OPAQUE_BROADCAST_LIMIT:  # the estimate may be a guess: measure
            n = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
        if n > OPAQUE_BROADCAST_LIMIT:
            raise ProcessorDefinitionError(f"port {name}: {n} bytes are too many to broadcast to opaque code; use a join")
        return df.toArrow()

    def _declared(self, vertex: Vertex, ports: dict[str, Any], _) -> list[DataFrame | None]:
        processor = vertex.processor
        narrow = [p.name for p in processor.inputs if p.movement is Movement.ONE_TO_ONE]
        if len(narrow) > 1:  # a union, not a zip: one port is bound at a time
            calls = [ports | {other: None for other in narrow if other != name} for name in narrow if ports[name] is not None]
        else:
            calls = [ports]
        results: list[list[DataFrame]] = [[] for _ in processor.outputs]
        for bound in calls:
            got = processor.process(**bound)
            if isinstance(got, Write):
                if processor.outputs:
                    raise ProcessorDefinitionError(f"{vertex.name}: only a processor without output ports writes")
                self.out.sinks.append((vertex, replace(got, df=self._limited(processor, got.df))))
                continue
            if isinstance(got, DataFrame):
                if not processor.outputs:
                    self.out.sinks.append((vertex, self._limited(processor, got)))
                    continue
                got = {processor.outputs[0].name: got}
            for i, port in enumerate(processor.outputs):
                if got and port.name in got:
                    results[i].append(self._limited(processor, got[port.name]))
        return [unite(*frames) if frames else None for frames in results]

    @staticmethod
    def _limited(processor: Processor, df: DataFrame) -> DataFrame:
        return df.coalesce(processor.max_concurrency) if processor.max_concurrency else df

    def _opaque(self, vertex: Vertex, ports: dict[str, Any], broadcasts: dict[str, pa.Table | None]) -> list[DataFrame | None]:
        # workers get the processor without the ports' orders: columns cannot be shipped
        processor = copy(vertex.processor)
        processor.inputs = tuple(replace(p, order_by=()) for p in processor.inputs)
        names = [p.name for p in processor.outputs]
        kind = T.StructType([T.StructField("_port", T.IntegerType())] + [T.StructField(p.name, T.StructType.fromDDL(p.schema)) for p in processor.outputs])
        schema, logical, records, size = to_arrow_schema(kind), vertex.id, self.records, self.size
        handles = {n: None if t is None else self.spark.sparkContext.broadcast(t) for n, t in broadcasts.items()}
        every = {p.name: None for p in processor.inputs}

        def started():
            processor.thread_local_initialize()
            return every | {n: None if h is None else h.value for n, h in handles.items()}

        def one(bound, physical):
            task = Task(bound, names, logical, physical)
            processor.run(task)
            yield from emit(task, names, schema, records, size)

        def source(batches):
            base = started()
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    yield from one(base, i)
            processor.thread_local_finalize()

        def narrow(name):
            def run(batches):
                base, part = started(), TaskContext.get().partitionId()
                for batch in batches:
                    if batch.num_rows:
                        yield from one(base | {name: pa.Table.from_batches([batch])}, part)
                processor.thread_local_finalize()
            return run

        def pieces(frames, batches):
            """Consecutive rows of one port, as they come."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                side = batch["_side"].to_numpy()
                edges = [0, *(np.flatnonzero(side[1:] != side[:-1]) + 1).tolist(), len(side)]
                for start, stop in zip(edges[:-1], edges[1:], strict=True):
                    i = side[start]
                    name, columns = frames[i]
                    yield name, pa.table({c: batch[f"_{i}_{c}"].slice(start, stop - start) for c in columns})

        def streamed(frames):
            def run(batches):
                task = Task(started(), names, logical, TaskContext.get().partitionId())
                for name, rows in processor.stream(pieces(frames, batches), task):
                    task.output(name).append(rows)
                    yield from emit(task, names, schema, records, size)
                    task.output(name).clear()
                processor.thread_local_finalize()
            return run

        def partition(frames):
            def run(batches):
                base, rows = started(), list(batches)
                part = TaskContext.get().partitionId()
                table = pa.Table.from_batches(rows) if rows else None
                bound = dict(base)
                for i, (name, columns) in enumerate(frames):
                    if table is None:
                        bound[name] = pa.table({c: [] for c in columns})
                        continue
                    own = table.filter(pa.compute.equal(table["_side"], i))
                    bound[name] = pa.table({c: own[f"_{i}_{c}"] for c in columns})
                yield from one(bound, part)
                processor.thread_local_finalize()
            return run

        n = self.partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if processor.is_source:
            made = [self.spark.range(0, processor.task_count, 1, processor.task_count).mapInArrow(source, kind)] if processor.task_count else []
        elif any(p.movement is Movement.SCATTER_GATHER for p in processor.inputs):
            groups = [(p.name, ports[p.name]) for p in processor.inputs if p.movement is Movement.SCATTER_GATHER and ports[p.name] is not None]
            tagged, frames = None, []
            for i, (name, g) in enumerate(groups):
                keys = [F.col(k).alias(f"_k{j}") for j, k in enumerate(g.key)]
                order = [F.struct(*[F.col(c) if isinstance(c, str) else c for c in g.order_by]).alias(f"_o{i}")] if g.order_by else []
                side = g.df.select(F.lit(i).alias("_side"), *keys, *order, *[F.col(c).alias(f"_{i}_{c}") for c in g.df.columns])
                tagged = side if tagged is None else tagged.unionByName(side, allowMissingColumns=True)
                frames.append((name, g.df.columns))
            made = []
            if tagged is not None:
                keys = [c for c in tagged.columns if c.startswith("_k")]
                order = [c for c in tagged.columns if c.startswith("_o")]
                bodies = streamed if isinstance(processor, StreamProcessor) else partition
                made = [tagged.repartition(n, *keys).sortWithinPartitions(*keys, "_side", *order).mapInArrow(bodies(frames), kind)]
        else:
            made = [ports[p.name].mapInArrow(narrow(p.name), kind) for p in processor.inputs if p.movement is Movement.ONE_TO_ONE and ports[p.name] is not None]
        if not made:
            return [self.spark.createDataFrame([], T.StructType.fromDDL(p.schema)) for p in processor.outputs]
        whole = self._limited(processor, unite(*made))
        if len(names) > 1:
            whole = whole.persist(StorageLevel.DISK_ONLY)
            self.out.persisted.append(whole)
        if not names:
            self.out.sinks.append((vertex, whole))
        return [whole.where(F.col("_port") == i).select(f"{name}.*") for i, name in enumerate(names)]
