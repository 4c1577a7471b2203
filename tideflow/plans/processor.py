"""Processors: the vertices of a flow graph."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import ProcessorDefinitionError
from .ports import InputPort, Movement, OutputPort


@dataclass(frozen=True)
class Write:
    """What a sink's ``process`` may return instead of a DataFrame: an execution writes it."""

    df: DataFrame
    path: str
    format: str = "parquet"
    mode: str = "overwrite"
    partition_by: tuple[str, ...] = ()
    options: dict[str, Any] = field(default_factory=dict)

    def run(self) -> None:
        self.df.write.mode(self.mode).options(**self.options).partitionBy(*self.partition_by).format(self.format).save(self.path)


class Processor:
    """A vertex whose work is declared with DataFrames.

    Subclasses override ``process`` (or pass ``fn``). It gets one keyword argument per input
    port: a DataFrame for ONE_TO_ONE and BROADCAST ports, a ``Grouped`` for SCATTER_GATHER
    ports. Several ONE_TO_ONE ports are a union: ``process`` is called once for each with the
    others as None, and the outputs are united. It returns a DataFrame per output port (a
    mapping, or the DataFrame itself if there is one port). A sink, without output ports, returns a
    ``Write``, a DataFrame that is only run, or None if ``process`` itself has done everything.
    """

    def __init__(self, inputs: Sequence[InputPort] = (), outputs: Sequence[OutputPort] = (), fn=None, *,
                 task_count: int | None = None, max_concurrency: int | None = None):
        self.inputs, self.outputs, self._fn = tuple(inputs), tuple(outputs), fn
        movements = {p.movement for p in self.inputs}
        if {Movement.ONE_TO_ONE, Movement.SCATTER_GATHER} <= movements:
            raise ProcessorDefinitionError("ONE_TO_ONE and SCATTER_GATHER ports cannot be mixed")
        for ports in (self.inputs, self.outputs):
            if len({p.name for p in ports}) < len(ports):
                raise ProcessorDefinitionError("two ports have the same name")
        self.task_count, self.max_concurrency = 0, None
        if task_count is not None:
            self.set_task_count(task_count)
        if max_concurrency is not None:
            self.set_max_concurrency(max_concurrency)

    def set_task_count(self, n: int) -> Processor:
        """Number of runs of a source; other processors have theirs from their input."""
        if any(p.movement is not Movement.BROADCAST for p in self.inputs):
            raise ProcessorDefinitionError("task_count is for processors with BROADCAST ports at most")
        if n < 0:
            raise ValueError("task_count is 0 or more")
        self.task_count = n
        return self

    def set_max_concurrency(self, n: int) -> Processor:
        if n < 1:
            raise ValueError("max_concurrency is 1 or more")
        self.max_concurrency = n
        return self

    @property
    def is_source(self) -> bool:
        return all(p.movement is Movement.BROADCAST for p in self.inputs)

    def global_initialize(self, broadcasts: dict[str, Any]) -> None:
        """Once for each execution, on the driver, before any run."""

    def global_finalize(self, cancelled: bool) -> None:
        """Once for each initialised processor, on the driver, whether the run succeeded or not."""

    def process(self, **ports) -> Any:
        if self._fn is None:
            raise NotImplementedError
        return self._fn(**ports)


class Task:
    """What opaque code sees of one run."""

    def __init__(self, inputs: dict[str, pa.Table | None], outputs: Sequence[str], logical: int, physical: int):
        self._inputs, self._out = inputs, {name: [] for name in outputs}
        self.logical_task_id, self.physical_task_id, self.is_cancelled = logical, physical, False

    def input(self, port: str) -> pa.Table | None:
        """The port's rows; None if this run is another port's."""
        if port not in self._inputs:
            raise IndexError(f"no input port {port}")
        return self._inputs[port]

    def output(self, port: str) -> list:
        """Append Arrow tables or batches, or lists of dicts, to emit them; empty ones send nothing."""
        if port not in self._out:
            raise IndexError(f"no output port {port}")
        return self._out[port]


class ArrowProcessor(Processor):
    """A vertex of opaque code on Arrow data.

    ``run`` is called once for each task index of a source, each batch of a ONE_TO_ONE port, or
    each partition (empty ones too) of SCATTER_GATHER ports, whose rows are sorted by key and
    then by the port's order. ``thread_local_initialize`` and ``_finalize`` surround the runs of
    a partition inside the worker. State set by ``global_initialize`` is shipped to workers.
    Output ports need a schema.
    """

    def __init__(self, inputs: Sequence[InputPort] = (), outputs: Sequence[OutputPort] = (), **settings):
        super().__init__(inputs, outputs, **settings)
        for port in self.outputs:
            if port.schema is None:
                raise ProcessorDefinitionError(f"port {port.name} of opaque code needs a schema")

    def thread_local_initialize(self) -> None: ...

    def thread_local_finalize(self) -> None: ...

    def run(self, task: Task) -> None:
        raise NotImplementedError

    def process(self, **ports) -> DataFrame:
        raise NotImplementedError("the compiler runs opaque code")


class StreamProcessor(ArrowProcessor):
    """Opaque code that reads a partition of SCATTER_GATHER ports as a stream, so neither a partition nor a key need fit in a worker.

    ``stream`` gets an iterator of (port name, Arrow table) over the partition's rows, sorted by key; a key's rows come
    port by port and then in the port's order, in as many tables as they need. It yields (output port, rows), rows as
    ``Task.output`` takes them; they are sent on before the next piece is read. It is called for empty partitions too.
    """

    def __init__(self, inputs: Sequence[InputPort] = (), outputs: Sequence[OutputPort] = (), **settings):
        super().__init__(inputs, outputs, **settings)
        if not any(p.movement is Movement.SCATTER_GATHER for p in self.inputs):
            raise ProcessorDefinitionError("a stream needs a SCATTER_GATHER port")

    def stream(self, pieces: Iterator[tuple[str, pa.Table]], task: Task) -> Iterator[tuple[str, Any]]:
        raise NotImplementedError

    def run(self, task: Task) -> None:
        raise NotImplementedError("the compiler calls stream")


def emit(task: Task, names: Sequence[str], schema: pa.Schema, records: int | None = None, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """What a run has put out, as batches of (_port, one struct per port) with at most ``records`` rows and about ``size`` bytes."""
    for i, name in enumerate(names):
        kind = schema.field(name).type
        for item in task.output(name):
            if isinstance(item, list):
                table = pa.Table.from_pylist(item, pa.schema(list(kind)))
            else:
                table = pa.Table.from_batches([item]) if isinstance(item, pa.RecordBatch) else item
            table = table.select([f.name for f in kind]).cast(pa.schema(list(kind)))
            most = records
            if size and table.nbytes > size:
                most = min(records or table.num_rows, max(1, size * table.num_rows // table.nbytes))
            for batch in table.to_batches(max_chunksize=most):
                n = batch.num_rows
                if not n:
                    continue
                own = pa.StructArray.from_arrays(batch.columns, fields=list(kind))
                columns = [pa.array([i] * n, pa.int32())]
                columns += [own if other == name else pa.nulls(n, schema.field(other).type) for other in names]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
