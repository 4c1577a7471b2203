"""Flow graphs: vertices, edges and their validation."""

from __future__ import annotations

import copy
from dataclasses import dataclass

from ..errors import RoutingError
from .ports import InputPort, Movement, OutputPort
from .processor import Processor


@dataclass(frozen=True)
class PortRef:
    """One port of one vertex."""

    graph: FlowGraph
    vertex: int
    index: int
    is_input: bool

    @property
    def port(self) -> InputPort | OutputPort:
        processor = self.graph.vertices[self.vertex].processor
        return (processor.inputs if self.is_input else processor.outputs)[self.index]


@dataclass(frozen=True)
class Vertex:
    graph: FlowGraph
    id: int
    name: str
    processor: Processor

    def input_port(self, which: int | str) -> PortRef:
        return PortRef(self.graph, self.id, _index(self.processor.inputs, which), True)

    def output_port(self, which: int | str) -> PortRef:
        return PortRef(self.graph, self.id, _index(self.processor.outputs, which), False)


def _index(ports, which: int | str) -> int:
    names = [p.name for p in ports]
    at = names.index(which) if which in names else which
    if not isinstance(at, int) or not 0 <= at < len(ports):
        raise IndexError(f"no port {which}")
    return at


class FlowGraph:
    """Processors joined by edges. A port takes any number of edges, the same one twice included (UNION ALL)."""

    def __init__(self):
        self.vertices: list[Vertex] = []
        #: (vertex, input port) to its source (vertex, output port) pairs, in the order they were added.
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def __eq__(self, other):
        return self is other

    __hash__ = object.__hash__

    def add_vertex(self, name: str, processor: Processor) -> Vertex:
        """A vertex with a copy of the processor: what is done to the caller's object later does not reach the graph."""
        vertex = Vertex(self, len(self.vertices), name, copy.copy(processor))
        self.vertices.append(vertex)
        return vertex

    def add_edge(self, source: PortRef, target: PortRef) -> None:
        for ref in (source, target):
            if not isinstance(ref, PortRef) or ref.graph is not self:
                raise ValueError("the port is not of this graph")
        if source.is_input or not target.is_input:
            raise ValueError("an edge leads from an output port to an input port")
        if target.port.movement is Movement.SCATTER_GATHER and not source.port.has_key:
            raise ValueError(f"{target.port.name} groups by key, but {source.port.name} has none")
        self.edges.setdefault((target.vertex, target.index), []).append((source.vertex, source.index))

    def copied(self) -> FlowGraph:
        """A graph of its own with copies of the processors, for one execution."""
        out = FlowGraph()
        for v in self.vertices:
            out.add_vertex(v.name, v.processor)
        out.edges = {target: list(sources) for target, sources in self.edges.items()}
        return out

    def sources(self, vertex: int, port: int) -> list[tuple[int, int]]:
        return self.edges.get((vertex, port), [])

    def consumers(self) -> dict[tuple[int, int], list[tuple[int, int]]]:
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for target, sources in self.edges.items():
            for source in sources:
                out.setdefault(source, []).append(target)
        return out

    def order(self) -> list[Vertex]:
        """Vertices with every producer before its consumers; RoutingError if there is a cycle."""
        needs = {v.id: {s for (t, _), sources in self.edges.items() if t == v.id for s, _ in sources} for v in self.vertices}
        out: list[Vertex] = []
        while needs:
            ready = sorted(v for v, before in needs.items() if not before)
            if not ready:
                raise RoutingError(f"cycle among the vertices {', '.join(self.vertices[v].name for v in sorted(needs))}")
            for v in ready:
                del needs[v]
                out.append(self.vertices[v])
            for before in needs.values():
                before.difference_update(ready)
        return out
