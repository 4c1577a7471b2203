"""tideflow: a Spark-native batch dataflow engine.

A job is either a composition of the functions in ``tideflow.operators`` or a
``FlowGraph`` of processors joined by ports whose movement (straight through,
hash-partitioned by key, gathered and broadcast) is declared, and which compiles
to lazy DataFrames so that Catalyst plans the whole graph at once.
"""

from .errors import ProcessorDefinitionError, RoutingError
from .plans.context import Configuration, Context, ThreadObserver
from .plans.graph import FlowGraph
from .plans.ports import Grouped, InputPort, Movement, OutputPort
from .plans.processor import ArrowProcessor, Processor, StreamProcessor, Task

__all__ = [
    "ArrowProcessor", "Configuration", "Context", "FlowGraph", "Grouped", "InputPort", "Movement",
    "OutputPort", "Processor", "ProcessorDefinitionError", "RoutingError", "StreamProcessor", "Task", "ThreadObserver",
]
