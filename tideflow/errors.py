"""Exceptions of the graph layer."""


class ProcessorDefinitionError(ValueError):
    """A processor declares ports that cannot work together."""


class RoutingError(ValueError):
    """The edges of a graph form a cycle."""
