"""Graph layer: ports, processors, flow graphs, their compiler and the execution context."""
