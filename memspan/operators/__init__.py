"""Set-oriented operators: retrieval, graph, lifecycle, maintenance, context, metrics."""
