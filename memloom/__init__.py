"""Set-at-a-time knowledge-graph, retrieval and agent-memory analytics on PySpark."""
