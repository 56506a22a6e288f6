"""loomgraph: documents to a queryable knowledge graph, as Spark DataFrame transforms."""

__version__ = "0.1.0"
