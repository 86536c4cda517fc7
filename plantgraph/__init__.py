"""plantgraph: structural analytics over facility cooling networks, as Spark DataFrames."""

__version__ = "0.1.0"
