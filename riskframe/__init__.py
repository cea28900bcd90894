"""riskframe: supervised risk analytics as Spark DataFrame, ML and streaming work."""

from riskframe import functions, operators, plans, sources, streaming

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
