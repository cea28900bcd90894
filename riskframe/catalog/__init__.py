"""The registered queries: one per operator, each with its reference SQL where SQL can say it."""

from riskframe.catalog import (  # noqa: F401  (importing a module registers its queries)
    etl,
    evaluation,
    features,
    modelling,
    monitoring,
    sampling,
    scorecards,
    selection,
    sources,
    streams,
)
from riskframe.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
