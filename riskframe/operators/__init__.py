from riskframe.operators import (
    clean,
    evaluate,
    generate,
    models,
    monitor,
    neighbours,
    ordering,
    preprocess,
    profile,
    sampling,
    scorecard,
    scoring,
    screening,
    tuning,
)

__all__ = [
    "clean",
    "evaluate",
    "generate",
    "models",
    "monitor",
    "neighbours",
    "ordering",
    "preprocess",
    "profile",
    "sampling",
    "scorecard",
    "scoring",
    "screening",
    "tuning",
]
