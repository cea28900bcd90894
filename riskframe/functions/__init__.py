from riskframe.functions.expr import (
    NULL_TOKENS,
    drop_nan,
    hash_unit,
    interval_bin,
    key_hash,
    known,
    long_form,
    null_safe,
    ratio,
    round_half_up,
)

__all__ = [
    "NULL_TOKENS",
    "drop_nan",
    "hash_unit",
    "interval_bin",
    "key_hash",
    "known",
    "long_form",
    "null_safe",
    "ratio",
    "round_half_up",
]
