"""Physical-plan helpers shared by the operators."""

from .checkpoints import cut_lineage
from .sizing import join_measured, measured
from .ordering import (
    exact_quantiles,
    hashed_rank,
    join_keys,
    neighbours,
    number_and_least,
    number_rows,
    running_sum,
)
from .blocks import apply_model, moments, run_blocks, split_blocks

__all__ = [
    "apply_model",
    "cut_lineage",
    "exact_quantiles",
    "hashed_rank",
    "join_keys",
    "join_measured",
    "measured",
    "moments",
    "neighbours",
    "number_and_least",
    "number_rows",
    "run_blocks",
    "running_sum",
    "split_blocks",
]
