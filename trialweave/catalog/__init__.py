"""Named queries over the driver tables, each with its SQL counterpart where one exists."""

from .registry import ORACLES, QUERIES
from . import (  # noqa: F401  (importing registers the queries)
    arrays,
    channels,
    epochs,
    events,
    learning,
    signals,
    sources,
    stats,
)

__all__ = ["ORACLES", "QUERIES"]
