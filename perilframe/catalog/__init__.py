"""Registered queries. Importing the package fills the registry."""

from . import tables as _tables  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
from . import (  # noqa: F401  (import for registration)
    q_aggregates,
    q_feeds,
    q_graph,
    q_joins,
    q_learning,
    q_portfolio,
    q_rowwise,
    q_series,
    q_text,
)
