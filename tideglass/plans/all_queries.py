"""Imports every module that registers queries."""

from . import (  # noqa: F401
    data_queries,
    feature_queries,
    label_queries,
    metric_queries,
    model_queries,
    portfolio_queries,
    recursion_queries,
)
