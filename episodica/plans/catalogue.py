"""All registered queries."""

from episodica.plans import (  # noqa: F401
    dataset_queries,
    feature_queries,
    filter_queries,
    join_queries,
    metric_queries,
    model_queries,
    report_queries,
    sampling_queries,
    scalar_queries,
    source_queries,
    window_queries,
)
from episodica.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
