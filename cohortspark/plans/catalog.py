"""All registered queries."""

from cohortspark.plans import (  # noqa: F401
    queries_cohort,
    queries_io,
    queries_runs,
    queries_scores,
    queries_series,
)
from cohortspark.plans.registry import ORACLES, QUERIES  # noqa: F401
