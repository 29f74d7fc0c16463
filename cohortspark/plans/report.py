"""From run records to the nine result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cohortspark import config as C
from cohortspark.operators import cohort, gates, results
from cohortspark.session import cut_lineage


def result_tables(
    runs: DataFrame, allow_duplicates: bool = False, expected: DataFrame | None = None,
    wide_metrics: Sequence[str] = ("test/auprc", "test/auroc", "test/mae"),
    seeds: Sequence[int] = C.FIXED_SEEDS,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The marts and the validation warnings; the caller decides what to do about those."""
    flat = results.flatten_runs(runs)
    gates.require(results.missing_class(flat), "runs without an experiment class")
    rows = cut_lineage(results.per_seed(flat, allow_duplicates))  # every table reads it
    keys = [k for k in C.FINGERPRINT if k in rows.columns]
    long = results.metrics_long(rows, [*keys, "run_id"])
    agg = results.aggregate_seeds(long, keys)
    wide = results.wide_aggregate(agg, keys, wide_metrics)
    tests = results.statistical_tests(rows)
    marts = {
        "per_seed": cohort.public_columns(rows, ("config_json",)),
        "aggregated": results.null_safe_join(results.seed_counts(rows), wide, keys),
        "metrics_long": results.metrics_long(rows),
        "run_configs": results.run_configs(rows),
        "label_efficiency_curve": results.label_efficiency_view(rows),
        "capacity_comparison": results.capacity_view(rows),
        "classical_context": results.classical_views(rows),
        "statistical_tests": tests,
        "extension_tests": results.extension_tests(rows),
    }
    return marts, gates.validate_marts(rows, tests, expected, seeds)
