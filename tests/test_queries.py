"""A spread of the registered queries against DuckDB; ``check_queries.py`` runs all of them."""

import pytest

import check_queries as CQ
from cohortspark.plans.catalog import ORACLES, QUERIES

SAMPLE = (
    "hourly_bins", "concept_rules", "slot_selection", "mortality_windowed", "aki_labels", "absolute_rise",
    "patient_split", "label_fraction", "sliding_windows", "tabular_summary", "normalization_stats",
    "block_timestep_mask", "missing_by_group", "ranking_metrics", "binary_report", "signed_rank_test",
    "embedding_dim_stats", "fairness_staleness", "matrix_differences",
)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, sf, name):
    ok, text, _ = CQ.compare(spark, CQ.duck(sf), name, sf)
    assert ok, text


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
