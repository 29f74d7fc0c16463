"""From an hourly export to a processed dataset."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortspark import config as C
from cohortspark.config import TaskConfig
from cohortspark.operators import cohort, gates, grid, labels
from cohortspark.session import stage
from cohortspark.sources import sinks
from cohortspark.sources.tables import DatasetSource


def feature_names(series: DataFrame, blocked: Sequence[str] = C.BLOCKED_FEATURES) -> list[str]:
    """Feature columns of a wide series, blocked ones left out."""
    keys = {"stay_id", "hour"}
    return [c for c in series.columns if c not in keys and not c.endswith("_mask") and c not in blocked]


def build_tables(
    source: DatasetSource, tasks: Sequence[TaskConfig], stays: DataFrame | None = None,
    features: Sequence[str] | None = None, length: int = C.SEQ_LENGTH_HOURS,
    min_stay_hours: float = C.MIN_STAY_HOURS, order: Sequence[str] | None = None, series: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """``static``, ``timeseries``, ``labels`` and ``removed`` of one dataset, as lazy plans.

    Stays need a valid length of at least ``min_stay_hours`` and one observed cell in
    the input hours; labels are made for exactly those. With ``series``, the staged hourly rows of the stays, the source's
    series is not read and the grid is staged, since every table needs to know which stays it holds.
    """
    cohort_stays = cohort.min_stay(cohort.valid_los(source.stays() if stays is None else stays), min_stay_hours)
    ids = cohort_stays.select("stay_id")
    own = cohort.only_stays(source.source("timeseries"), ids) if series is None else series
    known = cohort.drop_blocked(own)
    names = list(features) if features is not None else feature_names(known)
    seen = cohort.observed_stays(grid.dense_grid(known, cohort_stays, names, length, order))
    if series is not None:
        seen = stage(seen, "grid")
    static = cohort.only_stays(cohort_stays, seen)
    wanted = sorted({s for t in tasks for s in t.sources} - {"stays"})
    sources = {"stays": static, **{s: own if s == "timeseries" else cohort.only_stays(source.source(s), ids) for s in wanted}}
    built = labels.extract_labels(tasks, sources, source.name)
    removed = cohort.without_stays(cohort_stays, seen).select(
        "stay_id", F.lit("no_observation").alias("reason")
    )
    return {"static": static, "timeseries": seen, "labels": built, "removed": removed}


def staged_series(source: DatasetSource, stays: DataFrame) -> tuple[DataFrame, dict]:
    """The hourly rows of the stays, staged, and facts about the whole export observed on the way: the only pass over it.

    Facts: ``rows``, ``last_hour``, ``negative_hours``.
    """
    raw, ids = source.source("timeseries"), stays.select("stay_id")
    hour = F.col("hour")
    facts = [F.count(F.lit(1)).alias("rows"), F.max(hour).alias("last_hour"), F.count_if(hour < 0).alias("negative_hours")]
    if ids.limit(1).isEmpty() or raw.limit(1).isEmpty():  # a join with nothing would not read what is observed
        return stage(raw.limit(0), "series"), raw.agg(*facts).first().asDict()
    seen = Observation()
    series = stage(cohort.only_stays(raw.observe(seen, *facts), ids), "series")
    return series, seen.get


def check_tables(tables: dict[str, DataFrame], limits: dict[str, float] | None = None) -> DataFrame:
    """Fail on broken stays or missing labels; returns the tasks above their missing limit."""
    gates.check_stays(tables["static"])
    lost = gates.label_coverage_issues(tables["static"], tables["labels"]).filter("issue = 'missing'")
    gates.require(lost, "stays without labels")
    return gates.excessive_missing(tables["labels"], limits or {})


def check_horizon(source: DatasetSource, tasks: Sequence[TaskConfig]) -> None:
    short = labels.horizon_check(source.source("timeseries"), tasks).filter("not enough")
    gates.require(short, "the export is too short for")


def build_dataset(
    spark: SparkSession, source: DatasetSource, tasks: Sequence[TaskConfig], path: str,
    signature: str, length: int = C.SEQ_LENGTH_HOURS, min_stay_hours: float = C.MIN_STAY_HOURS,
    exported_hours: int | None = None,
) -> str:
    """Extract, check and write; new stays are appended when the output still fits.

    ``exported_hours`` is the horizon the export states. Without one the largest hour
    of the series stands in.
    """
    if exported_hours is not None and any(labels.required_horizon(t) > exported_hours for t in tasks):
        raise gates.GateError("the export is too short for the labels")
    names = feature_names(source.source("timeseries"))
    settings = {
        "seq_length_hours": length, "min_stay_hours": min_stay_hours,
        "label_horizon_hours": C.LABEL_HORIZON_HOURS,
        "label_hashes": [f"{t.name}:{t.config_hash()}" for t in tasks],
    }
    stays = cohort.min_stay(cohort.valid_los(source.stays()), min_stay_hours)

    def build(new: DataFrame) -> dict[str, DataFrame]:
        series, facts = staged_series(source, new)
        if exported_hours is None:
            short = [t.name for t in tasks if labels.required_horizon(t) > (facts["last_hour"] if facts["last_hour"] is not None else -1) + 1]
            if short:
                raise gates.GateError(f"the export is too short for {short}: its hours end at {facts['last_hour']}")
        tables = build_tables(source, tasks, new, names, length, min_stay_hours, series=series)
        limits = {t.name: t.max_missing_pct for t in tasks if t.max_missing_pct is not None}
        for row in check_tables(tables, limits).collect():  # one row per task at most
            warnings.warn(f"many missing labels: {row.asDict()}", stacklevel=2)
        return tables

    verdict = sinks.append_or_rebuild(spark, path, stays, build, settings, signature, names)
    labels.label_manifest(spark, tasks).coalesce(1).write.mode("overwrite").json(f"{path}/label_manifest")
    return verdict
