"""Writers: part files by stay, processed datasets, marts, snapshots, resumable appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.cohort import only_stays
from cohortspark.operators.grid import dense_to_rows
from cohortspark.sources.tables import path_exists

TABLES = ("static", "timeseries", "labels")
MART_TABLES = (
    "per_seed", "aggregated", "metrics_long", "run_configs", "label_efficiency_curve",
    "capacity_comparison", "classical_context", "statistical_tests", "extension_tests",
)


def write_hourly(df: DataFrame, path: str, parts: int | None = None, mode: str = "overwrite") -> None:
    """Part files clustered by stay and hour; Spark chooses the number unless it is given.

    Rows are spread by (stay, hour block), so one huge stay fills several files.
    """
    block = F.floor(F.col("hour") / F.lit(24))
    keyed = df.repartition(parts, "stay_id", block) if parts else df.repartition("stay_id", block)
    keyed.sortWithinPartitions("stay_id", "hour").write.mode(mode).parquet(path)


def write_dataset(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    for name in TABLES:
        tables[name].write.mode(mode).parquet(f"{path}/{name}")


def write_metadata(meta: DataFrame, path: str) -> None:
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def extraction_metadata(
    spark: SparkSession, stays: DataFrame, labels: DataFrame, features: Sequence[str],
    settings: dict, signature: str | None = None,
) -> DataFrame:
    """One row: settings, feature names, counts and the labelled share per task."""
    tasks = [c for c in labels.columns if c != "stay_id"]
    known = F.array(
        *[F.struct(F.lit(t).alias("task"), F.count(t).alias("non_null")) for t in tasks]
    ) if tasks else F.lit(None)
    counts = stays.agg(F.count(F.lit(1)).alias("n_stays")).crossJoin(labels.agg(known.alias("labels")))
    return _described(counts, tasks, features, settings, signature)


def _described(counts: DataFrame, tasks: Sequence[str], features: Sequence[str], settings: dict, signature: str | None) -> DataFrame:
    extra = {k: F.lit(v) if not isinstance(v, (list, tuple)) else F.array(*[F.lit(x) for x in v])
             for k, v in settings.items()}
    return counts.withColumns(
        {
            "feature_names": F.array(*[F.lit(f) for f in features]),
            "n_features": F.lit(len(features)), "tasks": F.array(*[F.lit(t) for t in tasks]),
            "upstream_signature": F.lit(signature), "zero_observation_stays_excluded": F.lit(True), **extra,
        }
    )


def counted(df: DataFrame, labels: bool = False) -> tuple[DataFrame, Observation]:
    """``df`` with its rows counted while it is written, and the non-null values of each label column with ``labels``."""
    seen = Observation()
    return df.observe(seen, *_counts(df, labels)), seen


def _counts(df: DataFrame, labels: bool) -> list[Column]:
    tasks = [c for c in df.columns if c != "stay_id"] if labels else []
    return [F.count(F.lit(1)).alias("rows"), *[F.count(t).alias(f"task:{t}") for t in tasks]]


def observed_metadata(
    spark: SparkSession, counts: dict[str, int], features: Sequence[str], settings: dict, signature: str | None = None,
) -> DataFrame:
    """The row of ``extraction_metadata`` from counts observed on the writes: ``rows`` of the static table and ``task:<name>``."""
    tasks = {k.removeprefix("task:"): v for k, v in counts.items() if k.startswith("task:")}
    known = [F.struct(F.lit(t).alias("task"), F.lit(n).cast("bigint").alias("non_null")) for t, n in tasks.items()]
    row = spark.range(1).select(F.lit(counts["rows"]).cast("bigint").alias("n_stays"), (F.array(*known) if known else F.lit(None)).alias("labels"))
    return _described(row, list(tasks), features, settings, signature)


def write_embeddings(df: DataFrame, path: str, id_col: str = "id") -> None:
    df.select(
        F.col(id_col).alias("id"), F.col("embedding").cast("array<float>").alias("embedding")
    ).write.mode("overwrite").parquet(path)


def write_marts(marts: dict[str, DataFrame], path: str, warnings: DataFrame | None = None,
                allow_incomplete: bool = False) -> None:
    """The nine result tables; refused while the validation has warnings, unless allowed."""
    from cohortspark.operators.gates import require

    lost = sorted(set(MART_TABLES) - set(marts))
    if lost:
        raise ValueError(f"tables missing: {lost}")
    if warnings is not None and not allow_incomplete:
        require(warnings, "result validation failed")
    for name in MART_TABLES:
        marts[name].write.mode("overwrite").parquet(f"{path}/{name}")


def write_snapshot(
    tables: dict[str, DataFrame], ids: DataFrame, features: Sequence[str], path: str,
    include_labels: bool = True, flatten: bool = True,
) -> None:
    """CSV folders of the chosen stays, with a small metadata record beside them."""
    from cohortspark.operators.grid import dense_to_long

    series = only_stays(tables["timeseries"], ids)
    rows = dense_to_long(series, features) if flatten else dense_to_rows(series, features)
    out = {"static": only_stays(tables["static"], ids), "timeseries": rows}
    if include_labels:
        out["labels"] = only_stays(tables["labels"], ids)
    for name, df in out.items():
        df.orderBy(*[c for c in ("stay_id", "hour", "feature_name") if c in df.columns]) \
            .write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    meta = ids.agg(
        F.count(F.lit(1)).alias("n_stays"), F.lit(flatten).alias("flattened"),
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
    )
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/snapshot_metadata")


# --- resume --------------------------------------------------------------------------------

def new_stays(spark: SparkSession, stays: DataFrame, path: str) -> DataFrame:
    """Stays that the output does not hold yet."""
    where = f"{path}/static"
    if not path_exists(spark, where):
        return stays
    done = spark.read.parquet(where).select("stay_id")
    return stays.join(done, "stay_id", "left_anti")


def can_resume(spark: SparkSession, path: str, settings: dict, signature: str) -> bool:
    """An output is extended only when settings and inputs are those it was made from."""
    where = f"{path}/metadata"
    if not (path_exists(spark, where) and all(path_exists(spark, f"{path}/{t}") for t in TABLES)):
        return False
    row = spark.read.json(where).first()
    if row is None:
        return False
    saved = row.asDict(recursive=True)
    return saved.get("upstream_signature") == signature and all(
        saved.get(k) == (list(v) if isinstance(v, tuple) else v) for k, v in settings.items()
    )


def append_or_rebuild(
    spark: SparkSession, path: str, stays: DataFrame, build, settings: dict, signature: str,
    features: Sequence[str],
) -> str:
    """Append the tables of new stays to a resumable output, or rebuild it; says which.

    The list of done stays is read from the static table, so it is cut from its
    lineage before the same folder is appended to. A run that ended between two tables left
    stays without a static row: tables that have them already do not get them again.
    """
    from cohortspark.session import cut_lineage

    if can_resume(spark, path, settings, signature):
        fresh = cut_lineage(new_stays(spark, stays, path))
        if fresh.limit(1).isEmpty():
            return "unchanged"
        # static last: a stay counts as done only when its other tables are written
        tables = build(fresh)
        counts = saved_counts(spark, path)
        for name in ("timeseries", "labels", "static"):
            held = spark.read.parquet(f"{path}/{name}").join(fresh.select("stay_id"), "stay_id", "left_semi")
            done = cut_lineage(held.select("stay_id").distinct())
            lacking, seen = counted(tables[name].join(done, "stay_id", "left_anti").select(tables[name].columns), name == "labels")
            died = not done.limit(1).isEmpty()
            # rows of a run that died are in the table, but not in the saved counts
            left = held.agg(*_counts(held, name == "labels")).first().asDict() if died else {}
            lacking.write.mode("append").parquet(f"{path}/{name}")
            if name != "timeseries":
                _add(counts, seen.get, name)
                _add(counts, left, name)
        verdict = "appended"
    else:
        tables, counts = build(stays), {}
        for name in ("timeseries", "labels", "static"):
            table, seen = counted(tables[name], name == "labels")
            table.write.mode("overwrite").parquet(f"{path}/{name}")
            if name != "timeseries":
                _add(counts, seen.get, name)
        verdict = "rebuilt"
    meta = observed_metadata(spark, counts, features, settings, signature)
    write_metadata(meta, path)
    return verdict


def _add(counts: dict[str, int], seen: dict, table: str) -> None:
    for k, n in seen.items():
        if k.startswith("task:") or table == "static":
            counts[k] = counts.get(k, 0) + n


def saved_counts(spark: SparkSession, path: str) -> dict[str, int]:
    """The counts that the stored metadata give."""
    row = spark.read.json(f"{path}/metadata").first().asDict(recursive=True)
    return {"rows": row["n_stays"], **{f"task:{r['task']}": r["non_null"] for r in row.get("labels") or []}}
