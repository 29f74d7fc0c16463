"""Two processed datasets into one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import config as C
from cohortspark.operators import gates

ID_OFFSET = 100_000_000


def namespaced_patients(df: DataFrame, dataset: str) -> DataFrame:
    """``{dataset}:{patient_id}`` as text; null stays null."""
    pid = F.col("patient_id").cast("string")
    return df.withColumn(
        "patient_id", F.when(pid.isNotNull(), F.concat_ws(":", F.lit(dataset), pid))
    )


def ids_collide(a: DataFrame, b: DataFrame) -> bool:
    common = a.select("stay_id").join(b.select("stay_id"), "stay_id", "left_semi")
    return not common.limit(1).isEmpty()


def offset_stays(df: DataFrame, offset: int = ID_OFFSET) -> DataFrame:
    return df.withColumn("stay_id", F.col("stay_id") + F.lit(offset))


def tagged(df: DataFrame, dataset: str) -> DataFrame:
    return df.withColumn("source_dataset", F.lit(dataset))


def harmonized(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cast shared columns of different type to text on both sides."""
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    for c in ta:
        if c in tb and ta[c] != tb[c]:
            a = a.withColumn(c, F.col(c).cast("string"))
            b = b.withColumn(c, F.col(c).cast("string"))
    return a, b


def merged_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of label frames; a column one side lacks is null there; sorted column order."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select("stay_id", *sorted(c for c in both.columns if c != "stay_id"))


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of many frames: absent or null-typed columns take the type others have."""
    types: dict[str, str] = {}
    order: list[str] = []
    for f in frames:
        for name, kind in f.dtypes:
            if name not in types:
                order.append(name)
                types[name] = kind
            elif types[name] == "void":
                types[name] = kind
            elif kind != "void" and kind != types[name]:
                numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
                types[name] = "double" if {kind, types[name]} <= numeric else "string"
    fixed = [
        f.select(
            *[
                (F.col(c) if c in f.columns else F.lit(None)).cast(
                    "string" if types[c] == "void" else types[c]
                ).alias(c)
                for c in order
            ]
        )
        for f in frames
    ]
    return reduce(DataFrame.unionByName, fixed)


def task_sets(tasks_a: DataFrame, tasks_b: DataFrame) -> DataFrame:
    """(task, side): in ``both``, only in ``a`` or only in ``b``."""
    a, b = tasks_a.select("task"), tasks_b.select("task")
    parts = [
        a.intersect(b).withColumn("side", F.lit("both")),
        a.exceptAll(b).withColumn("side", F.lit("a")),
        b.exceptAll(a).withColumn("side", F.lit("b")),
    ]
    return reduce(DataFrame.unionByName, parts)


def combine(
    a: dict[str, DataFrame], b: dict[str, DataFrame], names: tuple[str, str]
) -> dict[str, DataFrame]:
    """Combine ``static``, ``timeseries`` and ``labels`` of two datasets.

    Checks feature order and frame schemas, namespaces patients, moves the second
    side's stay ids only when ids collide, tags rows by source and unions.
    """
    if "features" in a and "features" in b:
        gates.require(gates.feature_mismatch(a["features"], b["features"]), "features differ")
    diff = gates.schema_differences(a["timeseries"], b["timeseries"])
    if diff:
        raise gates.GateError(f"series schemas differ: {diff}")
    if ids_collide(a["static"], b["static"]):
        b = {k: offset_stays(v) if "stay_id" in v.columns else v for k, v in b.items()}
        if ids_collide(a["static"], b["static"]):
            raise gates.GateError("stay ids collide after the offset")
    sa, sb = (
        tagged(namespaced_patients(side["static"], name), name)
        for side, name in ((a, names[0]), (b, names[1]))
    )
    sa, sb = harmonized(sa, sb)
    return {
        "static": sa.unionByName(sb, allowMissingColumns=True),
        "timeseries": a["timeseries"].unionByName(b["timeseries"]),
        "labels": merged_labels(a["labels"], b["labels"]),
    }


def patients_collide(a: DataFrame, b: DataFrame) -> bool:
    common = a.select("patient_id").join(b.select("patient_id"), "patient_id", "left_semi")
    return not common.limit(1).isEmpty()


def combine_checked(
    a: dict[str, DataFrame], b: dict[str, DataFrame], names: tuple[str, str], required: Sequence[str] = C.BENCHMARK_TASKS,
) -> dict[str, DataFrame]:
    """``combine`` behind all gates, with the combined ``manifest`` of the tasks both sides have.

    Fails closed: what metadata or manifests do not confirm is an error, and all findings are named at once.
    """
    gates.require(gates.combine_findings(a, b, names, required), "the datasets cannot be combined", show=50)
    spaced = [namespaced_patients(side["static"], name) for side, name in zip((a, b), names, strict=True)]
    if patients_collide(*spaced):
        raise gates.GateError("patient ids collide after namespacing")
    out = combine(a, b, names)
    shared = a["manifest"].join(b["manifest"].select("task"), "task", "left_semi")
    return out | {"manifest": shared}
