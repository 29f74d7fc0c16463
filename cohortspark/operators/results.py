"""Run records to result tables: flattening, per-seed and seed-aggregated marts, views, tests."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark import config as C
from cohortspark.functions import values as V
from cohortspark.functions.tdist import t_975
from cohortspark.operators.events import keep_last
from cohortspark.operators.ordering import exact_quantiles, null_safe_join
from cohortspark.operators.significance import bonferroni, cohens_d, signed_rank
from cohortspark.session import cut_lineage

MOST_PARADIGMS = 200
IDENTITY = (
    "run_id", "run_url", "run_name", "experiment_class", "paradigm", "dataset", "task", "seed",
    "phase", "revision", "launch_commit",
)


# --- flattening ----------------------------------------------------------------------

#: the part of a run's config that the marts read; every leaf as text, whatever its JSON type
CONFIG_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "experiment_class", "phase", "paradigm", "dataset", "seed", "protocol", "label_fraction",
            "revision", "launch_commit", "source_dataset", "output_dir", "model_size",
            "experiment_subtype", "upstream_pretrain_lr", "upstream_pretrain_mask_ratio",
        )
    ]
    + [
        T.StructField(n, T.StructType([T.StructField(k, T.StringType()) for k in keys]))
        for n, keys in (
            ("ssl", ("name", "mask_ratio")), ("task", ("task_name",)),
            ("training", ("freeze_encoder",)), ("optimizer", ("lr",)),
            ("xgboost", ("learning_rate",)), ("encoder", ("name", "d_model", "n_layers")),
        )
    ]
)


def with_config(runs: DataFrame) -> DataFrame:
    """Add the JSON text of ``config`` as a struct, so that a row is parsed once and not once per value."""
    return runs.withColumn("_cfg", F.from_json("config", CONFIG_SCHEMA))


def parsed(key: str) -> Column:
    """A value of the parsed config by its dotted key."""
    return F.col(f"_cfg.{key}")


def flatten_runs(runs: DataFrame) -> DataFrame:
    """One wide row per run: identity, fingerprint, provenance text and a metric map.

    Input: ``id, url, name, group, created_at, tags array, config JSON, summary map of
    text``. The config is parsed once. Config wins over tags; phase, protocol, size and
    source are inferred when neither states them.
    """
    cfg = parsed
    tag = lambda prefix: V.tag_value("tags", prefix)
    text = lambda c: F.nullif(c, F.lit(""))
    plain = cfg("paradigm")
    paradigm = F.coalesce(text(plain), cfg("ssl.name"))
    inferred = F.coalesce(
        text(cfg("phase")), tag("phase"),
        F.when(plain.isin(*C.CLASSICAL_PARADIGMS), "baseline")
        .when(plain == "supervised", "supervised").otherwise("finetune"),
    )
    phase = F.col("_phase")
    frozen = cfg("training.freeze_encoder").try_cast("boolean")
    protocol = F.coalesce(
        V.protocol_of(F.col("_protocol")),
        V.protocol_from_freeze(frozen),
        F.when((plain == "xgboost") | (phase == "baseline"), F.lit(C.FULL_FINETUNE)),
    )
    lr = F.when(
        paradigm == "xgboost", F.coalesce(cfg("xgboost.learning_rate"), cfg("optimizer.lr"))
    ).otherwise(cfg("optimizer.lr"))
    klass = F.col("_class")
    numbers = F.transform_values(
        F.map_filter("summary", lambda k, v: v.isNotNull() & V.is_metric_key(k)), lambda k, v: v.try_cast("double")
    )
    metrics = F.map_filter(numbers, lambda k, v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))  # NaN is above all numbers
    fairness_keys = F.sort_array(
        F.map_keys(F.map_filter("summary", lambda k, v: v.isNotNull() & k.startswith("fairness/")))
    )
    staged = with_config(runs).withColumns(  # what several columns read is computed once per row
        {
            "_up": V.recover_pretrain(cfg, "name"), "_phase": inferred,
            "_class": F.coalesce(text(cfg("experiment_class")), tag("experiment_class")),
            "_protocol": V.protocol_key(F.coalesce(text(cfg("protocol")), tag("protocol"))),
        }
    )
    s = lambda key: F.element_at("summary", F.lit(key))
    return staged.select(
        F.col("id").alias("run_id"), F.col("url").alias("run_url"), F.col("name").alias("run_name"),
        F.col("group").alias("run_group"), "created_at",
        klass.alias("experiment_class"), klass.alias("experiment_type"),
        F.col("_up.subtype").alias("experiment_subtype"), paradigm.alias("paradigm"),
        cfg("dataset").alias("dataset"), cfg("task.task_name").alias("task"),
        cfg("seed").try_cast("bigint").alias("seed"), protocol.alias("protocol"),
        F.coalesce(cfg("label_fraction").try_cast("double"), F.lit(1.0)).alias("label_fraction"),
        lr.try_cast("double").alias("lr"), cfg("ssl.mask_ratio").try_cast("double").alias("mask_ratio"),
        V.model_size(cfg).alias("model_size"),
        V.recover_source_dataset(cfg, "name").alias("source_dataset"),
        F.coalesce(text(cfg("revision")), tag("revision")).alias("revision"),
        F.coalesce(text(cfg("launch_commit")), tag("commit")).alias("launch_commit"),
        phase.alias("phase"), F.col("_up.lr").alias("upstream_pretrain_lr"),
        F.col("_up.mask_ratio").alias("upstream_pretrain_mask_ratio"),
        cfg("output_dir").alias("output_dir"),
        *[
            s(f"_{k}").alias(k)
            for k in (
                "eval_checkpoint_source", "eval_artifact_path", "eval_artifact_sha256",
                "best_ckpt_path", "best_ckpt_load_ok", "best_ckpt_error",
                "fairness_summary_schema_version", "fairness_script_version",
                "fairness_artifact_path", "fairness_artifact_sha256", "fairness_artifact_source",
                "fairness_checkpoint_source", "fairness_protected_attributes",
                "fairness_min_subgroup_size",
            )
        ],
        fairness_keys.alias("fairness_keys"),
        F.coalesce("config", F.lit("{}")).alias("config_json"), metrics.alias("metrics"),
    )


def missing_class(flat: DataFrame) -> DataFrame:
    """Runs that state no experiment class; an export must not contain any."""
    return flat.filter(F.col("experiment_class").isNull()).select("run_id")


def fingerprint(columns: Sequence[str] = C.FINGERPRINT) -> Column:
    """One hash of the scientific identity; nulls are part of it."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def latest_runs(flat: DataFrame, keys: Sequence[str] = (*C.FINGERPRINT, "seed")) -> DataFrame:
    """The newest run per key; each task keeps one per key before the shuffle.

    Rows are sorted by a hash of the key first: one number tells most keys apart, where the
    texts of a key would be compared one by one. Equal hashes are still told apart by the key.
    """
    keys = [k for k in keys if k in flat.columns]
    hashed = flat.withColumn("_hash", F.xxhash64(*keys) if keys else F.lit(0))
    return keep_last(hashed, ["_hash", *keys], ["created_at", "run_id"]).drop("_hash")


def per_seed(flat: DataFrame, allow_duplicates: bool = False) -> DataFrame:
    """The per-seed mart; ambiguous or (unless allowed) repeated fingerprints are errors."""
    from cohortspark.operators.gates import duplicate_fingerprints, fingerprint_collisions

    flat = cut_lineage(flat)  # two checks and the mart read it
    if not fingerprint_collisions(flat).limit(1).isEmpty():
        raise ValueError("different runs share one fingerprint")
    if not allow_duplicates and not duplicate_fingerprints(flat).limit(1).isEmpty():
        raise ValueError("repeated fingerprints; pass allow_duplicates to keep the newest")
    return latest_runs(flat)


def class_row_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("experiment_class").agg(F.count(F.lit(1)).alias("n_rows"))


def metrics_long(df: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """(identity, metric_name, metric_value) of the finite metrics."""
    ids = [c for c in identity if c in df.columns]
    return df.select(*ids, F.explode("metrics").alias("metric_name", "metric_value")).filter(
        F.col("metric_value").isNotNull() & ~F.isnan("metric_value")
        & (F.abs("metric_value") < F.lit(float("inf")))
    )


def run_configs(df: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    ids = [c for c in identity if c in df.columns]
    return df.select(*ids, F.coalesce("config_json", F.lit("{}")).alias("config_json"))


# --- seed aggregation ---------------------------------------------------------------------

def mean_ci95(mean: Column, std: Column, n: Column) -> tuple[Column, Column]:
    """Student-t interval of a mean: NaN below two values, the mean itself when std is 0."""
    half = t_975(n - 1) * std / F.sqrt(n.cast("double"))

    def edge(sign):
        return F.when(n < 2, float("nan")).when(std == 0, mean).otherwise(mean + sign * half)

    return edge(-1.0), edge(1.0)


def aggregate_seeds(
    long: DataFrame, keys: Sequence[str], name: str = "metric_name", value: str = "metric_value"
) -> DataFrame:
    """n, mean, std (0 for one seed), min, max and 95 % interval per key and metric."""
    v = F.col(value)
    per = long.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, name).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    low, high = mean_ci95(F.col("mean"), F.col("std"), F.col("n"))
    return per.withColumns({"ci95_lower": low, "ci95_upper": high})


def seed_counts(per_seed_rows: DataFrame, keys: Sequence[str] = C.FINGERPRINT) -> DataFrame:
    """Number of runs and of distinct seeds per fingerprint."""
    keys = [k for k in keys if k in per_seed_rows.columns]
    return per_seed_rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.count_distinct("seed").alias("n_distinct_seeds")
    )


def seed_members(per_seed_rows: DataFrame, keys: Sequence[str] = C.FINGERPRINT) -> DataFrame:
    """The runs and seeds behind every aggregated row, one row each instead of lists."""
    keys = [k for k in keys if k in per_seed_rows.columns]
    extra = [c for c in ("seed", "run_id") if c in per_seed_rows.columns]
    return per_seed_rows.select(fingerprint(keys).alias("fingerprint"), *keys, *extra)


def wide_aggregate(agg: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``{metric}/{stat}`` columns for the named metrics."""
    stats = ("n", "mean", "std", "min", "max", "ci95_lower", "ci95_upper")
    cols = [
        F.max(F.when(F.col("metric_name") == m, F.col(s))).alias(f"{m}/{s}")
        for m in metrics for s in stats
    ]
    return agg.groupBy(*keys).agg(*cols)


def seed_distribution(counts: DataFrame) -> DataFrame:
    return counts.groupBy("experiment_class", "n_seeds").agg(F.count(F.lit(1)).alias("n_configs"))


# --- views -------------------------------------------------------------------------------------

def _view(df: DataFrame, cond: Column, view: Column, klass: Column) -> DataFrame:
    """The rows of a view, in one pass: its conditions exclude each other."""
    return df.filter(cond).withColumns(
        {
            "source_experiment_class": F.col("experiment_class"),
            "experiment_class": klass, "experiment_type": klass, "comparison_view": view,
        }
    )


def _fraction() -> Column:
    return F.coalesce(F.col("label_fraction"), F.lit(1.0))


def label_efficiency_view(df: DataFrame) -> DataFrame:
    """Low-label rows plus the full-label core rows that end their curves."""
    own = F.col("experiment_class") == "label_efficiency"
    end = (
        (F.col("experiment_class") == "core_ssl_benchmark") & (_fraction() == 1.0)
        & F.col("phase").isin("finetune", "supervised") & F.col("source_dataset").isNull()
        & (F.col("model_size") == "default")
    )
    name = "label_efficiency_with_core_endpoint"
    return _view(df, own | end, F.lit(name), F.lit("label_efficiency"))


def capacity_view(df: DataFrame) -> DataFrame:
    own = F.col("experiment_class") == "capacity_study"
    base = (
        F.col("experiment_class").isin("core_ssl_benchmark", "label_efficiency")
        & (F.col("dataset") == "miiv") & (F.col("task") == "mortality_24h")
        & F.col("paradigm").isin("mae", "supervised") & (F.col("model_size") == "default")
        & _fraction().isin(*C.MATRIX_CAPACITY_FRACTIONS, 1.0)
    )
    name = "capacity_with_default_baseline"
    return _view(df, own | base, F.lit(name), F.lit("capacity_study"))


def classical_views(df: DataFrame) -> DataFrame:
    """Fully tuned rows beside the classical baselines, at full and at low label counts."""
    tuned = V.protocol_name("protocol") == C.FULL_FINETUNE
    klass = F.col("experiment_class")
    full = tuned & (_fraction() == 1.0) & klass.isin("core_ssl_benchmark", "classical_baselines")
    low = tuned & (_fraction() < 1.0) & klass.isin("label_efficiency", "classical_baselines")
    view = F.when(full, C.CONTEXT_CLASSES[0]).otherwise(C.CONTEXT_CLASSES[1])
    return _view(df, full | low, view, view)


# --- paired tests ---------------------------------------------------------------------------------

def primary_values(df: DataFrame) -> DataFrame:
    """Adds the primary metric of the row's task and its value."""
    named = df.withColumn("primary_metric_name", V.primary_metric("task"))
    return named.withColumn(
        "primary_metric_value", F.element_at("metrics", F.col("primary_metric_name"))
    )


def paradigm_names(df: DataFrame) -> list[str]:
    """The distinct paradigms: a short list of method names, read once."""
    rows = df.select("paradigm").filter("paradigm is not null").distinct().take(MOST_PARADIGMS + 1)
    if len(rows) > MOST_PARADIGMS:
        raise ValueError("too many paradigms to pair; name the ones to compare")
    return sorted(r["paradigm"] for r in rows)


def paired_values(
    df: DataFrame, scope: Sequence[str], pairs: Sequence[tuple[str, str]],
    value: str = "primary_metric_value",
) -> DataFrame:
    """(scope, task, seed, paradigm_a, paradigm_b, value_a, value_b) for the listed pairs.

    Each (scope, task, seed) first becomes one row with a column per paradigm, which the
    listed pairs then read: no self-join, and a side may be missing.
    """
    names = sorted({n for p in pairs for n in p})
    keys = list(dict.fromkeys([*scope, "task", "seed"]))
    v = F.col(value)
    usable = df.filter(v.isNotNull() & ~F.isnan(v) & F.col("task").isNotNull() & F.col("seed").isNotNull())
    wide = usable.groupBy(*keys).agg(
        *[F.max(F.when(F.col("paradigm") == n, v)).alias(f"_p{i}") for i, n in enumerate(names)]
    )
    at = {n: F.col(f"_p{i}") for i, n in enumerate(names)}
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("paradigm_a"), F.lit(b).alias("paradigm_b"),
                    at[a].alias("value_a"), at[b].alias("value_b"),
                )
                for a, b in pairs
            ]
        )
    )
    out = wide.select(*keys, cells.alias("_c")).select(*keys, "_c.*")
    return out.filter(F.col("value_a").isNotNull() | F.col("value_b").isNotNull())


def pair_coverage(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """Task-seed pairs per side, shared and in all."""
    a, b = F.col("value_a").isNotNull(), F.col("value_b").isNotNull()
    return paired.groupBy(*by).agg(
        F.count_if(a).alias("n_pairs_a"), F.count_if(b).alias("n_pairs_b"),
        F.count_if(a & b).alias("n_shared_pairs"), F.count(F.lit(1)).alias("n_union_pairs"),
    )


def missing_pairs(paired: DataFrame) -> DataFrame:
    """One row per task-seed pair that a side lacks."""
    one = F.col("value_a").isNull() | F.col("value_b").isNull()
    side = F.when(F.col("value_a").isNull(), F.col("paradigm_a")).otherwise(F.col("paradigm_b"))
    return paired.filter(one).withColumn("missing_paradigm", side)


def paired_tests(
    paired: DataFrame, scope: Sequence[str], higher: Column | bool = True,
) -> DataFrame:
    """Signed-rank test, effect size and Bonferroni per scope for every listed pair."""
    scope = list(scope)
    by = [*scope, "paradigm_a", "paradigm_b"]
    paired = cut_lineage(paired)  # six statistics read it
    both = paired.filter(F.col("value_a").isNotNull() & F.col("value_b").isNotNull())
    up = F.lit(higher) if isinstance(higher, bool) else higher
    gain = F.when(up, F.col("value_a") - F.col("value_b")).otherwise(F.col("value_b") - F.col("value_a"))
    both = both.withColumn("diff", gain).withColumn("_zero", F.lit(0.0))
    base = both.groupBy(*by).agg(
        F.count_distinct("task").alias("n_tasks"), F.avg("value_a").alias("score_a_mean"),
        F.avg("value_b").alias("score_b_mean"), F.avg("diff").alias("mean_improvement"),
    )
    median = exact_quantiles(both, by, "diff", {"median_improvement": 0.5})
    effect = cohens_d(both, by, "diff", "_zero", paired=True).drop("n_pairs")
    out = base
    for part in (median, signed_rank(both, by), effect, pair_coverage(paired, by)):
        out = null_safe_join(out, part, by)
    better = F.when(F.col("mean_improvement") > 0, F.col("paradigm_a")).when(
        F.col("mean_improvement") < 0, F.col("paradigm_b")
    )
    p = F.col("p_value")
    out = out.withColumns(
        {"better_paradigm": better, "significant_at_005": ~F.isnan(p) & (p < 0.05)}
    )
    return bonferroni(out, scope)


def statistical_tests(df: DataFrame, paradigms: Sequence[str] | None = None) -> DataFrame:
    """All paradigm pairs per class: over all tasks of a metric, and per task.

    Omnibus scopes need at least two tasks. In the classical context views only pairs of
    one classical and one other paradigm are tested.
    """
    needed = [c for c in (*C.FINGERPRINT, "seed", "metrics") if c in df.columns]
    # read by every scope and statistic below, so computed once
    rows = cut_lineage(primary_values(df.select(*needed)).drop("metrics"))
    rows = rows.unionByName(classical_views(rows), allowMissingColumns=True)
    names = list(paradigms) if paradigms is not None else paradigm_names(rows)
    pairs = list(combinations(sorted(names), 2))
    base = [c for c in C.FINGERPRINT if c in rows.columns and c not in ("paradigm", "task", "phase")]
    base.append("primary_metric_name")
    higher = V.higher_is_better("primary_metric_name")
    out = None
    for name, scope, min_tasks in (
        ("omnibus_primary_metric", base, 2), ("per_task", [*base, "task"], 1),
    ):
        paired = paired_values(rows, scope, pairs)
        if min_tasks > 1:
            n = rows.groupBy(*scope).agg(F.count_distinct("task").alias("_nt"))
            paired = null_safe_join(paired, n.filter(F.col("_nt") >= min_tasks).drop("_nt"), scope)
        classical = [F.col(c).isin(*C.CLASSICAL_PARADIGMS) for c in ("paradigm_a", "paradigm_b")]
        context = F.col("experiment_class").isin(*C.CONTEXT_CLASSES)
        paired = paired.filter(~context | (classical[0] != classical[1]))
        tested = paired_tests(paired, scope, higher).withColumn("comparison_scope", F.lit(name))
        out = tested if out is None else out.unionByName(tested, allowMissingColumns=True)
    return out


def extension_tests(
    df: DataFrame, a: tuple[str, str] = ("ts2vec_extension", "ts2vec"),
    b: tuple[str, str] = ("core_ssl_benchmark", "contrastive"),
) -> DataFrame:
    """One fixed pair across two classes, corrected over all its scopes."""
    sides = (
        (F.col("experiment_class") == a[0]) & (F.col("paradigm") == a[1])
    ) | ((F.col("experiment_class") == b[0]) & (F.col("paradigm") == b[1]))
    needed = [c for c in (*C.FINGERPRINT, "seed", "metrics") if c in df.columns]
    rows = primary_values(df.filter(sides).select(*needed)).drop("metrics")
    scope = ["dataset", "protocol", "label_fraction", "model_size", "source_dataset",
             "primary_metric_name"]
    paired = paired_values(rows, scope, [(a[1], b[1])])
    tested = paired_tests(paired, scope, V.higher_is_better("primary_metric_name"))
    tested = tested.drop("p_value_bonferroni", "significant_bonferroni_005")
    return bonferroni(tested, []).withColumns(
        {"experiment_class_a": F.lit(a[0]), "experiment_class_b": F.lit(b[0])}
    )


# --- expected matrix --------------------------------------------------------------------------------

def expected_matrix(spark: SparkSession, with_pretrain: bool = False) -> DataFrame:
    """The evaluation runs a full export must contain, from the dimension lists.

    Each class is a product of small lists, written as explodes of literal arrays.
    """

    def lits(*values, kind=None):
        items = F.array(*[F.lit(v) for v in values])
        return F.explode(items.cast(f"array<{kind}>") if kind else items)

    def fractions(mapping):
        return F.explode(
            F.array(
                *[
                    F.struct(F.lit(t).alias("task"), F.lit(f).alias("label_fraction"))
                    for t, fs in mapping.items() for f in fs
                ]
            )
        )

    seeds = spark.range(1).select(lits(*C.FIXED_SEEDS, kind="bigint").alias("seed"))
    full = {t: (1.0,) for t in C.BENCHMARK_TASKS}
    empty = {
        "experiment_subtype": "string", "source_dataset": "string",
        "upstream_pretrain_lr": "double", "upstream_pretrain_mask_ratio": "double",
    }

    def shaped(df, klass):
        out = df.withColumn("experiment_class", F.lit(klass)).withColumn("experiment_type", F.lit(klass))
        if "model_size" not in out.columns:
            out = out.withColumn("model_size", F.lit("default"))
        for c, t in empty.items():
            if c not in out.columns:
                out = out.withColumn(c, F.lit(None).cast(t))
        return out.select(*C.FINGERPRINT, "seed")

    def tasks(df, mapping):
        return df.withColumn("_t", fractions(mapping)).select("*", "_t.*").drop("_t")

    def tuned(df, protocols=(C.LINEAR_PROBE, C.FULL_FINETUNE)):
        return df.withColumn("protocol", lits(*protocols)).withColumn("phase", F.lit("finetune"))

    def from_scratch(df, paradigm="supervised", phase="supervised"):
        return df.withColumns(
            {"paradigm": F.lit(paradigm), "protocol": F.lit(C.FULL_FINETUNE), "phase": F.lit(phase)}
        )

    by_data = seeds.withColumn("dataset", lits(*C.MATRIX_DATASETS))
    pretrained = by_data.withColumn("paradigm", lits(*C.MATRIX_PARADIGMS))
    one = seeds.withColumn("dataset", F.lit("miiv"))
    single = {"mortality_24h": (1.0,)}
    parts = [
        shaped(tuned(tasks(pretrained, full)), "core_ssl_benchmark"),
        shaped(from_scratch(tasks(by_data, full)), "core_ssl_benchmark"),
        shaped(tuned(tasks(pretrained, C.MATRIX_FRACTIONS)), "label_efficiency"),
        shaped(from_scratch(tasks(by_data, C.MATRIX_FRACTIONS)), "label_efficiency"),
    ]
    moved = seeds.withColumn(
        "_p",
        F.explode(
            F.array(
                *[F.struct(F.lit(s).alias("source_dataset"), F.lit(d).alias("dataset"))
                  for s, d in C.MATRIX_TRANSFERS]
            )
        ),
    ).select("seed", "_p.*").withColumn("paradigm", lits(*C.MATRIX_PARADIGMS))
    parts.append(shaped(tuned(tasks(moved, full), (C.FULL_FINETUNE,)), "cross_dataset_transfer"))
    sweep = tasks(one.withColumn("paradigm", lits(*C.MATRIX_PARADIGMS)), single)
    by_lr = sweep.withColumn("upstream_pretrain_lr", lits(*C.MATRIX_LRS)).withColumn(
        "experiment_subtype", F.lit("lr_sensitivity")
    )
    by_ratio = sweep.withColumn("upstream_pretrain_mask_ratio", lits(*C.MATRIX_MASK_RATIOS)).withColumn(
        "experiment_subtype",
        F.when(F.col("paradigm") == "contrastive", "view_mask_sensitivity")
        .otherwise("mask_ratio_sensitivity"),
    )
    for s in (by_lr, by_ratio):
        parts.append(shaped(tuned(s, (C.FULL_FINETUNE,)), "hp_robustness"))
    sized = tasks(
        one.withColumn("model_size", lits(*C.MATRIX_CAPACITY_SIZES)),
        {"mortality_24h": C.MATRIX_CAPACITY_FRACTIONS},
    )
    parts.append(shaped(tuned(sized.withColumn("paradigm", F.lit("mae"))), "capacity_study"))
    parts.append(shaped(from_scratch(sized), "capacity_study"))
    classic = tasks(by_data, full).unionByName(tasks(by_data, C.MATRIX_CLASSICAL_FRACTIONS))
    for name in C.CLASSICAL_PARADIGMS:
        parts.append(shaped(from_scratch(classic, name, "baseline"), "classical_baselines"))
    ext = tasks(by_data.withColumn("paradigm", F.lit("ts2vec")), full)
    parts.append(shaped(tuned(ext), "ts2vec_extension"))
    smart = tasks(by_data.withColumn("paradigm", F.lit("smart")), full)
    parts.append(shaped(tuned(smart), "smart_external_reference"))
    if with_pretrain:
        pre = {"task": F.lit(None).cast("string"), "protocol": F.lit(None).cast("string"),
               "label_fraction": F.lit(1.0), "phase": F.lit("pretrain")}
        base = pretrained.withColumns(pre)
        parts.append(shaped(base, "core_ssl_benchmark"))
        lone = one.withColumn("paradigm", lits(*C.MATRIX_PARADIGMS)).withColumns(pre)
        parts.append(shaped(
            lone.withColumn("upstream_pretrain_lr", lits(*C.MATRIX_LRS))
            .withColumn("experiment_subtype", F.lit("lr_sensitivity")), "hp_robustness"))
        parts.append(shaped(
            lone.withColumn("upstream_pretrain_mask_ratio", lits(*C.MATRIX_MASK_RATIOS))
            .withColumn("experiment_subtype",
                        F.when(F.col("paradigm") == "contrastive", "view_mask_sensitivity")
                        .otherwise("mask_ratio_sensitivity")), "hp_robustness"))
        parts.append(shaped(
            one.withColumn("model_size", lits(*C.MATRIX_CAPACITY_SIZES))
            .withColumn("paradigm", F.lit("mae")).withColumns(pre), "capacity_study"))
        for name, klass in (("ts2vec", "ts2vec_extension"), ("smart", "smart_external_reference")):
            parts.append(shaped(by_data.withColumn("paradigm", F.lit(name)).withColumns(pre), klass))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
