"""Scalar Column functions: categories, text clean-up, bins, config lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark import config as C


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression that a lambda captures is computed again for every item; a lambda
    variable is not.
    """
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however many filters and columns read them.

    Spark puts the expression of a plain column into every filter above it; it moves none
    below a generator, here of one item.
    """
    item = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(item)).alias("_item")).select("*", "_item.*").drop("_item")


# --- categorical and time types ---------------------------------------------

def encode_categories(df: DataFrame, codes: dict | None = None) -> DataFrame:
    """Text categories to ordinal doubles; unseen text is null with mask False.

    Columns that are already numeric are left alone.
    """
    out = df
    types = dict(df.dtypes)
    for name, mapping in (codes or C.ORDINAL_CODES).items():
        if types.get(name) != "string":
            continue
        out = out.withColumn(name, literal_map(mapping)[F.col(name)])
        mask = f"{name}_mask"
        if mask in types:
            out = out.withColumn(mask, F.col(mask) & F.col(name).isNotNull())
    return out


def duration_hours(c) -> Column:
    """Hours of a day-time interval."""
    c = col_of(c)
    seconds = F.date_part(F.lit("SECOND"), c).cast("double")
    return (
        F.date_part(F.lit("DAY"), c) * 24.0
        + F.date_part(F.lit("HOUR"), c)
        + F.date_part(F.lit("MINUTE"), c) / 60.0
        + seconds / 3600.0
    )


def intervals_to_hours(df: DataFrame) -> DataFrame:
    """Turn every day-time interval column into double hours."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DayTimeIntervalType):
            out = out.withColumn(f.name, duration_hours(f.name))
    return out


def as_utc_timestamps(df: DataFrame, names) -> DataFrame:
    """Cast the named columns that exist to one microsecond timestamp type."""
    out = df
    for n in names:
        if n in df.columns:
            out = out.withColumn(n, F.col(n).cast("timestamp"))
    return out


# --- people -----------------------------------------------------------------

def gender_group(c) -> Column:
    """M, F, null for unknown words, any other text unchanged."""
    text = F.trim(col_of(c).cast("string"))
    word = F.lower(F.regexp_replace(text, r"\s+", " "))
    return (
        F.when((word == "") | word.isin(*C.UNKNOWN_GENDER_WORDS), F.lit(None))
        .when(word.isin("m", "male"), "M")
        .when(word.isin("f", "female"), "F")
        .otherwise(text)
    )


def strict_gender(c) -> Column:
    """M or F; everything else is null (the rule used at ingest)."""
    word = F.lower(col_of(c).cast("string"))
    return F.when(word.isin("female", "f"), "F").when(word.isin("male", "m"), "M")


def race_group(c, source=None, dataset: str | None = None) -> Column:
    """Five groups, null when missing or when the row's source has no race rule.

    ``source`` is the row's source dataset; rows whose source names another
    hospital system take no part.
    """
    if dataset == "eicu":
        return F.lit(None).cast("string")
    text = F.regexp_replace(F.upper(col_of(c).cast("string")), r"[/_\\\-]+", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))

    def has(*markers):
        hit = F.lit(False)
        for m in markers:
            hit = hit | text.contains(m)
        return hit

    group = F.when(text.isNull() | (text == "") | has(*C.UNKNOWN_RACE_MARKERS), F.lit(None))
    for name, markers in C.RACE_GROUP_MARKERS:
        group = group.when(has(*markers), name)
    group = group.otherwise("Other")
    if source is None:
        return group if dataset != "combined" else F.lit(None).cast("string")
    src = F.lower(F.trim(col_of(source).cast("string")))
    fallback = F.lit(dataset != "combined")
    takes_part = F.coalesce(src.contains("miiv") | src.contains("mimic"), fallback)
    return F.when(takes_part, group)


def age_group(c) -> Column:
    """Closed bins; ages below 18, gaps such as 44.5, null and NaN are null."""
    age = col_of(c).cast("double")
    out = None
    for name, lo, hi in C.AGE_GROUPS:
        inside = (age >= lo) & ~F.isnan(age) & (age < F.lit(float("inf")))
        if hi is not None:
            inside = inside & (age <= hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def report_bins(c, edges, labels) -> Column:
    """Left-closed bins for reports: ``x < e1``, ``x < e2`` ... else the last label."""
    x = col_of(c)
    out = None
    for e, name in zip(edges, labels):
        out = F.when(x < e, name) if out is None else out.when(x < e, name)
    return F.when(x.isNotNull(), out.otherwise(labels[-1]))


def cut_right_closed(c, edges, labels) -> Column:
    """Right-closed bins ``(-inf, e1], (e1, e2], ... (en, inf)``; null stays null."""
    x = col_of(c)
    out = None
    for e, name in zip(edges, labels):
        out = F.when(x <= e, name) if out is None else out.when(x <= e, name)
    return F.when(x.isNotNull(), out.otherwise(labels[-1]))


# --- run records -------------------------------------------------------------

def protocol_key(c) -> Column:
    """The text of a protocol in the form that aliases are written in."""
    return F.translate(F.lower(F.trim(col_of(c).cast("string"))), "-", "_")


def protocol_name(c) -> Column:
    return protocol_of(protocol_key(c))


def protocol_of(key: Column) -> Column:
    """The protocol that a key names; the key is read several times, so a column is cheaper than an expression."""
    return (
        F.when(key == "", F.lit(None))
        .when(key.isin(*C.LINEAR_PROBE_ALIASES), C.LINEAR_PROBE)
        .when(key.isin(*C.FULL_FINETUNE_ALIASES), C.FULL_FINETUNE)
        .otherwise(key)
    )


def protocol_from_freeze(c) -> Column:
    frozen = col_of(c)
    return F.when(frozen, C.LINEAR_PROBE).when(~frozen, C.FULL_FINETUNE)


def artifact_id(c) -> Column:
    """Path from its last-root ``outputs/`` part on, without outer slashes."""
    text = F.replace(F.trim(col_of(c).cast("string")), F.lit("\\"), F.lit("/"))
    rooted = F.instr(text, "/outputs/")
    loose = F.instr(text, "outputs/")
    tail = (
        F.when(rooted > 0, F.concat(F.lit("outputs/"), F.btrim(F.substr(text, rooted + 9), F.lit("/"))))
        .when(loose > 0, F.btrim(F.substr(text, loose), F.lit("/")))
        .otherwise(F.btrim(text, F.lit("/")))
    )
    return F.coalesce(tail, F.lit(""))


def decode_attributes(c) -> Column:
    """JSON list or comma list to an array, order kept, duplicates dropped."""
    text = F.trim(col_of(c))
    parsed = F.from_json(text, T.ArrayType(T.StringType()))
    words = F.filter(F.transform(F.split(text, ","), lambda w: F.trim(w)), lambda w: w != "")
    return F.when(text != "", F.array_distinct(F.when(text.startswith("["), parsed).otherwise(words)))


def encode_attributes(c) -> Column:
    return F.to_json(F.array_distinct(col_of(c)))


def config_value(c, dotted: str) -> Column:
    """A nested value of a config by its dotted key, as text.

    ``c`` is a JSON column, or a function from key to Column for a config that is
    already parsed.
    """
    if callable(c) and not isinstance(c, Column):
        return c(dotted)
    return F.get_json_object(col_of(c), "$." + dotted)


def tag_value(tags, prefix: str) -> Column:
    """Text after ``prefix:`` of the first tag that has that prefix."""
    head = prefix + ":"
    first = F.get(F.filter(col_of(tags), lambda t: t.startswith(head)), F.lit(0))
    return F.substr(first, F.lit(len(head) + 1))


def coded(text: Column, part: str, pattern: str) -> Column:
    """First group of a pattern that holds ``part`` as it is; null without it, and no pattern is run there."""
    return F.when(F.contains(text, F.lit(part)), F.regexp_extract(text, pattern, 1))


def recover_source_dataset(cfg, run_name) -> Column:
    """Source dataset from config, else from ``_from_<name>`` in the folder or run name."""
    stated = config_value(cfg, "source_dataset")
    pattern = r"_from_(miiv|eicu|combined)(?:_|$)"

    def named(text):
        return F.nullif(coded(text, "_from_", pattern), F.lit(""))

    return F.coalesce(
        F.when(stated.isin("miiv", "eicu", "combined"), stated),
        named(config_value(cfg, "output_dir")),
        named(col_of(run_name)),
    )


def recover_pretrain(cfg, run_name) -> Column:
    """Struct (lr, mask_ratio, subtype) of the upstream run.

    Stated values win; sweeps read them from the optimizer and objective settings;
    otherwise the coded parts of the folder name are decoded.
    """
    subtype = config_value(cfg, "experiment_subtype")
    lr = F.coalesce(
        config_value(cfg, "upstream_pretrain_lr"),
        F.when(subtype.isin("lr_sensitivity", "lr_ablation"), config_value(cfg, "optimizer.lr")),
    ).cast("double")
    ratio = F.coalesce(
        config_value(cfg, "upstream_pretrain_mask_ratio"),
        F.when(
            subtype.isin("mask_ratio_sensitivity", "view_mask_sensitivity", "mask_ablation"),
            config_value(cfg, "ssl.mask_ratio"),
        ),
    ).cast("double")
    folder = F.coalesce(config_value(cfg, "output_dir"), col_of(run_name), F.lit(""))
    coded_lr = literal_map(C.LR_CODES)[coded(folder, "_lr", r"_lr([^_]+)")]
    coded_ratio = literal_map(C.MASK_RATIO_CODES)[coded(folder, "_mask", r"_mask_?ratio([^_]+)")]
    stated = lr.isNotNull() | ratio.isNotNull()
    decoded_subtype = F.when(coded_lr.isNotNull(), F.lit("lr_sensitivity")).otherwise(
        F.coalesce(subtype, F.when(coded_ratio.isNotNull(), F.lit("mask_ratio_sensitivity")))
    )
    return F.struct(
        F.when(stated, lr).otherwise(coded_lr).alias("lr"),
        F.when(stated, ratio).otherwise(coded_ratio).alias("mask_ratio"),
        F.when(stated, subtype).otherwise(decoded_subtype).alias("subtype"),
    )


def model_size(cfg) -> Column:
    """Size name from config, else from (width, depth) of the encoder."""
    width = config_value(cfg, "encoder.d_model").cast("int")
    depth = config_value(cfg, "encoder.n_layers").cast("int")
    named = None
    for (w, d), name in C.MODEL_SIZES.items():
        hit = (width == w) & (depth == d)
        named = F.when(hit, name) if named is None else named.when(hit, name)
    stated = config_value(cfg, "model_size")
    smart = F.lit(False)
    for key in ("paradigm", "ssl.name", "encoder.name"):
        smart = smart | F.coalesce(F.lower(config_value(cfg, key)) == "smart", F.lit(False))
    return F.coalesce(
        F.when(stated != "", stated),
        F.when(smart | width.isNull(), F.lit("default")),
        named,
        F.when(width == 64, F.lit("default")),
        F.when(depth.isNull(), F.concat(F.lit("d"), width.cast("string"))),
        F.concat(F.lit("d"), width.cast("string"), F.lit("_L"), depth.cast("string")),
    )


def finite_or_null(c) -> Column:
    """Numeric text or number; infinities and NaN become null."""
    x = col_of(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def is_metric_key(c) -> Column:
    """Keys that follow a run into the metric tables."""
    exact = "|".join(C.COMPUTE_METRICS)
    prefix = "|".join(C.METRIC_PREFIXES)
    return col_of(c).rlike(f"^(?:(?:{exact})$|{prefix})")


def is_blank(c) -> Column:
    """Null or only white space."""
    text = col_of(c).cast("string")
    return text.isNull() | (F.trim(text) == "")


def is_true_text(c) -> Column:
    """Text 'true' in any case, or the number 1; null is false."""
    text = F.lower(F.trim(col_of(c).cast("string")))
    return F.coalesce(text.isin("true", "1", "1.0"), F.lit(False))


def primary_metric(task) -> Column:
    """The metric a task is compared on: MAE for stay length, AUPRC otherwise."""
    t = col_of(task)
    out = F.when(t.isNull(), F.lit(None))
    for name, metric in C.PRIMARY_METRIC.items():
        out = out.when(t == name, metric)
    return out.when(t.startswith("los"), "test/mae").otherwise("test/auprc")


def higher_is_better(metric) -> Column:
    return ~col_of(metric).isin(*C.LOWER_IS_BETTER)
