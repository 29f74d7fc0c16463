"""Registered queries: metrics, fairness, significance, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import embeddings as EM
from cohortspark.operators import fairness as FA
from cohortspark.operators import metrics as ME
from cohortspark.operators import resampling as RS
from cohortspark.operators import significance as SG
from cohortspark.plans import analogs as A
from cohortspark.plans.queries_cohort import r6
from cohortspark.plans.registry import CTES, query
from cohortspark.plans.registry import with_tables as W


# --- ranking and threshold metrics over all line items --------------------------------------

def _ranking_ctes(prefix, source, by):
    part = f"PARTITION BY {by}"
    CTES[f"{prefix}_ties"] = f"""
SELECT {by}, prediction, count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label = 0)::DOUBLE AS neg FROM {source} GROUP BY {by}, prediction"""
    CTES[f"{prefix}_cum"] = f"""
SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM {prefix}_ties WINDOW w AS ({part} ORDER BY prediction DESC)"""
    CTES[f"{prefix}_rank"] = f"""
SELECT {by}, CAST(sum(pos) + sum(neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 'nan'::DOUBLE ELSE 1 - sum(pos * (fp - neg / 2)) / (sum(pos) * sum(neg)) END AS auroc,
  CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 'nan'::DOUBLE ELSE sum(pos * tp / (tp + fp)) / sum(pos) END AS auprc
FROM {prefix}_cum GROUP BY {by}"""
    return f"{prefix}_ties {prefix}_cum {prefix}_rank"


_RK = "pred " + _ranking_ctes("li", "pred", "status")


@query("ranking_metrics", W(_RK, "SELECT status, n, n_pos, n_neg, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM li_rank"))
def ranking_metrics(spark, sf):
    return r6(ME.ranking_metrics(A.predictions(spark, sf), ["status"]), "auroc", "auprc")


@query("ranking_metrics_overall", W("pred", """
SELECT count(*) AS n, round(1 - (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
  / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)), 6) AS auroc
FROM (SELECT label, rank() OVER (ORDER BY prediction DESC) + (count(*) OVER (PARTITION BY prediction) - 1) / 2.0 AS r FROM pred)"""))
def ranking_metrics_overall(spark, sf):
    out = ME.ranking_metrics(A.predictions(spark, sf))
    return r6(out.select("n", "auroc"), "auroc")


_CONF = """count(*) FILTER (prediction >= 0.5 AND label = 1) AS tp, count(*) FILTER (prediction >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (prediction < 0.5 AND label = 0) AS tn, count(*) FILTER (prediction < 0.5 AND label = 1) AS fn"""
_RATES = """round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END, 6) AS specificity,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1"""


@query("confusion_metrics", W("pred", f"SELECT line, tp, fp, tn, fn, {_RATES} FROM (SELECT line, {_CONF} FROM pred GROUP BY line)"))
def confusion_metrics(spark, sf):
    out = ME.confusion(A.predictions(spark, sf), ["line"])
    return r6(out, "accuracy", "precision", "recall", "specificity", "f1")


@query("brier_score", W("pred", "SELECT line, round(avg((prediction - label) ** 2), 6) AS brier_score FROM pred GROUP BY line"))
def brier_score(spark, sf):
    return r6(ME.brier(A.predictions(spark, sf), ["line"]), "brier_score")


CTES["ece"] = """
SELECT status, least(CAST(floor(prediction * 15) AS INTEGER), 14) AS bin, count(*) AS n, avg(prediction) AS confidence, avg(label) AS accuracy
FROM pred GROUP BY 1, 2"""


@query("calibration_bins", W("pred ece", "SELECT status, bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM ece"))
def calibration_bins(spark, sf):
    return r6(ME.calibration_bins(A.predictions(spark, sf), ["status"]), "confidence", "accuracy")


@query("calibration_error", W("pred ece", "SELECT status, round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM ece GROUP BY status"))
def calibration_error(spark, sf):
    return r6(ME.expected_calibration_error(A.predictions(spark, sf), ["status"]), "ece")


@query("binary_report", W(_RK + " ece", f"""
SELECT status, r.n, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, {_RATES}, round(brier_score, 6) AS brier_score, round(ece, 6) AS ece
FROM li_rank r JOIN (SELECT status, {_CONF}, avg((prediction - label) ** 2) AS brier_score FROM pred GROUP BY status) USING (status)
JOIN (SELECT status, sum(n * abs(confidence - accuracy)) / sum(n) AS ece FROM ece GROUP BY status) USING (status)"""))
def binary_report(spark, sf):
    out = ME.binary_report(A.predictions(spark, sf), ["status"])
    return r6(out, *[c for c in out.columns if c not in ("status", "n")])


@query("test_support", W("pred", """
SELECT status, count(*) AS n_samples, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative,
  round(avg(label), 6) AS positive_ratio FROM pred GROUP BY status"""))
def test_support(spark, sf):
    return r6(ME.support(A.predictions(spark, sf), ["status"]), "positive_ratio")


@query("regression_metrics", W("pred", """
SELECT status, count(*) AS n, round(avg((prediction - target) ** 2), 6) AS mse, round(avg(abs(prediction - target)), 6) AS mae,
  round(sqrt(avg((prediction - target) ** 2)), 6) AS rmse, round(1 - sum((prediction - target) ** 2) / (var_pop(target) * count(*)), 6) AS r2
FROM pred GROUP BY status"""))
def regression_metrics(spark, sf):
    p = A.predictions(spark, sf).withColumn("label", F.col("target"))
    return r6(ME.regression_report(p, ["status"]), "mse", "mae", "rmse", "r2")


CTES["mc"] = """
SELECT line % 3 AS y, prediction AS p0, prediction_b AS p1, (prediction + prediction_b) / 2 AS p2 FROM pred"""
CTES["mcl"] = """
SELECT 0 AS class, p0 AS prediction, CAST(y = 0 AS INTEGER) AS label FROM mc UNION ALL
SELECT 1, p1, CAST(y = 1 AS INTEGER) FROM mc UNION ALL SELECT 2, p2, CAST(y = 2 AS INTEGER) FROM mc"""
_MC = "pred mc mcl " + _ranking_ctes("mc", "mcl", "class")


@query("multiclass_metrics", W(_MC, """
SELECT round(avg(auroc), 6) AS auroc, round(avg(auprc), 6) AS auprc, round(any_value(acc), 6) AS accuracy, round(any_value(acc), 6) AS f1,
  round(any_value(acc), 6) AS precision, round(any_value(acc), 6) AS recall FROM mc_rank,
  (SELECT avg(CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = y AS INTEGER)) AS acc FROM mc)"""))
def multiclass_metrics(spark, sf):
    p = A.predictions(spark, sf)
    both = (F.col("prediction") + F.col("prediction_b")) / 2
    rows = p.select((F.col("line") % 3).alias("label"), F.array("prediction", "prediction_b", both).alias("scores"))
    out = ME.multiclass_report(rows)
    return r6(out, *out.columns)


CTES["ml"] = """
SELECT 0 AS class, prediction, label FROM pred UNION ALL SELECT 1, prediction_b, CAST(line > 4 AS INTEGER) FROM pred"""
_ML = "pred ml " + _ranking_ctes("ml", "ml", "class")


@query("multilabel_metrics", W(_ML, f"""
SELECT round(avg(auroc), 6) AS auroc, round(avg(auprc), 6) AS auprc, any_value(accuracy) AS accuracy, any_value(f1) AS f1
FROM ml_rank, (SELECT {_RATES} FROM (SELECT {_CONF} FROM ml))"""))
def multilabel_metrics(spark, sf):
    rows = A.predictions(spark, sf).select(
        F.array("prediction", "prediction_b").alias("scores"),
        F.array("label", (F.col("line") > 4).cast("int")).alias("labels"),
    )
    out = ME.multilabel_report(ME.multilabel_rows(rows))
    return r6(out, *out.columns)


@query("auroc_precision", W("pred", """
SELECT line, n_positive, n_negative, round(se, 6) AS auroc_se, round(greatest(0.5, 0.85 - 1.959963984540054 * se), 6) AS auroc_low,
  round(least(1.0, 0.85 + 1.959963984540054 * se), 6) AS auroc_high FROM (SELECT *, sqrt(greatest(0.85 * 0.15 + (n_positive - 1) * (0.85 / 1.15 - 0.7225)
  + (n_negative - 1) * (2 * 0.7225 / 1.85 - 0.7225), 0) / (n_positive * n_negative)) AS se FROM (
  SELECT line, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative FROM pred GROUP BY line))"""))
def auroc_precision(spark, sf):
    counts = ME.support(A.predictions(spark, sf), ["line"]).select("line", "n_positive", "n_negative")
    return r6(ME.auroc_precision(counts), "auroc_se", "auroc_low", "auroc_high")


@query("batch_scoring", W("ev", """
SELECT stay_id, round(1 / (1 + exp(-(avg(value) - 50) / 25)), 6) AS prediction FROM ev GROUP BY stay_id"""))
def batch_scoring(spark, sf):
    """A two-column model over Arrow batches of per-stay features."""
    per = A.raw_events(spark, sf).groupBy("stay_id").agg(F.avg("value").alias("x"))

    def model(pdf):
        import numpy as np

        p = 1.0 / (1.0 + np.exp(-(pdf["x"] - 50.0) / 25.0))
        return pdf[["stay_id"]].assign(p0=1.0 - p, p1=p)

    return r6(ME.score(per, model), "prediction")


# --- fairness over stays --------------------------------------------------------------------------

MIN = 10
CTES["frows"] = """
SELECT stay_id, patient_id, prediction, label, target, attr, grp AS "group" FROM (
 SELECT p.*, patient_id, 'gender' AS attr, CASE lower(trim(gender)) WHEN 'm' THEN 'M' WHEN 'male' THEN 'M' WHEN 'f' THEN 'F' WHEN 'female' THEN 'F' END AS grp FROM spred p JOIN stays USING (stay_id)
 UNION ALL SELECT p.*, patient_id, 'age_group', CASE WHEN age BETWEEN 18 AND 44 THEN '18-44' WHEN age BETWEEN 45 AND 64 THEN '45-64' WHEN age BETWEEN 65 AND 79 THEN '65-79' WHEN age >= 80 THEN '80+' END FROM spred p JOIN stays USING (stay_id)
 UNION ALL SELECT p.*, patient_id, 'race', CASE WHEN source_dataset <> 'miiv' THEN NULL WHEN race = 'UNKNOWN' THEN NULL WHEN race LIKE 'HISP%' THEN 'Hispanic'
   WHEN race LIKE 'BLACK%' THEN 'Black' WHEN race LIKE 'ASIAN%' THEN 'Asian' WHEN race LIKE 'WHITE%' THEN 'White' WHEN race IS NOT NULL THEN 'Other' END FROM spred p JOIN stays USING (stay_id))
WHERE grp IS NOT NULL"""
CTES["fsize"] = f"""
SELECT *, count(*) FILTER (valid) OVER (PARTITION BY attr) AS n_valid_groups, count(*) FILTER (valid) OVER (PARTITION BY attr) >= 2 AS reported
FROM (SELECT attr, "group", count(DISTINCT patient_id) AS n_patients, count(*) AS n_stays, count(DISTINCT patient_id) >= {MIN} AS valid FROM frows GROUP BY 1, 2)"""
CTES["fok"] = 'SELECT f.*, f.attr || \'|\' || f."group" AS ag FROM frows f JOIN fsize s ON s.attr = f.attr AND s."group" = f."group" WHERE valid AND reported'
_F = "ev stays spred frows fsize fok"
_FR = _F + " " + _ranking_ctes("fr", "fok", "ag")
CTES["frank"] = "SELECT *, split_part(ag, '|', 1) AS attr, split_part(ag, '|', 2) AS \"group\" FROM fr_rank"
CTES["frates"] = """
SELECT attr, "group", count(*) AS n_samples, avg(CAST(prediction >= 0.5 AS INTEGER)) AS positive_rate,
  avg(CAST(prediction >= 0.5 AS INTEGER)) FILTER (label = 1) AS tpr, avg(CAST(prediction >= 0.5 AS INTEGER)) FILTER (label = 0) AS fpr FROM fok GROUP BY 1, 2"""
CTES["fpar"] = """
SELECT attr, max(positive_rate) - min(positive_rate) AS demographic_parity_diff,
  CASE WHEN count(tpr) = count(*) AND count(fpr) = count(*) THEN greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) ELSE 'nan'::DOUBLE END AS equalized_odds_diff,
  CASE WHEN max(positive_rate) = 0 THEN 1.0 ELSE min(positive_rate) / max(positive_rate) END AS disparate_impact_ratio FROM frates GROUP BY attr"""


def fairness_rows(spark, sf):
    static = A.stays(spark, sf)
    attrs = FA.available_attributes(static, dataset="combined")
    return FA.with_groups(A.stay_predictions(spark, sf), static, attrs, "combined")


@query("subgroup_sizes", W(_F, 'SELECT attr, "group", n_patients, n_stays, valid, n_valid_groups, reported FROM fsize'))
def subgroup_sizes(spark, sf):
    return FA.group_sizes(fairness_rows(spark, sf), MIN)


@query("subgroup_rates", W(_F + " frates", """
SELECT attr, "group", n_samples, round(positive_rate, 6) AS positive_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM frates"""))
def subgroup_rates(spark, sf):
    rows = fairness_rows(spark, sf)
    ok = FA.valid_rows(rows, FA.group_sizes(rows, MIN))
    return r6(FA.subgroup_rates(ok), "positive_rate", "tpr", "fpr")


@query("parity_metrics", W(_F + " frates fpar", """
SELECT attr, round(demographic_parity_diff, 6) AS demographic_parity_diff, round(equalized_odds_diff, 6) AS equalized_odds_diff,
  round(disparate_impact_ratio, 6) AS disparate_impact_ratio, disparate_impact_ratio < 0.8 AS four_fifths_violation FROM fpar"""))
def parity_metrics(spark, sf):
    rows = fairness_rows(spark, sf)
    ok = FA.valid_rows(rows, FA.group_sizes(rows, MIN))
    out = FA.parity(FA.subgroup_rates(ok))
    return r6(out, "demographic_parity_diff", "equalized_odds_diff", "disparate_impact_ratio")


CTES["fbin"] = """
SELECT attr, CASE WHEN count(*) FILTER (NOT isnan(auroc)) >= 2 THEN min(auroc) FILTER (NOT isnan(auroc)) ELSE 'nan'::DOUBLE END AS worst_group_auroc,
  CASE WHEN count(*) FILTER (NOT isnan(auroc)) >= 2 THEN min(auprc) FILTER (NOT isnan(auroc)) ELSE 'nan'::DOUBLE END AS worst_group_auprc,
  CASE WHEN count(*) FILTER (NOT isnan(auroc)) >= 2 THEN max(auroc) FILTER (NOT isnan(auroc)) - min(auroc) FILTER (NOT isnan(auroc)) ELSE 'nan'::DOUBLE END AS auroc_gap,
  CASE WHEN count(*) FILTER (NOT isnan(auroc)) >= 2 THEN max(auprc) FILTER (NOT isnan(auroc)) - min(auprc) FILTER (NOT isnan(auroc)) ELSE 'nan'::DOUBLE END AS auprc_gap,
  count(*) AS n_valid_groups, count(*) FILTER (NOT isnan(auroc)) AS n_metric_valid_groups, count(*) FILTER (isnan(auroc)) AS n_single_class_groups
FROM frank GROUP BY attr"""
_FB = _FR + " frank frates fpar fbin"
_FBV = ("worst_group_auroc worst_group_auprc auroc_gap auprc_gap demographic_parity_diff equalized_odds_diff disparate_impact_ratio").split()


@query("binary_fairness", W(_FB, "SELECT attr, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FBV)
                            + ", n_valid_groups, n_metric_valid_groups, n_single_class_groups FROM fbin JOIN fpar USING (attr)"))
def binary_fairness(spark, sf):
    return r6(FA.binary_fairness(fairness_rows(spark, sf), MIN), *_FBV)


@query("binary_group_scores", W(_FR + " frank", """
SELECT r.attr, r."group", n_patients, n_stays, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc
FROM frank r JOIN fsize s ON s.attr = r.attr AND s."group" = r."group" """))
def binary_group_scores(spark, sf):
    return r6(FA.binary_group_scores(fairness_rows(spark, sf), MIN), "auroc", "auprc")


CTES["freg"] = """
SELECT attr, "group", count(*) AS n, avg((prediction - target) ** 2) AS mse, avg(abs(prediction - target)) AS mae,
  1 - sum((prediction - target) ** 2) / greatest(var_pop(target) * count(*), 1e-8) AS r2 FROM fok GROUP BY 1, 2"""


def regression_rows(spark, sf):
    static = A.stays(spark, sf)
    p = A.stay_predictions(spark, sf).select("stay_id", "prediction", F.col("target").alias("label"))
    return FA.with_groups(p, static, FA.available_attributes(static), "combined")


@query("regression_fairness", W(_F + " freg", """
SELECT attr, round(max(mse), 4) AS worst_group_mse, round(max(mae), 4) AS worst_group_mae, round(max(mse) - min(mse), 4) AS mse_gap,
  round(max(mae) - min(mae), 4) AS mae_gap, count(*) AS n_valid_groups FROM freg GROUP BY attr"""))
def regression_fairness(spark, sf):
    out = FA.regression_fairness(regression_rows(spark, sf), MIN)
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c not in ("attr", "n_valid_groups")})


@query("regression_group_scores", W(_F + " freg", """
SELECT attr, "group", n, round(mse, 4) AS mse, round(mae, 4) AS mae, round(r2, 4) AS r2 FROM freg"""))
def regression_group_scores(spark, sf):
    out = FA.regression_group_scores(regression_rows(spark, sf), MIN)
    return out.withColumns({c: F.round(c, 4) for c in ("mse", "mae", "r2")})


@query("flat_fairness_report", W(_FB, """
SELECT 'fairness/' || attr || '/' || metric AS key, round(value, 6) AS value FROM (
 UNPIVOT (SELECT attr, worst_group_auroc, worst_group_auprc, auroc_gap, auprc_gap, n_valid_groups::DOUBLE AS n_valid_groups,
  n_metric_valid_groups::DOUBLE AS n_metric_valid_groups, n_single_class_groups::DOUBLE AS n_single_class_groups,
  demographic_parity_diff, equalized_odds_diff, disparate_impact_ratio FROM fbin JOIN fpar USING (attr))
 ON COLUMNS(* EXCLUDE attr) INTO NAME metric VALUE value)
UNION ALL SELECT 'fairness/' || r.attr || '/per_group_' || m.name || '/' || r."group",
  round(CASE m.name WHEN 'auroc' THEN auroc WHEN 'auprc' THEN auprc WHEN 'n_patients' THEN n_patients ELSE n_stays END, 6)
FROM frank r JOIN fsize s ON s.attr = r.attr AND s."group" = r."group", (VALUES ('auroc'), ('auprc'), ('n_patients'), ('n_stays')) m(name)"""))
def flat_fairness_report(spark, sf):
    rows = fairness_rows(spark, sf)
    report = FA.long_report(FA.binary_fairness(rows, MIN), FA.binary_group_scores(rows, MIN))
    return r6(FA.flat_keys(report), "value")


# --- significance ------------------------------------------------------------------------------------

@query("bootstrap_accuracy", W("pred", """
SELECT round(avg(CAST((prediction >= 0.5) = (label = 1) AS INTEGER)), 6) AS point, 'accuracy' AS metric, 200::BIGINT AS n_valid,
  true AS brackets, true AS std_near FROM pred"""))
def bootstrap_accuracy(spark, sf):
    """Interval of a mean metric; its width is checked against the binomial error."""
    p = A.predictions(spark, sf)
    ci = SG.bootstrap_ci(p, "accuracy", n=200)
    size = p.agg(F.count(F.lit(1)).alias("n"))
    want = F.sqrt(F.col("point") * (1 - F.col("point")) / F.col("n"))
    return ci.crossJoin(size).select(  # two one-row frames
        F.round("point", 6).alias("point"), "metric", "n_valid",
        ((F.col("ci_lower") < F.col("point")) & (F.col("point") < F.col("ci_upper"))).alias("brackets"),
        F.col("std").between(0.75 * want, 1.25 * want).alias("std_near"),
    )


@query("bootstrap_auroc", W("pred", """
SELECT round(1 - (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
  / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)), 6) AS point, 'auroc' AS metric, 100::BIGINT AS n_valid, true AS brackets, true AS std_near
FROM (SELECT label, rank() OVER (ORDER BY prediction DESC) + (count(*) OVER (PARTITION BY prediction) - 1) / 2.0 AS r FROM pred)"""))
def bootstrap_auroc(spark, sf):
    """Interval of a ranking metric; its width is checked against the closed-form error."""
    p = A.predictions(spark, sf)
    ci = SG.bootstrap_ci(p, "auroc", n=100)
    counts = ME.support(p)
    both = ci.crossJoin(counts)  # two one-row frames
    want = F.sqrt((1.0 / F.col("n_positive") + 1.0 / F.col("n_negative")) / 12.0)
    return both.select(
        F.round("point", 6).alias("point"), "metric", "n_valid",
        ((F.col("ci_lower") < F.col("point")) & (F.col("point") < F.col("ci_upper"))).alias("brackets"),
        F.col("std").between(0.6 * want, 1.4 * want).alias("std_near"),
    )


@query("paired_bootstrap", W("pred", """
SELECT round(avg((prediction - label) ** 2), 6) AS score_a, round(avg((prediction_b - label) ** 2), 6) AS score_b,
  round(avg((prediction - label) ** 2) - avg((prediction_b - label) ** 2), 6) AS delta, 100::BIGINT AS n_valid, true AS p_in_range FROM pred"""))
def paired_bootstrap(spark, sf):
    out = SG.paired_bootstrap(
        A.predictions(spark, sf), "brier_score", "prediction", "prediction_b", n=100,
        higher_is_better=False,
    )
    return out.select(
        *[F.round(c, 6).alias(c) for c in ("score_a", "score_b", "delta")], "n_valid",
        F.col("p_value").between(0.0, 1.0).alias("p_in_range"),
    )


@query("positive_rate_interval", W("pred", """
SELECT line, count(*) AS n, round(avg(label), 6) AS positive_rate, true AS brackets, true AS near FROM pred GROUP BY line"""))
def positive_rate_interval(spark, sf):
    out = SG.positive_rate_ci(A.predictions(spark, sf), ["line"], n=2000)
    p = F.col("positive_rate")
    want = 2 * 1.96 * F.sqrt(p * (1 - p) / F.col("n"))
    return out.select(
        "line", "n", F.round(p, 6).alias("positive_rate"),
        ((F.col("ci_lower") < p) & (p < F.col("ci_upper"))).alias("brackets"),
        (F.col("ci_upper") - F.col("ci_lower")).between(0.85 * want, 1.15 * want).alias("near"),
    )


# --- resampled metrics: SQL repeats the draws ---------------------------------------------------------

N_REPS = 25


def _cells_ctes(prefix: str, by: str, keys: list[str], group: list[str] | None = None, seed: int = 42) -> str:
    """Subqueries with the cells of ``pred``, their draws, and the cells of every replicate with a weight ``w`` (0: the rows)."""
    group = [by] if group is None else group
    cols = ", ".join([*group, *keys])
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    cells = f"SELECT *, {RS.key_sql(seed, group, keys)} AS h FROM (SELECT {cols}, count(*) AS c FROM pred WHERE {known} GROUP BY ALL)"
    # two cells may share a key: the weight is drawn for a key and a count
    drawn = RS.draws_sql(f"(SELECT DISTINCT h, c FROM {prefix}_cells)", N_REPS).replace("SELECT h, replicate, CAST", "SELECT h, c, replicate, CAST").replace(
        "GROUP BY h, replicate", "GROUP BY h, c, replicate")
    return f"""RECURSIVE pred AS ({CTES["pred"]}), {prefix}_cells AS ({cells}), {drawn},
{prefix} AS (SELECT {cols}, replicate, weight AS w FROM {prefix}_cells JOIN drawn USING (h, c)
  UNION ALL SELECT {cols}, 0, c FROM {prefix}_cells)"""


_B_TABLE = """sum(w) FILTER (prediction >= 0.5 AND label = 1) AS tp, sum(w) FILTER (prediction >= 0.5 AND label = 0) AS fp,
  sum(w) FILTER (prediction < 0.5 AND label = 0) AS tn, sum(w) FILTER (prediction < 0.5 AND label = 1) AS fn"""
_B_INTERVALS = """SELECT status, metric, round(any_value(v) FILTER (replicate = 0), 6) AS point,
  round(quantile_cont(v, 0.025) FILTER (replicate > 0 AND NOT isnan(v)), 6) AS ci_lower, round(quantile_cont(v, 0.975) FILTER (replicate > 0 AND NOT isnan(v)), 6) AS ci_upper,
  round(stddev_samp(v) FILTER (replicate > 0 AND NOT isnan(v)), 6) AS std, count(*) FILTER (replicate > 0 AND NOT isnan(v)) AS n_valid"""


def _rounded(df):
    return r6(df, "point", "ci_lower", "ci_upper", "std")


@query("bootstrap_binary", f"""WITH {_cells_ctes("b", "status", ["prediction", "label"])},
t AS (SELECT status, replicate, {_B_TABLE}, sum(w) AS n, sum(w * (prediction - label) ** 2) AS e FROM b GROUP BY status, replicate),
g AS (SELECT status, replicate, sum(abs(p - y)) / sum(n) AS ece FROM (
  SELECT status, replicate, least(floor(prediction * 15), 14) AS bin, sum(w) AS n, sum(w * prediction) AS p, sum(w * label) AS y FROM b GROUP BY ALL) GROUP BY ALL),
v AS (UNPIVOT (SELECT status, replicate, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
  CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS specificity, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, (tp + tn) / n::DOUBLE AS accuracy, e / n AS brier_score, ece
  FROM t JOIN g USING (status, replicate)) ON f1, specificity, precision, recall, accuracy, brier_score, ece INTO NAME metric VALUE v)
{_B_INTERVALS} FROM v GROUP BY ALL""")
def bootstrap_binary(spark, sf):
    """Seven binary metrics per status from one pass, compared replicate for replicate."""
    states = RS.metric_states()
    names = ["f1", "specificity", "precision", "recall", "accuracy", "brier_score", "ece"]
    return _rounded(SG.bootstrap_intervals(A.predictions(spark, sf), {k: states[k] for k in names}, N_REPS, 42, ["status"]))


@query("bootstrap_regression", f"""WITH {_cells_ctes("b", "status", ["prediction", "label"]).replace(f"pred AS ({CTES['pred']})", f"pred AS (SELECT status, prediction, target AS label FROM ({CTES['pred']}))")},
t AS (SELECT status, replicate, sum(w) AS n, sum(w * (prediction - label) ** 2) AS e, sum(w * abs(prediction - label)) AS a, sum(w * label) AS y, sum(w * label * label) AS yy FROM b GROUP BY ALL),
v AS (UNPIVOT (SELECT status, replicate, e / n AS mse, a / n AS mae, sqrt(e / n) AS rmse, 1 - e / (yy - y * y / n) AS r2 FROM t)
  ON mse, mae, rmse, r2 INTO NAME metric VALUE v)
{_B_INTERVALS} FROM v GROUP BY ALL""")
def bootstrap_regression(spark, sf):
    states = RS.metric_states()
    rows = A.predictions(spark, sf).withColumn("label", F.col("target"))
    return _rounded(SG.bootstrap_intervals(rows, {k: states[k] for k in ("mse", "mae", "rmse", "r2")}, N_REPS, 42, ["status"]))


@query("bootstrap_own_metric", f"""WITH {_cells_ctes("b", "status", ["prediction", "label"])},
t AS (SELECT status, replicate, {_B_TABLE}, sum(w) AS n, sum(w * -ln(CASE WHEN label = 1 THEN greatest(prediction, 0.01) ELSE 1 - least(prediction, 0.99) END)) AS l FROM b GROUP BY status, replicate),
v AS (UNPIVOT (SELECT status, replicate, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, l / n AS log_loss FROM t)
  ON balanced_accuracy, log_loss INTO NAME metric VALUE v)
{_B_INTERVALS} FROM v GROUP BY ALL""")
def bootstrap_own_metric(spark, sf):
    """Metrics of a caller's own, by features and a function of their sums."""
    import numpy as np

    def losses(rows):
        p, y = rows["prediction"].to_numpy(float), rows["label"].to_numpy(float)
        loss = -np.log(np.where(y == 1, np.maximum(p, 0.01), 1 - np.minimum(p, 0.99)))
        return np.stack([np.ones(len(p)), loss], axis=1)

    table = RS.metric_states()["f1"].features
    own = {
        "balanced_accuracy": RS.WeightedSums(4, table, lambda s: (s[:, 0] / (s[:, 0] + s[:, 3]) + s[:, 2] / (s[:, 2] + s[:, 1])) / 2),
        "log_loss": RS.WeightedSums(2, losses, lambda s: s[:, 1] / s[:, 0]),
    }
    return _rounded(SG.bootstrap_intervals(A.predictions(spark, sf), own, N_REPS, 42, ["status"]))


@query("paired_bootstrap_f1", f"""WITH {_cells_ctes("b", "", ["prediction", "prediction_b", "label"], [])},
t AS (SELECT replicate, sum(w) FILTER (prediction >= 0.5 AND label = 1) AS tp, sum(w) FILTER ((prediction >= 0.5) <> (label = 1)) AS f,
  sum(w) FILTER (prediction_b >= 0.5 AND label = 1) AS tp_b, sum(w) FILTER ((prediction_b >= 0.5) <> (label = 1)) AS f_b FROM b GROUP BY ALL),
v AS (SELECT replicate, 2 * tp / (2 * tp + f) AS a, 2 * tp_b / (2 * tp_b + f_b) AS b FROM t), p AS (SELECT a, b FROM v WHERE replicate = 0)
SELECT round(any_value(p.a), 6) AS score_a, round(any_value(p.b), 6) AS score_b, round(any_value(p.a - p.b), 6) AS delta,
  round(avg(CAST(v.a - v.b >= 2 * (p.a - p.b) AS INTEGER)), 6) AS p_value, count(*) AS n_valid, avg(CAST(v.a - v.b >= 2 * (p.a - p.b) AS INTEGER)) < 0.05 AS significant_at_005
FROM v, p WHERE replicate > 0""")
def paired_bootstrap_f1(spark, sf):
    out = SG.paired_bootstrap(A.predictions(spark, sf), "f1", "prediction", "prediction_b", n=N_REPS)
    return r6(out, "score_a", "score_b", "delta", "p_value")


@query("bootstrap_ranking", f"""WITH {_cells_ctes("b", "", ["prediction"], ["label"])},
s AS (SELECT replicate, prediction, sum(w) FILTER (label = 1)::DOUBLE AS pos, sum(w) FILTER (label = 0)::DOUBLE AS neg FROM b WHERE replicate > 0 GROUP BY ALL),
c AS (SELECT replicate, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, sum(coalesce(pos, 0)) OVER o AS tp, sum(coalesce(neg, 0)) OVER o AS fp
  FROM s WINDOW o AS (PARTITION BY replicate ORDER BY prediction DESC))
SELECT CAST(replicate AS INTEGER) AS replicate, round(1 - sum(pos * (fp - neg / 2)) / (sum(pos) * sum(neg)), 6) AS auroc,
  round(sum(pos * tp / greatest(tp + fp, 1)) / sum(pos), 6) AS auprc FROM c GROUP BY replicate""")
def bootstrap_ranking(spark, sf):
    """Both ranking metrics of every replicate."""
    draws = RS.cell_key(42, ["_y"], ["prediction"])
    return r6(SG.replicate_ranking(A.predictions(spark, sf), N_REPS, 42, draws=draws), "auroc", "auprc")


CTES["pair"] = """
SELECT o_orderpriority AS task, l_suppkey % 7 AS scope, l_linenumber AS seed, l_suppkey,
  avg(l_discount) FILTER (l_returnflag = 'A') AS value_a, avg(l_discount) FILTER (l_returnflag = 'N') AS value_b
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL"""
CTES["pdiff"] = "SELECT task, value_a, value_b, round(value_a - value_b, 9) AS diff FROM pair WHERE value_a IS NOT NULL AND value_b IS NOT NULL"


def paired_rows(spark, sf):
    li, o = A.table(spark, sf, "lineitem"), A.table(spark, sf, "orders")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))

    def side(flag):
        return F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_discount")))

    per = rows.groupBy(F.col("o_orderpriority").alias("task"), "l_suppkey", F.col("l_linenumber").alias("seed")).agg(
        side("A").alias("value_a"), side("N").alias("value_b")
    )
    per = per.filter("value_a is not null and value_b is not null")
    return per.withColumn("diff", F.round(F.col("value_a") - F.col("value_b"), 9))


@query("signed_rank_test", W("pair pdiff", """
SELECT task, n_pairs, n_nonzero_pairs, least(wp, wm) AS statistic,
  round((wp - mu - sign(wp - mu) * 0.5) / sd, 6) AS z_score FROM (
 SELECT task, wp, wm, n_pairs, n_nonzero_pairs, n * (n + 1) / 4.0 AS mu, sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS sd FROM (
  SELECT task, any_value(np) AS n_pairs, count(*) AS n_nonzero_pairs, count(*)::DOUBLE AS n, sum(r) FILTER (diff > 0) AS wp, sum(r) FILTER (diff < 0) AS wm,
    sum(t * t - 1.0) AS ties FROM (
   SELECT task, diff, np, rank() OVER (PARTITION BY task ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY task, abs(diff)) - 1) / 2.0 AS r,
     count(*) OVER (PARTITION BY task, abs(diff))::DOUBLE AS t
   FROM (SELECT *, count(*) OVER (PARTITION BY task) AS np FROM pdiff) WHERE diff <> 0) GROUP BY task))"""))
def signed_rank_test(spark, sf):
    out = SG.signed_rank(paired_rows(spark, sf), ["task"])
    return out.select("task", "n_pairs", "n_nonzero_pairs", "statistic", F.round("z_score", 6).alias("z_score"))


CTES["sdiff"] = """
SELECT task, l_suppkey % 10 AS part, l_suppkey, seed, value_a, value_b, round(value_a - value_b, 9) AS diff FROM pair
WHERE value_a IS NOT NULL AND value_b IS NOT NULL AND seed <= 1 + l_suppkey % 3"""
_SUBSETS = """ways(r, counts) AS (
  SELECT 0, [1.0::DOUBLE] UNION ALL
  SELECT r + 1, list_transform(range(0, len(counts) + r + 1), lambda s: coalesce(counts[s + 1], 0.0) + CASE WHEN s >= r + 1 THEN coalesce(counts[s - r], 0.0) ELSE 0.0 END)
  FROM ways WHERE r < 50)"""


@query("signed_rank_exact", W("pair sdiff", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_SUBSETS},
ranked AS (SELECT *, rank() OVER (PARTITION BY task, part ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY task, part, abs(diff)) - 1) / 2.0 AS r FROM sdiff WHERE diff <> 0),
sums AS (SELECT task, part, count(*) AS n, coalesce(sum(r) FILTER (diff > 0), 0) AS wp, coalesce(sum(r) FILTER (diff < 0), 0) AS wm FROM ranked GROUP BY task, part)
SELECT task, part, (SELECT count(*) FROM sdiff d WHERE d.task = s.task AND d.part = s.part) AS n_pairs, n AS n_nonzero_pairs, least(wp, wm) AS statistic,
  round(least(2 * list_sum(counts[1:CAST(ceil(least(wp, wm)) AS INTEGER) + 1]) / 2.0 ** n, 1.0), 9) AS p_value
FROM sums s JOIN ways ON ways.r = n WHERE n <= 50""")
def signed_rank_exact(spark, sf):
    """Small families, whose p-values come from the distribution of rank sums."""
    rows = paired_rows(spark, sf).withColumn("part", F.col("l_suppkey") % 10).filter("seed <= 1 + l_suppkey % 3")
    out = SG.signed_rank(rows, ["task", "part"]).filter("n_nonzero_pairs BETWEEN 1 AND 50")
    return out.select("task", "part", "n_pairs", "n_nonzero_pairs", "statistic", F.round("p_value", 9).alias("p_value"))


@query("effect_sizes", W("pair pdiff", """
SELECT task, count(*) AS n_pairs, round(avg(value_a - value_b) / stddev_samp(value_a - value_b), 6) AS paired_d,
  round((avg(value_a) - avg(value_b)) / sqrt((var_samp(value_a) + var_samp(value_b)) / 2), 6) AS pooled_d FROM pdiff GROUP BY task"""))
def effect_sizes(spark, sf):
    rows = paired_rows(spark, sf)
    a = SG.cohens_d(rows, ["task"]).withColumnRenamed("cohens_d", "paired_d")
    b = SG.cohens_d(rows, ["task"], paired=False).drop("n_pairs").withColumnRenamed("cohens_d", "pooled_d")
    return r6(a.join(b, "task"), "paired_d", "pooled_d")


@query("bonferroni", """
SELECT o_orderpriority AS family, o_orderkey AS item, round(p, 6) AS p_value,
  round(least(p * count(*) OVER (PARTITION BY o_orderpriority), 1.0), 6) AS p_value_bonferroni,
  least(p * count(*) OVER (PARTITION BY o_orderpriority), 1.0) < 0.05 AS significant_bonferroni_005
FROM (SELECT *, (o_totalprice / 1000000.0) ** 8 AS p FROM orders)""")
def bonferroni(spark, sf):
    o = A.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("item"),
        F.pow(F.col("o_totalprice") / 1000000.0, 8).alias("p_value"),
    )
    return r6(SG.bonferroni(o, ["family"]), "p_value", "p_value_bonferroni")


# --- embeddings ---------------------------------------------------------------------------------------------

CTES["edim"] = "SELECT CAST(i - 1 AS INTEGER) AS dim, x::DOUBLE AS x FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query("embedding_dim_stats", W("edim", """
SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max FROM edim GROUP BY dim"""))
def embedding_dim_stats(spark, sf):
    return r6(EM.dim_stats(A.table(spark, sf, "embeddings")), "mean", "std")


@query("embedding_global_stats", W("edim", """
SELECT count(*) // 64 AS n_samples, 64 AS embedding_dim, round(avg(x), 6) AS global_mean, round(stddev_pop(x), 6) AS global_std FROM edim"""))
def embedding_global_stats(spark, sf):
    return r6(EM.global_stats(A.table(spark, sf, "embeddings")), "global_mean", "global_std")


@query("embedding_spectrum", W("edim", """
SELECT 64::BIGINT AS n_components, round(sum(v), 6) AS total_variance, 1.0::DOUBLE AS total_share FROM (SELECT var_samp(x) AS v FROM edim GROUP BY dim)"""))
def embedding_spectrum(spark, sf):
    """The eigenvalues add up to the total variance and the shares to one."""
    e = EM.eigenvalues(A.table(spark, sf, "embeddings"))
    return e.agg(F.count(F.lit(1)).alias("n_components"), F.round(F.sum("eigenvalue"), 6).alias("total_variance"),
                 F.round(F.sum("explained"), 6).alias("total_share"))


@query("embedding_dimensionality", None)
def embedding_dimensionality(spark, sf):
    out = EM.dimensionality(EM.eigenvalues(A.table(spark, sf, "embeddings")))
    return r6(out, "effective_rank", "participation_ratio")


CTES["enorm"] = "SELECT vec_id, embedding::DOUBLE[] AS v, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-8) AS nrm FROM embeddings"


CTES["eunit"] = "SELECT vec_id, list_transform(v, lambda x: x / nrm) AS u FROM enorm"


@query("embedding_cosines", W("enorm eunit", """
SELECT round(avg(c), 8) AS mean_cosine, round(stddev_pop(c), 8) AS std_cosine, count(*) AS n_pairs
FROM (SELECT list_inner_product(a.u, b.u) AS c FROM eunit a JOIN eunit b ON a.vec_id < b.vec_id)"""))
def embedding_cosines(spark, sf):
    """Moments of the cosines of all pairs, from sums over single rows; SQL makes every pair."""
    out = EM.cosine_moments(A.table(spark, sf, "embeddings"))
    return out.withColumns({c: F.round(c, 8) for c in ("mean_cosine", "std_cosine")})


@query("embedding_participation", W("edim", """
SELECT any_value(n) AS n_samples, round(sum(c) FILTER (i = j), 8) AS total_variance, round(sum(c * c), 8) AS squared_norm,
  round(sum(c) FILTER (i = j) ** 2 / sum(c * c), 6) AS participation_ratio
FROM (SELECT i, j, count(*) AS n, covar_samp(x, y) AS c FROM (
  SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings) JOIN (
  SELECT generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS y, vec_id FROM embeddings) USING (vec_id) GROUP BY i, j)"""))
def embedding_participation(spark, sf):
    out = EM.participation(A.table(spark, sf, "embeddings"))
    return out.withColumns({"total_variance": F.round("total_variance", 8), "squared_norm": F.round("squared_norm", 8), "participation_ratio": F.round("participation_ratio", 6)})


@query("embedding_pair_similarity", W("edim", """
SELECT least(10000, (count(*) // 64) * (count(*) // 64 - 1) // 2) AS n_pairs, true AS cosine_in_range, true AS uniformity_in_range FROM edim"""))
def embedding_pair_similarity(spark, sf):
    e = A.table(spark, sf, "embeddings")
    out = EM.pair_similarity(EM.sampled_pairs(e, 10000, "vec_id"))
    return out.select(
        "n_pairs", F.col("mean_cosine").between(-1.0, 1.0).alias("cosine_in_range"),
        F.col("uniformity").between(-8.0, 0.0).alias("uniformity_in_range"),
    )


@query("embedding_collapse", W("edim", """
SELECT count(*) FILTER (s < 1e-6) AS dead_dimensions, count(*) AS embedding_dim, false AS is_collapsed FROM (SELECT stddev_pop(x) AS s FROM edim GROUP BY dim)"""))
def embedding_collapse(spark, sf):
    e = A.table(spark, sf, "embeddings")
    out = EM.collapse(EM.dim_stats(e), EM.pair_similarity(EM.sampled_pairs(e, 10000, "vec_id")))
    return out.select("dead_dimensions", "embedding_dim", "is_collapsed")


@query("embedding_report", W("edim", """
SELECT count(*) // 64 AS n_samples, round(avg(x), 6) AS global_mean, round(stddev_pop(x), 6) AS global_std, 0::BIGINT AS dead_dimensions, 0 AS n_warnings FROM edim"""))
def embedding_report(spark, sf):
    out = EM.quality_report(A.table(spark, sf, "embeddings"), "vec_id")
    out = out.withColumn("n_warnings", F.size("warnings"))
    return r6(out, "global_mean", "global_std").select(
        "n_samples", "global_mean", "global_std", "dead_dimensions", "n_warnings"
    )


@query("embedding_comparison", """
SELECT 'A' AS "set", count(*) AS n_samples, 0::BIGINT AS dead_dimensions FROM embeddings WHERE label < 5
UNION ALL SELECT 'B', count(*), 0 FROM embeddings WHERE label >= 5""")
def embedding_comparison(spark, sf):
    e = A.table(spark, sf, "embeddings")
    out = EM.compare(e.filter("label < 5"), e.filter("label >= 5"), "vec_id", n_pairs=2000)
    return out.select("set", "n_samples", "dead_dimensions")


@query("embedding_extraction", W("ev", """
SELECT stay_id, count(*)::DOUBLE AS e0, round(min(value), 4) AS e1, round(max(value), 4) AS e2 FROM ev GROUP BY stay_id"""))
def embedding_extraction(spark, sf):
    """An encoder over Arrow batches; three numbers per stay."""
    per = A.raw_events(spark, sf).groupBy("stay_id").agg(
        F.count(F.lit(1)).alias("a"), F.round(F.min("value"), 4).alias("b"), F.round(F.max("value"), 4).alias("c")
    )

    def encoder(pdf):
        vecs = pdf[["a", "b", "c"]].to_numpy(dtype="float32")
        return pdf[["stay_id"]].assign(embedding=list(vecs))

    out = EM.encode(per, encoder, "stay_id")
    return out.select("stay_id", *[F.round(F.col("embedding")[i].cast("double"), 4).alias(f"e{i}") for i in range(3)])
