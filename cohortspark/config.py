"""Fixed benchmark values and the frozen settings objects of the operators."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

# --- fixed values: windows, cohort, split -----------------------------------
SEQ_LENGTH_HOURS = 24
MIN_STAY_HOURS = 24
LABEL_HORIZON_HOURS = 48
SPLIT_RATIOS = (0.7, 0.15, 0.15)
BENCHMARK_TASKS = ("mortality_24h", "mortality_hospital", "aki_kdigo", "los_remaining")

# --- fixed values: features that never reach model input ---------------------
LEAKING_FEATURES = ("los_hosp", "los_icu", "dur_var")
FUTURE_FEATURES = (
    "dobu_dur", "dopa_dur", "epi_dur", "norepi_dur",
    "dobu60", "dopa60", "epi60", "norepi60", "vaso_ind",
    "sofa_cardio", "sofa", "susp_inf", "sep3",
)
SUMMARY_FEATURES = (
    "pafi", "safi", "norepi_equiv", "vent_ind", "gcs", "urine24",
    "sofa_resp", "sofa_coag", "sofa_liver", "sofa_cns", "sofa_renal",
    "qsofa", "sirs", "news", "mews",
)
BLOCKED_FEATURES = LEAKING_FEATURES + FUTURE_FEATURES + SUMMARY_FEATURES

# --- fixed values: categorical encodings, vocabulary ------------------------
ORDINAL_CODES = {
    "avpu": {"A": 0.0, "V": 1.0, "P": 2.0, "U": 3.0},
    "mech_vent": {"noninvasive": 1.0, "invasive": 2.0},
}
DEATH_WORDS = ("death", "died", "expired", "deceased", "dead")
UNKNOWN_GENDER_WORDS = (
    "unknown", "unk", "missing", "not specified", "not available", "na", "n/a", "none", "null",
)
UNKNOWN_RACE_MARKERS = ("UNKNOWN", "DECLIN", "UNABLE", "PATIENT REFUSED", "NOT SPECIFIED")
RACE_GROUP_MARKERS = (
    ("Hispanic", ("HISPANIC", "LATINO")),
    ("Black", ("BLACK", "AFRICAN")),
    ("Asian", ("ASIAN",)),
    ("White", ("WHITE",)),
)
AGE_GROUPS = (("18-44", 18, 44), ("45-64", 45, 64), ("65-79", 65, 79), ("80+", 80, None))
PROTECTED_ATTRIBUTES = ("gender", "age_group", "race")
MIN_SUBGROUP_PATIENTS = 50

# --- fixed values: run records ----------------------------------------------
LINEAR_PROBE = "linear_probe"
FULL_FINETUNE = "full_finetune"
LINEAR_PROBE_ALIASES = ("a", "protocol_a", "probe", "linear_probe")
FULL_FINETUNE_ALIASES = (
    "b", "protocol_b", "finetune", "fine_tune", "full_finetune", "full_fine_tune",
    "fully_finetuned",
)
FINGERPRINT = (
    "experiment_class", "experiment_type", "experiment_subtype", "paradigm", "dataset", "task",
    "protocol", "label_fraction", "model_size", "source_dataset", "phase",
    "upstream_pretrain_lr", "upstream_pretrain_mask_ratio",
)
EXPERIMENT_CLASSES = (
    "core_ssl_benchmark", "label_efficiency", "cross_dataset_transfer", "hp_robustness",
    "capacity_study", "classical_baselines", "ts2vec_extension",
)
FIXED_SEEDS = (42, 123, 456, 789, 1011)
EVAL_PHASES = ("finetune", "supervised", "baseline")
CLASSICAL_PARADIGMS = ("gru_d", "xgboost")
CONTEXT_CLASSES = ("classical_context_full", "classical_context_label_efficiency")
PRIMARY_METRIC = {
    "mortality_24h": "test/auprc",
    "mortality_hospital": "test/auprc",
    "aki_kdigo": "test/auprc",
    "los_remaining": "test/mae",
}
LOWER_IS_BETTER = ("test/loss", "test/mae", "test/mse")
METRIC_PREFIXES = (
    "train/", "val/", "test/", "fairness/", "baseline/", "train_label_support/", "trainer/",
)
COMPUTE_METRICS = (
    "train/gradient_steps", "train/wall_clock_seconds", "_runtime", "_step", "epoch",
    "trainer/global_step",
)
MODEL_SIZES = {(64, 2): "default", (128, 4): "medium", (256, 4): "large"}
LR_CODES = {"00002": 2e-4, "00005": 5e-4, "0002": 2e-3}
MASK_RATIO_CODES = {"03": 0.3, "075": 0.75}
BINARY_FAIRNESS_KEYS = (
    "n_valid_groups", "n_metric_valid_groups", "worst_group_auroc", "worst_group_auprc",
    "auroc_gap", "auprc_gap", "demographic_parity_diff", "equalized_odds_diff",
    "disparate_impact_ratio",
)
REGRESSION_FAIRNESS_KEYS = (
    "n_valid_groups", "worst_group_mse", "worst_group_mae", "mse_gap", "mae_gap",
)
FAIRNESS_SCHEMA_VERSION = "2026-04-23.v2"
FAIRNESS_SCRIPT_VERSION = "evaluate_fairness.py:2026-04-23.v2"

# --- fixed values: the expected run matrix ----------------------------------
MATRIX_DATASETS = ("miiv", "eicu", "combined")
MATRIX_PARADIGMS = ("mae", "jepa", "contrastive")
MATRIX_TRANSFERS = (("miiv", "eicu"), ("eicu", "miiv"))
MATRIX_FRACTIONS = {
    "mortality_24h": (0.05, 0.1, 0.25, 0.5),
    "mortality_hospital": (0.01, 0.05, 0.1, 0.25, 0.5),
    "aki_kdigo": (0.1,),
    "los_remaining": (0.1,),
}
MATRIX_CLASSICAL_FRACTIONS = {
    "mortality_24h": (0.05, 0.1, 0.25, 0.5),
    "mortality_hospital": (0.1,),
    "aki_kdigo": (0.1,),
    "los_remaining": (0.1,),
}
MATRIX_CAPACITY_FRACTIONS = (0.05, 0.1, 0.5)
MATRIX_CAPACITY_SIZES = ("medium", "large")
MATRIX_LRS = (2e-4, 5e-4, 2e-3)
MATRIX_MASK_RATIOS = (0.3, 0.75)


@dataclass(frozen=True)
class TaskConfig:
    """One label task: windows in hours, sources it reads, and free parameters.

    ``prediction_hours`` is None (no window), -1 (until unit discharge) or hours.
    """

    name: str
    category: str
    task_type: str = "binary"
    prediction_hours: int | None = None
    observation_hours: int | None = None
    gap_hours: int = 0
    sources: tuple[str, ...] = ("stays",)
    params: dict = field(default_factory=dict)
    max_missing_pct: float | None = None
    datasets: tuple[str, ...] = ()

    def __post_init__(self):
        if self.gap_hours < 0:
            raise ValueError("gap_hours must be >= 0")
        if self.prediction_hours is not None and self.prediction_hours < -1:
            raise ValueError("prediction_hours must be None, -1 or >= 0")

    def config_hash(self) -> str:
        """16 hex digits over the settings that change label values."""
        body = {
            "name": self.name, "category": self.category, "task_type": self.task_type,
            "prediction_hours": self.prediction_hours,
            "observation_hours": self.observation_hours, "gap_hours": self.gap_hours,
            "sources": list(self.sources), "params": self.params,
        }
        text = json.dumps(body, sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class ConceptRule:
    """How one feature is taken from raw events.

    ``kind`` is ``item`` (id list), ``column``, ``string`` (exact) or ``regex``.
    ``agg`` is mean, sum, max, min, last, first or any.
    """

    feature: str
    agg: str = "mean"
    kind: str = "string"
    match: tuple = ()
    lo: float | None = None
    hi: float | None = None
    transform: str | None = None

    def __post_init__(self):
        if self.agg not in ("mean", "sum", "max", "min", "last", "first", "any"):
            raise ValueError(f"unknown aggregation {self.agg!r}")
        if self.kind not in ("item", "column", "string", "regex"):
            raise ValueError(f"unknown rule kind {self.kind!r}")


@dataclass(frozen=True)
class Criterion:
    """A stratification rule: either listed values or right-closed numeric bins."""

    column: str
    values: tuple | None = None
    edges: tuple | None = None
    labels: tuple | None = None


@dataclass(frozen=True)
class Slot:
    """One pick of the slot-based selection."""

    name: str
    filters: tuple = ()  # of (column, operator, value)
    sort_by: str | None = None
    descending: bool = False


DEFAULT_CRITERIA = (
    Criterion("los_days", edges=(1, 3, 7), labels=("<1d", "1-3d", "3-7d", ">7d")),
    Criterion("age", edges=(40, 65), labels=("<40", "40-65", ">65")),
)
DEFAULT_SLOTS = (
    Slot("short_stay_survived", (("los_days", "<", 1), ("mortality_24h", "==", 0)), "los_days"),
    Slot("short_stay_died", (("los_days", "<", 1), ("mortality_24h", "==", 1)), "los_days"),
    Slot("medium_stay_clean", (("los_days", "between", (1, 3)),), "missingness_pct"),
    Slot("medium_stay_sparse", (("los_days", "between", (1, 3)),), "missingness_pct", True),
    Slot("long_stay", (("los_days", ">", 5),), "los_days", True),
    Slot("young_patient", (("age", "<", 40),), "age"),
    Slot("elderly_patient", (("age", ">", 80),), "age", True),
    Slot("random_sample"),
)
MISSINGNESS_EDGES = (10, 30, 50, 70)
MISSINGNESS_LABELS = ("<10%", "10-30%", "30-50%", "50-70%", ">70%")
