"""Raw hospital tables to the stays, mortality and diagnoses frames.

One spec per dataset family says which column plays which role; missing tables or
columns become typed nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark import schemas
from cohortspark.config import DEATH_WORDS
from cohortspark.functions.values import strict_gender
from cohortspark.operators.cohort import complete_columns

# --- fixed values: offsets count from this moment; words for missing and for life ----
SYNTHETIC_EPOCH = "2000-01-01 00:00:00"
BLANK_WORDS = ("", "na", "nan", "null", "unknown")
ALIVE_WORDS = ("alive",)


def _has(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def _pick(df: DataFrame, names: Sequence[str], kind: str) -> Column:
    """The first of the named columns that exists, cast; else a typed null."""
    name = _has(df, names)
    return (F.col(name) if name else F.lit(None)).cast(kind)


def _epoch() -> Column:
    return F.lit(SYNTHETIC_EPOCH).cast("timestamp")


def from_minutes(minutes: Column) -> Column:
    """A timestamp from minutes after the synthetic epoch."""
    base = F.unix_micros(_epoch())
    return F.timestamp_micros((base + minutes.cast("double") * 60_000_000).cast("bigint"))


# --- administrative data ------------------------------------------------------------

def _icu_admin(tables: dict[str, DataFrame]) -> DataFrame:
    """ICU stays with the admission's race, admission type and insurance (two id styles)."""
    icu = tables["icustays"]
    base = icu.select(
        _pick(icu, ("stay_id", "icustay_id"), "bigint").alias("stay_id"),
        _pick(icu, ("subject_id",), "string").alias("patient_id"),
        _pick(icu, ("hadm_id",), "bigint").alias("hadm_id"),
        _pick(icu, ("intime",), "timestamp").alias("intime"),
        _pick(icu, ("outtime",), "timestamp").alias("outtime"),
        _pick(icu, ("first_careunit",), "string").alias("first_careunit"),
    )
    adm = tables.get("admissions")
    if adm is None:
        return base
    extra = adm.select(
        F.col("hadm_id").cast("bigint").alias("hadm_id"),
        _pick(adm, ("race", "ethnicity"), "string").alias("race"),
        _pick(adm, ("admission_type",), "string").alias("admission_type"),
        _pick(adm, ("insurance",), "string").alias("insurance"),
    )
    return base.join(extra, "hadm_id", "left")


def _offset_admin(tables: dict[str, DataFrame]) -> DataFrame:
    """Offset-based stays: admission at the epoch, discharge by minutes."""
    pat = tables["patient"]
    admitted = _epoch() if "hospitaladmitoffset" in pat.columns else F.lit(None).cast("timestamp")
    minutes = _pick(pat, ("unitdischargeoffset",), "double")
    return pat.select(
        _pick(pat, ("patientunitstayid", pat.columns[0]), "bigint").alias("stay_id"),
        _pick(pat, ("uniquepid", "patienthealthsystemstayid"), "string").alias("patient_id"),
        F.lit(None).cast("bigint").alias("hadm_id"),
        admitted.alias("intime"), from_minutes(minutes).alias("outtime"),
        _pick(pat, ("unittype",), "string").alias("first_careunit"),
        _pick(pat, ("ethnicity",), "string").alias("race"),
        _pick(pat, ("hospitaladmitsource",), "string").alias("admission_type"),
    )


def _plain_admin(table: str, stay: Sequence[str], patient: Sequence[str], begin: str, end: str | None):
    def build(tables: dict[str, DataFrame]) -> DataFrame:
        df = tables[table]
        return df.select(
            _pick(df, stay, "bigint").alias("stay_id"),
            _pick(df, patient, "string").alias("patient_id"),
            F.lit(None).cast("bigint").alias("hadm_id"),
            _pick(df, (begin,), "timestamp").alias("intime"),
            _pick(df, (end,) if end else (), "timestamp").alias("outtime"),
        )

    return build


ADMIN: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
    "miiv": _icu_admin,
    "mimic": _icu_admin,
    "eicu": _offset_admin,
    "hirid": _plain_admin("general", ("patientid", "admissionid"), ("patientid", "admissionid"),
                          "admissiontime", None),
    "aumc": _plain_admin("admissions", ("admissionid",), ("patientid",), "admittedat", "dischargedat"),
    "sic": _plain_admin("cases", ("CaseID", "caseid"), ("CaseID", "caseid"), "AdmissionOn", "DischargeOn"),
}
ADMIN_TABLE = {
    "miiv": "icustays", "mimic": "icustays", "eicu": "patient", "hirid": "general",
    "aumc": "admissions", "sic": "cases",
}


def admin_rows(family: str, tables: dict[str, DataFrame]) -> DataFrame | None:
    """The family's administrative columns; None when its main table is not there."""
    if family not in ADMIN or tables.get(ADMIN_TABLE[family]) is None:
        return None
    return ADMIN[family](tables)


def build_stays(
    windows: DataFrame, demographics: DataFrame | None, admin: DataFrame | None
) -> DataFrame:
    """Stay windows left-joined to demographics and administration, in the 14-column form."""
    out = windows
    for side in (demographics, admin):
        if side is not None:
            fresh = [c for c in side.columns if c == "stay_id" or c not in out.columns]
            out = out.join(side.select(*fresh), "stay_id", "left")
    if "sex" in out.columns:
        out = out.withColumn("gender", strict_gender("sex"))
    return complete_columns(out, schemas.STAYS)


# --- mortality --------------------------------------------------------------------------

def death_columns(df: DataFrame) -> DataFrame:
    """Precision-aware death columns: the admission's death time, else the patient's date."""
    exact, day = F.col("deathtime"), F.col("date_of_death")
    by_date = exact.isNull() & day.isNotNull()
    return df.withColumns(
        {
            "death_time": exact,
            "death_date": F.when(by_date, day.cast("date")),
            "death_time_precision": F.when(exact.isNotNull(), "timestamp").when(by_date, "date"),
            "death_source": F.when(exact.isNotNull(), "admissions.deathtime").when(
                by_date, "patients.dod"
            ),
        }
    )


def _icu_mortality(tables: dict[str, DataFrame]) -> DataFrame:
    icu = tables["icustays"]
    out = icu.select(
        _pick(icu, ("stay_id", "icustay_id"), "bigint").alias("stay_id"),
        _pick(icu, ("subject_id",), "bigint").alias("subject_id"),
        _pick(icu, ("hadm_id",), "bigint").alias("hadm_id"),
    )
    pat, adm = tables.get("patients"), tables.get("admissions")
    if pat is not None:
        dod = pat.select(
            F.col("subject_id").cast("bigint").alias("subject_id"),
            _pick(pat, ("dod",), "timestamp").alias("date_of_death"),
        )
        out = out.join(dod, "subject_id", "left")
    else:
        out = out.withColumn("date_of_death", F.lit(None).cast("timestamp"))
    if adm is not None:
        facts = adm.select(
            F.col("hadm_id").cast("bigint").alias("hadm_id"),
            _pick(adm, ("hospital_expire_flag",), "int").alias("hospital_expire_flag"),
            _pick(adm, ("dischtime",), "timestamp").alias("dischtime"),
            _pick(adm, ("discharge_location",), "string").alias("discharge_location"),
            _pick(adm, ("deathtime",), "timestamp").alias("deathtime"),
        )
        out = out.join(facts, "hadm_id", "left")
    else:
        out = out.withColumn("deathtime", F.lit(None).cast("timestamp"))
    return death_columns(out)


def _offset_mortality(tables: dict[str, DataFrame]) -> DataFrame:
    """Death from discharge status and place, hospital before unit, times from offsets."""
    pat = tables["patient"]
    text = lambda n: _pick(pat, (n,), "string")

    def word(c):
        w = F.lower(F.trim(c))
        return F.when(~w.isin(*BLANK_WORDS), w)

    def dead(c):
        return F.coalesce(word(c).isin(*DEATH_WORDS), F.lit(False))

    places = {"hospital": text("hospitaldischargelocation"), "unit": text("unitdischargelocation")}
    states = {"hospital": text("hospitaldischargestatus"), "unit": text("unitdischargestatus")}
    minutes = {k: _pick(pat, (f"{k}dischargeoffset",), "string").try_cast("double") for k in places}
    by_place = {k: dead(c) for k, c in places.items()}
    by_state = {k: dead(c) for k, c in states.items()}
    where = {k: by_place[k] | by_state[k] for k in places}
    died = where["hospital"] | where["unit"]
    alive = F.coalesce(word(states["hospital"]).isin(*ALIVE_WORDS), F.lit(False))
    offset = F.coalesce(
        F.when(where["hospital"], minutes["hospital"]), F.when(where["unit"], minutes["unit"]),
        F.when(died, F.coalesce(minutes["hospital"], minutes["unit"])),
    )
    at = from_minutes(offset)
    stated_place = F.when(by_place["hospital"], places["hospital"]).when(by_place["unit"], places["unit"])
    usual_place = F.when(
        places["hospital"].isNull() | (F.trim(places["hospital"]) == ""), places["unit"]
    ).otherwise(places["hospital"])
    source = (
        F.when(by_state["hospital"], "patient.hospitaldischargestatus")
        .when(by_place["hospital"], "patient.hospitaldischargelocation")
        .when(by_state["unit"], "patient.unitdischargestatus")
        .when(by_place["unit"], "patient.unitdischargelocation")
    )
    return pat.select(
        _pick(pat, ("patientunitstayid", pat.columns[0]), "bigint").alias("stay_id"),
        at.alias("date_of_death"), at.alias("death_time"),
        F.lit(None).cast("date").alias("death_date"),
        F.when(at.isNotNull(), "timestamp").when(died, "unknown").alias("death_time_precision"),
        source.alias("death_source"),
        F.when(died, 1).when(alive, 0).alias("hospital_expire_flag"),
        from_minutes(F.coalesce(minutes["hospital"], minutes["unit"])).alias("dischtime"),
        F.coalesce(stated_place, usual_place).alias("discharge_location"),
    )


def generic_mortality(flags: DataFrame | None, stays: DataFrame) -> DataFrame:
    """From a per-stay death flag, or all null when the dataset has none."""
    if flags is None:
        return complete_columns(stays.select("stay_id"), schemas.MORTALITY)
    flag = flags.select("stay_id", F.col("death").cast("int").alias("hospital_expire_flag"))
    return complete_columns(flag, schemas.MORTALITY)


def build_mortality_info(
    family: str, tables: dict[str, DataFrame], stays: DataFrame, flags: DataFrame | None = None
) -> DataFrame:
    builders = {"miiv": ("icustays", _icu_mortality), "mimic": ("icustays", _icu_mortality),
                "eicu": ("patient", _offset_mortality)}
    if family in builders and tables.get(builders[family][0]) is not None:
        return complete_columns(builders[family][1](tables), schemas.MORTALITY)
    return generic_mortality(flags, stays)


# --- diagnoses ------------------------------------------------------------------------------

def clean_codes(df: DataFrame) -> DataFrame:
    """Drop blank codes, one row per code of a comma list, trimmed."""
    parts = F.transform(F.split("icd_code", ","), lambda c: F.trim(c))
    return df.withColumn("icd_code", F.explode(F.filter(parts, lambda c: c != "")))


def build_diagnoses(family: str, tables: dict[str, DataFrame]) -> DataFrame | None:
    """(stay_id, icd_code, icd_version); None when the family has no diagnosis rule."""
    if family in ("miiv", "mimic"):
        diag, icu = tables.get("diagnoses_icd"), tables.get("icustays")
        if diag is None or icu is None or _has(diag, ("icd_code", "icd9_code")) is None:
            return None
        ids = icu.select(
            _pick(icu, ("stay_id", "icustay_id"), "bigint").alias("stay_id"),
            F.col("hadm_id").cast("bigint").alias("hadm_id"),
        )
        version = _pick(diag, ("icd_version",), "int") if "icd_code" in diag.columns else F.lit(9)
        codes = diag.select(
            F.col("hadm_id").cast("bigint").alias("hadm_id"),
            _pick(diag, ("icd_code", "icd9_code"), "string").alias("icd_code"),
            version.alias("icd_version"),
        )
        return complete_columns(ids.join(codes, "hadm_id"), schemas.DIAGNOSES)
    diag = tables.get("diagnosis")
    if family != "eicu" or diag is None:
        return None
    name = _has(diag, ("icd9code", "diagnosisstring"))
    if name is None:
        return None
    version = F.lit(9) if name == "icd9code" else F.lit(None).cast("int")
    rows = diag.select(
        _pick(diag, ("patientunitstayid", diag.columns[0]), "bigint").alias("stay_id"),
        F.col(name).cast("string").alias("icd_code"), version.alias("icd_version"),
    )
    return complete_columns(clean_codes(rows), schemas.DIAGNOSES)
