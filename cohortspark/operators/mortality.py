"""Death labels as interval tests.

A death is an interval: a timestamp is a point, a date runs from 00:00:00 to
23:59:59 of that day. Each label is one comparison of that interval with the
windows of the task; an interval that straddles a window edge stays unlabelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.config import DEATH_WORDS, TaskConfig
from cohortspark.functions.values import as_utc_timestamps

LAST_SECOND = "INTERVAL '23:59:59' HOUR TO SECOND"


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def complete_mortality(df: DataFrame) -> DataFrame:
    """Give every frame the same death columns and types.

    A frame with only ``date_of_death`` is an older export: its values, even
    datetimes, count as dates, with precision ``date`` and source ``legacy``.
    """
    out = as_utc_timestamps(df, ("intime", "outtime", "dischtime", "death_time"))
    have = set(out.columns)

    def ensure(name, kind):
        nonlocal out
        c = F.col(name) if name in have else F.lit(None)
        out = out.withColumn(name, c.cast(kind))

    ensure("hospital_expire_flag", T.IntegerType())
    ensure("dischtime", T.TimestampType())
    ensure("discharge_location", T.StringType())
    if "death_time_precision" in have or "date_of_death" not in have:
        ensure("death_time", T.TimestampType())
        ensure("death_date", T.DateType())
        ensure("death_time_precision", T.StringType())
        ensure("death_source", T.StringType())
        return out
    day = F.col("date_of_death").cast("date")
    return out.withColumns(
        {
            "death_time": F.lit(None).cast("timestamp"),
            "death_date": day,
            "death_time_precision": F.when(day.isNotNull(), "date"),
            "death_source": F.lit("legacy"),
        }
    )


def location_says_death() -> Column:
    return _sure(F.lower(F.trim("discharge_location")).isin(*DEATH_WORDS))


def evidence(scope: str = "any") -> Column:
    """Whether the stay's outcome is death: anywhere (``any``) or in ``hospital``.

    A date alone says nothing about the hospital unless the flag or the discharge
    place agree, or the flag is unknown and the date is not after discharge.
    """
    stated = _sure(F.col("hospital_expire_flag") == 1) | location_says_death()
    timed = F.col("death_time").isNotNull()
    return stated | timed | (dated_death(scope))


def dated_death(scope: str) -> Column:
    dated = F.col("death_date").isNotNull()
    if scope == "any":
        return dated
    stated = _sure(F.col("hospital_expire_flag") == 1) | location_says_death()
    before_discharge = _sure(F.col("death_date") <= F.to_date("dischtime"))
    return dated & (stated | (F.col("hospital_expire_flag").isNull() & before_discharge))


def survivor(scope: str = "any") -> Column:
    return _sure(F.col("hospital_expire_flag") == 0) & ~evidence(scope)


def death_interval(scope: str = "any") -> Column:
    """Struct (lo, hi, precision) of the best known death time.

    Without a death time, the discharge time of a death without a date is used.
    """
    fallback = F.when(evidence(scope) & F.col("death_date").isNull(), F.col("dischtime"))
    point = F.coalesce(F.col("death_time"), fallback)
    midnight = F.col("death_date").cast("timestamp")
    kind = (
        F.when(point.isNotNull(), "timestamp")
        .when(dated_death(scope), "date")
        .when(evidence(scope), "unknown")
    )
    lo = F.coalesce(point, F.when(kind == "date", midnight))
    hi = F.coalesce(point, F.when(kind == "date", midnight + F.expr(LAST_SECOND)))
    return F.struct(lo.alias("lo"), hi.alias("hi"), kind.alias("precision"))


def _after(start: str, hours: int) -> Column:
    return F.col(start) + F.make_dt_interval(hours=F.lit(hours))


def _timed(d: Column) -> Column:
    return _sure(d["precision"].isin("timestamp", "date"))


def hospital_label() -> Column:
    return F.when(evidence(), 1).when(survivor(), 0)


def hospital_after_observation_label(obs_hours: int) -> Column:
    """Hospital death; deaths that may have begun inside the observation are dropped."""
    d = death_interval("hospital")
    early = _timed(d) & (d["lo"] < _after("intime", obs_hours))
    return (
        F.when(early, F.lit(None))
        .when(evidence("hospital"), 1)
        .when(survivor("hospital"), 0)
    )


def unit_label() -> Column:
    """Death up to unit discharge; a timed death later than that is a negative."""
    d = death_interval()
    inside = F.when(_timed(d), d["lo"] <= F.col("outtime"))
    return F.when(inside, 1).when(survivor() | (evidence() & ~inside), 0)


def admission_window_label(hours: int) -> Column:
    """Death within ``hours`` of admission; a date that straddles the end is unknown."""
    d = death_interval()
    end = _after("intime", hours)
    died = F.when(
        _timed(d),
        F.when(d["hi"] <= end, True)
        .when((d["lo"] <= end) & (end < d["hi"]), F.lit(None))
        .when(end.isNull() & (d["precision"] == "timestamp"), F.lit(None))
        .otherwise(False),
    )
    return F.when(died, 1).when(died.isNotNull() | survivor(), 0)


def windowed_label(obs: int, gap: int, horizon: int) -> Column:
    """Observation ``[in, in+obs)``, gap, prediction ``[start, end]``.

    ``horizon`` of -1 ends the prediction at unit discharge. Unlabelled: any interval
    across an edge, deaths in the observation or strictly inside the gap, unknown
    times. Known survivors and deaths outside all windows are negatives.
    """
    d = death_interval()
    obs_end, start = _after("intime", obs), _after("intime", obs + gap)
    end = F.col("outtime") if horizon == -1 else _after("intime", obs + gap + horizon)
    lo, hi = d["lo"], d["hi"]
    straddles = (
        ((lo < obs_end) & (hi >= obs_end))
        | ((lo < start) & (hi >= start))
        | ((lo <= end) & (hi > end))
    )
    dropped = straddles | (hi < obs_end)
    if gap > 0:
        dropped = dropped | ((lo > obs_end) & (hi < start))
    timed = F.when(dropped, F.lit(None)).when((lo >= start) & (hi <= end), 1).otherwise(0)
    return F.when(_timed(d), timed).when(survivor(), 0)


def build_mortality(task: TaskConfig, sources: dict[str, DataFrame]) -> DataFrame:
    """(stay_id, label) for any of the five window forms of the task."""
    joined = sources["stays"].join(sources["mortality_info"], "stay_id", "left")
    df = complete_mortality(joined)
    window, obs = task.prediction_hours, task.observation_hours
    if window is None:
        label = hospital_label() if obs is None else hospital_after_observation_label(obs)
    elif obs is not None:
        label = windowed_label(obs, task.gap_hours, window)
    else:
        label = unit_label() if window == -1 else admission_window_label(window)
    _require_times(df, task)
    return df.select("stay_id", label.cast("int").alias("label"))


def _require_times(df: DataFrame, task: TaskConfig) -> None:
    """A window needs at least one admission (or discharge) time in a non-empty cohort."""
    needed = []
    if task.observation_hours is not None or (task.prediction_hours or -1) >= 0:
        needed.append("intime")
    if task.prediction_hours == -1:
        needed.append("outtime")
    for name in needed:
        some = df.select(F.col(name).isNotNull().alias("ok")).limit(1).first()
        if some is None or some["ok"]:
            continue  # empty cohort, or the first row already has the time
        if df.filter(F.col(name).isNotNull()).limit(1).isEmpty():
            raise ValueError(f"task {task.name!r} needs {name!r}, but every value is null")
