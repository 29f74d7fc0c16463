from datetime import date, datetime, timedelta

import pytest

from cohortspark.config import TaskConfig
from cohortspark.operators.mortality import build_mortality, complete_mortality

IN = datetime(2024, 1, 1, 12)
STAYS = "stay_id bigint, intime timestamp, outtime timestamp"
INFO = (
    "stay_id bigint, death_time timestamp, death_date date, death_time_precision string, "
    "death_source string, hospital_expire_flag int, dischtime timestamp, discharge_location string"
)


def label(spark, *, time=None, day=None, flag=None, disch=None, place=None, intime=IN,
          outtime=None, **task):
    kind = "timestamp" if time else "date" if day else None
    stays = spark.createDataFrame([(1, intime, outtime or IN + timedelta(days=6))], STAYS)
    info = spark.createDataFrame([(1, time, day, kind, None, flag, disch, place)], INFO)
    t = TaskConfig("m", "mortality", **task)
    return build_mortality(t, {"stays": stays, "mortality_info": info}).first()["label"]


def hours(h):
    return IN + timedelta(hours=h)


WINDOW = dict(observation_hours=48, gap_hours=6, prediction_hours=24)


@pytest.mark.parametrize(
    "at, want",
    [
        (10, None),      # inside the observation
        (48, 0),         # exactly at its end with a gap: in no window
        (50, None),      # inside the gap
        (54, 1),         # exactly at prediction start
        (60, 1),
        (78, 1),         # prediction end is inclusive
        (78.01, 0),      # after it
    ],
)
def test_windowed_exact_times(spark, at, want):
    assert label(spark, time=hours(at), flag=1, **WINDOW) == want


def test_no_gap_death_at_observation_end_is_positive(spark):
    assert label(spark, time=hours(48), flag=1, observation_hours=48, prediction_hours=24) == 1


@pytest.mark.parametrize(
    "day, want",
    [
        (date(2024, 1, 2), None),   # before the observation end
        (date(2024, 1, 3), None),   # straddles it
        (date(2024, 1, 4), None),   # straddles the prediction end
        (date(2024, 1, 5), 0),      # the first day after it
        (date(2024, 1, 8), 0),      # after all windows
    ],
)
def test_windowed_dates_are_conservative(spark, day, want):
    assert label(spark, day=day, flag=1, **WINDOW) == want


def test_windowed_date_inside_prediction(spark):
    got = label(spark, day=date(2024, 1, 4), flag=1, observation_hours=24, prediction_hours=96)
    assert got == 1


def test_survivor_and_unknown(spark):
    assert label(spark, flag=0, **WINDOW) == 0
    assert label(spark, **WINDOW) is None
    # death known, time unknown
    assert label(spark, flag=1, **WINDOW) is None


def test_discharge_time_stands_in_for_a_death_without_date(spark):
    assert label(spark, place=" Expired ", disch=hours(60), **WINDOW) == 1


def test_hospital_needs_hospital_evidence_for_dates(spark):
    kw = dict(day=date(2024, 1, 9), disch=datetime(2024, 1, 6), observation_hours=24)
    assert label(spark, flag=0, **kw) == 0      # post-discharge date of a survivor
    assert label(spark, flag=1, **kw) == 1
    assert label(spark, flag=None, **kw) is None
    early = dict(day=date(2024, 1, 5), disch=datetime(2024, 1, 6), observation_hours=24)
    assert label(spark, flag=None, **early) == 1
    # without observation the date counts as a death
    assert label(spark, flag=0, day=date(2024, 1, 9), disch=datetime(2024, 1, 6)) == 1


def test_unit_mortality(spark):
    kw = dict(prediction_hours=-1, outtime=datetime(2024, 1, 5, 8))
    assert label(spark, time=datetime(2024, 1, 5, 8), flag=1, **kw) == 1
    assert label(spark, time=datetime(2024, 1, 5, 9), flag=1, **kw) == 0
    assert label(spark, day=date(2024, 1, 5), flag=1, **kw) == 1
    assert label(spark, flag=1, **kw) is None
    assert label(spark, flag=0, **kw) == 0


def test_window_from_admission(spark):
    kw = dict(prediction_hours=36)  # ends 2024-01-03 00:00
    assert label(spark, time=hours(36), flag=1, **kw) == 1
    assert label(spark, time=hours(36.5), flag=1, **kw) == 0
    assert label(spark, day=date(2024, 1, 2), flag=1, **kw) == 1
    assert label(spark, day=date(2024, 1, 3), flag=1, **kw) is None
    assert label(spark, day=date(2024, 1, 4), flag=1, **kw) == 0


def test_until_discharge_window(spark):
    kw = dict(observation_hours=24, prediction_hours=-1, outtime=hours(100))
    assert label(spark, time=hours(100), flag=1, **kw) == 1
    assert label(spark, time=hours(101), flag=1, **kw) == 0


def test_missing_admission_times_are_refused(spark):
    with pytest.raises(ValueError, match="intime"):
        label(spark, flag=0, intime=None, **WINDOW)


def test_empty_cohort_is_typed(spark):
    t = TaskConfig("m", "mortality", **WINDOW)
    out = build_mortality(
        t, {"stays": spark.createDataFrame([], STAYS), "mortality_info": spark.createDataFrame([], INFO)}
    )
    assert out.dtypes == [("stay_id", "bigint"), ("label", "int")] and out.count() == 0


def test_legacy_frame_counts_datetimes_as_dates(spark):
    old = spark.createDataFrame([(1, datetime(2024, 1, 3)), (2, None)], "stay_id bigint, date_of_death timestamp")
    rows = {r["stay_id"]: r for r in complete_mortality(old).collect()}
    assert rows[1]["death_time_precision"] == "date" and rows[1]["death_date"] == date(2024, 1, 3)
    assert rows[2]["death_time_precision"] is None and rows[1]["death_time"] is None
