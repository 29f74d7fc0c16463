import math
import random

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import grid as GR
from cohortspark.operators import windows as WI

FE = ["hr", "sbp"]
SPARSE = "stay_id bigint, hour int, hr double, hr_mask boolean, sbp double, sbp_mask boolean"


def sparse(spark):
    return spark.createDataFrame(
        [
            (10, 0, 80.0, True, 120.0, True), (10, 2, 82.0, True, None, False),
            (10, 3, 99.0, False, 110.0, True),  # value hidden by its mask
            (20, 5, None, False, 130.0, True), (20, 9, 1.0, True, 1.0, True),  # hour 9 is too late
            (20, -1, 1.0, True, 1.0, True),
        ],
        SPARSE,
    )


def stays(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "stay_id bigint")


def test_dense_grid_equals_cell_loop(spark):
    rows = sparse(spark).collect()
    got = {r["stay_id"]: r for r in GR.dense_grid(sparse(spark), stays(spark, 10, 20, 30), FE, 6).collect()}
    assert set(got) == {10, 20, 30}
    for sid, r in got.items():
        for h in range(6):
            src = [x for x in rows if x["stay_id"] == sid and x["hour"] == h]
            for d, f in enumerate(FE):
                seen = bool(src) and src[0][f"{f}_mask"] and src[0][f] is not None
                assert r["mask"][h][d] == seen
                assert r["timeseries"][h][d] == (src[0][f] if seen else None)


def test_nan_form_missing_column_and_repeats(spark):
    g = GR.dense_grid(sparse(spark).drop("sbp", "sbp_mask"), stays(spark, 10), FE, 2, nan=True).first()
    assert math.isnan(g["timeseries"][0][1]) and g["mask"][0] == [True, False]
    twice = spark.createDataFrame([(1, 0, 5.0, 1), (1, 0, 6.0, 2)], "stay_id bigint, hour int, hr double, k int")
    g = GR.dense_grid(twice, stays(spark, 1), ["hr"], 1, order=["k"]).first()
    assert g["timeseries"] == [[6.0]]


def test_round_trip_resize_and_guard(spark):
    dense = GR.dense_grid(sparse(spark), stays(spark, 10, 20), FE, 6)
    long = GR.dense_to_long(dense, FE)
    assert long.count() == 2 * 6 * 2
    back = GR.long_to_dense(long, stays(spark, 10, 20), FE, 6)
    key = lambda df: sorted((r["stay_id"], str(r["timeseries"]), str(r["mask"])) for r in df.collect())
    assert key(back) == key(dense)
    r = GR.resize(dense, 8, 2).first()
    assert len(r["timeseries"]) == 8 and r["mask"][7] == [False, False]
    assert GR.resize(dense, 3, 2).select(F.size("mask").alias("n")).first()["n"] == 3
    GR.check_grid_size(GR.grid_rows(sparse(spark), stays(spark, 10, 20), FE, 6), stays(spark, 10, 20), 6)
    with pytest.raises(ValueError):
        GR.check_grid_size(sparse(spark), stays(spark, 10), 7)


def random_dense(spark, n=12, length=30, d=2, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        p = 0 if i == 0 else rnd.choice([0.05, 0.3, 0.8])
        mask = [[rnd.random() < p for _ in range(d)] for _ in range(length)]
        ts = [[rnd.uniform(0, 9) if m else None for m in row] for row in mask]
        rows.append((i, ts, mask))
    return spark.createDataFrame(rows, "stay_id bigint, timeseries array<array<double>>, mask array<array<boolean>>")


def test_windows_equal_loop(spark):
    dense = random_dense(spark)
    got = sorted((r["stay_id"], r["window_start"], r["window_idx"], str(r["timeseries"]))
                 for r in WI.sliding_windows(dense, 8, 3).collect())
    want = []
    for r in dense.collect():
        seen = [h for h in range(30) if any(r["mask"][h])]
        length = seen[-1] + 1 if seen else 0
        for s in range(0, 30 - 8 + 1, 3):
            if s < length:
                want.append((r["stay_id"], s, s // 3, str(r["timeseries"][s:s + 8])))
    assert got == sorted(want)


def test_window_errors_and_default_stride(spark):
    dense = random_dense(spark, n=3)
    with pytest.raises(ValueError):
        WI.sliding_windows(dense, 0)
    with pytest.raises(ValueError):
        WI.sliding_windows(dense, 4, 0)
    with pytest.raises(Exception, match="exceeds"):
        WI.sliding_windows(dense, 31).collect()
    starts = {r["window_start"] for r in WI.sliding_windows(dense, 10).collect()}
    assert starts <= {0, 5, 10, 15, 20}


def test_gaps_and_carry_forward(spark):
    rows = [(1, h, v, v is not None) for h, v in enumerate([None, 4.0, None, None, 6.0, None])]
    df = spark.createDataFrame(rows, "stay_id bigint, hour int, x double, x_mask boolean")
    got = [r["x_delta"] for r in WI.time_since_observed(df, ["x"]).orderBy("hour").collect()]
    want, prev = [0], 0
    for t in range(1, 6):
        prev = 1 if rows[t - 1][3] else prev + 1
        want.append(prev)
    assert got == want
    last = [r["x_last"] for r in WI.last_observed(df, ["x"], {"x": 9.0}).orderBy("hour").collect()]
    assert last == [9.0, 9.0, 4.0, 4.0, 4.0, 6.0]


def test_tabular_summary_equals_loop(spark):
    dense = random_dense(spark)
    rows = GR.dense_to_rows(dense, FE)
    got = {r["stay_id"]: r for r in WI.tabular_summary(rows, FE, 30).collect()}
    for r in dense.collect():
        for d, f in enumerate(FE):
            v = [row[d] for row, m in zip(r["timeseries"], r["mask"]) if m[d]]
            g = got[r["stay_id"]]
            mean = sum(v) / len(v) if v else 0.0
            std = math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)) if v else 0.0
            want = [mean, std, min(v, default=0), max(v, default=0), v[0] if v else 0, v[-1] if v else 0, len(v), len(v) / 30]
            have = [g[f"{f}__{s}"] for s in WI.SUMMARY_NAMES]
            assert have == pytest.approx(want)


def test_tokens_in_time_then_feature_order(spark):
    dense = GR.dense_grid(sparse(spark), stays(spark, 10, 30), FE, 6)
    got = {r["stay_id"]: r for r in WI.observed_tokens(dense, most=6).collect()}
    assert [tuple(t) for t in got[10]["tokens"][:4]] == [(0, 0, 80.0), (0, 1, 120.0), (2, 0, 82.0), (3, 1, 110.0)]
    assert got[10]["n_obs"] == 4 and len(got[10]["tokens"]) == 6 and got[30]["tokens"] == [None] * 6


def test_repeated_hours_keep_one_row(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 0, 7.0), (1, 2, 1.0)], "stay_id int, hour int, hr double")
    stays = spark.createDataFrame([(1,)], "stay_id int")
    for parts in (1, 8):
        got = GR.dense_grid(rows.repartition(parts), stays, ["hr"], 3).first()
        assert got["timeseries"] == [[7.0], [None], [1.0]] and got["mask"] == [[True], [False], [True]]
