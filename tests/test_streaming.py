from datetime import datetime, timedelta

from cohortspark.config import ConceptRule
from cohortspark.streaming import binning
from cohortspark.streaming.binning import hourly_stream, run_to_folder

SCHEMA = "stay_id bigint, ts timestamp, event_id bigint, feature string, value double"
RULES = [ConceptRule("a", "mean"), ConceptRule("b", "last")]


def test_closed_hours_equal_the_batch_bins(spark, folder):
    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(minutes=20 * i), i, "ab"[i % 2], float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):  # three files, three micro-batches
        df.filter(f"event_id div 10 = {k}").coalesce(1).write.parquet(f"{folder}/in/part{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = run_to_folder(hourly_stream(stream, RULES, "1 hour"), f"{folder}/out", f"{folder}/ck")
    q.awaitTermination(120)
    got = {(r["hour_start"], r["feature"]): r["value"] for r in spark.read.parquet(f"{folder}/out").collect()}
    want = {}
    for _, ts, i, f, v in rows:
        want.setdefault((ts.replace(minute=0), f), []).append(v)
    assert len(got) >= 12
    for (h, f), v in got.items():
        w = want[(h, f)]
        assert v == (sum(w) / len(w) if f == "a" else w[-1])


def test_stream_and_batch_give_equal_rows_and_late_ones_are_counted(spark, folder):
    import random

    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rules = [ConceptRule(f, a) for f, a in zip("abcdefg", ("mean", "sum", "min", "max", "any", "first", "last"), strict=True)]
    rows, late = [], []
    for i in range(240):
        ts = start + timedelta(minutes=4 * i + rng.randint(-50, 0), seconds=rng.randint(0, 59))
        rows.append((i % 3, ts, i, rng.choice("abcdefgx"), rng.choice([None, 0.0, rng.random(), -2.5])))
    for k in range(4):  # four micro-batches; the last two hold events of hours long closed
        part = rows[60 * k : 60 * (k + 1)]
        if k >= 2:
            late += [(k, start + timedelta(minutes=10 + k), 1000 + k, "a", 7.0)]
            part = part + late[-1:]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part{k}")
    key, provider = binning.STATE_STORE
    spark.conf.set(key, provider)
    try:
        def run():
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
            q = run_to_folder(binning.hourly_states(stream, rules, "1 hour"), f"{folder}/out", f"{folder}/ck")
            assert q.awaitTermination(200)
            return spark.read.parquet(f"{folder}/out")

        before = run().filter("not late").count()
        events = spark.createDataFrame(rows, SCHEMA)
        want = {tuple(r) for r in binning.batch_rows(events, rules).collect()}
        assert before < len(want)  # the last hours are open
        binning.write_flush(spark, events, f"{folder}/in/flush", max(r[1] for r in rows), timedelta(hours=1))
        got = run()
    finally:
        spark.conf.unset(key)
    closed = [(r.stay_id, r.hour_start, r.feature, r.value, r.n) for r in got.filter("not late").collect()]
    near = lambda rs: sorted((a, b, c, None if v is None else round(v, 9), n) for a, b, c, v, n in rs)
    assert sorted(set(near(want)) - set(near(closed))) == sorted(set(near(closed)) - set(near(want))) == []
    assert near(closed) == near(want) and len(closed) == len(set(closed))
    assert sorted((r.stay_id, r.event_id, r.value) for r in got.filter("late").collect()) == [(k, i, v) for k, _, i, _, v in late]
