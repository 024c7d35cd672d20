"""Queries over whole tables, against brute force on small ones."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from eventloom.operators import annotate as an
from eventloom.streaming import events as st


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_episodes_of_every_death(spark, tmp_path):
    hour = 3_600_000_000
    rows = [(i, i * 1_000_000, ("error", "click")[i % 650 > 0]) for i in range(1300)] + [(5001, 5 * hour, "error"), (5002, 5 * hour + hour // 2, "view"), (5003, 5 * hour + hour // 2 + 1000, "view")]
    df = spark.createDataFrame(rows, "event_id long, t long, event_type string")
    df.selectExpr("event_id", "timestamp_micros(t) ts", "event_id % 3 user_id", "event_type", "1.0D value", "'{\"k\": 1}' props").write.parquet(f"{tmp_path}/events.parquet")
    want = set()
    for e, at, kind in rows:
        if kind == "error":
            near = sorted((t // 1000, i) for i, t, _ in rows if at // 1000 - 3_600_000 <= t // 1000 <= at // 1000 + 1_800_000)
            want |= {(e, n, i, float(t - at // 1000)) for n, (t, i) in enumerate(near[:1200], 1)}
    got = entry.queries()["jn09_all_episodes"](spark, str(tmp_path)).select("episode_id", "nth", "sample_id", "offset_ms").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) == 2402


def test_active_identities_by_date(spark, tmp_path):
    days = [(1, 10, "F", "1998-06-01 00:00:00"), (2, 20, "F", "1998-06-02 00:00:00"), (3, 30, "O", "1998-01-01 00:00:00"), (86400, 40, "F", "1998-05-31 00:00:00"), (101, 50, "F", "1995-01-01 00:00:00"), (14, 60, "F", "1998-06-01 00:00:00")]
    df = spark.createDataFrame([(*d, "p", 1.0) for d in days], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_orderpriority string, o_totalprice double")
    df.withColumn("o_orderdate", df["o_orderdate"].cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    assert entry.queries()["jn10_active_on_day"](spark, str(tmp_path)).first().n == 3  # 10, 30 (not left yet), 40


def test_cover_holds_no_set(spark):
    expected = [("a", 1), ("a", 2), ("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", None), ("f", None), (None, 1), ("g", 1), ("g", None)]
    answers = [("a", 2), ("a", 1), ("b", 1), ("b", 2), ("d", 2), ("e", None), (None, 1), ("x", 1), ("g", 1), ("g", 1)]
    df = lambda rows: spark.createDataFrame(rows, "r string, i long")
    got = an.exact_cover(df(answers), df(expected), "r", "i")
    assert {r.r: r.covers for r in got.collect()} == {"a": True, "b": False, "c": False, "d": False, "e": True, "f": False, None: False, "g": True}
    assert "collect_set" not in plan(got)


def test_greedy_admission_streams(spark, small_batches):
    rnd = random.Random(1)
    rows = [(rnd.choice(["p", "q", None]), i, rnd.randrange(1, 30), rnd.randrange(1, 30)) for i in range(200)]
    want, sums = {}, {}
    for q, i, t, b in rows:
        used = sums.setdefault(q, [0, 0, 0])
        want[i] = used[0] < 25 and used[1] + t <= 200 and used[2] + b <= 210
        if want[i]:
            sums[q] = [used[0] + 1, used[1] + t, used[2] + b]
    rnd.shuffle(rows)
    got = an.admit_greedy(spark.createDataFrame(rows, "q string, i long, t long, b long").repartition(3), "q", "i", "t", "b", 25, 200, 210)
    assert {r.i: r.admitted for r in got.collect()} == want
    assert "FlatMapGroupsInPandas" not in plan(got) and "MapInPandas" in plan(got)


def test_batch_episodes_stream(spark, small_batches):
    rnd = random.Random(2)
    rows = [(rnd.choice(["s", "t"]), rnd.choice(["r", None]), i, rnd.randrange(100) * 1000, rnd.choice(["error", "view"])) for i in range(150)]
    want, state = [], {}
    for server, rnd_id, i, t, kind in sorted(rows, key=lambda r: (r[3], r[2])):
        last, ring = state.get((server, rnd_id), (None, []))
        if kind == "error" and (last is None or t - last >= 10_000):
            want.append((server, rnd_id, i, t, ring))
            last = t
        state[server, rnd_id] = (last, [*ring, i][-4:])
    rnd.shuffle(rows)
    got = st.promote_episodes_batch(spark.createDataFrame(rows, "server string, round_id string, event_id long, t_us long, event_type string"), 10, 4, ("error",))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "FlatMapGroupsInPandas" not in plan(got) and "MapInPandas" in plan(got)


def test_gaps_travel_as_ranges(spark, tmp_path, small_batches):
    rnd = random.Random(3)
    seqs = {q: [v for v in range(1, 300) if rnd.random() < 0.8] for q in ("a", "b")}
    rows = [(q, v) for q in seqs for v in seqs[q] for _ in range(rnd.choice([1, 2]))]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "server string, seq long").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = st.sequence_gaps(spark.readStream.schema("server string, seq long").parquet(f"{tmp_path}/in"))
    got = st.drain(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()
    want = {(q, a + 1, b, b - a - 1) for q in seqs for a, b in zip([0, *seqs[q]], seqs[q]) if b > a + 1}
    assert set(map(tuple, got)) == want and len(got) == len(want)
    lo, hi = st._merged(np.array([5, 1, 2, 9]), np.array([7, 1, 4, 9]))
    assert (lo.tolist(), hi.tolist()) == ([1, 9], [7, 9])
