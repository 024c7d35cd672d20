"""Exact ranks and percentiles against sorted lists, on ties, nulls, skew and forced sketches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import anomaly as an
from eventloom.operators.ranks import exact_percentiles, with_cohort_percentiles


def interpolated(values, q):
    v = sorted(values)
    at = (len(v) - 1) * q
    low, high = v[math.floor(at)], v[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def table(spark, seed=1, n=3000):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, 7.0, 7.0, float(rnd.randrange(40)), rnd.random() * 100, -rnd.random()])
    # one key has most rows, one a single row, one nothing but nulls
    rows = [(rnd.choice(["hot"] * 8 + ["b", None]), value()) for _ in range(n)] + [("one", 3.5), ("none", None), ("same", 2.0), ("same", 2.0)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"accuracy": 50, "few": 10}])
def test_percentiles_by_counting(spark, sizes):
    rows, df = table(spark)
    shares, names = [0.0, 0.5, 0.9, 0.99, 1.0], ["a", "b", "c", "d", "e"]
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", shares, names, **sizes).collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert got[k].n == len(values)
        assert [got[k][n] for n in names] == pytest.approx([interpolated(values, q) for q in shares], abs=1e-9)
    whole = exact_percentiles(df, [], F.col("v"), [0.5], ["m"], **sizes).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(interpolated([v for _, v in rows if v is not None], 0.5))
    assert exact_percentiles(df.limit(0), ["k"], "v", [0.5], ["m"]).count() == 0


def test_few_values_reach_the_last_sort(spark):
    """Without a key the last ranks are found in one task, but only among the values between the sketch's bounds."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    plan = exact_percentiles(df, [], "v", [0.5], ["m"], accuracy=1000, few=1000)
    values = sorted(r.v for r in df.collect())
    assert plan.first().m == interpolated(values, 0.5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in text


def test_robust_z_of_skewed_groups(spark):
    rows, df = table(spark, 2, 500)
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    for r in an.robust_z(df, "v", ["k"]).collect():
        values = [v for v in by[r.k] if v is not None]
        if r.v is None or len(values) < 3:
            assert r.robust_z is None
            continue
        med = interpolated(values, 0.5)
        mad = interpolated([abs(v - med) for v in values], 0.5)
        assert r.robust_z == pytest.approx(0.6745 * (r.v - med) / mad if mad else 0.0)
    assert an.robust_z(df, "v").count() == len(rows)


@pytest.mark.parametrize("ranges", [2, 200])
def test_cohort_percentiles(spark, ranges):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 1.0, 1.0, float(rnd.randrange(9))]), float(rnd.randrange(1000)), 5.0) for i in range(700)]
    got = {r.i: r for r in with_cohort_percentiles(spark.createDataFrame(rows, "i long, a double, b double, c double").repartition(3), "i", ["a", "b", "c"], ranges).collect()}
    least = -math.inf
    for i, *values in rows:
        for name, k, v in zip("abc", range(3), values, strict=True):
            share = sum((least if r[1 + k] is None else r[1 + k]) <= (least if v is None else v) for r in rows) / len(rows)
            assert got[i][f"{name}_percentile"] == pytest.approx(100 * share)


def test_style_profiles_rank_without_one_task(spark):
    rates = spark.createDataFrame([(i, i % 15, float(i % 7), float(i)) for i in range(60)], "player_id long, sessions long, offense double, defense double")
    out = an.style_profiles(rates, "player_id", "sessions", ["offense", "defense"])
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text.replace("Exchange SinglePartition, ENSURE_REQUIREMENTS", "", 1)  # the one-row count
    by = {r.player_id: r for r in out.collect()}
    assert by[59].defense_percentile == 100.0 and by[6].offense_percentile == 100.0 and by[9].published is False and by[10].published is True
    single = an.style_profiles(rates.limit(1), "player_id", "sessions", ["offense"]).first()
    assert single.offense_percentile is None
