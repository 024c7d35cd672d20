from pyspark.sql import functions as F

from eventloom.operators import quality as q
from eventloom.operators import timeseries as ts

S = 1_000_000


def pings(spark, values, step_s=5):
    return spark.createDataFrame([("a", i * step_s * S, i, float(v)) for i, v in enumerate(values)], "session_id string, t_us long, sample_id long, ping double")


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0)], "v double")
    assert df.agg(*ts.percentiles(F.col("v"), [0.5], ["p"])).first().p == 2.5


def test_ping_spikes_and_time_above(spark):
    row = ts.ping_metrics(pings(spark, [90, 160, 160]), "session_id", "t_us", "sample_id", "ping").first()
    assert (row.samples, row.spikes_50, row.seconds_above_100, row.longest_high) == (3, 1, 5.0, 5.0)


def test_pooled_percentiles_do_not_cross_sessions(spark):
    rows = [("a", "p", 0, 1, 100.0), ("a", "p", 5 * S, 2, 150.0), ("b", "p", 6 * S, 3, 200.0), ("b", "p", 9 * S, 4, 250.0)]
    df = spark.createDataFrame(rows, "session_id string, player string, t_us long, sample_id long, ping double")
    row = ts.ping_metrics(df, "session_id", "t_us", "sample_id", "ping", group="player").first()
    assert (row.samples, row.p50, row.session_count, row.jitter) == (4, 175.0, 2, 50.0)
    assert round(row.p95, 9) == 242.5


def test_ranked_percentiles_agree(spark):
    df = pings(spark, [5, 1, 9, 9, 2, 7])
    a = ts.ranked_percentiles(df, "session_id", "ping", "sample_id").first()
    b = ts.ping_metrics(df, "session_id", "t_us", "sample_id", "ping").first()
    assert [round(a[k], 9) for k in ("p50", "p90", "p95", "p99")] == [round(b[k], 9) for k in ("p50", "p90", "p95", "p99")]


def test_movement_of_three_four_five(spark):
    rows = [("a", 0.0, 1, 0.0, 0.0, False), ("a", 1000.0, 2, 3.0, 4.0, False), ("a", 2000.0, 3, 3.0, 4.0, True), ("b", 0.0, 4, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "s string, game_ms double, sample_id long, x double, y double, airborne boolean")
    got = {r.s: r for r in ts.movement(df, ["s"], "game_ms", "sample_id").collect()}
    assert (got["a"].distance, got["a"].static_seconds, got["a"].max_speed, got["a"].airtime) == (5.0, 1.0, 5.0, 1.0)
    assert (got["b"].distance, got["b"].coverage) == (0.0, 0.0)


def test_direction_switch_uses_last_heading(spark):
    rows = [("a", float(i * 1000), i, x, 0.0, False) for i, x in enumerate([0.0, 1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "s string, game_ms double, sample_id long, x double, y double, airborne boolean")
    assert ts.movement(df, ["s"], "game_ms", "sample_id").first().direction_switches == 1


def test_counter_delta(spark):
    df = spark.createDataFrame([("a", 1, 1, 2.0), ("a", 2, 2, 7.0), ("b", 1, 3, 1.0)], "s string, t long, i long, shots double")
    assert [(r.s, r.shots) for r in ts.counter_deltas(df, "s", "t", "i", ["shots"]).collect()] == [("a", 5.0)]


def test_bursts_at_one_instant(spark):
    df = spark.createDataFrame([("a", 7 * S, i, "Pressed") for i in range(5)], "s string, t long, i long, transition string")
    row = ts.input_bursts(df, "s", "t", "i").first()
    assert (row.events, row.transitions, row.bursts) == (5, 5, 1)


def test_missing_values(spark):
    df = spark.createDataFrame([("x",), ("1.5",), (None,), ("NaN",), ("Infinity",)], "v string")
    assert [r.f for r in df.select(ts.finite(F.col("v")).alias("f")).collect()] == [0.0, 1.5, 0.0, 0.0, 0.0]


def test_gaps_after_restart(spark):
    df = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2), ("s", 5)], "server string, seq long")
    assert [tuple(r) for r in q.sequence_gaps(df, "server", "seq").collect()] == [("s", 3, 5, 2)]
    cov = q.source_coverage(df, "server", "seq").first()
    assert (cov.event_count, cov.missing, cov.source_coverage) == (3, 2, 0.6)


def test_fresh_only_forms(spark):
    new = spark.createDataFrame([("s", 2), ("s", 3), ("s", 6)], "server string, seq long")
    done = spark.createDataFrame([("s", 2), ("s", 5)], "server string, seq long")
    assert sorted(r.seq for r in q.fresh_only(new, done, "server", "seq").collect()) == [3, 6]
    assert [r.seq for r in q.fresh_only(new, done, "server", "seq", high_water=True).collect()] == [6]


def test_population_counts_identities(spark):
    rows = [(1, "a", False), (2, "a", False), (3, "b", False), (4, None, False), (5, "c", True), (6, None, True), (7, None, True)]
    row = q.population(spark.createDataFrame(rows, "session_id long, identity_id string, is_bot boolean")).first()
    assert (row.human_sessions, row.bot_sessions, row.human_identities, row.bot_identities, row.null_sessions, row.player_entities) == (4, 3, 2, 1, 3, 6)
    assert (row.human_coverage, round(row.bot_coverage, 6)) == (0.75, 0.333333)


def test_freshness_states(spark):
    df = spark.createDataFrame([(1, 0), (2, 200 * S)], "i long, t long")
    assert q.freshness(df, "i", "t", 2, 300 * S).first().idle_s == 100.0
    assert q.freshness(df, "i", "t", 1, 300 * S).first().state == "behind"
