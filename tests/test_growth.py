"""What a step moves grows with its input: plans without an exchange of matches, and results on dense tables."""

import random
import re
import time

from pyspark.sql import functions as F

from eventloom.operators import combat as cb
from eventloom.operators import scene as sc
from eventloom.operators import sessions as se
from eventloom.queries import catalog
from eventloom.sources import envelope as ev


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def matches_stay(df):
    """Whether no exchange lies above the topmost join."""
    text = plan(df)
    return "Join" in text.split("Exchange")[0]


def dense(spark, n=60, seed=3):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, *range(20)])) for i in range(n)]
    episodes = [(1000 + i, rnd.choice(["a", "b", None]), rnd.choice([None, *range(25)])) for i in range(12)]
    return rows, episodes, spark.createDataFrame(rows, "row long, round string, t long"), spark.createDataFrame(episodes, "episode_id long, round string, at long")


def test_episodes_take_their_limit_before_the_join(spark):
    rows, episodes, r, e = dense(spark)
    for limit in (1, 3, 500):
        out = sc.assemble_episodes(e, r, ["round"], "at", "t", "row", -4.0, 2.0, limit)
        want = []
        for i, k, at in episodes:
            near = sorted((t, n) for n, rk, t in rows if None not in (k, at, t) and rk == k and at - 4 <= t <= at + 2)
            want += [(i, j + 1, n, t - at) for j, (t, n) in enumerate(near[:limit])]
        assert sorted(tuple(x) for x in out.collect()) == sorted(want)
    assert matches_stay(sc.assemble_episodes(e, r, ["round"], "at", "t", "row", -4.0, 2.0, 3))


def test_unlimited_sources_are_numbered_without_moving_matches(spark):
    rows, episodes, r, e = dense(spark)
    source = sc.EpisodeSource(r.withColumnRenamed("t", "at"), "row", ["at"], None)
    out = sc.whole_episodes(e, {"s": source}, "round", "at", None, "at", -4.0, 2.0)
    want = []
    for i, k, at in episodes:
        near = sorted((t, n) for n, rk, t in rows if None not in (k, at, t) and rk == k and at - 4 <= t <= at + 2)
        want += [(i, j + 1, n) for j, (t, n) in enumerate(near)]
    assert sorted((x.episode_id, x.nth, x.row_id) for x in out.collect()) == sorted(want)
    assert matches_stay(out)


def test_blocks_widen_with_the_windows(spark):
    """Blocks of any width give the same matches; 500 windows of 4,000 rows move as 9 rows each, not as 63."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice("ab"), int(rnd.gauss(50, 15))) for i in range(900)]
    episodes = [(1000 + i, rnd.choice("abc"), rnd.randrange(100)) for i in range(20)]
    r, e = spark.createDataFrame(rows, "row long, round string, at long"), spark.createDataFrame(episodes, "episode_id long, round string, at long")
    want = {(i, n): [q for _, q in sorted((t, q) for q, k, t in rows if k == g and at - 20 <= t <= at + 10)][:n] for i, g, at in episodes for n in (150, None)}
    sources = {f"{n}": sc.EpisodeSource(r, "row", ["at"], n) for n in (150, None)}
    for cells in (1, 64):
        got = sc.whole_episodes(e, sources, "round", "at", None, "at", -20.0, 10.0, cells).orderBy("nth").collect()
        assert {(i, n): [x.row_id for x in got if (x.episode_id, x.source) == (i, f"{n}")] for i, n in want} == want
        assert [x.nth for x in got] == sorted(j + 1 for found in want.values() for j in range(len(found)))

    def written():
        time.sleep(1)
        context, jvm = spark.sparkContext._jsc.sc(), spark._jvm
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    dense = spark.range(4000).selectExpr("id as row", "'r' as round", "id as at").localCheckpoint()
    windows = spark.range(500).selectExpr("id as episode_id", "'r' as round", "2000 + id as at").localCheckpoint()
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sc.whole_episodes(windows, {"s": sc.EpisodeSource(dense, "row", ["at"], None)}, "round", "at", None, "at", -5000.0, 5000.0).count() == 2_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written() - before < 20_000


def test_attribution_moves_no_matches(spark):
    """200 deaths with 400 hits each by different attackers: 80,000 matches, of which none is exchanged."""
    hits = spark.range(400).selectExpr("id as event_id", "id * 1000 as t_us", "'r' as round_id", "'player_damage' as event_type", "id + 10 as attacker_id", "5 as victim_id", "1.0D as damage")
    deaths = spark.range(200).selectExpr("id + 1000 as event_id", "500000 + id as t_us", "'r'", "'player_death'", "0L", "5", "cast(null as double)")
    combat = hits.union(deaths).localCheckpoint()

    def written():
        time.sleep(1)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    out = cb.attribute_deaths(combat).collect()
    assert {(r.killer_id, r.confidence, tuple(r.assists)) for r in out} == {(409, "low", ())} and len(out) == 200
    assert written() - before < 100_000


def write_events(spark, path, rows, files):
    """Events (id, user, k, value) dealt to files by turns, so that partial sums meet in another order than ids."""
    df = spark.createDataFrame(rows, "event_id long, user_id long, k int, value double")
    df = df.selectExpr("event_id", "timestamp_micros(1704067200000000 + event_id) as ts", "user_id", "'click' as event_type", "value", "concat('{\"k\": ', k, '}') as props")
    for i in range(files):
        df.where(f"event_id % {files} = {i}").coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")


def test_limits_see_sums_by_event_id(spark, tmp_path):
    """By id the values add up to 100.00000000000001 or to 100; by files, to the other one for some pairs."""
    rnd, rows, want = random.Random(5), [], set()
    for user in range(400):
        cents = [rnd.randrange(1, 2500) for _ in range(7)]
        values = [c / 100 for c in cents] + [(10_000 - sum(cents)) / 100]
        total = 0.0
        for n, v in enumerate(values):
            rows.append((user * 8 + n, user, 7, v))
            total += v
        if total > 100:
            want.add(user)
    write_events(spark, tmp_path, rows, 3)
    assert {r.attacker_id for r in catalog.QUERIES["agg26_combat_pairs"](spark, str(tmp_path)).collect()} == want and 0 < len(want) < 400


def test_copies_of_a_player_tie(spark, tmp_path):
    """Copies of a player have one rate, whatever files and tasks their events come from."""
    rnd = random.Random(6)
    base = [[rnd.randrange(1, 30_000) / 100 for _ in range(30)] for _ in range(21)]
    rows = [((c * 21 + u) * 31 + n, c * 21 + u, 7, v) for c in range(6) for u, vs in enumerate(base) for n, v in enumerate(vs)]
    write_events(spark, tmp_path, rows, 4)
    got = {r.player_id: r.damage_rate_percentile for r in catalog.QUERIES["agg33_style_profiles"](spark, str(tmp_path)).collect()}
    assert all(got[c * 21 + u] == got[u] for c in range(6) for u in range(21)) and len(set(got.values())) == 21


def test_round_metrics_hold_no_table_of_sessions(spark):
    """Sessions and identities of a round are counted along one sort; only rounds are aggregated."""
    rnd = random.Random(7)
    sessions = [(i, rnd.choice([None, *range(6)]), rnd.random() < 0.3) for i in range(25)]
    players = list({(rnd.choice([1, 2, 3, None]), rnd.choice([None, *range(30)]), rnd.random() < 0.5) for _ in range(150)})
    of = {i: (identity, bot) for i, identity, bot in sessions}
    want = []
    for r in (1, 2, 3, 4):
        mine = [(s, late, *of.get(s, (None, None))) for q, s, late in players if q == r]
        who = {(identity, bot) for _, _, identity, bot in mine if identity is not None}
        want.append((r, len({s for s, *_ in mine if s is not None}), sum(not b for _, b in who), sum(b for _, b in who), len({s for s, _, identity, _ in mine if s is not None and identity is None}), sum(late for _, late, *_ in mine)))
    rounds = spark.createDataFrame([(r, 8, 1.0, None) for r in (1, 2, 3, 4)], "round_id long, player_count int, duration_ms double, result_source string")
    got = se.round_metrics(rounds, spark.createDataFrame(players, "round_id long, session_id long, late_join boolean"), spark.createDataFrame(sessions, "session_id long, identity_id long, is_bot boolean"))
    assert sorted(tuple(x)[:1] + tuple(x)[2:7] for x in got.collect()) == want
    assert not re.search(r"keys=\[[^\]]*(session_id|identity_id)", plan(got))


def test_lines_are_parsed_once(spark):
    """A filter on an envelope's error or fields doesn't parse the line again; odd lines keep their errors."""
    head = '{"v":1,"seq":%s,"ts":"2024-01-01T00:00:00.000Z","type":"a","server_session":"s","round":"","data":%s}'
    lines = [None, "", "x", ev.PREFIX, ev.PREFIX + "{", *(ev.PREFIX + head % p for p in ((1, "{}"), (2, "[1]"), (3, "null"), (4, "3"), (0, "{}"), ('"q"', "{}")))]
    parsed = ev.parse_envelopes(spark.createDataFrame([(x,) for x in lines], "value string").localCheckpoint())
    sound, bad = ev.split_dead_letters(parsed)
    for part in (sound, bad, sound.where("seq > 0 and type = 'a'").select("seq")):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r.seq for r in sound.collect()] == [1] and bad.count() == len(lines) - 1
    assert [r.error for r in parsed.collect()] == ["prefix mismatch"] * 3 + ["invalid JSON"] * 2 + [None, "invalid data", "invalid data", "invalid data", "unsupported version or sequence", "invalid JSON"]
