from eventloom.operators import combat as c
from eventloom.operators import sessions as se

S = 1_000_000
SESSION = "session_id long, identity_id long, joined_us long, left_us long, is_bot boolean, reason string"


def test_visits_stitch_and_censor(spark):
    rows = [(1, 9, 0, 100 * S, False, "x"), (2, 9, 150 * S, 160 * S, False, "x"), (3, 9, 10 * S, 20 * S, False, "x"), (4, 9, 900 * S, None, False, None)]
    got = se.stitch_visits(spark.createDataFrame(rows, SESSION), 120, 0, 1000 * S).orderBy("visit").collect()
    assert [(r.start_us, r.end_us, r.sessions, r.censored) for r in got] == [(0, 160 * S, 3, False), (900 * S, 1000 * S, 1, True)]


def test_day_bounds_on_clock_change(spark):
    row = se.day_bounds(spark.sql("select date '2026-03-29' as d"), "d", "Europe/Warsaw").first()
    assert (row.end_us - row.start_us) / 3600 / S == 23


def test_leave_context(spark):
    sessions = spark.createDataFrame([(1, 1, 0, 100 * S, False, "x"), (2, 2, 0, None, False, None), (3, 3, 0, 50 * S, False, "x")], SESSION)
    deaths = spark.createDataFrame([(1, 80 * S, 5), (1, 120 * S, 6), (3, 5 * S, 7)], "session_id long, t_us long, event_id long")
    pings = spark.createDataFrame([(1, 90 * S, 1, 200.0), (1, 90 * S, 2, 160.0)], "session_id long, t_us long, sample_id long, ping double")
    got = {r.session_id: r for r in se.leave_context(sessions, deaths, pings).collect()}
    assert set(got) == {1, 3}
    assert (got[1].last_death_us, got[1].death_within_10s, got[1].death_within_30s, got[1].last_ping, got[1].high_ping) == (80 * S, False, True, 160.0, True)
    assert (got[3].death_within_30s, got[3].death_within_60s, got[3].last_ping, got[3].high_ping) == (False, True, None, False)


COMBAT = "event_id long, t_us long, round_id string, event_type string, attacker_id int, victim_id int, damage double, weapon string, distance double"


def combat(spark, rows):
    return spark.createDataFrame([(i, int(t * S), r, k, a, v, d, "w", 1.0) for i, (t, r, k, a, v, d) in enumerate(rows)], COMBAT)


def test_killer_and_assist(spark):
    rows = [(10, "r", "player_damage", 1, 9, 60.0), (15.5, "r", "player_damage", 2, 9, 20.0), (16, "r", "player_death", None, 9, None)]
    row = c.attribute_deaths(combat(spark, rows)).first()
    assert (row.killer_id, row.confidence, row.assists) == (2, "high", [1])


def test_stale_other_round_and_self_hits_are_unattributed(spark):
    rows = [(10, "r", "player_damage", 1, 9, 60.0), (14, "r", "player_death", None, 9, None), (20, "q", "player_damage", 1, 8, 5.0), (20.2, "r", "player_death", None, 8, None), (30, "r", "player_damage", 7, 7, 5.0), (30.2, "r", "player_death", None, 7, None)]
    assert {r.confidence for r in c.attribute_deaths(combat(spark, rows)).collect()} == {"unattributed"}


def test_hits_match_a_naive_join(spark):
    import random

    rnd = random.Random(4)
    rows = [(rnd.randrange(0, 60) / 2, rnd.choice("ab"), rnd.choice(["player_damage", "player_death"]), rnd.randrange(3), rnd.randrange(3), 1.0) for _ in range(120)]
    df = combat(spark, rows)
    want = set()
    for i, (t, r, k, _, v, _) in enumerate(rows):
        for j, (u, q, h, a, w, _) in enumerate(rows):
            if k == "player_death" and h == "player_damage" and v == w and r == q and a != w and (u, j) < (t, i) and t - u <= 8:
                want.add((i, j))
    assert {(r.death_id, r.event_id) for r in c.hits_before_deaths(df).collect()} == want


def test_undirected_pairs_add_both_directions(spark):
    rows = [(1, "r", "player_damage", 1, 2, 3.0), (2, "r", "player_damage", 2, 1, 4.0), (3, "r", "player_damage", 1, 1, 9.0)]
    got = c.undirected_pairs(c.directed_pairs(combat(spark, rows))).collect()
    assert [tuple(r) for r in got] == [(1, 2, 7.0, 2)]
