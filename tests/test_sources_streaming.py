import base64
import json

from pyspark.sql import functions as F

from eventloom.plans import report as rp
from eventloom.sources import envelope as ev
from eventloom.sources import normalize as nz
from eventloom.sources import sinks
from eventloom.streaming import events as st


def line(**more):
    e = {"v": 1, "seq": 1, "ts": "2026-01-01T00:00:00.000Z", "type": "chat", "server_session": "s", "round": "", "data": {}} | more
    return ev.PREFIX + json.dumps(e, ensure_ascii=False)


def b64(text):
    return base64.b64encode(text.encode()).decode()


def test_spool_keeps_unicode_and_isolates_bad_values(spark):
    good = line(data={"message": "zażółć ☃"})
    text = f"string[]|slot_0|{b64(good)}|a===|" + r"\0\0|"
    got = ev.decode_spool(spark.createDataFrame([(text,), ("other",)], "value string")).collect()
    assert [(r.value, r.raw == "a===") for r in got] == [(good, False), (None, True)]


def test_validation_errors(spark):
    rows = [line(), "x", ev.PREFIX + "{", line(v=2), line(seq=0), line(type=""), line(seq=True), ev.PREFIX + '{"v":1}', line(data=[1])]
    got = [r.error for r in ev.parse_envelopes(spark.createDataFrame([(r,) for r in rows], "value string")).collect()]
    assert got[0] is None and all(got[1:]) and got[1] == "prefix mismatch"
    sound, dead = ev.split_dead_letters(ev.parse_envelopes(spark.createDataFrame([(rows[0],), ("y" * 999,)], "value string")))
    assert sound.count() == 1 and len(dead.first().head) == 256


def bronze(spark, *lines):
    return ev.to_events(ev.split_dead_letters(ev.parse_envelopes(spark.createDataFrame([(x,) for x in lines], "value string")))[0])


def test_hits_are_normalised(spark):
    melee = line(seq=1, type="melee_action", data={"attacker_session_id": "k", "weapon": "BAT", "hits": [{"victim_session_id": "a", "damage": 1}, {"victim_session_id": "b", "damage": 2}]})
    shot = line(seq=2, type="projectile_hit", player="c", data={"attacker_session_id": "k", "weapon": "UZI", "damage": 3})
    got = nz.combat_hits(bronze(spark, melee, shot)).orderBy("seq", "nth").collect()
    assert [(r.victim_id, r.hit_type, r.weapon, r.is_player) for r in got] == [("a", "Melee", "BAT", True), ("b", "Melee", "BAT", True), ("c", "Projectile", "UZI", True)]


def test_scene_tables(spark):
    batch = line(seq=1, round="r", type="scene_frame_batch", game_ms=5, data={"objects": [{"object_id": 3, "x": 1}, {"instance_id": 4, "kind": "projectile", "game_ms": 7}, {"object_id": "no"}]})
    end = line(seq=2, round="r", type="object_terminated", data={"object_id": 3, "name": "Crate"})
    kick = line(seq=3, round="r", type="melee_action", data={"attacker_session_id": "k", "action": "kick", "hits": [{"object_id": 3, "is_player": False}]})
    window = line(seq=4, round="r", type="scene_window_complete", data={})
    b = bronze(spark, batch, end, kick, window)
    assert sorted(r.game_ms for r in nz.scene_samples(b).collect()) == [5.0, 7.0]
    entity = nz.scene_entities(b).where("engine_id = '3'").first()
    assert (entity.name, entity.created_id, entity.terminated_id) == ("Crate", 1, 2)
    hit = nz.scene_interactions(b).first()
    assert (hit.interaction, hit.player, hit.target_id) == ("player_kick_object", "k", entity.entity_id)
    assert tuple(nz.scene_windows(b).first())[3:] == ("unknown", 0.0)


def test_profiles_and_state_windows(spark):
    b = bronze(spark, line(seq=1, type="user_join", player="p", data={"profile": "{}"}), line(seq=2, type="user_join", player="p", data={"profile": '{"a":1}'}), line(seq=3, type="state_window", player="p", data={"samples": [{"x": 1}, {"x": 2}]}))
    assert [r.seq for r in nz.profiles(b).collect()] == [2]
    assert [r.x for r in nz.state_windows(b).orderBy("nth").collect()] == [1.0, 2.0]


def test_day_upsert_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    day = lambda d, v: spark.createDataFrame([(d, v)], "report_date string, v int")
    sinks.upsert_days(day("2026-01-01", 1).unionByName(day("2026-01-02", 1)), path)
    for _ in range(2):
        sinks.upsert_days(day("2026-01-02", 2), path)
    assert sorted((str(r.report_date), r.v) for r in spark.read.parquet(path).collect()) == [("2026-01-01", 1), ("2026-01-02", 2)]


def test_reports_refuse_raw_chat(spark):
    chat = spark.createDataFrame([("2026-01-01", "hi")], "report_date string, message string")
    try:
        sinks.day_reports(chat, "report_date", {"chat": chat})
    except ValueError:
        return
    raise AssertionError("raw chat went into a report")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i * 7_000_000, ["player_death", "chat"][i % 2], float(i), "s", f"r{i % 2}", i + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, t_us long, event_type string, value double, server string, round_id string, seq long")
    df.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = lambda: st.event_source(spark, f"{tmp_path}/events", 1)
    out = st.drain(st.window_totals(st.with_event_time(stream(), "t_us"), ["event_type"], "value"), f"{tmp_path}/a", f"{tmp_path}/ca", "update")
    assert sorted(map(tuple, st.latest_per_key(out, ["start_us", "event_type"]).collect())) == sorted(map(tuple, st.batch_totals(df, ["event_type"], "value").collect()))
    one = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/events")
    got = st.drain(st.promote_episodes(one, 20_000, 3, ("player_death",)), f"{tmp_path}/b", f"{tmp_path}/cb")
    want = st.promote_episodes_batch(df, 20_000, 3, ("player_death",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 3


def test_summary_has_shown_and_total(spark):
    pings = spark.createDataFrame([(i, i % 3, i * 1_000_000, float(i)) for i in range(9)], "sample_id long, session_id long, t_us long, ping double")
    fights = spark.createDataFrame([(1, 0, "r", "player_damage", 1, 2, 3.0, "w", 1.0)], "event_id long, t_us long, round_id string, event_type string, attacker_id int, victim_id int, damage double, weapon string, distance double")
    results = rp.recompute({"network_samples": pings, "combat_events": fights}, "1970-01-01", "1970-01-02")
    report = json.loads(rp.summaries(results, 2).first().report)
    assert [r["total"] for r in report["network"]] == [3, 3] and report["schema_version"] == 1


def test_live_summary(spark):
    pings = spark.createDataFrame([(1, 7, 0), (2, 8, 500_000_000)], "sample_id long, session_id long, t_us long")
    sessions = spark.createDataFrame([(7, 1, False)], "session_id long, identity_id long, is_bot boolean")
    row = rp.live_summary(pings, sessions, pings, 1, 10**9).first()
    assert (row.sessions, row.unmapped, row.incidents) == (2, 1, "unmapped_sessions,backlog")
    assert F is not None
