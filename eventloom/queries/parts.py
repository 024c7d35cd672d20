"""Queries of operators that other queries use as parts, and of the whole-scene, review and ingest jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as an
from ..operators import anomaly as am
from ..operators import combat as cb
from ..operators import scene as sc
from ..operators import sessions as se
from ..operators import timeseries as ts
from ..plans import report as rp
from ..sources import envelope as ev
from ..sources import normalize as nz
from ..staging import checkpointed
from ..streaming import events as st
from .ingest import _OK, bronze
from .scene import _CAT, _OBJ, RULES
from .scene import assisted as assisted_movement
from .shapes import SQL, query
from .streaming import _folder, _stream
from .timeseries import rounded

START, END = 820_454_400_000_000, 823_132_800_000_000  # January 1996


@query("flt07_overlap_seconds", f"select session_id, greatest(0, least(coalesce(left_us, {END}), {END}) - greatest(joined_us, {START})) / 1e6 as seconds from player_sessions")
def overlap(s):
    return s.player_sessions.select("session_id", se.overlap_seconds(START, END).alias("seconds"))


@query(
    "win07_direction_switches",
    """with d as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy from state_samples window w as (partition by session_id, round_id order by game_ms, sample_id)),
g as (select *, last_value(case when dx <> 0 or dy <> 0 then {'x': dx, 'y': dy} end ignore nulls) over (partition by session_id, round_id order by game_ms, sample_id rows between unbounded preceding and 1 preceding) as h from d)
select session_id, round_id, count(*) filter (where dx * h.x + dy * h.y < 0) as direction_switches from g group by 1, 2""",
)
def switches(s):
    return ts.movement(s.state_samples, ["session_id", "round_id"], "game_ms", "sample_id").select("session_id", "round_id", "direction_switches")


@query("jn13_left_at", "select event_id, left_us from combat_events left join player_sessions on session_id = attacker_id")
def left_at(s):
    return se.left_of(s.combat_events.withColumn("session_id", F.col("attacker_id")), s.player_sessions).select("event_id", "left_us")


@query("jn14_round_leaves", "select round_id, count(*) as leaves from rounds join player_sessions on server = map and left_us between started_us and started_us + duration_ms * 1000 group by 1")
def round_leaves(s):
    return se.leaves_during(s.rounds, s.player_sessions)


@query("jn04_sample_entities", f"select s.sample_id, e.t_us, {_CAT.format(n='n.name')} as category, n.name as name from state_samples s join network_samples e using (sample_id) join object_names n on n.object_id = s.y::bigint")
def sample_entities(s):
    samples = s.state_samples.select("sample_id", F.col("y").cast("long").alias("entity_id"))
    events = s.network_samples.select("sample_id", "t_us")
    found = sc.samples_of(samples, events, s.object_names.withColumnRenamed("object_id", "entity_id"), "sample_id")
    return found.select("sample_id", "t_us", sc.object_category(F.col("name"), RULES).alias("category"), "name")


@query("sc04_observed_days", "select identity_id, (max(joined_us) - min(joined_us)) // 86400000000 as days from player_sessions where identity_id is not null group by 1")
def observed_days(s):
    return s.player_sessions.where("identity_id is not null").groupBy("identity_id").agg(se.whole_days(F.min("joined_us"), F.max("joined_us")).alias("days"))


@query("sc09_decay", "select event_id, round(exp(-((t_us % 8000000) / 1e6) / 4), 6) as weight from combat_events")
def decay(s):
    return rounded(s.combat_events.select("event_id", cb.decay((F.col("t_us") % 8_000_000) / 1e6).alias("weight")))


@query("sc11_speed_bucket", "select sample_id, floor(sqrt(vx * vx + vy * vy) / 2)::bigint as bucket from state_samples")
def speed_bucket(s):
    return s.state_samples.select("sample_id", sc.speed_bucket(F.hypot("vx", "vy")).alias("bucket"))


@query(
    "sc18_candidate_state",
    "select event_id, case when event_id % 23 >= 12 and event_id % 7 >= 3 and event_id % 5 >= 3 and event_id % 11 / 10.0 >= 0.8 and event_id % 13 / 12.0 >= 0.75 and event_id % 3 / 20.0 < 0.1 then 'active' else 'candidate' end as state from combat_events",
)
def candidate_state(s):
    i = F.col("event_id")
    return s.combat_events.select("event_id", am.candidate_state(i % 23, i % 7, i % 5, i % 11 / 10.0, i % 13 / 12.0, i % 3 / 20.0).alias("state"))


@query(
    "sc20_boost_confidence",
    "with v as (select sample_id, (sample_id % 5) / 4.0 as c, vx / 50 as i, vy / 50 as g, y / 100 as m from state_samples) select sample_id, case when c < 0.7 then 'insufficient' when i > 0.5 and g > 0.5 and m > 0.25 then 'high' when i > 0.25 and (g > 0.25 or m > 0.25) then 'medium' else 'low' end as confidence from v",
)
def boost_confidence(s):
    return s.state_samples.select("sample_id", sc.boost_confidence(F.col("sample_id") % 5 / 4.0, F.col("vx") / 50, F.col("vy") / 50, F.col("y") / 100).alias("confidence"))


@query(
    "sc21_kill_confidence",
    "with v as (select event_id, (t_us % 4000000) / 1e6 as a, event_id % 10 / 10.0 as p, event_id % 3 + 1 as n from combat_events) select event_id, case when a <= 2.5 and a <= 0.75 and (n = 1 or p >= 0.5) then 'high' when a <= 2.5 then 'low' end as confidence from v",
)
def kill_confidence(s):
    i = F.col("event_id")
    return s.combat_events.select("event_id", cb.kill_confidence(F.col("t_us") % 4_000_000 / 1e6, i % 10 / 10.0, i % 3 + 1).alias("confidence"))


@query("set04_interaction_producers", f"with {_OK} select case when k = 7 and kk = 7 then 'player_kick_object' when k = 7 then 'player_melee_object' when k = 8 then 'projectile_hit_object' when kk = 9 then 'object_damage_projectile' else 'object_damage_player' end as interaction, count(*) as n from b where k = 7 or kk = 18 or k = 9 group by 1")
def producers(s):
    return sc.counts_by(nz.scene_interactions(bronze(s)), "interaction")


@query("job06_scene_patterns", f"with j as ({SQL['job04_assisted_movement']}) select interaction_id, 'scene_assisted_movement' as signature, case confidence when 'high' then 1.0 else 0.65 end::double as confidence from j where confidence in ('high', 'medium')")
def scene_patterns(s):
    return sc.scene_pattern_matches(assisted_movement(s))


@query(
    "job06_match_confidence",
    "with c as (select event_id as interaction_id, case event_id % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'insufficient' end as confidence from events) select interaction_id, 'scene_assisted_movement' as signature, case confidence when 'high' then 1.0 else 0.65 end::double as confidence from c where confidence in ('high', 'medium')",
)
def match_confidence(s):
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit("insufficient")), (F.col("event_id") % 4 + 1).cast("int"))
    return sc.scene_pattern_matches(s.events.select(F.col("event_id").alias("interaction_id"), level.alias("confidence")))


@query(
    "job05_scene_overview",
    f"""with {_OBJ}, s as (select *, sqrt(vx * vx + vy * vy) as speed from state_samples),
x as (select 'interactions_by_type' as section, interaction as key, count(*) as n from o group by 2
union all select 'object_categories', category, count(*) from o group by 2
union all (select 'interaction_heatmap', round_even(x / 50, 0)::bigint * 50 || '|' || round_even(y / 50, 0)::bigint * 50 as k, count(*) as c from o where x is not null and y is not null group by 2 order by c desc, k limit 500)
union all (select 'object_usage', coalesce(object_name, 'unknown') || '|' || category as k, count(*) as c from o group by 2 order by c desc, k limit 50)
union all (select 'interaction_graph', 'player:' || player_id || '|' || interaction || '|' || category as k, count(*) as c from o group by 2 order by c desc, k limit 100)
union all (select 'trajectory_clusters', (case when airborne then 'air' else 'ground' end) || '|' || floor(speed / 2)::bigint || '|' || (floor((atan2(vy, vx) + pi()) / (pi() / 4)) % 8)::int || '|' || rolling as k, count(*) as c from s where speed >= 0.5 group by 2 order by c desc, k limit 50)
union all select 'lifecycle', event_type, count(*) from combat_events where event_type = 'projectile_hit' group by 2
union all (select 'episodes', event_id::varchar, victim_id from combat_events where event_type = 'player_death' order by t_us desc, event_id desc limit 200)
union all select 'totals', 'interactions', count(*) from o union all select 'totals', 'samples', count(*) from s union all select 'totals', 'environmental_damage', count(*) filter (where interaction = 'object_damage_player') from o)
select section, key, n::bigint as n from x""",
)
def overview(s):
    samples = s.state_samples.withColumns({"category": F.when(F.col("airborne"), "air").otherwise("ground"), "is_missile": F.col("rolling")})
    windows = s.combat_events.where("event_type = 'player_death'").select(F.col("event_id").alias("window_id"), "t_us", F.col("victim_id").alias("entities"))
    return rp.scene_overview(s.scene_interactions, s.object_names, samples, windows, s.combat_events.select("event_type"), RULES)


@query(
    "job10_superseded",
    "with r as (select doc_id, case when doc_id % 2 = 0 then 'gameplay' else 'chat' end as t, case doc_id % 3 when 0 then 'queued' when 1 then 'done' else 'failed' end as status, doc_id % 5 = 0 as legacy, doc_id % 7 = 0 as identifying from documents) select doc_id, case when t = 'gameplay' and status = 'queued' and (legacy or identifying) then 'superseded' else status end as status, t = 'gameplay' and status = 'queued' and (legacy or identifying) as answered from r",
)
def superseded(s):
    i = F.col("doc_id")
    payload = F.when(i % 7 == 0, F.to_json(F.struct(F.struct(i.alias("player_session_id")).alias("who")))).when(i % 11 == 0, F.lit('{"session')).otherwise(F.to_json(F.struct("lang")))
    rows = s.documents.select(
        "doc_id", F.when(i % 2 == 0, "gameplay").otherwise("chat").alias("source_type"), F.when(i % 3 == 0, "queued").when(i % 3 == 1, "done").otherwise("failed").alias("status"),
        F.when(i % 5 == 0, F.when(i % 4 == 0, "moves-v1@v2").otherwise("moves-v1")).otherwise("moves-v2").alias("kind"), payload.alias("payload"),
    )
    return an.supersede(rows, "moves-v1").select("doc_id", "status", F.col("response").isNotNull().alias("answered"))


@query("st10_closed_episodes", "select event_id, case when event_id % 3 = 0 then t_us + 5 when event_id % 2 = 0 and t_us < 1705276800000000 then 1705276800000000 end as closed_us from combat_events where event_type = 'player_death'")
def closed(s):
    i = F.col("event_id")
    rows = s.combat_events.where("event_type = 'player_death'").select("event_id", F.col("t_us").alias("created_us"), F.when(i % 2 == 0, "selected").otherwise("expired").alias("status"), F.when(i % 3 == 0, F.col("t_us") + 5).alias("closed_us"))
    return rp.close_episodes(rows, 1_705_276_800_000_000).select("event_id", "closed_us")


@query("st10_confirmed_patterns", "select attacker_id as signature, count(*) as occurrences, case when count(*) >= 12 then 'confirmed' else 'candidate' end as state from combat_events group by 1")
def confirmed(s):
    rows = s.combat_events.groupBy(F.col("attacker_id").alias("signature")).agg(F.count("*").alias("occurrences")).withColumn("state", F.lit("candidate"))
    return rp.confirm_patterns(rows)


@query("st03_fan_out", "select 'types' as sink, event_type as key, count(*) as n from events group by 2 union all select 'days', strftime(ts, '%Y-%m-%d'), count(*) from events group by 2")
def fanned(s):
    """One pass of the stream into two sinks; the rows of all batches added up."""
    at = _folder(s)
    types, days = st.keyed_sink(f"{at}/types"), st.keyed_sink(f"{at}/days")
    sinks = {"types": lambda b, i: types(sc.counts_by(b, "event_type"), i), "days": lambda b, i: days(sc.counts_by(b, "round_id"), i)}
    st.fan_out(_stream(s), f"{at}/checkpoint", sinks).awaitTermination()
    read = lambda name, key: s.spark.read.parquet(f"{at}/{name}").groupBy(F.lit(name).alias("sink"), F.col(key).alias("key")).agg(F.sum("n").alias("n"))
    return read("types", "event_type").unionByName(read("days", "round_id"))


@query("src01_decoded_values", "select props as value from events")
def decoded(s):
    """Values written as spool lines between empty slots, decoded again."""
    line = F.concat(F.lit("string[]|slot_"), F.col("event_id").cast("string"), F.lit("|"), F.base64(F.encode("props", "UTF-8")), F.lit(r"||\0\0"))
    return ev.decode_spool(s.events.select(F.regexp_replace(line, "[\r\n]", "").alias("line")), "line").select("value")


def _more_events(s):
    """Profiles, state windows and scene windows, one of each kind in turn."""
    i = F.col("event_id")
    j = lambda **f: F.to_json(F.struct(*(c.alias(n) for n, c in f.items())))
    sample = lambda x, y: F.struct(x.alias("x"), y.alias("y"), i.cast("double").alias("game_ms"))
    data = F.when(i % 3 == 0, j(profile=F.when(i % 2 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"p":'), i.cast("string"), F.lit("}")))))
    data = data.when(i % 3 == 1, j(samples=F.array(sample(i.cast("double"), F.lit(1.0)), sample(F.lit(2.0), i.cast("double")))))
    data = data.otherwise(F.when(i % 2 == 0, j(trigger=F.lit("death"), coverage=F.lit(0.5))).otherwise(F.lit("{}")))
    kind = F.element_at(F.array(*map(F.lit, ("user_present", "state_window", "scene_window_complete"))), (i % 3 + 1).cast("int"))
    head = j(v=F.lit(1), seq=i + 1, ts=F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), type=kind, server_session=F.lit("s"), round=F.when(i % 5 == 0, "").otherwise("r"), player=F.lit("p"))
    rows = s.events.select("event_id", head.alias("head"), data.alias("data"))
    lines = rows.select(F.concat(F.lit(ev.PREFIX), F.expr("left(head, length(head) - 1)"), F.lit(',"data":'), F.col("data"), F.lit("}")).alias("value"))
    return checkpointed(ev.to_events(ev.split_dead_letters(ev.parse_envelopes(checkpointed(lines)))[0]))


@query("src13_profiles", "select event_id + 1 as seq, 'p' as player_id, '{\"p\":' || event_id || '}' as profile from events where event_id % 6 = 3")
def profiles(s):
    return nz.profiles(_more_events(s)).select("seq", "player_id", "profile")


@query("src16_state_windows", "select event_id + 1 as seq, n::int as nth, case n when 0 then event_id else 2 end::double as x, case n when 0 then 1 else event_id end::double as y from events, range(2) r(n) where event_id % 3 = 1")
def state_windows(s):
    return nz.state_windows(_more_events(s)).select("seq", "nth", "x", "y")


@query("src21_scene_windows", "select event_id + 1 as seq, case when event_id % 5 = 0 then '' else 'r' end as round_id, case when event_id % 2 = 0 then 'death' else 'unknown' end as trigger, case when event_id % 2 = 0 then 0.5 else 0 end::double as coverage from events where event_id % 3 = 2")
def scene_windows(s):
    return nz.scene_windows(_more_events(s)).select("seq", "round_id", "trigger", "coverage")
