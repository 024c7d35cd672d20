"""Queries of the envelope and normalisation operators, over envelopes written from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeseries import finite
from ..sources import envelope as ev
from ..sources import normalize as nz
from ..staging import checkpointed
from .shapes import Shapes, query
from .timeseries import rounded


def envelope_lines(s: Shapes) -> DataFrame:
    """One spool value per event; every 37th is cut short and every 41st has sequence 0."""
    i, k, v = F.col("event_id"), F.col("event_id") % 10, F.col("value")
    p = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    j = lambda **f: F.to_json(F.struct(*(c.alias(n) for n, c in f.items())))
    kinds = ["user_join", "user_leave", "ping", "state_sample", "chat", "round_start", "round_end", "melee_action", "projectile_hit", "object_damage_batch"]
    kind = F.when(i % 20 == 13, "scene_frame_batch").otherwise(F.element_at(F.array(*map(F.lit, kinds)), (k + 1).cast("int")))
    record = F.array(F.lit("7"), v.cast("string"), F.lit("2"), *[F.lit("0")] * 4, F.lit("false"), v.cast("string"), F.when(i % 20 == 9, "Projectile").otherwise("Impact"), F.lit("9"), (i % 20 == 19).cast("string"), F.lit(None).cast("string"), i.cast("string"))
    hit = lambda oid, victim, player: F.struct(oid.alias("object_id"), victim.alias("victim_session_id"), v.alias("damage"), F.lit(player).alias("is_player"), v.alias("x"), F.lit(1.0).alias("y"))
    none = F.lit(None).cast("string")
    data = [
        j(identity=F.when(F.col("user_id") % 7 == 0, "").otherwise(text("id", F.col("user_id"))), account_name=text("A", F.col("user_id")), character_name=text("C", i % 3), is_bot=F.col("user_id") % 10 == 0, team=text("T", i % 2)),
        j(reason=F.col("event_type"), ping=(i % 200).cast("int")),
        j(ping=v.cast("int")),
        j(x=v, y=F.lit(1.0), vx=F.lit(0.5), vy=F.lit(0.0)),
        j(message=F.col("props")),
        j(map=text("M", i % 4), composition=F.array(F.struct(p.alias("session_id"), F.lit("x").alias("team")))),
        j(duration_ms=v * 1000, winners=F.array(p), draw=F.lit(False), result_source=F.lit("exact")),
        j(attacker_session_id=p, weapon=F.lit("bat"), action=F.when(i % 20 == 7, "kick").otherwise("swing"), hits=F.array(hit(F.lit("5"), none, False), hit(none, F.lit("p1"), True))),
        j(attacker_session_id=p, damage=v, is_player=i % 20 == 8, hit_object_id=(i % 50).cast("string"), projectile=F.struct(i.cast("string").alias("instance_id")), hit_x=v, hit_y=F.lit(2.0), weapon=F.lit("uzi")),
        j(field_map=F.lit("object_damage_v1"), records=F.array(record, F.array(F.lit("1")))),
    ]
    payload = F.when(i % 20 == 13, j(entities=F.array(F.struct(F.lit("object").alias("kind"), (i % 30).cast("string").alias("object_id"), text("n", i % 30).alias("name"), v.alias("x"), F.lit(0.0).alias("y")))))
    for n, d in enumerate(data):
        payload = payload.when(k == n, d)
    head = j(v=F.lit(1), seq=F.when(i % 41 == 3, F.lit(0)).otherwise(i + 1), ts=F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), type=kind, server_session=text("srv", F.col("user_id") % 3), round=F.date_format("ts", "yyyy-MM-dd"), player=p, game_ms=i.cast("double"))
    line = F.concat(F.lit(ev.PREFIX), F.expr("left(head, length(head) - 1)"), F.lit(',"data":'), F.col("payload"), F.lit("}"))
    rows = s.events.select("event_id", head.alias("head"), payload.alias("payload"))
    return checkpointed(rows.select(F.when(F.col("event_id") % 37 == 2, F.left(line, F.lit(60))).otherwise(line).alias("value")))


def bronze(s: Shapes) -> DataFrame:
    sound, _ = ev.split_dead_letters(ev.parse_envelopes(envelope_lines(s)))
    return checkpointed(ev.to_events(sound))


#: The same events for the oracle: n = seq, k = kind.
_OK = "b as (select event_id + 1 as seq, event_id as i, event_id % 10 as k, event_id % 20 as kk, 'p' || user_id as p, user_id, strftime(ts, '%Y-%m-%d') as round_id, epoch_us(ts) // 1000 * 1000 as t_us, value as v, props, event_type as et from events where event_id % 37 <> 2 and event_id % 41 <> 3)"


@query("src02_envelopes", "select case when event_id % 37 = 2 then 'invalid JSON' when event_id % 41 = 3 then 'unsupported version or sequence' else 'ok' end as outcome, count(*) as n from events group by 1")
def outcomes(s):
    return ev.parse_envelopes(envelope_lines(s)).groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query("src03_dead_letters", "select 'invalid JSON' as error, 60::int as n, count(*) as rows from events where event_id % 37 = 2 union all select 'unsupported version or sequence', 256, count(*) from events where event_id % 37 <> 2 and event_id % 41 = 3 and event_id % 10 = 0 having count(*) < 0")
def dead(s):
    _, bad = ev.split_dead_letters(ev.parse_envelopes(envelope_lines(s)))
    return bad.where("error = 'invalid JSON'").groupBy("error", F.length("head").alias("n")).agg(F.count("*").alias("rows"))


@query("src06_events", f"with {_OK} select seq, t_us, round_id, p as player_id, 'srv' || (user_id % 3) as server from b")
def events(s):
    return bronze(s).select("seq", "t_us", "round_id", "player_id", "server")


@query("src07_server_sessions", f"with {_OK} select 'srv' || (user_id % 3) as server, min(t_us) as first_us, max(t_us) as last_us, null::bigint as started_us, null::bigint as ended_us from b group by 1")
def servers(s):
    return nz.server_sessions(bronze(s))


_ROUNDS = "st as (select round_id, arg_max(t_us, seq) as started_us, 'M' || arg_max(i % 4, seq) as map, 1 as player_count from b where k = 5 group by 1), en as (select round_id, arg_max(v * 1000, seq) as duration_ms, arg_max(p, seq) as winner from b where k = 6 group by 1), rounds as (select * from st full join en using (round_id))"


@query("src08_rounds", f"with {_OK}, {_ROUNDS} select round_id, started_us, map, player_count, round(duration_ms, 6) as duration_ms, winner from rounds".replace("rounds as", "rr as").replace("from rounds", "from rr"))
def rounds(s):
    return rounded(nz.rounds(bronze(s)).select("round_id", "started_us", "map", "player_count", "duration_ms", F.get("winners", F.lit(0)).alias("winner")))


@query(
    "src09_round_players",
    f"with {_OK}, {_ROUNDS}, m as (select round_id, p, false as late from b where k = 5 union all select round_id, p, true from b where k = 0 and round_id in (select round_id from rr)), f as (select round_id, p, bool_and(late) as late_join from m group by 1, 2), l as (select round_id, p, arg_max(i::double, seq) as left_game_ms from b where k = 1 group by 1, 2) select f.round_id, f.p as player_id, late_join, left_game_ms, coalesce(winner = f.p, false) as winner from f join rr on rr.round_id = f.round_id left join l on l.round_id = f.round_id and l.p = f.p".replace("rounds as", "rr as"),
)
def members(s):
    return nz.round_players(bronze(s)).select("round_id", "player_id", "late_join", "left_game_ms", "winner")


_SESS = "ss as (select * from (select p as player_id, min(t_us) as joined_us, arg_min(case when user_id % 7 = 0 then null else 'id' || user_id end, seq) as identity_id, bool_or(user_id % 10 = 0) as is_bot, 'A' || max(user_id) as account_name, 'C' || arg_max(i % 3, seq) as character_name, 'T' || arg_max(i % 2, seq) as team from b where k = 0 group by 1) left join (select p as player_id, arg_max(t_us, seq) as left_us, arg_max(et, seq) as reason, arg_max((i % 200)::int, seq) as last_ping from b where k = 1 group by 1) using (player_id))"


@query("src10_player_sessions", f"with {_OK}, {_SESS} select * from ss")
def sessions(s):
    return nz.player_sessions(bronze(s))


@query("src11_players", f"with {_OK}, {_SESS} select identity_id, min(joined_us) as first_us, max(coalesce(left_us, joined_us)) as last_us, count(*) as sessions from ss where identity_id is not null group by 1")
def players(s):
    return nz.players(nz.player_sessions(bronze(s)))


@query("src12_aliases", f"with {_OK}, a as (select p, 'account_name' as alias_type, 'A' || user_id as alias, t_us from b where k = 0 union all select p, 'character_name', 'C' || (i % 3), t_us from b where k = 0) select p as player_id, alias_type, alias, min(t_us) as first_us from a group by 1, 2, 3")
def aliases(s):
    return nz.player_aliases(bronze(s))


@query("src14_network_samples", f"with {_OK} select seq as sample_id, p as session_id, t_us, trunc(v)::int as ping from b where k = 2")
def network(s):
    return nz.network_samples(bronze(s))


@query("src15_state_samples", f"with {_OK} select seq, p as player_id, i::double as game_ms, round(v, 6) as x, 0.5::double as vx from b where kk = 3")
def states(s):
    return rounded(nz.state_samples(bronze(s)).select("seq", "player_id", "game_ms", finite(F.col("x")).alias("x"), "vx"))


@query("src17_chat_messages", f"with {_OK} select seq as chat_id, p as player_id, round_id, t_us, props as message from b where k = 4")
def chat(s):
    return nz.chat_messages(bronze(s))


@query("src19_scene_entities", f"with {_OK} select (i % 30)::varchar as engine_id, 'object' as kind, 'n' || (i % 30) as name, min(seq) as created_id, count(*) as mentions, round_id, 'srv' || (user_id % 3) as server from b where kk = 13 group by all".replace("group by all", "group by 1, 3, 6, 7"))
def entities(s):
    b = bronze(s)
    rows = b.where("type = 'scene_frame_batch'").withColumn("i", F.explode("d.entities")).select(nz.entity_id(F.lit("object"), F.col("i.object_id")).alias("entity_id"), "round_id", "server").distinct()
    return nz.scene_entities(b).join(rows, "entity_id").select("engine_id", "kind", "name", "created_id", "mentions", "round_id", "server")


@query("src20_scene_samples", f"with {_OK} select seq, round_id, i::double as game_ms, round(v, 6) as x, false as is_missile from b where kk = 13")
def samples(s):
    return rounded(nz.scene_samples(bronze(s)).select("seq", "round_id", "game_ms", "x", "is_missile"))


@query("src23_damage_records", f"with {_OK} select seq, '7' as object_id, case kk when 9 then 'Projectile' else 'Impact' end as damage_type, i::varchar as game_ms from b where k = 9")
def records(s):
    return nz.damage_records(bronze(s)).select("seq", "object_id", "damage_type", "game_ms")


@query(
    "src22_scene_interactions",
    f"""with {_OK} select seq, i::double as game_ms, case when k = 7 and kk = 7 then 'player_kick_object' when k = 7 then 'player_melee_object' when k = 8 then 'projectile_hit_object' when kk = 9 then 'object_damage_projectile' else 'object_damage_player' end as interaction,
 p as player, kk <> 19 and k <> 7 as has_actor, round(v, 6) as x, case k when 7 then 1.0 else 2.0 end::double as y, case when k = 8 then round(v, 6) else round(v, 6) end as damage from b where k = 7 or kk = 18 or k = 9""",
)
def interactions(s):
    return rounded(nz.scene_interactions(bronze(s)).select("seq", "game_ms", "interaction", "player", F.col("actor_id").isNotNull().alias("has_actor"), "x", "y", "damage"))


@query("src24_combat_events", f"with {_OK} select seq as event_id, case k when 7 then 'melee_action' else 'projectile_hit' end as event_type, p as attacker_id, p as victim_id, case k when 8 then round(v, 6) end as damage, case k when 7 then 'bat' else 'uzi' end as weapon from b where k in (7, 8)")
def combat(s):
    return rounded(nz.combat_events(bronze(s)).select("event_id", "event_type", "attacker_id", "victim_id", "damage", "weapon"))


@query(
    "src25_combat_hits",
    f"with {_OK} select seq, n::int as nth, p as attacker_id, case n when 1 then 'p1' end as victim_id, round(v, 6) as damage, 'Melee' as hit_type, n = 1 as is_player from b, range(2) r(n) where k = 7 union all select seq, 0, p, p, round(v, 6), 'Projectile', kk = 8 from b where k = 8",
)
def hits(s):
    return rounded(nz.combat_hits(bronze(s)).select("seq", "nth", "attacker_id", "victim_id", "damage", "hit_type", "is_player"))


@query("src01_spool")
def spool(s):
    """Envelopes written as spool lines and decoded again."""
    lines = envelope_lines(s).select(F.concat(F.lit("string[]|slot_0|"), F.base64(F.encode("value", "UTF-8"))).alias("value"))
    return ev.decode_spool(lines.withColumn("value", F.regexp_replace("value", "[\r\n]", ""))).select("value")


@query("src27_pinned_read", "select count(*) as events, max(event_id) as last_id from events where event_id <= 900")
def pinned(s):
    from ..sources.sinks import pinned as pin

    return pin(s.events, "event_id", 900).agg(F.count("*").alias("events"), F.max("event_id").alias("last_id"))
