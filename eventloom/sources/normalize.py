"""Typed tables from bronze events (server, seq, t_us, type, round_id, player_id, game_ms, data, d).

Dimensions are latest-state aggregates ordered by sequence; facts are selections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMBAT_TYPES = "^(player_damage|player_death|melee_|projectile_|explosion_|weapon_)"
DAMAGE_RECORD = "object_id x y vx vy health max_health is_missile damage damage_type source_id source_is_player source_player_session_id game_ms".split()


def _last(value: Column | str, when: Column | None = None) -> Column:
    return F.max_by(value, F.when(when, F.col("seq")) if when is not None else F.col("seq"))


def _first(value: Column | str, when: Column | None = None) -> Column:
    return F.min_by(value, F.when(when, F.col("seq")) if when is not None else F.col("seq"))


def server_sessions(events: DataFrame) -> DataFrame:
    """First and last event, start and end of each server session; a later start clears the end."""
    start, stop = F.col("type") == "script_start", F.col("type") == "script_shutdown"
    out = events.groupBy("server").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), _last("t_us", start).alias("started_us"), F.max(F.when(start, F.col("seq"))).alias("_s"), _last("t_us", stop).alias("_end"), F.max(F.when(stop, F.col("seq"))).alias("_e"))
    return out.select("server", "first_us", "last_us", "started_us", F.when(F.col("_s").isNull() | (F.col("_e") > F.col("_s")), F.col("_end")).alias("ended_us"))


def rounds(events: DataFrame) -> DataFrame:
    """Rounds from their last start, completed by their last end."""
    s = events.where("type = 'round_start' and round_id is not null").groupBy("round_id").agg(_last("t_us").alias("started_us"), _last("d.map").alias("map"), _last(F.size("d.composition")).alias("player_count"))
    e = events.where("type = 'round_end' and round_id is not null").groupBy("round_id").agg(_last(F.struct("d.duration_ms", "d.winners", "d.draw", "d.result_source")).alias("e"))
    return s.join(e, "round_id", "full").select("round_id", "started_us", "map", "player_count", "e.duration_ms", "e.winners", "e.draw", "e.result_source")


def round_players(events: DataFrame) -> DataFrame:
    """Players of a round's composition, and late ones that joined during a known round; first row of a pair wins."""
    members = events.where("type = 'round_start' and round_id is not null").select("round_id", "seq", F.explode("d.composition.session_id").alias("player_id"), F.lit(False).alias("late_join"))
    known = rounds(events).select("round_id", "winners", "draw", "result_source")
    late = events.where("type = 'user_join' and player_id is not null").join(known.select("round_id"), "round_id", "left_semi").select("round_id", "seq", "player_id", F.lit(True).alias("late_join"))
    first = members.unionByName(late).groupBy("round_id", "player_id").agg(F.min_by("late_join", F.struct("late_join", "seq")).alias("late_join"))
    left = events.where("type = 'user_leave' and round_id is not null").groupBy("round_id", "player_id").agg(_last("game_ms").alias("left_game_ms"))
    return first.join(known, "round_id").join(left, ["round_id", "player_id"], "left").select("round_id", "player_id", "late_join", "left_game_ms", F.coalesce(F.array_contains("winners", F.col("player_id")), F.lit(False)).alias("winner"), "draw", "result_source")


def player_sessions(events: DataFrame) -> DataFrame:
    """Sessions: identity and flags frozen by the first join, names and team from the last one, then the last leave."""
    joins = events.where("type in ('user_join', 'user_present') and player_id is not null").groupBy("player_id").agg(
        F.min("t_us").alias("joined_us"), _first(F.nullif("d.identity", F.lit(""))).alias("identity_id"), _first("d.is_bot").alias("is_bot"), _last("d.account_name").alias("account_name"), _last("d.character_name").alias("character_name"), _last("d.team").alias("team")
    )
    leaves = events.where("type = 'user_leave'").groupBy("player_id").agg(_last("t_us").alias("left_us"), _last("d.reason").alias("reason"), _last("d.ping").alias("last_ping"))
    return joins.join(leaves, "player_id", "left")


def players(sessions: DataFrame) -> DataFrame:
    """Identities with first and last sight; sessions without one are no player."""
    return sessions.where("identity_id is not null").groupBy("identity_id").agg(F.min("joined_us").alias("first_us"), F.max(F.coalesce("left_us", "joined_us")).alias("last_us"), F.count("*").alias("sessions"))


def player_aliases(events: DataFrame) -> DataFrame:
    """Distinct names of a session by kind, with the first time each was seen."""
    rows = events.where("type in ('user_join', 'user_present') and player_id is not null")
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("alias_type"), F.col(f"d.{k}").alias("alias")) for k in ("account_name", "character_name"))))
    return rows.select("player_id", "t_us", pairs.alias("a")).where("a.alias is not null").groupBy("player_id", "a.alias_type", "a.alias").agg(F.min("t_us").alias("first_us"))


def profiles(events: DataFrame) -> DataFrame:
    return events.where("d.profile is not null and d.profile <> '{}'").select("seq", "player_id", "t_us", "d.profile")


def network_samples(events: DataFrame) -> DataFrame:
    return events.where("type = 'ping' and player_id is not null").select(F.col("seq").alias("sample_id"), F.col("player_id").alias("session_id"), "t_us", "d.ping")


def state_samples(events: DataFrame) -> DataFrame:
    return events.where("type in ('state_sample', 'highres_state_sample') and player_id is not null").select("seq", "player_id", "round_id", "game_ms", "d.x", "d.y", "d.vx", "d.vy", "data")


def state_windows(events: DataFrame) -> DataFrame:
    """Samples of pre-event dumps, one row each."""
    rows = events.where("type = 'state_window'").select("seq", "player_id", "round_id", F.posexplode("d.samples").alias("nth", "s"))
    return rows.select("seq", "player_id", "round_id", "nth", "s.*")


def chat_messages(events: DataFrame) -> DataFrame:
    return events.where("type = 'chat'").select(F.col("seq").alias("chat_id"), "player_id", "round_id", "t_us", "d.message")


def scene_windows(events: DataFrame) -> DataFrame:
    return events.where("type = 'scene_window_complete'").select("seq", F.coalesce("round_id", F.lit("")).alias("round_id"), F.coalesce("game_ms", F.lit(0.0)).alias("game_ms"), F.coalesce("d.trigger", F.lit("unknown")).alias("trigger"), F.coalesce("d.coverage", F.lit(0.0)).alias("coverage"))


def damage_records(events: DataFrame) -> DataFrame:
    """Records of object damage, one row each: named objects or positional arrays of 14 values."""
    rows = events.where("type = 'object_damage_batch'").select("server", "seq", "round_id", "player_id", F.col("game_ms").alias("event_ms"), "d.field_map", F.explode("d.records").alias("r"))
    v = F.from_json("r", "array<string>")
    named = F.from_json("r", ", ".join(f"{n} string" for n in DAMAGE_RECORD))
    at = {n: F.when(F.col("field_map") == "object_damage_v1", F.get(v, F.lit(i))).otherwise(named[n]) for i, n in enumerate(DAMAGE_RECORD)}
    whole = (F.col("field_map") != "object_damage_v1") | F.col("field_map").isNull() | (F.size(v) == len(DAMAGE_RECORD))
    return rows.where(whole).select("server", "seq", "round_id", "player_id", "event_ms", *(at[n].alias(n) for n in DAMAGE_RECORD))


def damage_type(kind: Column, by_player: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("unknown")))
    return F.when(k.contains("explosion"), "object_damage_explosion").when(k.contains("projectile"), "object_damage_projectile").when(F.coalesce(by_player, F.lit(False)), "object_damage_player").otherwise("object_impact_object")


def entity_id(kind: Column, engine_id: Column) -> Column:
    """Surrogate id of a scene entity: a hash of its key, null for ids that are no integers."""
    number = engine_id.try_cast("long")
    return F.when(number.isNotNull(), F.xxhash64(F.col("server"), F.coalesce("round_id", F.lit("")), kind, number))


_INTERACTION = ["seq", "round_id", "game_ms", "interaction", "player", "actor_id", "target_id", "x", "y", "damage"]


def scene_interactions(events: DataFrame) -> DataFrame:
    """Interactions with objects of all producers in one table."""
    none = F.lit(None)
    target = lambda c: entity_id(F.lit("object"), c)

    def rows(base: DataFrame, kind: Column, player: Column, actor: Column, of: Column, x: Column, y: Column, damage: Column, game_ms: Column) -> DataFrame:
        cols = [F.col("seq"), F.col("round_id"), game_ms.cast("double"), kind, player.cast("string"), actor.cast("long"), of, x.cast("double"), y.cast("double"), damage.cast("double")]
        return base.select(*(c.alias(n) for c, n in zip(cols, _INTERACTION, strict=True)))

    d = lambda f: F.col(f"d.{f}")
    single = events.where("type = 'object_damage'")
    by_player = F.coalesce(d("source_is_player"), F.lit(False))
    kind = damage_type(d("damage_type"), by_player)
    source = F.when(kind == "object_damage_projectile", F.lit("projectile")).otherwise(F.lit("object"))
    one = rows(single, kind, F.coalesce(d("source_player_session_id"), F.col("player_id")), F.when(~by_player, entity_id(source, d("source_id"))), target(F.coalesce(d("object.object_id"), d("object_id"))), F.coalesce(d("x"), d("hit_x")), F.coalesce(d("y"), d("hit_y")), d("damage"), F.coalesce(d("game_ms"), F.col("game_ms"))).where("target_id is not null")
    batch = damage_records(events)
    flag = F.coalesce(F.col("source_is_player").try_cast("boolean"), F.lit(False))
    kind = damage_type(F.col("damage_type"), flag)
    source = F.when(kind == "object_damage_projectile", F.lit("projectile")).otherwise(F.lit("object"))
    num = lambda c: F.col(c).try_cast("double")
    many = rows(batch, kind, F.coalesce("source_player_session_id", "player_id"), F.when(~flag, entity_id(source, F.col("source_id"))), target(F.col("object_id")), num("x"), num("y"), num("damage"), F.coalesce(num("game_ms"), F.col("event_ms"))).where("target_id is not null")
    hits = events.where("type in ('melee_action', 'explosion_hit')").withColumn("h", F.explode("d.hits")).where(~F.coalesce("h.is_player", F.lit(False)))
    kick = F.when(F.col("type") == "explosion_hit", "explosion_hit_object").when(d("action") == "kick", "player_kick_object").otherwise("player_melee_object")
    melee = rows(hits, kick, F.when(F.col("type") == "melee_action", d("attacker_session_id")), none, target(F.col("h.object_id")), F.coalesce("h.x", "h.hit_x"), F.coalesce("h.y", "h.hit_y"), F.col("h.damage"), F.col("game_ms"))
    shots = events.where("type = 'projectile_hit'").where(~F.coalesce(d("is_player"), F.lit(False)))
    shot = rows(shots, F.lit("projectile_hit_object"), d("attacker_session_id"), entity_id(F.lit("projectile"), d("projectile.instance_id")), target(d("hit_object_id")), F.coalesce(d("x"), d("hit_x")), F.coalesce(d("y"), d("hit_y")), d("damage"), F.col("game_ms"))
    return one.unionByName(many).unionByName(melee).unionByName(shot)


def scene_samples(events: DataFrame) -> DataFrame:
    """Samples of scene batches; kind defaults to object, time to the envelope's; one per entity, event and time."""
    rows = events.where("type in ('scene_frame_batch', 'scene_highres_batch')").withColumn("i", F.explode(F.coalesce("d.entities", "d.objects")))
    kind = F.coalesce("i.kind", F.lit("object"))
    out = rows.select("seq", "round_id", entity_id(kind, F.coalesce("i.object_id", "i.instance_id")).alias("entity_id"), F.coalesce("i.game_ms", "game_ms", F.lit(0.0)).alias("game_ms"), "i.x", "i.y", "i.vx", "i.vy", F.coalesce("i.is_missile", F.lit(False)).alias("is_missile"))
    return out.where("entity_id is not null").dropDuplicates(["entity_id", "seq", "game_ms"])


def scene_entities(events: DataFrame) -> DataFrame:
    """Entities from batches and object events: last known name, first mention, end."""
    batch = events.withColumn("i", F.explode(F.coalesce("d.entities", "d.objects"))).select("server", "round_id", F.coalesce("i.kind", F.lit("object")).alias("kind"), F.coalesce("i.object_id", "i.instance_id").alias("engine_id"), F.col("i.name").alias("name"), "seq", F.lit(False).alias("ends"))
    single = events.where("type in ('object_created', 'object_damage', 'object_terminated')").select("server", "round_id", F.lit("object").alias("kind"), F.coalesce("d.object.object_id", "d.object_id").alias("engine_id"), F.coalesce("d.object.name", "d.name").alias("name"), "seq", (F.col("type") == "object_terminated").alias("ends"))
    rows = batch.unionByName(single).withColumn("entity_id", entity_id(F.col("kind"), F.col("engine_id"))).where("entity_id is not null")
    return rows.groupBy("entity_id", "kind", "engine_id").agg(_last("name", F.col("name").isNotNull()).alias("name"), F.min("seq").alias("created_id"), F.max(F.when(F.col("ends"), F.col("seq"))).alias("terminated_id"), F.count("*").alias("mentions"))


def combat_events(events: DataFrame) -> DataFrame:
    """Combat events by prefix of their type; the victim falls back to the envelope's player."""
    return events.where(F.col("type").rlike(COMBAT_TYPES)).select(F.col("seq").alias("event_id"), "t_us", "round_id", F.col("type").alias("event_type"), F.col("d.attacker_session_id").alias("attacker_id"), F.coalesce(F.nullif("d.victim_session_id", F.lit("")), "player_id").alias("victim_id"), "d.damage", "d.damage_type", "d.weapon", "d.distance")


def combat_hits(events: DataFrame) -> DataFrame:
    """One row per hit: ``hits`` of melee actions and explosions, other combat events as a hit of their own."""
    rows = events.where(F.col("type").rlike(COMBAT_TYPES))
    listed = F.col("type").isin("melee_action", "explosion_hit")
    several = rows.where(listed).select("seq", "type", F.col("d.attacker_session_id").alias("attacker_id"), "d.weapon", F.col("d.is_player").alias("whole"), F.posexplode("d.hits").alias("nth", "h"))
    default = lambda t: F.when(t.startswith("melee"), "Melee").when(t.startswith("projectile"), "Projectile").when(t.startswith("explosion"), "Explosion").otherwise("Other")
    a = several.select("seq", "nth", "attacker_id", F.col("h.victim_session_id").alias("victim_id"), F.coalesce("h.damage", "h.hit_damage").alias("damage"), F.coalesce("h.type", default(F.col("type"))).alias("hit_type"), "weapon", F.coalesce("h.is_player", "whole", F.lit(True)).alias("is_player"))
    b = rows.where(~listed).select("seq", F.lit(0).alias("nth"), F.col("d.attacker_session_id").alias("attacker_id"), F.coalesce("d.victim_session_id", "player_id").alias("victim_id"), "d.damage", F.coalesce("d.damage_type", default(F.col("type"))).alias("hit_type"), "d.weapon", F.coalesce("d.is_player", F.lit(True)).alias("is_player"))
    return a.unionByName(b)
