"""Queries of the scene and anomaly operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import anomaly as an
from ..operators import scene as sc
from ..operators import timeseries as ts
from ..operators.ranks import sums_in_order
from .shapes import query
from .timeseries import rounded

RULES = [("round", "ring|washer"), ("threaded", "bolt|gear"), ("tool", "gizmo|widget")]
_CAT = "case when regexp_matches(lower({n}), 'ring|washer') then 'round' when regexp_matches(lower({n}), 'bolt|gear') then 'threaded' when regexp_matches(lower({n}), 'gizmo|widget') then 'tool' else 'other' end"
_OBJ = f"o as (select i.*, n.name as object_name, {_CAT.format(n='n.name')} as category from scene_interactions i left join object_names n on n.object_id = i.target_id)"


def _objects(s):
    return sc.with_objects(s.scene_interactions, s.object_names, RULES)


@query("sc12_object_category", f"select object_id, {_CAT.format(n='name')} as category from object_names")
def category(s):
    return s.object_names.select("object_id", sc.object_category(F.col("name"), RULES).alias("category"))


@query("agg27_by_type_and_category", f"with {_OBJ} select interaction, category, count(*) as n from o group by 1, 2")
def by_type(s):
    return sc.counts_by(_objects(s), "interaction", "category")


@query("agg28_object_usage", f"with {_OBJ} select object_name, category, count(*) as n from o where object_name is not null group by 1, 2 order by n desc, object_name, category limit 50")
def usage(s):
    return sc.top_counts(_objects(s).where("object_name is not null"), ["object_name", "category"], 50)


@query("agg29_interaction_graph", f"with {_OBJ} select player_id, interaction, category, count(*) as n from o group by 1, 2, 3 order by n desc, player_id, interaction, category limit 100")
def graph(s):
    return sc.top_counts(_objects(s), ["player_id", "interaction", "category"], 100)


@query("agg30_heatmap", "select round_even(x / 50, 0) * 50 as cell_x, round_even(y / 50, 0) * 50 as cell_y, count(*) as n from scene_interactions group by 1, 2")
def heat(s):
    return sc.heatmap(s.scene_interactions, 50.0)


@query("top01_heatmap", "select round_even(x / 50, 0) * 50 as cell_x, round_even(y / 50, 0) * 50 as cell_y, count(*) as n from scene_interactions group by 1, 2 order by n desc, cell_x, cell_y limit 5")
def top_heat(s):
    return sc.heatmap(s.scene_interactions, 50.0).orderBy(F.desc("n"), "cell_x", "cell_y").limit(5)


@query("agg41_usage_share", f"with {_OBJ} select category, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from o group by 1")
def share(s):
    return rounded(sc.usage_share(_objects(s), "category"))


@query("agg31_interaction_objects", "select target_id, count(*) as n, count(*) filter (where interaction = 'error') as terminated from scene_interactions group by 1")
def objects(s):
    return s.scene_interactions.groupBy("target_id").agg(F.count("*").alias("n"), F.count_if(F.col("interaction") == "error").alias("terminated"))


@query(
    "agg32_trajectory_clusters",
    "select (case when airborne then 'air' else 'ground' end) as category, floor(sqrt(vx * vx + vy * vy) / 2)::bigint as speed_bucket, (floor((atan2(vy, vx) + pi()) / (pi() / 4)) % 8)::int as octant, rolling as is_missile, count(*) as n from state_samples where sqrt(vx * vx + vy * vy) >= 0.5 group by 1, 2, 3, 4",
)
def clusters(s):
    return sc.trajectory_clusters(s.state_samples.withColumn("category", F.when(F.col("airborne"), "air").otherwise("ground")), "category", "rolling")




@query(
    "win12_motifs",
    """with r as (select *, list({'t': game_ms, 'a': interaction}) over (partition by player_id, round_id order by game_ms, interaction_id rows between 7 preceding and current row) as r from scene_interactions),
e as (select r, unnest(range(2, len(r) + 1)) as n from r where len(r) >= 2), t as (select r[len(r) - n + 1:] as s from e)
select array_to_string(list_transform(s, lambda x: x.a), '>') as motif, count(*) as n from t where s[len(s)].t - s[1].t <= 86400000 group by 1""",
)
def motifs(s):
    return sc.motifs(s.scene_interactions, ["player_id", "round_id"], "game_ms", "interaction_id", "interaction", 8, 86_400_000.0)


@query(
    "win14_action_ngrams",
    """with q as (select session_id, list(key order by t_us, event_id) as s from key_input group by 1), n as (select s, unnest(range(2, 7)) as n from q),
g as (select array_to_string(s[i:i + n - 1], '>') as gram from (select s, n, unnest(range(1, len(s) - n + 2)) as i from n)) select gram, count(*) as n from g group by 1""",
)
def ngrams(s):
    return sc.ordered_ngrams(s.key_input, ["session_id"], ["t_us", "event_id"], "key")


_NEAR = "select i.interaction_id, {agg}(({{'x': s.x, 'y': s.y, 'vx': s.vx, 'vy': s.vy}}), (s.game_ms, s.sample_id)) as v from i join state_samples s on s.round_id = i.round_id and {key} and s.game_ms between i.game_ms + {lo} and i.game_ms + {hi} group by 1"
_SPEED = "coalesce(sqrt({n}.v.vx * {n}.v.vx + {n}.v.vy * {n}.v.vy), 0)"


@query(
    "job04_assisted_movement",
    "with i as (select interaction_id, round_id, game_ms, target_id::bigint as target, player_id::bigint as player from scene_interactions), "
    + f"ob as ({_NEAR.format(agg='arg_max', key='s.y::bigint = i.target', lo=-14400000, hi=0)}), oa as ({_NEAR.format(agg='arg_min', key='s.y::bigint = i.target', lo=0, hi=14400000)}), "
    + f"pb as ({_NEAR.format(agg='arg_max', key='s.session_id = i.player', lo=-14400000, hi=0)}), pa as ({_NEAR.format(agg='arg_min', key='s.session_id = i.player', lo=3600000, hi=28800000)}), "
    + f"""c as (select i.interaction_id, ((ob.v is not null)::int + (oa.v is not null)::int + (pb.v is not null)::int + (pa.v is not null)::int) / 4.0 as coverage,
 {_SPEED.format(n='oa')} - {_SPEED.format(n='ob')} as impulse, {_SPEED.format(n='pa')} - {_SPEED.format(n='pb')} as gain, coalesce(sqrt(power(pa.v.x - pb.v.x, 2) + power(pa.v.y - pb.v.y, 2)), 0) as moved
 from i left join ob using (interaction_id) left join oa using (interaction_id) left join pb using (interaction_id) left join pa using (interaction_id))
select interaction_id, coverage::double as coverage, round(impulse, 6) as impulse, round(gain, 6) as speed_gain, round(moved, 6) as displacement, round(greatest(gain, moved), 6) as advantage,
 case when coverage < 0.7 then 'insufficient' when impulse > 0.5 and gain > 0.5 and moved > 0.25 then 'high' when impulse > 0.25 and (gain > 0.25 or moved > 0.25) then 'medium' else 'low' end as confidence from c""",
)
def assisted(s):
    of = lambda key: s.state_samples.select("sample_id", F.col(key).cast("long").alias("entity_id"), "round_id", "game_ms", "x", "y", "vx", "vy")
    return rounded(sc.assisted_movement(s.scene_interactions, of("y"), of("session_id"), 14_400_000.0, (3_600_000.0, 28_800_000.0)))


@query(
    "jn09_episodes",
    """with e as (select event_id as episode_id, round_id, t_us // 1000 as at_ms from combat_events where event_type = 'player_death' and event_id % 10 = 0),
r as (select e.episode_id, sample_id, c.t_us // 1000 - at_ms as offset_ms, row_number() over (partition by e.episode_id order by c.t_us // 1000, sample_id) as nth from e join (select event_id as sample_id, round_id, t_us from combat_events) c on c.round_id = e.round_id and c.t_us // 1000 between at_ms - 3600000 and at_ms + 1800000)
select episode_id, nth, sample_id, offset_ms::double as offset_ms from r where nth <= 10""",
)
def episodes(s):
    rows = s.combat_events.select(F.col("event_id").alias("sample_id"), "round_id", "event_type", F.floor(F.col("t_us") / 1000).alias("ms"))
    starts = rows.where("event_type = 'player_death' and sample_id % 10 = 0").select(F.col("sample_id").alias("episode_id"), "round_id", "ms")
    return sc.assemble_episodes(starts, rows, ["round_id"], "ms", "ms", "sample_id", -3_600_000.0, 1_800_000.0, 10).withColumn("offset_ms", F.col("offset_ms").cast("double"))


@query(
    "jn09_all_episodes",
    """with e as (select event_id as episode_id, round_id, t_us // 1000 as at_ms from combat_events where event_type = 'player_death'),
r as (select e.episode_id, sample_id, c.t_us // 1000 - at_ms as offset_ms, row_number() over (partition by e.episode_id order by c.t_us // 1000, sample_id) as nth from e join (select event_id as sample_id, round_id, t_us from combat_events) c on c.round_id = e.round_id and c.t_us // 1000 between at_ms - 3600000 and at_ms + 1800000)
select episode_id, nth, sample_id, offset_ms::double as offset_ms from r where nth <= 1200""",
)
def all_episodes(s):
    rows = s.combat_events.select(F.col("event_id").alias("sample_id"), "round_id", "event_type", F.floor(F.col("t_us") / 1000).alias("ms"))
    starts = rows.where("event_type = 'player_death'").select(F.col("sample_id").alias("episode_id"), "round_id", "ms")
    return sc.assemble_episodes(starts, rows, ["round_id"], "ms", "ms", "sample_id", -3_600_000.0, 1_800_000.0).withColumn("offset_ms", F.col("offset_ms").cast("double"))


@query(
    "jn09_whole_episodes",
    """with e as (select event_id as episode_id, round_id, t_us / 1000.0 as at_ms, [attacker_id, victim_id] as own from combat_events where event_type = 'player_death'),
s as (select sample_id, round_id, session_id, game_ms + epoch_us(round_id::timestamp) / 1000.0 as game_ms, x, y from state_samples), i as (select interaction_id, round_id, game_ms + epoch_us(round_id::timestamp) / 1000.0 as game_ms, x from scene_interactions),
rows as (select 'samples' as source, round_id, session_id as entity, game_ms, sample_id as row_id, round(x, 3) as v from s union all select 'players', round_id, null, game_ms, sample_id, round(y, 3) from s
  union all select 'interactions', round_id, null, game_ms, interaction_id, round(x, 3) from i union all select 'explosions', round_id, null, t_us / 1000.0, event_id, round(damage, 3) from combat_events where event_type = 'projectile_hit'),
m as (select episode_id, source, row_id, game_ms - at_ms as offset_ms, v from e join rows on rows.round_id = e.round_id and game_ms - at_ms between -3600000 and 1800000 and (entity is null or list_contains(own, entity))),
n as (select *, row_number() over (partition by episode_id, source order by offset_ms, row_id) as nth from m)
select episode_id, source, nth, row_id, round(offset_ms, 3) as offset_ms, v as value from n where source in ('interactions', 'explosions') or nth <= 12""",
)
def whole(s):
    day = F.unix_micros(F.col("round_id").cast("timestamp")) / 1000.0  # the rounds' clocks start at midnight
    samples = s.state_samples.select("sample_id", "round_id", "session_id", (F.col("game_ms") + day).alias("game_ms"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
    touched = s.scene_interactions.select("interaction_id", "round_id", (F.col("game_ms") + day).alias("game_ms"), F.round("x", 3).alias("x"))
    combat = s.combat_events.withColumn("game_ms", F.col("t_us") / 1000.0)
    blasts = combat.where("event_type = 'projectile_hit'").select("event_id", "round_id", "game_ms", F.round("damage", 3).alias("d"))
    deaths = combat.where("event_type = 'player_death'").select(F.col("event_id").alias("episode_id"), "round_id", "game_ms", F.array(F.col("attacker_id").cast("long"), F.col("victim_id").cast("long")).alias("entities"))
    sources = {
        "samples": sc.EpisodeSource(samples, "sample_id", ["x"], 12, "session_id"),
        "players": sc.EpisodeSource(samples, "sample_id", ["y"], 12),
        "interactions": sc.EpisodeSource(touched, "interaction_id", ["x"], None),
        "explosions": sc.EpisodeSource(blasts, "event_id", ["d"], None),
    }
    number = lambda v: F.coalesce(*(F.get_json_object(v, f"$.{k}").cast("double") for k in ("x", "y", "d")))
    out = sc.whole_episodes(deaths, sources, low=-3_600_000.0, high=1_800_000.0, decode=number)
    exact = F.rint(F.col("offset_ms") * 1000) / 1000  # whole microseconds: no ties, and far cheaper than a decimal for each match
    return out.select("episode_id", "source", "nth", "row_id", exact.alias("offset_ms"), "value")


def _features(s):
    return ts.movement(s.state_samples, ["session_id", "round_id"], "game_ms", "sample_id", 86_400.0, 0.001)


_Z = """m as (select session_id, round_id, count(*) as n, avg(x) as v from state_samples group by 1, 2),
d as (select *, median(v) over () as med from m where n > 1), z as (select *, median(abs(v - med)) over () as mad from d), w as (select *, 0.6745 * (v - med) / mad as robust_z from z)"""


@query("sc07_robust_z", f"with {_Z} select session_id, round_id, round(robust_z, 6) as robust_z from w")
def zscores(s):
    rows = s.state_samples.groupBy("session_id", "round_id").agg(F.count("*").alias("n"), F.avg("x").alias("v")).where("n > 1")
    return rounded(an.robust_z(rows, "v").select("session_id", "round_id", "robust_z"))


@query("job02_anomaly_windows", f"with {_Z} select session_id, round_id, round(robust_z, 6) as robust_z, round(least(1, abs(robust_z) / 4), 6) as confidence from w where abs(robust_z) >= 4")
def windows(s):
    rows = s.state_samples.groupBy("session_id", "round_id").agg(F.count("*").alias("n"), F.avg("x").alias("v")).where("n > 1").withColumn("coverage", F.lit(1.0))
    return rounded(an.pattern_matches(an.anomaly_windows(rows, "v", 4.0)).select("session_id", "round_id", "robust_z", "confidence"))


@query("top04_top_windows", f"with {_Z}, t as (select *, row_number() over (partition by round_id order by abs(robust_z) desc, session_id) as nth from w) select round_id, nth, session_id, round(robust_z, 6) as robust_z from t where nth <= 5")
def top_windows(s):
    rows = s.state_samples.groupBy("session_id", "round_id").agg(F.count("*").alias("n"), F.avg("x").alias("v")).where("n > 1")
    w = Window.partitionBy("round_id").orderBy(F.desc(F.abs("robust_z")), "session_id")
    return rounded(an.robust_z(rows, "v").withColumn("nth", F.row_number().over(w)).where("nth <= 5").select("round_id", "nth", "session_id", "robust_z"))


_SIG = "substr(sha256('a=' || printf('%.2f', (event_id % 7)::double) || ';b=' || printf('%.2f', (event_id % 5)::double)), 1, 24)"


def _matches(s):
    rows = s.combat_events.withColumns({"a": F.col("event_id") % 7, "b": F.col("event_id") % 5})
    return rows.select("event_id", "t_us", "round_id", F.col("attacker_id").alias("player_id"), an.window_signature(["b", "a"]).alias("signature"), (F.col("damage") / 500).alias("confidence"), F.col("weapon").alias("family"))


@query("sc13_signatures", f"select event_id, {_SIG} as signature from combat_events")
def signatures(s):
    return _matches(s).select("event_id", "signature")


@query("agg34_signature_rollup", f"select {_SIG} as signature, count(*) as occurrences, count(distinct attacker_id) as players, count(distinct round_id) as rounds, 'candidate' as state from combat_events group by 1")
def signature_rollup(s):
    return an.signature_rollup(_matches(s))


@query(
    "agg35_candidates",
    f"select {_SIG} as signature, count(*) as occurrences, round(max(damage / 500), 6) as confidence, min(t_us) as first_us, max(t_us) as last_us, arg_max(event_id, (t_us, event_id)) as last_evidence, count(*) >= 12 as confirmed from combat_events group by 1",
)
def candidates(s):
    return rounded(an.accumulate_candidates(_matches(s)))


@query("agg40_pattern_groups", f"with c as (select {_SIG} as signature, weapon as family, count(*) as occurrences, max(damage / 500) as confidence, case when count(*) >= 12 then 'confirmed' else 'open' end as state from combat_events group by 1, 2) select family, state, round(max(confidence), 6) as confidence, sum(occurrences)::bigint as occurrences, count(*) as evidence from c group by 1, 2")
def groups(s):
    rows = _matches(s).groupBy("signature", "family").agg(F.count("*").alias("occurrences"), F.max("confidence").alias("confidence"))
    return rounded(an.group_patterns(rows.withColumn("state", F.when(F.col("occurrences") >= 12, "confirmed").otherwise("open"))))


@query(
    "agg33_style_profiles",
    """with r as (select attacker_id as player_id, count(distinct round_id) as sessions, sum(damage) / count(distinct round_id) as damage_rate, count(*) / count(distinct round_id) as event_rate from combat_events group by 1)
select player_id, sessions, round(100 * cume_dist() over (order by damage_rate), 6) as damage_rate_percentile, round(100 * cume_dist() over (order by event_rate), 6) as event_rate_percentile, round(least(1, sessions / 10), 6) as confidence, sessions >= 10 as published from r""",
)
def styles(s):
    rows, damage = sums_in_order(s.combat_events, ["attacker_id"], "damage", "event_id")
    r = rows.groupBy(F.col("attacker_id").alias("player_id")).agg(F.count_distinct("round_id").alias("sessions"), (damage / F.count_distinct("round_id")).alias("damage_rate"), (F.count("*") / F.count_distinct("round_id")).alias("event_rate"))
    return rounded(an.style_profiles(r, "player_id", "sessions", ["damage_rate", "event_rate"]).drop("damage_rate", "event_rate"))


_COUNTERS = {
    "playtime_s": "count(*) * 7", "damage_dealt": "sum(value)", "damage_received": "sum(case when event_id % 3 = 0 then value end)", "deaths": "sum(case when event_type = 'error' then 1 else 0 end)",
    "melee_hits": "sum(case when event_type = 'click' then 1 else 0 end)", "kick_hits": "sum(case when event_id % 17 = 0 then 1 else 0 end)", "melee_swings": "sum(case when event_type in ('click', 'view') then 1 else 0 end)",
    "kick_swings": "sum(case when event_id % 9 = 0 then 1 else 0 end)", "projectile_hits": "sum(case when event_id % 11 = 0 then 1 else 0 end)", "shots_fired": "sum(case when event_id % 7 = 0 then 1 else 0 end)",
    "blocks": "sum(case when event_id % 13 = 0 then 1 else 0 end)", "rolls": "sum(case when event_id % 5 = 0 then 1 else 0 end)", "active_distance": "sum(case when value > 20 then value end)",
    "static_seconds": "sum(case when value < 5 then 3 else 0 end)", "combat_events": "sum(case when event_id % 2 = 0 then 1 else 0 end)",
}
_PLAYERS = "select user_id as player_id, count(distinct cast(ts as date)) as sessions, " + ", ".join(f"{v} as {k}" for k, v in _COUNTERS.items()) + " from events group by user_id"
_RATES = {
    "offense": "damage_dealt / greatest(playtime_s, 1)", "survival": "1 / greatest(deaths, 1)", "damage_efficiency": "damage_dealt / greatest(damage_received, 1)", "melee_precision": "(melee_hits + kick_hits) / greatest(melee_swings + kick_swings, 1)",
    "ranged_projectile_effectiveness": "projectile_hits / greatest(shots_fired, 1)", "defense": "blocks / greatest(playtime_s, 1)", "movement": "active_distance / greatest(playtime_s, 1)", "consistency": "(sessions >= 2)::int",
    "aggression": "combat_events / greatest(playtime_s, 1)", "staticness": "static_seconds / greatest(playtime_s, 1)", "block_roll_reliance": "(blocks + rolls) / greatest(playtime_s, 1)",
}


@query(
    "agg33_all_rates",
    f"with p as ({_PLAYERS}), r as (select player_id, sessions, " + ", ".join(f"round({v}, 9) as {k}" for k, v in _RATES.items()) + " from p) select player_id, sessions, " + ", ".join(f"round(100 * cume_dist() over (order by {k}), 6) as {k}_percentile" for k in _RATES) + ", round(least(1, sessions / 10), 6) as confidence, sessions >= 10 as published from r",
)
def all_rates(s):
    rates = an.style_rates(s.sql(_PLAYERS))
    rates = rates.select("player_id", "sessions", *(F.round(c, 9).alias(c) for c in an.STYLE_RATES))
    return rounded(an.style_profiles(rates, "player_id", "sessions", list(an.STYLE_RATES)).drop(*an.STYLE_RATES))


@query("win13_cohort_percentile", "select sample_id, round(100 * cume_dist() over (partition by session_id order by ping), 6) as percentile from network_samples")
def cohort(s):
    return rounded(s.network_samples.select("sample_id", an.cohort_percentile("ping", ["session_id"]).alias("percentile")))


@query(
    "sc19_drift",
    """with a as (select floor(ping / 25) as b, count(*) as n from network_samples where sample_id % 2 = 0 group by 1), z as (select floor(ping / 25) as b, count(*) as n from network_samples where sample_id % 2 = 1 group by 1),
s as (select greatest(coalesce(a.n / (select sum(n) from a), 0), 1e-6) as p, greatest(coalesce(z.n / (select sum(n) from z), 0), 1e-6) as q from a full join z using (b)) select round(sum((p - q) * ln(p / q)), 6) as psi, sum((p - q) * ln(p / q)) > 0.25 as drift from s""",
)
def drift(s):
    rows = s.network_samples.withColumn("b", F.floor(F.col("ping") / 25))
    psi = an.population_stability(rows.where("sample_id % 2 = 0"), rows.where("sample_id % 2 = 1"), "b")
    return rounded(psi.withColumn("drift", an.should_drift(F.lit(False), F.col("psi"), F.lit(1.0))))


@query("job03_isolation_forest")
def forest(s):
    rows = s.network_samples.select("sample_id", "ping", (F.col("session_id") % 24).alias("hour"))
    return rounded(an.isolation_scores(rows, "sample_id", ["ping", "hour"]))
