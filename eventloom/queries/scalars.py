"""Queries of the scalar functions, simple predicates and plain joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import combat as cb
from ..operators import minute as mi
from ..operators import scene as sc
from ..operators import sessions as se
from ..operators import timeseries as ts
from ..operators.quality import live_labels, numbered
from .shapes import query
from .timeseries import rounded


@query("sc01_iso_times", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, epoch_us(date_trunc('second', ts)) as back_us from events")
def iso(s):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return s.events.select("event_id", text.alias("iso"), F.unix_micros(F.try_to_timestamp(text)).alias("back_us"))


@query("sc02_minute_bucket", "select event_id, epoch_us(date_trunc('minute', ts)) as minute_us from events")
def minute(s):
    return s.combat_events.select("event_id", mi.bucket("t_us").alias("minute_us"))


@query("sc03_window_index", "select event_id, epoch_us(ts) // 300000000 as window_index from events")
def index(s):
    return s.combat_events.select("event_id", F.floor(F.col("t_us") / 300_000_000).alias("window_index"))


@query("sc05_date_and_hour", "select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m-%dT%H') as hour from events")
def dates(s):
    return s.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour"))


@query("sc06_safe_divide", "select event_id, round(damage / nullif(victim_id % 5, 0), 6) as ratio from combat_events")
def divide(s):
    return rounded(s.combat_events.select("event_id", F.try_divide("damage", F.col("victim_id") % 5).alias("ratio")))


@query("sc08_speed", "select sample_id, round(sqrt(vx * vx + vy * vy), 6) as speed from state_samples")
def speed(s):
    return rounded(s.state_samples.select("sample_id", F.hypot("vx", "vy").alias("speed")))


@query("sc10_octant", "select sample_id, (floor((atan2(vy, vx) + pi()) / (pi() / 4)) % 8)::int as octant, floor(sqrt(vx * vx + vy * vy) / 2)::bigint as speed_bucket from state_samples")
def octants(s):
    return s.state_samples.select("sample_id", sc.octant(F.col("vx"), F.col("vy")).alias("octant"), F.floor(F.hypot("vx", "vy") / 2).alias("speed_bucket"))


@query("flt05_identified_humans", "select session_id from player_sessions where identity_id is not null and not is_bot")
def humans(s):
    return s.player_sessions.where("identity_id is not null and not is_bot").select("session_id")


@query("flt06_coverage_gate", "with f as (select session_id, round_id, (count(*) > 1)::int::double as coverage from state_samples group by 1, 2) select session_id, round_id from f where coverage >= 0.7")
def gate(s):
    return ts.movement(s.state_samples, ["session_id", "round_id"], "game_ms", "sample_id").where("coverage >= 0.7").select("session_id", "round_id")


@query("win02_time_above", "with w as (select session_id, lag(ping) over w as prev, least(30.0, greatest(0.0, (t_us - lag(t_us) over w) / 1e6)) as dt from network_samples window w as (partition by session_id order by t_us, sample_id)) select session_id, round(coalesce(sum(dt) filter (where prev > 100), 0), 6) as seconds from w group by 1")
def above(s):
    return rounded(ts.ping_metrics(s.network_samples, "session_id", "t_us", "sample_id", "ping").select("session_id", F.col("seconds_above_100").alias("seconds")))


@query("win15_latest_ping", "select session_id, sample_id, round(ping, 6) as ping from (select *, row_number() over (partition by session_id order by t_us desc, sample_id desc) as n from network_samples) where n = 1")
def latest(s):
    w = Window.partitionBy("session_id").orderBy(F.desc("t_us"), F.desc("sample_id"))
    return rounded(s.network_samples.withColumn("n", F.row_number().over(w)).where("n = 1").select("session_id", "sample_id", "ping"))


@query(
    "win16_live_labels",
    """with g as (select coalesce('identity:' || identity_id::varchar, 'session:' || attacker_id::varchar) as key, round(sum(damage), 3) as damage, count(*) as events from combat_events left join player_sessions on session_id = attacker_id group by 1)
select key, damage, events, printf('%s %03d', case when key like 'identity:%' then 'Player' else 'Session' end, row_number() over (order by damage desc, events desc, key desc)) as label from g""",
)
def live_labels_of_players(s):
    who = s.player_sessions.select(F.col("session_id").alias("attacker_id"), "identity_id")
    key = F.coalesce(F.concat(F.lit("identity:"), F.col("identity_id")), F.concat(F.lit("session:"), F.col("attacker_id")))
    return live_labels(s.combat_events.join(who, "attacker_id", "left").groupBy(key.alias("key")).agg(F.round(F.sum("damage"), 3).alias("damage"), F.count("*").alias("events")))


@query("win16_player_labels", "select session_id, printf('Player %03d', row_number() over (order by session_id)) as label from (select distinct session_id from network_samples)")
def labels(s):
    ids = s.network_samples.select("session_id").distinct()
    return numbered(ids, "session_id").select("session_id", F.format_string("Player %03d", "nth").alias("label"))


@query("agg26_combat_pairs", "select attacker_id, victim_id, count(*) as events, round(sum(damage), 6) as damage from combat_events where attacker_id is not null and victim_id is not null group by 1, 2 having sum(damage) > 100")
def pairs(s):
    return rounded(cb.directed_pairs(s.combat_events, ordered=True).where("damage > 100"))


@query("agg18_display_names", "select identity_id, coalesce(arg_min(character_name, (joined_us, session_id)) filter (where character_name is not null), arg_min(account_name, (joined_us, session_id))) as name from player_sessions where identity_id is not null group by 1")
def names(s):
    rows = s.player_sessions.where("identity_id is not null")
    return rows.groupBy("identity_id").agg(se.display_name(F.col("character_name"), F.col("account_name"), F.col("identity_id"), F.struct("joined_us", "session_id")).alias("name"))


@query("jn01_events_combat", "select e.event_type as kind, c.event_type, count(*) as n from events e join combat_events c using (event_id) group by 1, 2")
def joined(s):
    return s.events.select("event_id", F.col("event_type").alias("kind")).join(s.combat_events, "event_id").groupBy("kind", "event_type").agg(F.count("*").alias("n"))


@query("jn03_round_members", "select r.round_id, count(p.session_id) as members, count(s.session_id) as known from rounds r left join round_players p using (round_id) left join player_sessions s on s.session_id = p.session_id group by 1")
def members(s):
    rows = s.rounds.select("round_id").join(s.round_players, "round_id", "left").join(s.player_sessions.select("session_id", F.col("session_id").alias("known")), "session_id", "left")
    return rows.groupBy("round_id").agg(F.count("session_id").alias("members"), F.count("known").alias("known"))


@query("jn05_last_death_before_leave", "with l as (select session_id, max(t_us) - 86400000000 as left_us from network_samples group by 1) select l.session_id, max(c.t_us) as last_t_us from l left join combat_events c on c.victim_id = l.session_id and c.event_type = 'player_death' and c.t_us <= l.left_us group by 1")
def deaths(s):
    left = s.network_samples.groupBy("session_id").agg((F.max("t_us") - 86_400_000_000).alias("left_us"))
    died = s.combat_events.where("event_type = 'player_death'").select(F.col("victim_id").cast("long").alias("session_id"), "t_us", "event_id")
    return se.last_before(left, died, "session_id", "left_us", "t_us", "event_id", []).select("session_id", "last_t_us")


@query("jn08_next_action", "with i as (select interaction_id, round_id, player_id, game_ms from scene_interactions) select i.interaction_id, arg_min(s.sample_id, (s.game_ms, s.sample_id)) as near_sample from i left join state_samples s on s.round_id = i.round_id and s.session_id = i.player_id and s.game_ms between i.game_ms + 1000 and i.game_ms + 7200000 group by 1")
def following(s):
    left = s.scene_interactions.select("interaction_id", "round_id", F.col("player_id").cast("long").alias("session_id"), "game_ms")
    right = s.state_samples.select("round_id", F.col("session_id").cast("long").alias("session_id"), "game_ms", "sample_id", F.col("sample_id").alias("sample"))
    found = sc.nearest_within(left, right, ["round_id", "session_id"], "interaction_id", "game_ms", "game_ms", "sample_id", ["sample"], {"near": (1000.0, 7_200_000.0, False)})
    return left.select("interaction_id").join(found, "interaction_id", "left").select("interaction_id", F.col("near.sample").alias("near_sample"))


@query("jn10_active_semi", "select count(*) as n from (select distinct identity_id from player_sessions where identity_id in (select o_custkey from orders where o_orderkey % 100 = 1))")
def semi(s):
    active = s.orders.where("o_orderkey % 100 = 1").select(F.col("o_custkey").alias("identity_id"))
    return s.player_sessions.select("identity_id").distinct().join(active, "identity_id", "left_semi").agg(F.count("*").alias("n"))


@query(
    "jn10_active_on_day",
    "select count(*) as n from (select distinct identity_id from player_sessions where identity_id in (select identity_id from player_sessions where joined_us < epoch_us(timestamp '1998-06-02') and coalesce(left_us, epoch_us(timestamp '1998-06-02')) >= epoch_us(timestamp '1998-06-01')))",
)
def active_on_day(s):
    start, end = 896_659_200_000_000, 896_745_600_000_000  # 1998-06-01 and the day after
    active = s.player_sessions.where((F.col("joined_us") < end) & (F.coalesce("left_us", F.lit(end)) >= start)).select("identity_id")
    return s.player_sessions.select("identity_id").distinct().join(active, "identity_id", "left_semi").agg(F.count("*").alias("n"))


@query("jn12_label_lookup", "select e.event_id, n.n_name as nation from events e join nation n on n.n_nationkey = e.user_id % 25")
def lookup(s):
    return s.events.withColumn("k", F.col("user_id") % 25).join(s.nation, F.col("k") == F.col("n_nationkey")).select("event_id", F.col("n_name").alias("nation"))


@query("top05_rows_per_group", "select event_id, n from (select event_id, row_number() over (partition by round_id order by t_us, event_id)::int as n from combat_events) where n <= 12")
def per_group(s):
    w = Window.partitionBy("round_id").orderBy("t_us", "event_id")
    return s.combat_events.withColumn("n", F.row_number().over(w)).where("n <= 12").select("event_id", "n")


@query("agg04_day_quality", "select count(*) as samples, count(*) filter (where session_id % 7 = 0) as incomplete, round(count(*) filter (where identity_id is not null) / count(*), 6) as stable_identity from player_sessions")
def day_quality(s):
    return rounded(s.player_sessions.agg(F.count("*").alias("samples"), F.count_if(F.col("session_id") % 7 == 0).alias("incomplete"), F.try_divide(F.count_if(F.col("identity_id").isNotNull()), F.count("*")).alias("stable_identity")))


@query("jn11_stale_annotations", "select doc_id from labels where doc_id not in (select chat_id from chat_messages)")
def stale(s):
    return s.labels.join(s.chat_messages.select(F.col("chat_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")
