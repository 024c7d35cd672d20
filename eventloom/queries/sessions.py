"""Queries of the session and combat operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import combat as c
from ..operators import sessions as se
from .shapes import query
from .timeseries import rounded

#: 1998-06-01 and the next day, 2001-08-02, in epoch microseconds.
DAY, NEXT, END = 896_659_200_000_000, 896_745_600_000_000, 996_710_400_000_000
_OVER = "joined_us < {e} and coalesce(left_us, {e}) >= {s}"
_HUMAN = "identity_id is not null and not is_bot"


@query("flt03_overlap", f"select session_id, round(greatest(0, least(coalesce(left_us, {NEXT}), {NEXT}) - greatest(joined_us, {DAY})) / 1e6, 6) as seconds from player_sessions where {_OVER.format(s=DAY, e=NEXT)}")
def overlap(s):
    return rounded(s.player_sessions.where(se.overlaps(DAY, NEXT)).select("session_id", se.overlap_seconds(DAY, NEXT).alias("seconds")))


@query("flt01_day_slice", f"select session_id from player_sessions where joined_us >= {DAY} and joined_us < {NEXT}")
def day_slice(s):
    return s.player_sessions.where((F.col("joined_us") >= DAY) & (F.col("joined_us") < NEXT)).select("session_id")


_VISITS = f"""r as (select *, greatest(joined_us, coalesce(left_us, {END})) as l from player_sessions where identity_id is not null and {_OVER.format(s=0, e=END)}),
n as (select *, case when joined_us <= max(l) over (partition by identity_id order by joined_us, session_id rows between unbounded preceding and 1 preceding) + 2592000000000 then 0 else 1 end as new from r),
v as (select *, sum(new) over (partition by identity_id order by joined_us, session_id rows unbounded preceding)::bigint as visit from n),
visits as (select identity_id, visit, greatest(min(joined_us), 0) as start_us, least(max(l), {END}) as end_us, count(*) as sessions, bool_or(left_us is null) as censored from v group by 1, 2)"""


@query("win10_visits", f"with {_VISITS} select * from visits")
def visits(s):
    return se.stitch_visits(s.player_sessions, 30 * 86400, 0, END)


@query(
    "agg06_active_players",
    f"with f as (select identity_id, min(joined_us) as first from player_sessions where {_HUMAN} group by 1), a as (select distinct identity_id from player_sessions where {_HUMAN} and {_OVER.format(s=DAY, e=NEXT)}) select count(*) as active, count(*) filter (where first >= {DAY}) as new, count(*) filter (where first < {DAY}) as returning from f semi join a using (identity_id)",
)
def actives(s):
    return se.active_players(s.player_sessions, DAY, NEXT)


@query(
    "agg07_rolling_actives",
    "select " + ", ".join(f"count(distinct identity_id) filter (where {_OVER.format(s=NEXT - n * 86_400_000_000, e=NEXT)}) as active_{n}d" for n in (1, 7, 30)) + f" from player_sessions where {_HUMAN}",
)
def rolling(s):
    return se.rolling_actives(s.player_sessions, NEXT)


@query(
    "agg08_cohort_retention",
    " union all ".join(
        f"select {n}::int as n, count(*) as cohort, count(a.identity_id) as returned, round(count(a.identity_id) / nullif(count(*), 0), 6) as rate from (select distinct identity_id from player_sessions where {_HUMAN} and joined_us >= {DAY - n * 86_400_000_000} and joined_us < {DAY - (n - 1) * 86_400_000_000}) k left join (select distinct identity_id from player_sessions where {_HUMAN} and {_OVER.format(s=DAY, e=NEXT)}) a using (identity_id)"
        for n in (1, 7, 30)
    ),
)
def cohorts(s):
    return rounded(se.cohort_retention(s.player_sessions, DAY))


def _session_like(s):
    """Users' deaths and pings against sessions that are users and leave at fixed instants."""
    left = s.network_samples.groupBy("session_id").agg((F.max("t_us") - 86_400_000_000).alias("left_us"))
    return left, s.combat_events.where("event_type = 'player_death'").select(F.col("victim_id").cast("long").alias("session_id"), "t_us", "event_id"), s.network_samples


@query(
    "win11_leave_context",
    """with l as (select session_id, max(t_us) - 86400000000 as left_us from network_samples group by 1),
d as (select l.session_id, max(t_us) as death_us from l join combat_events c on c.victim_id = l.session_id and c.event_type = 'player_death' and c.t_us <= l.left_us group by 1),
p as (select l.session_id, arg_max(ping, (t_us, sample_id)) as last_ping from l join network_samples n on n.session_id = l.session_id and n.t_us <= l.left_us group by 1)
select l.session_id, death_us as last_death_us, round(last_ping, 6) as last_ping, coalesce((left_us - death_us) / 1e6 <= 86400, false) as death_within_86400s, coalesce((left_us - death_us) / 1e6 <= 864000, false) as death_within_864000s, coalesce(last_ping >= 60, false) as high_ping
from l left join d using (session_id) left join p using (session_id)""",
)
def leaves(s):
    left, deaths, pings = _session_like(s)
    return rounded(se.leave_context(left, deaths, pings, (86400, 864000), 60.0))


@query(
    "jn06_last_ping_before_leave",
    "with l as (select session_id, max(t_us) - 86400000000 as left_us from network_samples group by 1) select l.session_id, arg_max(t_us, (t_us, sample_id)) filter (where t_us <= left_us) as last_t_us, round(arg_max(ping, (t_us, sample_id)) filter (where t_us <= left_us), 6) as last_ping from l left join network_samples n using (session_id) group by 1",
)
def asof(s):
    left, _, pings = _session_like(s)
    return rounded(se.last_before(left, pings, "session_id", "left_us", "t_us", "sample_id", ["ping"]).select("session_id", "last_t_us", "last_ping"))


@query(
    "agg17_player_day",
    f"""with {_VISITS},
b as (select identity_id, coalesce(arg_min(character_name, (joined_us, session_id)) filter (where character_name is not null), arg_min(account_name, (joined_us, session_id)) filter (where account_name is not null)) as name, count(*) as sessions, count(*) filter (where left_us is null) as open_sessions,
  round(sum(greatest(0, least(coalesce(left_us, {END}), {END}) - greatest(joined_us, 0)) / 1e6), 6) as playtime_s from player_sessions where identity_id is not null and {_OVER.format(s=0, e=END)} group by 1),
x as (select identity_id, count(*) as visits, count(*) filter (where censored) as censored_visits, round(avg((end_us - start_us) / 1e6) filter (where not censored), 6) as visit_mean_s, round(quantile_cont((end_us - start_us) / 1e6, 0.5) filter (where not censored), 6) as visit_p50_s, round(quantile_cont((end_us - start_us) / 1e6, 0.9) filter (where not censored), 6) as visit_p90_s from visits group by 1),
q as (select identity_id, string_agg(reason || '=' || n, ',' order by reason) as reasons from (select identity_id, reason, count(*) as n from player_sessions where identity_id is not null and left_us is not null and {_OVER.format(s=0, e=END)} group by 1, 2) group by 1)
select * from b left join x using (identity_id) left join q using (identity_id)""",
)
def player_day(s):
    rows = se.player_day(s.player_sessions, se.stitch_visits(s.player_sessions, 30 * 86400, 0, END), 0, END)
    text = F.array_join(F.transform(F.map_entries("leave_reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rounded(rows.withColumn("reasons", text).drop("leave_reasons"))


@query(
    "agg11_round_metrics",
    """with p as (select round_id, count(distinct rp.session_id) as joined_sessions, count(distinct identity_id) filter (where not is_bot) as humans, count(distinct identity_id) filter (where is_bot) as bots, count(distinct rp.session_id) filter (where identity_id is null) as unidentified, count(*) filter (where late_join) as late_joins
 from round_players rp left join player_sessions s using (session_id) group by 1)
select r.round_id, player_count as slots, coalesce(joined_sessions, 0) as joined_sessions, coalesce(humans, 0) as humans, coalesce(bots, 0) as bots, coalesce(unidentified, 0) as unidentified, coalesce(late_joins, 0) as late_joins, round(duration_ms / 1000, 6) as duration_s, coalesce(result_source, 'inferred') as result_quality from rounds r left join p using (round_id)""",
)
def rounds(s):
    return rounded(se.round_metrics(s.rounds, s.round_players, s.player_sessions))


@query("agg10_map_rollup", "select map, count(*) as rounds, round(avg(duration_ms) / 1000, 6) as avg_duration_s from rounds group by 1")
def maps(s):
    return rounded(se.map_rollup(s.rounds))


@query("agg39_hourly_timeline", "select started_us // 3600000000 as hour, count(*) as rounds, sum(player_count)::bigint as players, round(sum(duration_ms) / 1000, 6) as duration_s from rounds group by 1")
def hours(s):
    return rounded(se.hourly_timeline(s.rounds))


@query(
    "agg22_session_summary",
    """with e as (select server, max(joined_us) as end_us from player_sessions group by 1), r as (select session_id, count(distinct round_id) as rounds from round_players group by 1), p as (select sample_id as session_id, avg(ping) as a, min(ping) as i, max(ping) as x from network_samples group by 1)
select s.session_id, round((coalesce(left_us, end_us) - joined_us) / 1e6, 6) as duration_s, coalesce(rounds, 0) as rounds, round(a, 6) as ping_avg, round(i, 6) as ping_min, round(x, 6) as ping_max from player_sessions s left join e using (server) left join r using (session_id) left join p using (session_id)""",
)
def summaries(s):
    ends = s.player_sessions.groupBy("server").agg(F.max("joined_us").alias("end_us"))
    pings = s.network_samples.select(F.col("sample_id").alias("session_id"), "ping")
    return rounded(se.session_summary(s.player_sessions, s.round_players, pings, ends))


@query("agg23_player_retention", "select identity_id, count(*) as sessions, round(sum((left_us - joined_us) / 1e6), 6) as playtime_s, floor((max(joined_us) - min(joined_us)) / 86400000000)::bigint as observed_days from player_sessions where identity_id is not null group by 1")
def retention(s):
    return rounded(se.player_retention(s.player_sessions))


@query("agg24_ping_distribution", "select session_id, round(avg(ping), 9) as mean, round(min(ping), 9) as min, round(max(ping), 9) as max, round(median(ping), 9) as median, count(*) filter (where ping > 100) as over_100, count(*) filter (where ping > 150) as over_150, count(*) filter (where ping > 200) as over_200, count(*) filter (where ping > 250) as over_250 from network_samples group by 1")
def distribution(s):
    return rounded(se.ping_distribution(s.network_samples, "session_id", "ping", "sample_id"), 9)


@query(
    "agg25_map_quality",
    """with l as (select r.round_id, count(*) as leaves from rounds r join player_sessions s on s.server = r.map and s.left_us between r.started_us and r.started_us + r.duration_ms * 1000 group by 1)
select map, count(*) as rounds, round(avg(duration_ms) / 1000, 6) as avg_seconds, round(avg(player_count), 6) as avg_players, coalesce(sum(leaves), 0)::bigint as leaves from rounds left join l using (round_id) group by 1""",
)
def quality(s):
    return rounded(se.map_quality(s.rounds, s.player_sessions))


_HITS = """h as (select d.event_id as death_id, d.victim_id, h.event_id, h.t_us, h.attacker_id, h.damage, (d.t_us - h.t_us) / 1e6 as age_s from combat_events d join combat_events h on d.event_type = 'player_death' and h.event_type = 'player_damage'
 and h.victim_id = d.victim_id and h.round_id is not distinct from d.round_id and h.attacker_id <> h.victim_id and (h.t_us < d.t_us or (h.t_us = d.t_us and h.event_id < d.event_id)) and (d.t_us - h.t_us) / 1e6 <= 28800)"""
_KILLS = f"""{_HITS},
per as (select death_id, attacker_id, sum(damage * exp(-age_s / 14400)) as w, max((t_us, event_id)) as last, arg_max(age_s, (t_us, event_id)) as age_s from h group by 1, 2),
tot as (select death_id, sum(w) as total, count(*) as attackers, arg_max(attacker_id, last) as k, arg_max(w, last) as kw, arg_max(age_s, last) as kage from per group by 1),
ast as (select death_id, string_agg(attacker_id::varchar, ',' order by attacker_id) as a from per join tot using (death_id) where attacker_id <> k and w / total >= 0.15 group by 1),
kills as (select d.event_id as death_id, d.victim_id, d.round_id, case when kage <= 9000 then k end as killer_id, case when kage <= 2700 and (attackers = 1 or kw / total >= 0.5) then 'high' when kage <= 9000 then 'low' else 'unattributed' end as confidence, case when kage <= 9000 then coalesce(a, '') else '' end as assists
 from combat_events d left join tot on tot.death_id = d.event_id left join ast on ast.death_id = d.event_id where d.event_type = 'player_death')"""


def _kills(s):
    return c.attribute_deaths(s.combat_events, 28800, 9000, 2700, 14400)


@query("jn07_hits_before_deaths", f"with {_HITS} select death_id, event_id, attacker_id, round(age_s, 6) as age_s from h")
def hits(s):
    return rounded(c.hits_before_deaths(s.combat_events, 28800).select("death_id", "event_id", "attacker_id", "age_s"))


@query("job01_death_attribution", f"with {_KILLS} select * from kills")
def kills(s):
    return _kills(s).withColumn("assists", F.array_join(F.col("assists").cast("array<string>"), ","))


@query(
    "job01_kill_credit",
    f"with {_KILLS}, r as (select killer_id as session_id, 'k' as w from kills where killer_id is not null union all select victim_id, 'd' from kills union all select unnest(string_split(assists, ','))::int, 'a' from kills where assists <> '') select session_id::bigint as session_id, count(*) filter (where w = 'k') as kills, count(*) filter (where w = 'a') as assists, count(*) filter (where w = 'd') as deaths from r group by 1",
)
def credit(s):
    return c.kill_credit(_kills(s))


@query("agg16_combat_totals", f"with {_KILLS} select (select count(*) from combat_events) as events, round((select sum(damage) from combat_events where event_type <> 'player_death'), 6) as damage, count(*) as deaths, count(*) filter (where confidence = 'high') as kills_high, count(*) filter (where confidence = 'low') as kills_low, count(*) filter (where confidence = 'unattributed') as unattributed from kills")
def totals(s):
    return rounded(c.combat_totals(s.combat_events, _kills(s)))


@query(
    "agg12_combat_by_session",
    """with r as (select attacker_id::bigint as session_id, true as deals, event_type, damage, distance from combat_events where event_type <> 'player_death' union all select victim_id, false, event_type, damage, distance from combat_events where event_type <> 'player_death'),
m as (select session_id, coalesce(sum(damage) filter (where deals), 0) as dealt, coalesce(sum(damage) filter (where not deals), 0) as received, count(*) filter (where deals) as events, quantile_cont(distance, 0.5) filter (where deals) as md from r group by 1),
t as (select session_id, string_agg(event_type || '=' || printf('%.2f', d), ',' order by event_type) as by_type from (select session_id, event_type, sum(damage) as d from r where deals group by 1, 2) group by 1)
select session_id, round(dealt, 6) as dealt, round(received, 6) as received, events, round(md, 6) as median_distance, by_type, round(dealt / nullif(received, 0), 6) as efficiency from m left join t using (session_id)""",
)
def by_session(s):
    text = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], F.format_string("%.2f", e["value"]))), ",")
    return rounded(c.combat_by_session(s.combat_events).withColumn("by_type", text))


@query("agg13_directed_pairs", "select attacker_id, victim_id, round(sum(damage), 6) as damage, count(*) as events from combat_events where victim_id is not null group by 1, 2")
def pairs(s):
    return rounded(c.directed_pairs(s.combat_events))


@query("agg14_undirected_pairs", "select least(attacker_id, victim_id) as a, greatest(attacker_id, victim_id) as b, round(sum(damage), 6) as damage, count(*) as events from combat_events where attacker_id <> victim_id group by 1, 2")
def undirected(s):
    return rounded(c.undirected_pairs(c.directed_pairs(s.combat_events)))


@query("agg15_weapon_rollup", "select case when event_id % 5 = 0 then 'unknown' else weapon end as weapon, count(*) as events, round(sum(damage), 6) as damage, round(avg(distance), 6) as mean_distance from combat_events group by 1")
def weapons(s):
    rows = s.combat_events.withColumn("context", F.lit("")).withColumn("weapon", F.when(F.col("event_id") % 5 != 0, F.col("weapon")))
    return rounded(c.weapon_rollup(rows, ["weapon", "context"]))


@query(
    "top02_pairs",
    "with p as (select least(attacker_id, victim_id) as a, greatest(attacker_id, victim_id) as b, round(sum(damage), 6) as damage, count(*) as events from combat_events where attacker_id <> victim_id group by 1, 2) select *, row_number() over (order by damage desc, a, b) as rank, (select count(*) from p) as total, least(50, (select count(*) from p)) as shown from p order by damage desc, a, b limit 50",
)
def top_pairs(s):
    rows = rounded(c.undirected_pairs(c.directed_pairs(s.combat_events)))
    return c.top_with_total(rows, [F.desc("damage"), F.asc("a"), F.asc("b")], 50)
