"""Queries of the whole-day jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import report as rp
from .shapes import query
from .timeseries import rounded

_RANGE = ("2024-01-05", "2024-01-20")


def _results(s):
    return rp.recompute({"network_samples": s.network_samples, "combat_events": s.combat_events}, *_RANGE, clamp_s=86_400.0)


@query("job12_day_weapons", "select round_id as report_date, weapon, count(*) as events, round(sum(damage), 6) as damage, round(avg(distance), 6) as mean_distance from combat_events where round_id between '2024-01-05' and '2024-01-20' group by 1, 2")
def weapons(s):
    return rounded(_results(s)["weapons"])


@query("job12_day_pairs", "select round_id as report_date, least(attacker_id, victim_id) as a, greatest(attacker_id, victim_id) as b, round(sum(damage), 6) as damage, count(*) as events from combat_events where attacker_id <> victim_id and round_id between '2024-01-05' and '2024-01-20' group by 1, 2, 3")
def pairs(s):
    return rounded(_results(s)["pairs"])


@query(
    "job12_day_network",
    "with n as (select *, strftime(make_timestamp(t_us), '%Y-%m-%d') as report_date from network_samples), g as (select *, abs(ping - lag(ping) over (partition by report_date, session_id order by t_us, sample_id)) as step from n) select report_date, session_id, count(*) as samples, round(quantile_cont(ping, 0.95), 6) as p95, round(coalesce(avg(step), 0), 6) as jitter from g where report_date between '2024-01-05' and '2024-01-20' group by 1, 2",
)
def network(s):
    return rounded(_results(s)["network"].select("report_date", F.col("session_id"), "samples", "p95", "jitter"))


def _everything(s):
    midnight = F.unix_micros(F.col("round_id").cast("timestamp"))
    states = s.state_samples.withColumn("t_us", midnight + F.round(F.col("game_ms") * 1000).cast("long"))
    return rp.recompute({"network_samples": s.network_samples, "combat_events": s.combat_events, "state_samples": states, "key_input": s.key_input, "player_sessions": s.player_sessions}, *_RANGE, clamp_s=86_400.0)


@query(
    "job12_day_movement",
    "with m as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy from state_samples where round_id between '2024-01-05' and '2024-01-20' window w as (partition by round_id, session_id order by game_ms, sample_id)) select round_id as report_date, session_id, count(*) as samples, round(coalesce(sum(sqrt(dx * dx + dy * dy)), 0), 6) as distance from m group by 1, 2",
)
def day_movement(s):
    return rounded(_everything(s)["movement"].select("report_date", "session_id", "samples", "distance"))


@query(
    "job12_day_inputs",
    "with k as (select *, strftime(make_timestamp(t_us), '%Y-%m-%d') as report_date from key_input) select report_date, session_id, count(*) as events, count(*) filter (where transition in ('Pressed', 'Released')) as transitions, round(count(*) / greatest((max(t_us) - min(t_us)) / 60e6, 1 / 60), 6) as apm from k where report_date between '2024-01-05' and '2024-01-20' group by 1, 2",
)
def day_inputs(s):
    return rounded(_everything(s)["inputs"].select("report_date", "session_id", "events", "transitions", "apm"))


@query(
    "job12_day_population",
    "with d as (select unnest(generate_series(date '1998-05-01', date '1998-05-20', interval 1 day))::date as day), r as (select d.day, p.* from d join player_sessions p on p.joined_us < epoch_us((day + 1)::timestamp) and (p.left_us is null or p.left_us >= epoch_us(day::timestamp))) select strftime(day, '%Y-%m-%d') as report_date, count(*) as sessions, count(distinct case when not is_bot then identity_id end) as humans, count(distinct case when is_bot then identity_id end) as bots, count(*) filter (where identity_id is null) as unidentified from r group by 1",
)
def day_population(s):
    return rp.day_population(s.player_sessions, "1998-05-01", "1998-05-20")


@query("job13_day_summaries")
def summaries(s):
    return rp.summaries(_results(s))


@query("job13_live_summary", "select (select count(distinct session_id) from network_samples) as sessions, (select count(distinct identity_id) from network_samples join player_sessions using (session_id)) as identities, (select count(distinct session_id) from network_samples where session_id not in (select session_id from player_sessions)) as unmapped, max(sample_id) as newest_id, count(*) filter (where sample_id > 900) as backlog, 'behind' as state from network_samples")
def live(s):
    out = rp.live_summary(s.network_samples, s.player_sessions, s.network_samples, 900, 1_710_000_000_000_000)
    return out.select("sessions", "identities", "unmapped", "newest_id", "backlog", "state")
