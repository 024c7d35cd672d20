"""Queries of the time-series and quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators import timeseries as ts
from ..operators.ranks import exact_percentiles
from .shapes import query

DAY = 86_400.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_STEPS = """
st as (select *, lag(ping) over w as prev, least(86400.0, greatest(0.0, (t_us - lag(t_us) over w) / 1e6)) as dt, abs(ping - lag(ping) over w) as step {more}
  from {source} window w as (partition by session_id order by t_us, sample_id)),
isl as (select *, sum(case when prev > 100 then 0 else 1 end) over (partition by session_id order by t_us, sample_id rows unbounded preceding) as island from st),
hi as (select session_id, max(s) as longest_high from (select session_id, island, sum(dt) as s from isl where prev > 100 group by all) group by session_id)
"""
_PING = """count(ping) as samples, round(avg(ping), 6) as mean, round(min(ping), 6) as "min", round(max(ping), 6) as "max", round(stddev_pop(ping), 6) as stddev,
  round(quantile_cont(ping, 0.5), 6) as p50, round(quantile_cont(ping, 0.9), 6) as p90, round(quantile_cont(ping, 0.95), 6) as p95, round(quantile_cont(ping, 0.99), 6) as p99,
  round(coalesce(avg(step), 0), 6) as jitter, count(*) filter (where step >= 50) as spikes_50, count(*) filter (where step >= 100) as spikes_100, count(*) filter (where step >= 150) as spikes_150,
  round(coalesce(sum(dt) filter (where prev > 100), 0), 6) as seconds_above_100, round(coalesce(sum(dt) filter (where prev > 150), 0), 6) as seconds_above_150,
  round(coalesce(sum(dt) filter (where prev > 200), 0), 6) as seconds_above_200, round(coalesce(sum(dt) filter (where prev > 250), 0), 6) as seconds_above_250"""


@query("agg02_ping_metrics", f"with {_STEPS.format(more='', source='network_samples')} select st.session_id, {_PING}, round(coalesce(max(longest_high), 0), 6) as longest_high from st left join hi using (session_id) group by st.session_id")
def ping_by_session(s):
    return rounded(ts.ping_metrics(s.network_samples, "session_id", "t_us", "sample_id", "ping", DAY))


@query(
    "agg03_ping_by_player",
    f"with src as (select *, session_id % 40 as player from network_samples), {_STEPS.format(more='', source='src')}, hp as (select player, max(longest_high) as longest_high from (select distinct session_id, player from src) left join hi using (session_id) group by player) "
    f"select st.player, {_PING}, count(distinct session_id) as session_count, round(coalesce(max(longest_high), 0), 6) as longest_high from st left join hp using (player) group by st.player",
)
def ping_by_player(s):
    return rounded(ts.ping_metrics(s.network_samples.withColumn("player", F.col("session_id") % 40), "session_id", "t_us", "sample_id", "ping", DAY, group="player"))


@query(
    "agg01_percentiles",
    "select session_id, round(quantile_cont(ping, 0.5), 6) as p50, round(quantile_cont(ping, 0.9), 6) as p90, round(quantile_cont(ping, 0.95), 6) as p95, round(quantile_cont(ping, 0.99), 6) as p99 from network_samples group by 1",
)
def percentile_rows(s):
    return rounded(exact_percentiles(s.network_samples, ["session_id"], "ping", ts.PING_QUANTILES, ["p50", "p90", "p95", "p99"]).drop("n"))


@query(
    "win04_ranked_percentiles",
    "select session_id, round(quantile_cont(ping, 0.5), 6) as p50, round(quantile_cont(ping, 0.9), 6) as p90, round(quantile_cont(ping, 0.95), 6) as p95, round(quantile_cont(ping, 0.99), 6) as p99 from network_samples group by 1",
)
def ranked(s):
    return rounded(ts.ranked_percentiles(s.network_samples, "session_id", "ping", "sample_id"))


@query("win01_jitter", f"with {_STEPS.format(more='', source='network_samples')} select sample_id, round(step, 6) as step, round(dt, 6) as dt from st")
def jitter(s):
    return rounded(ts.sample_steps(s.network_samples, "session_id", "t_us", "sample_id", "ping", DAY).select("sample_id", "step", "dt"))


@query("win03_longest_high", f"with {_STEPS.format(more='', source='network_samples')} select session_id, round(longest_high, 6) as longest_high from hi")
def longest(s):
    return rounded(ts.longest_above(s.network_samples, "session_id", "t_us", "sample_id", "ping", 100.0, DAY))


@query(
    "win06_movement",
    """with a as (select *, row_number() over w = 1 as first, x - lag(x) over w as dx, y - lag(y) over w as dy, case when lag(game_ms) over w is not null then least(86400.0, greatest(0.0, (game_ms - lag(game_ms) over w) / 1000.0)) end as dt from state_samples window w as (partition by session_id, round_id order by game_ms, sample_id)),
b as (select *, sqrt(dx * dx + dy * dy) as len, case when dt > 0 then sqrt(dx * dx + dy * dy) / dt when dt = 0 then 0 end as speed,
  last_value(case when dx <> 0 or dy <> 0 then {'dx': dx, 'dy': dy} end ignore nulls) over (partition by session_id, round_id order by game_ms, sample_id rows between unbounded preceding and 1 preceding) as h from a),
c as (select *, abs(speed - lag(speed) over (partition by session_id, round_id order by game_ms, sample_id)) as dspeed, coalesce(dx * h.dx + dy * h.dy < 0, false) as turned from b)
select session_id, round_id, count(*) as samples, round(coalesce(sum(len), 0), 6) as distance, round(coalesce(sum(len) filter (where speed >= 0.001), 0), 6) as active_distance,
 round(coalesce(sum(dt) filter (where not speed >= 0.001), 0), 6) as static_seconds, round(coalesce(avg(speed), 0), 6) as mean_speed, round(coalesce(max(speed), 0), 6) as max_speed,
 round(coalesce(avg(dspeed), 0), 6) as mean_speed_change, round(coalesce(max(dspeed), 0), 6) as max_speed_change, round(coalesce(sum(abs(dy)), 0), 6) as vertical,
 round(coalesce(sum(dt) filter (where airborne), 0), 6) as airtime, count(*) filter (where turned) as direction_switches, (count(*) > 1)::int::double as coverage
from c group by 1, 2""",
)
def movement(s):
    return rounded(ts.movement(s.state_samples, ["session_id", "round_id"], "game_ms", "sample_id", DAY, 0.001))


@query(
    "win08_state_durations",
    """with a as (select session_id, least(86400.0, greatest(0.0, (game_ms - lag(game_ms) over w) / 1000.0)) as dt, lag(airborne) over w as pa, lag(rolling) over w as pr, round_id from state_samples window w as (partition by session_id, round_id order by game_ms, sample_id)),
u as (select session_id, round_id, dt, 'airborne' as state from a where pa union all select session_id, round_id, dt, 'rolling' from a where pr)
select session_id, round_id, state, round(sum(dt), 6) as seconds from u group by 1, 2, 3""",
)
def durations(s):
    return rounded(ts.state_durations(s.state_samples, ["session_id", "round_id"], "game_ms", "sample_id", ["airborne", "rolling"], DAY))


@query(
    "agg19_counter_deltas",
    """select session_id, count(*) as snapshots, round(greatest(0, arg_max(shots, (t_us, event_id)) - arg_min(shots, (t_us, event_id))), 6) as shots, round(greatest(0, arg_max(jumps, (t_us, event_id)) - arg_min(jumps, (t_us, event_id))), 6) as jumps
from stat_snapshots group by 1 having count(*) >= 2""",
)
def counters(s):
    return rounded(ts.counter_deltas(s.stat_snapshots, "session_id", "t_us", "event_id", ["shots", "jumps"]))


@query(
    "src18_snapshot_deltas",
    """with b as (select *, last_value(case when checkpoint = 'round_start' then {'s': shots, 'j': jumps} end ignore nulls) over (partition by session_id, round_id order by event_id rows between unbounded preceding and 1 preceding) as base from stat_snapshots)
select event_id, round(shots - base.s, 6) as shots_delta, round(jumps - base.j, 6) as jumps_delta from b""",
)
def snapshots(s):
    return rounded(ts.snapshot_deltas(s.stat_snapshots, ["session_id", "round_id"], "event_id", "checkpoint", ["shots", "jumps"]).select("event_id", "shots_delta", "jumps_delta"))


@query(
    "win17_motion_deltas",
    """with a as (select *, sqrt(vx * vx + vy * vy) as intensity, greatest(1.0, game_ms - lag(game_ms) over w) / 1000.0 as dt0, lag(game_ms) over w as pg, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as distance from state_samples window w as (partition by session_id, round_id order by game_ms, sample_id)),
b as (select *, (intensity - lag(intensity) over (partition by session_id, round_id order by game_ms, sample_id)) / dt0 as acceleration from a)
select sample_id, round(distance, 6) as distance, round(intensity, 6) as intensity, round(acceleration, 6) as acceleration from b""",
)
def motion(s):
    return rounded(ts.motion_deltas(s.state_samples, ["session_id", "round_id"], "game_ms", "sample_id").select("sample_id", "distance", "intensity", "acceleration"))


@query(
    "win09_input_bursts",
    """with a as (select *, count(*) over (partition by session_id order by t_us range between 86400000000 preceding and current row) as c from key_input)
select session_id, count(*) as events, count(*) filter (where transition in ('Pressed', 'Released')) as transitions, count(*) filter (where c >= 5) as bursts,
  round(count(*) / greatest((max(t_us) - min(t_us)) / 60e6, 1.0 / 60), 6) as apm from a group by 1""",
)
def bursts(s):
    return rounded(ts.input_bursts(s.key_input, "session_id", "t_us", "event_id", DAY, 5))


@query("agg20_ping_report", f"with {_STEPS.format(more='', source='network_samples')} select session_id, count(*) as samples, round(avg(ping), 6) as mean, round(quantile_cont(ping, 0.95), 6) as p95, round(max(ping), 6) as max, count(*) filter (where step >= 100) as spikes from st group by 1")
def report(s):
    m = ts.ping_metrics(s.network_samples, "session_id", "t_us", "sample_id", "ping", DAY)
    return rounded(m.select("session_id", "samples", "mean", "p95", "max", F.col("spikes_100").alias("spikes")))


@query("src04_first_per_key", "select seq, server, min(event_id) as event_id from envelopes group by 1, 2")
def unique_events(s):
    return q.first_per_key(s.envelopes, ["server", "seq"], "event_id").select("seq", "server", "event_id")


@query("win05_sequence_gaps", "with u as (select distinct server, seq from envelopes), g as (select server, lag(seq, 1, 0) over (partition by server order by seq) + 1 as expected, seq as observed from u) select *, observed - expected as missing from g where expected < observed")
def gaps(s):
    return q.sequence_gaps(s.envelopes, "server", "seq")


@query(
    "agg04_source_coverage",
    """with u as (select distinct server, seq from envelopes), g as (select server, lag(seq, 1, 0) over (partition by server order by seq) + 1 as expected, seq as observed from u),
m as (select server, count(*) as gap_count, sum(observed - expected)::bigint as missing from g where expected < observed group by 1)
select u.server, count(*) as event_count, max(gap_count) as gap_count, max(missing) as missing, round(count(*) / (count(*) + max(missing)), 6) as source_coverage from u join m using (server) group by 1""",
)
def coverage(s):
    return rounded(q.source_coverage(s.envelopes, "server", "seq"))


@query("src05_fresh_only", "select distinct seq, event_id from envelopes where event_id % 3 <> 0")
def fresh(s):
    done = s.envelopes.where("event_id % 3 = 0")
    return q.fresh_only(q.first_per_key(s.envelopes, ["server", "seq"], "event_id"), done, "server", "seq").select("seq", "event_id")


@query(
    "jn02_identity_quality",
    """select case when p.session_id is null then 'unmapped_session' when identity_id is not null then 'identified' when is_bot then 'unidentified_bot_session' else 'unidentified_human_session' end as identity_quality, count(*) as samples, round(avg(ping), 6) as mean
from network_samples n left join player_sessions p on n.sample_id = p.session_id group by 1""",
)
def identities(s):
    samples = s.network_samples.drop("session_id").withColumnRenamed("sample_id", "session_id")
    return rounded(q.with_identity(samples, s.player_sessions).groupBy("identity_quality").agg(F.count("*").alias("samples"), F.avg("ping").alias("mean")))


_POP = """count(*) as sessions, count(*) filter (where not is_bot) as human_sessions, count(*) filter (where is_bot) as bot_sessions, count(distinct identity_id) filter (where not is_bot) as human_identities, count(distinct identity_id) filter (where is_bot) as bot_identities,
 count(*) filter (where identity_id is null) as null_sessions, count(*) filter (where identity_id is null and not is_bot) as unidentified_human_sessions, count(*) filter (where identity_id is null and is_bot) as unidentified_bot_sessions,
 count(distinct identity_id) + count(*) filter (where identity_id is null) as player_entities, round(count(*) filter (where identity_id is not null and not is_bot) / count(*) filter (where not is_bot), 6) as human_coverage, round(count(*) filter (where identity_id is not null and is_bot) / count(*) filter (where is_bot), 6) as bot_coverage"""


@query("agg05_population", f"select {_POP} from player_sessions")
def populations(s):
    return rounded(q.population(s.player_sessions))


@query(
    "sc22_quality_rows",
    f"with p as (select {_POP} from player_sessions) select 'human_coverage' as key, human_coverage::double as value, case when human_coverage is null then 'unknown' when human_coverage < 0.95 then 'warn' else 'ok' end as severity from p union all select 'bot_coverage', bot_coverage::double, case when bot_coverage is null then 'unknown' when bot_coverage < 0.95 then 'warn' else 'ok' end from p union all select 'null_sessions', null_sessions::double, case when null_sessions > 0 then 'warn' else 'ok' end from p",
)
def quality_table(s):
    return rounded(q.quality_rows(q.population(s.player_sessions), ["human_coverage", "bot_coverage"], ["null_sessions"]))


@query(
    "job14_freshness",
    "select max(sample_id) as newest_id, count(*) filter (where sample_id > 900) as backlog, round((max(t_us) - max(t_us) filter (where sample_id <= 900)) / 1e6, 6) as lag_s, null::double as idle_s, 'behind' as state from network_samples",
)
def freshness(s):
    return rounded(q.freshness(s.network_samples, "sample_id", "t_us", 900, 1_710_000_000_000_000))


@query("agg09_events_by_type", "select event_type, count(*) as events from combat_events group by 1")
def by_type(s):
    return s.combat_events.groupBy("event_type").agg(F.count("*").alias("events"))


@query("agg21_row_counts", "select 'orders' as table_name, count(*) as rows from orders union all select 'events', count(*) from events union all select 'lineitem', count(*) from lineitem")
def counts(s):
    return q.row_counts({n: s.table(n) for n in ("orders", "events", "lineitem")})
