"""Sessions, visits, retention, and what surrounded a leave.

Session tables have session_id, identity_id (null: unknown), joined_us, left_us (null: still
open), is_bot and reason.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def day_bounds(days: DataFrame, day: str, zone: str) -> DataFrame:
    """UTC bounds of local civil days: 23 or 25 hours where the clock changes."""
    start = F.to_utc_timestamp(F.col(day).cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add(F.col(day), 1).cast("timestamp"), zone)
    return days.withColumns({"start_us": F.unix_micros(start), "end_us": F.unix_micros(end)})


def overlaps(start_us: int, end_us: int) -> Column:
    """Sessions that touch [start, end); open sessions count, and so does leaving at start."""
    return (F.col("joined_us") < end_us) & (F.coalesce("left_us", F.lit(end_us)) >= start_us)


def overlap_seconds(start_us: int, end_us: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.coalesce("left_us", F.lit(end_us)), F.lit(end_us)) - F.greatest("joined_us", F.lit(start_us))) / 1e6


def stitch_visits(sessions: DataFrame, gap_s: float, start_us: int, end_us: int) -> DataFrame:
    """Sessions of an identity merged where one starts within ``gap_s`` of the end so far.

    Ends are clamped to [start, end]; a visit with an open session is censored.
    """
    left = F.greatest("joined_us", F.coalesce("left_us", F.lit(end_us)))
    rows = sessions.where(F.col("identity_id").isNotNull() & overlaps(start_us, end_us)).withColumn("_left", left)
    w = Window.partitionBy("identity_id").orderBy("joined_us", "session_id")
    far = F.max("_left").over(w.rowsBetween(Window.unboundedPreceding, -1)) + int(gap_s * 1e6)
    rows = rows.withColumn("_new", F.when(F.col("joined_us") <= far, 0).otherwise(1))
    rows = rows.withColumn("visit", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("identity_id", "visit").agg(
        F.greatest(F.min("joined_us"), F.lit(start_us)).alias("start_us"),
        F.least(F.max("_left"), F.lit(end_us)).alias("end_us"),
        F.count("*").alias("sessions"),
        F.max(F.col("left_us").isNull()).alias("censored"),
    )


def active_players(sessions: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """One row: active, new (first seen since start) and returning identities of [start, end)."""
    seen = sessions.where("identity_id is not null and not is_bot").groupBy("identity_id").agg(F.min("joined_us").alias("first"))
    active = sessions.where(F.col("identity_id").isNotNull() & ~F.col("is_bot") & overlaps(start_us, end_us)).select("identity_id").distinct()
    rows = seen.join(active, "identity_id", "left_semi")
    return rows.agg(F.count("*").alias("active"), F.count_if(F.col("first") >= start_us).alias("new"), F.count_if(F.col("first") < start_us).alias("returning"))


def rolling_actives(sessions: DataFrame, end_us: int, days: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """One row: distinct identities with a session in the last n days before ``end_us``."""
    rows = sessions.where("identity_id is not null and not is_bot")
    return rows.agg(*(F.count_distinct(F.when(overlaps(end_us - n * DAY_US, end_us), F.col("identity_id"))).alias(f"active_{n}d") for n in days))


def cohort_retention(sessions: DataFrame, start_us: int, days: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """Per n: identities that joined on the day n days before ``start_us``, and how many are active on its day."""
    rows = sessions.where("identity_id is not null and not is_bot")
    n = F.explode(F.array(*map(F.lit, days))).alias("n")
    joined = rows.select("identity_id", "joined_us", n)
    low = F.lit(start_us) - F.col("n").cast("long") * DAY_US
    cohort = joined.where((F.col("joined_us") >= low) & (F.col("joined_us") < low + DAY_US)).select("n", "identity_id").distinct()
    active = rows.where(overlaps(start_us, start_us + DAY_US)).select("identity_id").distinct().withColumn("back", F.lit(1))
    found = cohort.join(active, "identity_id", "left").groupBy("n").agg(F.count("*").alias("cohort"), F.count("back").alias("returned"))
    every = sessions.sparkSession.createDataFrame([(d,) for d in days], "n int")
    out = every.join(found, "n", "left").na.fill(0, ["cohort", "returned"])
    return out.withColumn("rate", F.try_divide("returned", "cohort"))


def last_before(left: DataFrame, right: DataFrame, key: str, at: str, time: str, row_id: str, values: Sequence[str]) -> DataFrame:
    """As-of join: for each left row the right row of its key with the largest (time, id) not after ``at``.

    Both sides are merged by one sort per key and the last right row is carried forward, so
    a key with many rows on both sides costs no more than its rows.
    """
    side = right.select(F.col(key).alias("_key"), F.col(time).alias("_at"), F.lit(0).alias("_side"), F.col(row_id).alias("_id"), F.struct(F.col(time).alias("time"), *values).alias("_right"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"))
    own = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[row_id].dataType).alias("_id"), F.lit(None).cast(side.schema["_right"].dataType).alias("_right"), F.struct(*left.columns).alias("_left"))
    w = Window.partitionBy("_key").orderBy("_at", "_side", "_id").rowsBetween(Window.unboundedPreceding, 0)
    merged = side.unionByName(own).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return merged.select("_left.*", F.col("_found.time").alias(f"last_{time}"), *(F.col(f"_found.{v}").alias(f"last_{v}") for v in values))


def leave_context(sessions: DataFrame, deaths: DataFrame, pings: DataFrame, limits_s: Sequence[int] = (10, 30, 60), high_ping: float = 150.0) -> DataFrame:
    """Per closed session: seconds since its last death and its last ping before leaving, as flags.

    ``deaths``: session_id, t_us, event_id; ``pings``: session_id, t_us, sample_id, ping.
    """
    closed = sessions.where("left_us is not null").select("session_id", "left_us")
    rows = last_before(closed, deaths, "session_id", "left_us", "t_us", "event_id", []).withColumnRenamed("last_t_us", "death_us")
    rows = last_before(rows, pings, "session_id", "left_us", "t_us", "sample_id", ["ping"])
    age = (F.col("left_us") - F.col("death_us")) / 1e6
    flags = [F.coalesce(age <= s, F.lit(False)).alias(f"death_within_{s}s") for s in limits_s]
    return rows.select("session_id", F.col("death_us").alias("last_death_us"), "last_ping", *flags, F.coalesce(F.col("last_ping") >= high_ping, F.lit(False)).alias("high_ping"))


def display_name(character: Column, account: Column, identity: Column, joined: Column) -> Column:
    """Aggregate: first known character name, else first account name, else 'Player ' and the id's end."""
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), joined))
    return F.coalesce(first(character), first(account), F.concat(F.lit("Player "), F.right(F.max(identity.cast("string")), F.lit(6))))


def player_day(sessions: DataFrame, visits: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """One row per identity of [start, end): sessions, playtime, visits, completed visit lengths, leave reasons."""
    rows = sessions.where(F.col("identity_id").isNotNull() & overlaps(start_us, end_us))
    base = rows.groupBy("identity_id").agg(
        display_name(F.col("character_name"), F.col("account_name"), F.col("identity_id"), F.struct("joined_us", "session_id")).alias("name"),
        F.count("*").alias("sessions"),
        F.count_if(F.col("left_us").isNull()).alias("open_sessions"),
        F.sum(overlap_seconds(start_us, end_us)).alias("playtime_s"),
    )
    length = F.when(~F.col("censored"), (F.col("end_us") - F.col("start_us")) / 1e6)
    of_visits = visits.groupBy("identity_id").agg(F.count("*").alias("visits"), F.count_if("censored").alias("censored_visits"), F.avg(length).alias("visit_mean_s"), F.percentile(length, 0.5).alias("visit_p50_s"), F.percentile(length, 0.9).alias("visit_p90_s"))
    reasons = rows.where("left_us is not null").groupBy("identity_id", "reason").count().groupBy("identity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("leave_reasons"))
    return base.join(of_visits, "identity_id", "left").join(reasons, "identity_id", "left")


def round_metrics(rounds: DataFrame, players: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per round: slots, joined sessions, distinct humans and bots, unidentified, late joins, duration, result quality."""
    joined = players.join(sessions.select("session_id", "identity_id", "is_bot"), "session_id", "left")
    # one sort by round, identity and session, streamed: a session or identity counts where it first appears, and no table of them is held
    order = Window.partitionBy("round_id").orderBy("is_bot", "identity_id", "session_id")
    again = lambda *names: functools.reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.lag(n).over(order)) for n in names))
    firsts = joined.select("round_id", "is_bot", "late_join", F.col("identity_id").isNotNull().alias("known"), (F.col("session_id").isNotNull() & ~again("session_id")).alias("session"), (~again("is_bot", "identity_id")).alias("identity"))
    per = firsts.groupBy("round_id").agg(
        F.count_if("session").alias("joined_sessions"),
        F.count_if(F.col("identity") & F.col("known") & ~F.col("is_bot")).alias("humans"),
        F.count_if(F.col("identity") & F.col("known") & F.col("is_bot")).alias("bots"),
        F.count_if(F.col("session") & ~F.col("known")).alias("unidentified"),
        F.count_if("late_join").alias("late_joins"),
    )
    out = rounds.join(per, "round_id", "left").na.fill(0, ["joined_sessions", "humans", "bots", "unidentified", "late_joins"])
    quality = F.coalesce("result_source", F.lit("inferred"))
    return out.select("round_id", F.col("player_count").alias("slots"), "joined_sessions", "humans", "bots", "unidentified", "late_joins", (F.col("duration_ms") / 1000).alias("duration_s"), quality.alias("result_quality"))


def map_rollup(rounds: DataFrame) -> DataFrame:
    return rounds.groupBy("map").agg(F.count("*").alias("rounds"), (F.avg("duration_ms") / 1000).alias("avg_duration_s"))


def hourly_timeline(rounds: DataFrame) -> DataFrame:
    """Rounds, players and seconds per hour (epoch hours) of the rounds' starts."""
    return rounds.groupBy(F.floor(F.col("started_us") / 3_600_000_000).alias("hour")).agg(F.count("*").alias("rounds"), F.sum("player_count").alias("players"), (F.sum("duration_ms") / 1000).alias("duration_s"))


def session_summary(sessions: DataFrame, rounds_of: DataFrame, pings: DataFrame, server_end: DataFrame) -> DataFrame:
    """Per session: duration (open ones up to the server's last event), rounds and ping range; each side aggregated first."""
    r = rounds_of.groupBy("session_id").agg(F.count_distinct("round_id").alias("rounds"))
    p = pings.groupBy("session_id").agg(F.avg("ping").alias("ping_avg"), F.min("ping").alias("ping_min"), F.max("ping").alias("ping_max"))
    out = sessions.join(server_end, "server", "left").join(r, "session_id", "left").join(p, "session_id", "left")
    return out.select("session_id", ((F.coalesce("left_us", "end_us") - F.col("joined_us")) / 1e6).alias("duration_s"), F.coalesce("rounds", F.lit(0)).alias("rounds"), "ping_avg", "ping_min", "ping_max")


def player_retention(sessions: DataFrame) -> DataFrame:
    """Per identity: sessions, seconds played in closed ones, and whole days between first and last join."""
    rows = sessions.where("identity_id is not null")
    return rows.groupBy("identity_id").agg(F.count("*").alias("sessions"), F.sum((F.col("left_us") - F.col("joined_us")) / 1e6).alias("playtime_s"), whole_days(F.min("joined_us"), F.max("joined_us")).alias("observed_days"))


def ping_distribution(samples: DataFrame, entity: str, value: str, row_id: str) -> DataFrame:
    """Per entity: mean, range, rank-based median and samples above fixed levels."""
    w = Window.partitionBy(entity)
    ranked = samples.withColumns({"rn": F.row_number().over(w.orderBy(value, row_id)), "n": F.count("*").over(w)})
    middle = (F.col("rn") == F.floor((F.col("n") + 1) / 2)) | (F.col("rn") == F.floor((F.col("n") + 2) / 2))
    return ranked.groupBy(entity).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(F.when(middle, F.col(value))).alias("median"), *(F.count_if(F.col(value) > x).alias(f"over_{x}") for x in (100, 150, 200, 250)))


def leaves_during(rounds: DataFrame, sessions: DataFrame, width_us: int = 3_600_000_000) -> DataFrame:
    """Per round with any: leaves of its server's sessions while it ran, met in time buckets."""
    ends = rounds.select("round_id", F.col("map").alias("server"), "started_us", (F.col("started_us") + F.col("duration_ms") * 1000).alias("ended_us"))
    left = sessions.where("left_us is not null").select("server", "left_us")
    spans = ends.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("started_us") / width_us), F.floor(F.col("ended_us") / width_us))))
    met = spans.join(left.withColumn("bucket", F.floor(F.col("left_us") / width_us)), ["server", "bucket"]).where("left_us between started_us and ended_us")
    return met.groupBy("round_id").agg(F.count("*").alias("leaves"))


def left_of(events: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Events with the time at which their session was left."""
    return events.join(sessions.select(session, "left_us"), session, "left")


def whole_days(first_us: Column, last_us: Column) -> Column:
    return F.floor((last_us - first_us) / DAY_US)


def map_quality(rounds: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per map: rounds, mean duration and players, and leaves while a round of its server ran.

    Leaves are matched to rounds first and counted once per round, so averages aren't weighted.
    """
    return rounds.join(leaves_during(rounds, sessions), "round_id", "left").groupBy("map").agg(F.count("*").alias("rounds"), (F.avg("duration_ms") / 1000).alias("avg_seconds"), F.avg("player_count").alias("avg_players"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"))
