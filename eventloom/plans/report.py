"""Whole-day jobs: one Spark job for a range of days, day summaries and live summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import combat as cb
from ..operators import scene as sc
from ..operators import quality as ql
from ..operators import timeseries as ts
from ..sources.sinks import day_reports

DAY_US = 86_400_000_000


def day_of(time: str):
    """Civil day (UTC) of an epoch-microsecond time, as text."""
    return F.date_format(F.timestamp_micros(F.col(time)), "yyyy-MM-dd")


def recompute(tables: dict[str, DataFrame], first: str, last: str, clamp_s: float = 30.0) -> dict[str, DataFrame]:
    """Results of all days from ``first`` to ``last``: the day is a grouping column, so a range is one job.

    ``tables``: network_samples and combat_events; state_samples (with t_us), key_input and player_sessions, where given,
    add movement, inputs and population.  Every result has report_date.
    """
    def within(rows: DataFrame) -> DataFrame:
        return rows.withColumn("report_date", day_of("t_us")).where(F.col("report_date").between(first, last))

    pings = within(tables["network_samples"]).withColumn("series", F.concat_ws("|", "report_date", "session_id"))
    network = ts.ping_metrics(pings, "series", "t_us", "sample_id", "ping", clamp_s)
    network = network.withColumns({"report_date": F.substring_index("series", "|", 1), "session_id": F.substring_index("series", "|", -1).cast("long")}).drop("series")
    combat = within(tables["combat_events"])
    weapons = combat.groupBy("report_date", "weapon").agg(F.count("*").alias("events"), F.sum("damage").alias("damage"), F.avg("distance").alias("mean_distance"))
    pairs = combat.where("attacker_id <> victim_id").groupBy("report_date", F.least("attacker_id", "victim_id").alias("a"), F.greatest("attacker_id", "victim_id").alias("b")).agg(F.sum("damage").alias("damage"), F.count("*").alias("events"))
    out = {"network": network, "weapons": weapons, "pairs": pairs}
    if "state_samples" in tables:
        out["movement"] = ts.movement(within(tables["state_samples"]), ["report_date", "session_id"], "game_ms", "sample_id", clamp_s)
    if "key_input" in tables:
        keys = within(tables["key_input"]).withColumn("series", F.concat_ws("|", "report_date", "session_id"))
        inputs = ts.input_bursts(keys, "series", "t_us", "event_id")
        out["inputs"] = inputs.withColumns({"report_date": F.substring_index("series", "|", 1), "session_id": F.substring_index("series", "|", -1).cast("long")}).drop("series")
    if "player_sessions" in tables:
        out["population"] = day_population(tables["player_sessions"], first, last)
    return out


def day_population(sessions: DataFrame, first: str, last: str) -> DataFrame:
    """Per day of the range: sessions that overlap it, and distinct identities, humans and bots among them; open sessions last on.

    A session counts for a day if it joined before the day's end and had not left before its start.
    """
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    on = lambda us: F.to_date(F.timestamp_micros(us))
    start, end = F.greatest(on(F.col("joined_us")), low), F.least(F.coalesce(on(F.col("left_us")), high), high)
    rows = sessions.where(start <= end).select("session_id", "identity_id", "is_bot", F.explode(F.sequence(start, end)).alias("_day"))
    # one row for each identity and day first, so that plain counts remain
    each = rows.groupBy("_day", "identity_id", "is_bot").agg(F.count("*").alias("n"))
    known = F.col("identity_id").isNotNull()
    return each.groupBy(F.date_format("_day", "yyyy-MM-dd").alias("report_date")).agg(
        F.sum("n").alias("sessions"), F.count_if(known & ~F.col("is_bot")).alias("humans"), F.count_if(known & F.col("is_bot")).alias("bots"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unidentified")
    )


def summaries(results: dict[str, DataFrame], keep: int = 50) -> DataFrame:
    """One JSON summary per day: per section the largest ``keep`` rows and how many there are."""
    from pyspark.sql import Window

    order = {"network": "p95", "weapons": "damage", "pairs": "damage"}
    key = {"network": ["session_id"], "weapons": ["weapon"], "pairs": ["a", "b"]}
    days, sections = None, {}
    for name, rows in results.items():
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("report_date").orderBy(F.desc(order[name]), *key[name]))).withColumn("total", F.count("*").over(Window.partitionBy("report_date")))
        sections[name] = ranked.where(F.col("rank") <= keep).select("report_date", "rank", "total", *[c for c in rows.columns if c != "report_date"])
        days = rows.select("report_date") if days is None else days.unionByName(rows.select("report_date"))
    return day_reports(days, "report_date", sections, ("network",))


def scene_overview(interactions: DataFrame, objects: DataFrame, samples: DataFrame, windows: DataFrame, events: DataFrame, rules=sc.DEFAULT_RULES, cell: float = 50.0) -> DataFrame:
    """What happened in a scene, section by section: section, key, n; the long sections have their most frequent keys only.

    ``interactions``: interaction, player_id, target_id, x, y; ``objects``: object_id, name; ``samples``:
    vx, vy, category, is_missile; ``windows``: window_id, t_us, entities; ``events``: event_type.
    """
    named = sc.with_objects(interactions, objects, rules)
    key = lambda *cols: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))

    def section(name: str, counted: DataFrame, cols: list[str], keep: int | None = None) -> DataFrame:
        rows = counted.select(key(*cols).alias("key"), F.col("n").cast("long").alias("n"))
        rows = rows.orderBy(F.desc("n"), "key").limit(keep) if keep else rows
        return rows.select(F.lit(name).alias("section"), "key", "n")

    usage = named.withColumn("object_name", F.coalesce("object_name", F.lit("unknown")))
    source = F.when(F.coalesce(F.col("player_id").cast("string"), F.lit("")) != "", F.concat(F.lit("player:"), F.col("player_id").cast("string"))).otherwise("scene_source")
    environmental = ("object_damage_player", "object_damage_explosion", "object_impact_object")
    life = ("object_created", "object_terminated", "projectile_created", "projectile_hit", "explosion_hit")
    latest = windows.orderBy(F.desc("t_us"), F.desc("window_id")).limit(200)
    sections = [
        section("interactions_by_type", sc.counts_by(named, "interaction"), ["interaction"]),
        section("object_categories", sc.counts_by(named, "category"), ["category"]),
        section("interaction_heatmap", sc.heatmap(interactions.where("x is not null and y is not null"), cell).withColumns({c: F.col(c).cast("long") for c in ("cell_x", "cell_y")}), ["cell_x", "cell_y"], 500),
        section("object_usage", sc.counts_by(usage, "object_name", "category"), ["object_name", "category"], 50),
        section("interaction_graph", sc.counts_by(named.withColumn("source", source), "source", "interaction", "category"), ["source", "interaction", "category"], 100),
        section("trajectory_clusters", sc.trajectory_clusters(samples, "category", "is_missile"), ["category", "speed_bucket", "octant", "is_missile"], 50),
        section("lifecycle", sc.counts_by(events.where(F.col("event_type").isin(*life)), "event_type"), ["event_type"]),
        section("episodes", latest.withColumn("n", F.col("entities")), ["window_id"]),
        section("totals", interactions.agg(F.count("*").alias("n")).withColumn("name", F.lit("interactions")), ["name"]),
        section("totals", samples.agg(F.count("*").alias("n")).withColumn("name", F.lit("samples")), ["name"]),
        section("totals", interactions.agg(F.count_if(F.col("interaction").isin(*environmental)).alias("n")).withColumn("name", F.lit("environmental_damage")), ["name"]),
    ]
    out = sections[0]
    for rows in sections[1:]:
        out = out.unionByName(rows)
    return out


def close_episodes(episodes: DataFrame, now_us: int) -> DataFrame:
    """Selected episodes created before ``now_us`` get it as their end, unless they have one."""
    due = (F.col("status") == "selected") & (F.col("created_us") < now_us)
    return episodes.withColumn("closed_us", F.coalesce("closed_us", F.when(due, F.lit(now_us))))


def confirm_patterns(candidates: DataFrame, least: int = 12) -> DataFrame:
    """Candidates seen ``least`` times (two at least) are confirmed."""
    return candidates.withColumn("state", F.when(F.col("occurrences") >= max(2, least), "confirmed").otherwise(F.col("state")))


def live_summary(minutes: DataFrame, sessions: DataFrame, events: DataFrame, checkpoint: int, now_us: int) -> DataFrame:
    """One row: population of the live window, freshness and incidents."""
    people = ql.with_identity(minutes, sessions).agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("identity_id").alias("identities"), F.count_distinct(F.when(F.col("identity_quality") == "unmapped_session", F.col("session_id"))).alias("unmapped"))
    state = ql.freshness(events, "sample_id", "t_us", checkpoint, now_us)
    out = people.crossJoin(F.broadcast(state))
    incidents = F.array_compact(F.array(F.when(F.col("unmapped") > 0, "unmapped_sessions"), F.when(F.col("state") == "behind", "backlog")))
    return out.withColumn("incidents", F.array_join(incidents, ","))


def kill_table(combat: DataFrame) -> DataFrame:
    """Kills, assists and deaths per session with the default attribution."""
    return cb.kill_credit(cb.attribute_deaths(combat))
