"""Data quality: sequence gaps, coverage, populations, freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import checkpointed


def first_per_key(events: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Keep the row with the smallest id of each key."""
    w = Window.partitionBy(*keys).orderBy(row_id)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sequence_gaps(events: DataFrame, source: str, seq: str, cell: int = 1 << 20) -> DataFrame:
    """Missing ranges of each source's sequence, which starts at 1: expected, observed, missing.

    Gaps are taken within ranges of ``cell`` numbers and between the ranges' ends, so that a source with
    most of the events is spread over many tasks.
    """
    cells = events.select(source, seq, F.floor(F.col(seq) / cell).alias("_cell")).distinct()
    inner = cells.withColumn("_before", F.lag(seq).over(Window.partitionBy(source, "_cell").orderBy(seq))).where("_before is not null")
    ends = cells.groupBy(source, "_cell").agg(F.min(seq).alias(seq), F.max(seq).alias("_last"))
    between = ends.withColumn("_before", F.lag("_last", 1, 0).over(Window.partitionBy(source).orderBy("_cell")))
    both = inner.select(source, seq, "_before").unionByName(between.select(source, seq, "_before")).withColumn("expected", F.col("_before") + 1)
    return both.where(F.col("expected") < F.col(seq)).select(source, "expected", F.col(seq).alias("observed"), (F.col(seq) - F.col("expected")).alias("missing"))


def numbered(rows: DataFrame, order: str | Sequence[str | Column], name: str = "nth", cell: int | None = None) -> DataFrame:
    """Rows numbered from 1 in any order (columns or sort expressions), without sorting all of them in one task.

    One exchange deals the rows to ranges of the order and a checkpoint fixes which row is where; rows are
    numbered within their range, from the sum of the ranges before.  Only one count for each range goes through one task.  ``cell`` is about how many
    rows a range should have; without it the session's number of shuffle partitions decides.
    Equal rows lie in one range and are numbered in any order, so the order should tell rows apart.
    """
    keys = [order] if isinstance(order, str) else list(order)
    parts = [] if cell is None else [max(1, -(-rows.count() // cell))]
    placed = checkpointed(rows.repartitionByRange(*parts, *keys).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return placed.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_own")).drop("_range", "_start", "_own")


def live_labels(players: DataFrame, key: str = "key") -> DataFrame:
    """Labels of live players (key, damage, events): by damage, events and key, largest first; keys of identities are players, others sessions."""
    ranked = numbered(players, [F.desc("damage"), F.desc("events"), F.desc(key)])
    kind = F.when(F.col(key).startswith("identity:"), "Player").otherwise("Session")
    return ranked.select(key, "damage", "events", F.format_string("%s %03d", kind, F.col("nth")).alias("label"))


def source_coverage(events: DataFrame, source: str, seq: str) -> DataFrame:
    """Per source: distinct events, gaps, missing events and n / (n + missing)."""
    gaps = sequence_gaps(events, source, seq).groupBy(source).agg(F.count("*").alias("gap_count"), F.sum("missing").alias("missing"))
    counts = events.groupBy(source).agg(F.count_distinct(seq).alias("event_count"))
    out = counts.join(gaps, source, "left").na.fill(0, ["gap_count", "missing"])
    return out.withColumn("source_coverage", F.try_divide("event_count", F.col("event_count") + F.col("missing")))


def fresh_only(events: DataFrame, processed: DataFrame, source: str, seq: str, high_water: bool = False) -> DataFrame:
    """Events not processed before: by key, or (``high_water``) above each source's highest sequence."""
    if not high_water:
        return events.join(processed.select(source, seq), [source, seq], "left_anti")
    marks = processed.groupBy(source).agg(F.max(seq).alias("_mark"))
    return events.join(marks, source, "left").where(F.col("_mark").isNull() | (F.col(seq) > F.col("_mark"))).drop("_mark")


def identity_quality(session: Column, identity: Column, is_bot: Column) -> Column:
    return (
        F.when(session.isNull(), F.lit("unmapped_session"))
        .when(identity.isNotNull(), F.lit("identified"))
        .when(is_bot, F.lit("unidentified_bot_session"))
        .otherwise(F.lit("unidentified_human_session"))
    )


def with_identity(samples: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Samples with their session's identity, bot flag and the quality of that mapping."""
    known = sessions.select(session, "identity_id", "is_bot", F.col(session).alias("_known"))
    return samples.join(known, session, "left").withColumn("identity_quality", identity_quality(F.col("_known"), F.col("identity_id"), F.col("is_bot"))).drop("_known")


def population(sessions: DataFrame) -> DataFrame:
    """One row: sessions and identities, human and bot, identified or not, and coverage."""
    human, bot, known = ~F.col("is_bot"), F.col("is_bot"), F.col("identity_id").isNotNull()
    return sessions.agg(
        F.count("*").alias("sessions"),
        F.count_if(human).alias("human_sessions"),
        F.count_if(bot).alias("bot_sessions"),
        F.count_distinct(F.when(human, F.col("identity_id"))).alias("human_identities"),
        F.count_distinct(F.when(bot, F.col("identity_id"))).alias("bot_identities"),
        F.count_if(~known).alias("null_sessions"),
        F.count_if(~known & human).alias("unidentified_human_sessions"),
        F.count_if(~known & bot).alias("unidentified_bot_sessions"),
        (F.count_distinct("identity_id") + F.count_if(~known)).alias("player_entities"),
        F.try_divide(F.count_if(known & human), F.count_if(human)).alias("human_coverage"),
        F.try_divide(F.count_if(known & bot), F.count_if(bot)).alias("bot_coverage"),
    )


def severity(ratio: Column | None = None, count: Column | None = None, least: float = 0.95) -> Column:
    """'warn' for a ratio below ``least`` or a positive count, 'unknown' for null, else 'ok'."""
    if ratio is not None:
        return F.when(ratio.isNull(), F.lit("unknown")).when(ratio < least, F.lit("warn")).otherwise(F.lit("ok"))
    return F.when(count.isNull(), F.lit("unknown")).when(count > 0, F.lit("warn")).otherwise(F.lit("ok"))


def quality_rows(measures: DataFrame, ratios: list[str], counts: list[str]) -> DataFrame:
    """A one-row table of measures as rows (key, value, severity)."""
    rows = [F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value"), severity(ratio=F.col(c)).alias("severity")) for c in ratios]
    rows += [F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value"), severity(count=F.col(c)).alias("severity")) for c in counts]
    return measures.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def freshness(events: DataFrame, row_id: str, time: str, checkpoint: int, now_us: int, alarm_s: float = 120.0) -> DataFrame:
    """One row: backlog behind the checkpoint (events, seconds) or how long the source has been idle."""
    seen = F.col(row_id) <= checkpoint
    out = events.agg(F.max(row_id).alias("newest_id"), F.max(time).alias("newest"), F.max(F.when(seen, F.col(time))).alias("processed"), F.count_if(~seen).alias("backlog"))
    lag = F.when(F.col("backlog") > 0, (F.col("newest") - F.col("processed")) / 1e6).otherwise(F.lit(0.0))
    idle = F.when(F.col("backlog") == 0, (F.lit(now_us) - F.col("newest")) / 1e6)
    return out.select("newest_id", "backlog", lag.alias("lag_s"), idle.alias("idle_s"), F.when(lag > alarm_s, "behind").when(F.col("backlog") > 0, "catching_up").otherwise("current").alias("state"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Name and number of rows of each table."""
    out = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
