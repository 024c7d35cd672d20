"""Per-minute aggregates: pure functions shared by batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60_000_000


def bucket(time: str, width_us: int = MINUTE_US) -> Column:
    """Start of the tumbling window of an epoch-microsecond time."""
    return F.floor(F.col(time) / width_us) * width_us


def metric_rows(rows: DataFrame, keys: Sequence[str], time: str, metrics: Sequence[str], width_us: int = MINUTE_US) -> DataFrame:
    """Long form (start, keys, name, value): metric names stay open until the sink."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return rows.select(bucket(time, width_us).alias("start_us"), *keys, pairs.alias("p")).select("start_us", *keys, "p.name", "p.value").where("value is not null")


def merge_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge long rows: names ending in _min and _max keep the extreme, all others are added."""
    merged = F.when(F.col("name").endswith("_min"), F.min("value")).when(F.col("name").endswith("_max"), F.max("value")).otherwise(F.sum("value"))
    return rows.groupBy("start_us", *keys, "name").agg(merged.alias("value"))


def bags(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged long rows as one map of metrics per start and keys."""
    return rows.groupBy("start_us", *keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics"))


def ping_moments(samples: DataFrame, key: str, time: str, value: str, width_us: int = MINUTE_US) -> DataFrame:
    """Count, sum, extremes and sum of squares per window and key; windows merge by adding them."""
    v = F.col(value)
    return samples.groupBy(bucket(time, width_us).alias("start_us"), key).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v * v).alias("squares"))


def ping_histogram(samples: DataFrame, key: str, time: str, value: str, band: int = 10, width_us: int = MINUTE_US) -> DataFrame:
    """Samples per window, key and band of ``band`` units."""
    return samples.groupBy(bucket(time, width_us).alias("start_us"), key, (F.floor(F.col(value) / band) * band).cast("long").alias("band")).agg(F.count("*").alias("n"))


def histogram_quantiles(histogram: DataFrame, key: str, shares: Sequence[float] = (0.5, 0.95), band: int = 10) -> DataFrame:
    """Merge histograms per key and take, per share, the middle of the first band that reaches ceil(n * share)."""
    merged = histogram.groupBy(key, "band").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(key)
    cum = merged.withColumns({"upto": F.sum("n").over(w.orderBy("band")), "all": F.sum("n").over(w)})
    reach = [(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("all") * q)), F.col("band"))) + band / 2).alias(f"p{round(q * 100)}") for q in shares]
    return cum.groupBy(key).agg(F.max("all").alias("n"), *reach)


def live_window(minutes: DataFrame, time: str = "start_us", minutes_back: int = 180) -> DataFrame:
    """Rows of the last ``minutes_back`` minutes before the newest one."""
    newest = minutes.agg(F.max(time).alias("_newest"))
    return minutes.crossJoin(F.broadcast(newest)).where(F.col(time) >= F.col("_newest") - minutes_back * MINUTE_US).drop("_newest")


def reconcile(stored: DataFrame, events: DataFrame, rebuild, time: str, now_us: int, horizon_s: float = 7200.0, width_us: int = MINUTE_US) -> DataFrame:
    """Replace the windows of the last ``horizon_s`` by a recount of their events; the cut-off is a whole window."""
    cut = (now_us - int(horizon_s * 1e6)) // width_us * width_us
    return stored.where(F.col("start_us") < cut).unionByName(rebuild(events.where(F.col(time) >= cut)))


def window_population(active: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """One row: distinct sessions seen, mapped ones, humans, bots, unknown."""
    seen = active.select(key).distinct().join(sessions.select(key, "identity_id", "is_bot", F.lit(True).alias("known")), key, "left")
    known = F.coalesce("known", F.lit(False))
    return seen.agg(
        F.count("*").alias("sessions"), F.count_if(known).alias("mapped"), F.count_distinct("identity_id").alias("identities"), F.count_if(~F.col("is_bot")).alias("humans"), F.count_if("is_bot").alias("bots"), F.count_if(~known).alias("unknown")
    )
