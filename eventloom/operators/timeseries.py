"""Operators over per-entity time series: latency statistics, movement, counters, durations.

Times are epoch microseconds unless a parameter says otherwise.  Every window is ordered
by time and then by a row id, so results don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import exact_percentiles, null_safe_join

PING_QUANTILES = (0.5, 0.9, 0.95, 0.99)
SPIKE_STEPS = (50, 100, 150)
HIGH_LEVELS = (100, 150, 200, 250)


def finite(c: Column, default: float = 0.0) -> Column:
    """A number, or the default where the value is missing, no number or not finite."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def percentiles(value: Column, shares: Sequence[float], names: Sequence[str]) -> list[Column]:
    """Linearly interpolated percentiles at (n - 1) * share as aggregates, for groups that are small by construction: a buffer holds their values."""
    return [F.percentile(value, float(q)).alias(n) for q, n in zip(shares, names, strict=True)]


def sample_steps(samples: DataFrame, entity: str, time: str, row_id: str, value: str, clamp_s: float = 30.0) -> DataFrame:
    """Add the previous value, the absolute step to it and the clamped seconds since it."""
    w = Window.partitionBy(entity).orderBy(time, row_id)
    gap = (F.col(time) - F.lag(time).over(w)) / 1e6
    return samples.withColumns({"prev": F.lag(value).over(w), "dt": F.least(F.lit(clamp_s), F.greatest(F.lit(0.0), gap))}).withColumn("step", F.abs(F.col(value) - F.col("prev")))


def longest_above(samples: DataFrame, entity: str, time: str, row_id: str, value: str, level: float = 100.0, clamp_s: float = 30.0) -> DataFrame:
    """Longest uninterrupted time for which the value stood at more than ``level``, per entity."""
    w = Window.partitionBy(entity).orderBy(time, row_id)
    steps = sample_steps(samples, entity, time, row_id, value, clamp_s)
    island = F.sum(F.when(F.col("prev") > level, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = steps.withColumn("island", island).where(F.col("prev") > level)
    return held.groupBy(entity, "island").agg(F.sum("dt").alias("s")).groupBy(entity).agg(F.max("s").alias("longest_high"))


def ping_metrics(samples: DataFrame, entity: str, time: str, row_id: str, value: str, clamp_s: float = 30.0, group: str | None = None) -> DataFrame:
    """Latency statistics per entity, or pooled per ``group`` with steps that never cross entities."""
    key = group or entity
    w = Window.partitionBy(entity).orderBy(time, row_id).rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce(F.col("prev") > HIGH_LEVELS[0], F.lit(False))
    steps = sample_steps(samples, entity, time, row_id, value, clamp_s).withColumn("total", F.sum(F.when(held, F.col("dt")).otherwise(0.0)).over(w))
    # the time held without a break so far: what was added since the last sample that wasn't held
    steps = steps.withColumn("held", F.when(held, F.col("total") - F.coalesce(F.max(F.when(~held, F.col("total"))).over(w), F.lit(0.0))))
    out = steps.groupBy(key).agg(
        F.count(value).alias("samples"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_pop(value).alias("stddev"),
        F.coalesce(F.avg("step"), F.lit(0.0)).alias("jitter"),
        *(F.count_if(F.col("step") >= s).alias(f"spikes_{s}") for s in SPIKE_STEPS),
        *(F.coalesce(F.sum(F.when(F.col("prev") > h, F.col("dt"))), F.lit(0.0)).alias(f"seconds_above_{h}") for h in HIGH_LEVELS),
        *([F.count_distinct(entity).alias("session_count")] if group else []),
        F.coalesce(F.max("held"), F.lit(0.0)).alias("longest_high"),
    )
    return with_percentiles(out, samples, [key], value)


def with_percentiles(out: DataFrame, rows: DataFrame, keys: Sequence[str], value: str | Column, shares: Sequence[float] = PING_QUANTILES, names: Sequence[str] | None = None) -> DataFrame:
    """``out``, one row per key, with exact percentiles of ``rows`` found by counting, so that a key may have any number of them."""
    names = names or [f"p{round(q * 100)}" for q in shares]
    return null_safe_join(out, exact_percentiles(rows, keys, value, shares, names).drop("n"), keys, "left")


def ranked_percentiles(samples: DataFrame, entity: str, value: str, row_id: str, shares: Sequence[float] = PING_QUANTILES) -> DataFrame:
    """The same percentiles from ranks: sorts instead of holding a group's values in memory."""
    w = Window.partitionBy(entity)
    ranked = samples.where(F.col(value).isNotNull()).withColumns({"rn": F.row_number().over(w.orderBy(value, row_id)) - 1, "n": F.count("*").over(w)})
    out = []
    for q in shares:
        at = (F.col("n") - 1) * F.lit(float(q))
        low = F.max(F.when(F.col("rn") == F.floor(at), F.col(value)))
        high = F.max(F.when(F.col("rn") == F.ceil(at), F.col(value)))
        out.append((low + (high - low) * (F.max(at) - F.floor(F.max(at)))).alias(f"p{round(q * 100)}"))
    return ranked.groupBy(entity).agg(*out)


def movement(samples: DataFrame, keys: Sequence[str], time_ms: str, row_id: str, clamp_s: float = 10.0, active_speed: float = 1.0) -> DataFrame:
    """Movement features per key: distance, speeds, changes of speed and heading, airtime.

    Needs columns x, y and airborne; fewer than two samples give zeros and coverage 0.
    """
    w = Window.partitionBy(*keys).orderBy(time_ms, row_id)
    dx, dy = finite(F.col("x")) - finite(F.lag("x").over(w)), finite(F.col("y")) - finite(F.lag("y").over(w))
    gap = F.least(F.lit(clamp_s), F.greatest(F.lit(0.0), (F.col(time_ms) - F.lag(time_ms).over(w)) / 1000.0))
    first = F.row_number().over(w) == 1
    steps = samples.withColumns({"dx": F.when(~first, dx), "dy": F.when(~first, dy), "dt": F.when(~first, gap)}).withColumn("len", F.hypot("dx", "dy"))
    steps = steps.withColumn("speed", F.when(F.col("dt") > 0, F.col("len") / F.col("dt")).when(F.col("dt") == 0, F.lit(0.0)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    heading = F.last(F.when((F.col("dx") != 0) | (F.col("dy") != 0), F.struct("dx", "dy")), ignorenulls=True).over(before)
    steps = steps.withColumns({"dspeed": F.abs(F.col("speed") - F.lag("speed").over(w)), "turned": F.coalesce(F.col("dx") * heading["dx"] + F.col("dy") * heading["dy"] < 0, F.lit(False))})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    moving = F.col("speed") >= active_speed
    return steps.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        zero(F.sum("len")).alias("distance"),
        zero(F.sum(F.when(moving, F.col("len")))).alias("active_distance"),
        zero(F.sum(F.when(~moving, F.col("dt")))).alias("static_seconds"),
        zero(F.avg("speed")).alias("mean_speed"),
        zero(F.max("speed")).alias("max_speed"),
        zero(F.avg("dspeed")).alias("mean_speed_change"),
        zero(F.max("dspeed")).alias("max_speed_change"),
        zero(F.sum(F.abs("dy"))).alias("vertical"),
        zero(F.sum(F.when(F.col("airborne"), F.col("dt")))).alias("airtime"),
        F.count_if("turned").alias("direction_switches"),
        (F.count("*") > 1).cast("double").alias("coverage"),
    )


def state_durations(samples: DataFrame, keys: Sequence[str], time_ms: str, row_id: str, flags: Sequence[str], clamp_s: float = 10.0) -> DataFrame:
    """Seconds credited to every flag that was set in the previous state."""
    w = Window.partitionBy(*keys).orderBy(time_ms, row_id)
    gap = F.least(F.lit(clamp_s), F.greatest(F.lit(0.0), (F.col(time_ms) - F.lag(time_ms).over(w)) / 1000.0))
    steps = samples.withColumn("dt", gap).withColumns({f"prev_{f}": F.lag(f).over(w) for f in flags})
    set_flags = F.filter(F.array(*(F.when(F.col(f"prev_{f}"), F.lit(f)) for f in flags)), lambda x: x.isNotNull())
    return steps.select(*keys, "dt", F.explode(set_flags).alias("state")).groupBy(*keys, "state").agg(F.sum("dt").alias("seconds"))


def counter_deltas(snapshots: DataFrame, entity: str, time: str, row_id: str, counters: Sequence[str]) -> DataFrame:
    """max(0, last - first) of each counter for entities with two snapshots or more."""
    order = F.struct(time, row_id)
    return (
        snapshots.groupBy(entity)
        .agg(F.count("*").alias("snapshots"), *(F.greatest(F.lit(0.0), F.max_by(c, order) - F.min_by(c, order)).alias(c) for c in counters))
        .where("snapshots >= 2")
    )


def snapshot_deltas(snapshots: DataFrame, keys: Sequence[str], row_id: str, checkpoint: str, counters: Sequence[str], start: str = "round_start") -> DataFrame:
    """Each snapshot minus the latest earlier ``start`` snapshot of the same keys; null without one."""
    before = Window.partitionBy(*keys).orderBy(row_id).rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when(F.col(checkpoint) == start, F.struct(*counters)), ignorenulls=True).over(before)
    known = [F.col(k).isNotNull() for k in keys]
    usable = known[0]
    for k in known[1:]:
        usable = usable & k
    out = snapshots.withColumn("_base", F.when(usable, base))
    return out.withColumns({f"{c}_delta": F.when(F.col("_base").isNotNull(), F.col(c) - F.coalesce(F.col("_base")[c], F.lit(0.0))) for c in counters}).drop("_base")


def motion_deltas(samples: DataFrame, keys: Sequence[str], time_ms: str, row_id: str, min_dt_ms: float = 1.0) -> DataFrame:
    """Per sample: distance to the previous one, speed and acceleration over at least ``min_dt_ms``."""
    w = Window.partitionBy(*keys).orderBy(time_ms, row_id)
    dt = F.greatest(F.lit(min_dt_ms), F.col(time_ms) - F.lag(time_ms).over(w)) / 1000.0
    out = samples.withColumns({"distance": F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), "intensity": F.hypot("vx", "vy"), "dt": dt})
    return out.withColumn("acceleration", (F.col("intensity") - F.lag("intensity").over(w)) / F.col("dt"))


def input_bursts(inputs: DataFrame, entity: str, time: str, row_id: str, window_s: float = 1.0, threshold: int = 5) -> DataFrame:
    """Per entity: inputs, transitions, actions per minute and inputs that end a burst.

    An input ends a burst when ``threshold`` or more lie in the trailing window, it included.
    """
    w = Window.partitionBy(entity)
    order = w.orderBy(time, row_id)
    ranked = inputs.withColumn("rn", F.row_number().over(order))
    trailing = w.orderBy(time).rangeBetween(-int(window_s * 1e6), 0)
    counted = ranked.withColumn("recent", F.col("rn") - F.min("rn").over(trailing) + 1)
    minutes = (F.max(time) - F.min(time)) / 60e6
    return counted.groupBy(entity).agg(
        F.count("*").alias("events"),
        F.count_if(F.col("transition").isin("Pressed", "Released")).alias("transitions"),
        F.count_if(F.col("recent") >= threshold).alias("bursts"),
        (F.count("*") / F.greatest(minutes, F.lit(1 / 60))).alias("apm"),
    )
