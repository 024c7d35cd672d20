"""Exact ranks and percentiles without a group's values in one buffer or one sort.

Both operators count equal values first, so a tie is one row whatever its size, and use a mergeable sketch
(``percentile_approx``, of bounded memory) only to place cuts; results come from exact counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch's rank error is 1 / ACCURACY of the rows; groups of fewer than FEW rows are counted whole.
ACCURACY, FEW = 10_000, 100_000
RANGES = 200


def _keyed(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with a key, a constant one where there is none."""
    return (rows, list(keys)) if keys else (rows.withColumn("_all", F.lit(1)), ["_all"])


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str | Column, shares: Sequence[float], names: Sequence[str], accuracy: int = ACCURACY, few: int = FEW) -> DataFrame:
    """Per key the linearly interpolated percentiles at (n - 1) * share, and ``n``; nulls don't count, a key without values has no row.

    A sketch bounds every percentile from below and above; the second pass counts the rows below exactly and keeps
    only the distinct values between the bounds, with their counts, where the ranks are then found.  ``n`` of ``few`` or less keeps all.
    Null keys are keys like others.
    """
    value = F.col(value) if isinstance(value, str) else value
    given = list(keys)
    rows, keys = _keyed(rows, keys)
    known = rows.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    slack = 2.0 / accuracy
    probes = [p for q in shares for p in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", probes, accuracy).alias("_p"))
    infinite = F.lit(float("inf"))
    bounds = {f"_{side}{i}": F.when(F.col("n") <= few, infinite * sign).otherwise(F.col("_p")[2 * i + (sign > 0)]) for i in range(len(shares)) for side, sign in (("lo", -1), ("hi", 1))}
    sketch = sketch.withColumns(bounds).drop("_p")
    both = null_safe_join(known, sketch, keys)
    within = [(F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}")) for i in range(len(shares))]
    any_within = within[0]
    for w in within[1:]:
        any_within = any_within | w
    # one aggregation gives both: rows outside all bounds meet under a null value
    below = [F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_below{i}") for i in range(len(shares))]
    counted = both.withColumn("_near", F.when(any_within, F.col("_v"))).groupBy(*keys, "_near").agg(F.count("*").alias("_c"), F.first("n").alias("n"), *below, *(F.first(f"_{s}{i}").alias(f"_{s}{i}") for i in range(len(shares)) for s in ("lo", "hi")))
    everyone = Window.partitionBy(*keys)
    upto = everyone.orderBy(F.asc_nulls_first("_near")).rowsBetween(Window.unboundedPreceding, 0)
    found, out = {}, []
    for i in range(len(shares)):
        mine = (F.col("_near") >= F.col(f"_lo{i}")) & (F.col("_near") <= F.col(f"_hi{i}"))
        found[f"_rank{i}"] = F.sum(f"_below{i}").over(everyone) + F.sum(F.when(mine, F.col("_c")).otherwise(0)).over(upto)
    ranked = counted.withColumns(found).where(F.col("_near").isNotNull())
    for i, (q, name) in enumerate(zip(shares, names, strict=True)):
        mine = (F.col("_near") >= F.col(f"_lo{i}")) & (F.col("_near") <= F.col(f"_hi{i}"))
        at = (F.col("n") - 1) * F.lit(float(q))
        low, high = (F.min(F.when(mine & (F.col(f"_rank{i}") > edge(at)), F.col("_near"))) for edge in (F.floor, F.ceil))
        part = F.max(at) - F.floor(F.max(at))
        out.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(name))
    result = ranked.groupBy(*keys).agg(F.first("n").alias("n"), *out)
    return result.select(*given, "n", *names)


def sums_in_order(rows: DataFrame, keys: Sequence[str], value: str, order: str, name: str = "_sum") -> tuple[DataFrame, Column]:
    """Rows with a running sum of ``value`` by ``order`` within ``keys``, and the aggregate that takes a key's whole sum from it.

    Doubles don't add up to the same bits in any order: where a sum is compared with a limit or with other sums, partial sums of whatever tasks
    would decide on ties.  Rows equal in ``order`` are taken by ``value``.  A key's rows are sorted and streamed, not held.
    """
    w = Window.partitionBy(*keys).orderBy(order, value).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.sum(value).over(w), f"{name}_nth": F.row_number().over(w)}), F.max_by(name, f"{name}_nth")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the left's key columns stay."""
    renamed = right.select(*(F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = [left[k].eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, on, how).drop(*(f"_r_{i}" for i in range(len(keys))))


def with_cohort_percentiles(rows: DataFrame, key: str, columns: Sequence[str], ranges: int = RANGES, suffix: str = "_percentile") -> DataFrame:
    """Add for each column 100 * (share of all rows with a value at most this one); ``key`` is unique, nulls are smaller than any value.

    All columns are taken in one pass, as (column, value) pairs: distinct values with their counts are dealt to ranges between a sketch's
    cuts, running counts are taken within a range and start at the sum of the ranges before; the shares go back to the pairs, and
    these to their rows.  No task sorts all rows, and only ``ranges`` cuts a column are sent around.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns)))
    long = rows.select(F.col(key).alias("_key"), pairs.alias("p")).select("_key", "p.*")
    counts = long.groupBy("name", "value").agg(F.count("*").alias("c"))
    cuts = counts.groupBy("name").agg(F.percentile_approx("value", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts"))
    placed = counts.join(F.broadcast(cuts), "name").withColumn("range", F.when(F.col("value").isNull(), -1).otherwise(F.size(F.filter(F.coalesce("cuts", F.array()), lambda x: x < F.col("value"))))).drop("cuts")
    sums = placed.groupBy("name", "range").agg(F.sum("c").alias("s"))
    ahead = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("name", "range", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("start"), F.sum("s").over(Window.partitionBy("name")).alias("n"))
    inside = Window.partitionBy("name", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    shares = placed.withColumn("upto", F.sum("c").over(inside)).join(F.broadcast(starts), ["name", "range"])
    shares = shares.select("name", "value", (100.0 * (F.col("start") + F.col("upto")) / F.col("n")).alias("share"))
    ranked = null_safe_join(long, shares, ["name", "value"])
    wide = ranked.groupBy("_key").agg(*(F.max(F.when(F.col("name") == c, F.col("share"))).alias(f"{c}{suffix}") for c in columns))
    return rows.join(wide, rows[key].eqNullSafe(wide["_key"]), "left").drop("_key")
