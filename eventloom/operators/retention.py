"""Retention: what may be kept, what goes, and what a quota evicts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versioned import VersionedTable

#: Ages in seconds after which rows of a kind expire.
AGES_S = {"chat": 30 * 86400, "network": 7 * 86400, "state": 86400, "highres": 7200, "minute": 180 * 86400, "episode": 90 * 86400}


def expire(rows: DataFrame, kind: str, time: str, now_us: int, ages: dict[str, int] | None = None, protected: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows that stay: those of unknown kinds, young ones, and protected keys."""
    limits = (ages or AGES_S).items()
    age = F.coalesce(*(F.when(F.col(kind) == k, F.lit(s)) for k, s in limits), F.lit(None).cast("int"))
    young = F.coalesce(F.col(time) >= F.lit(now_us) - age.cast("long") * 1_000_000, F.lit(True))
    if protected is None:
        return rows.where(young)
    marked = rows.join(protected.select(F.col(key).alias("_k"), F.lit(True).alias("_keep")).distinct(), F.col(key) == F.col("_k"), "left")
    return marked.where(young | F.coalesce("_keep", F.lit(False))).drop("_k", "_keep")


def evict_over_quota(segments: DataFrame, size: str, priority: str, created: str, row_id: str, quota: int, cell: int = 3600) -> DataFrame:
    """Segments to delete, low priority first, oldest first, until at most ``quota`` bytes are left.

    The running sum over all segments is taken in two steps, within cells of ``cell`` units of
    ``created`` and over the cells' totals, so no task sorts the whole table.
    """
    placed = segments.withColumn("_cell", F.floor(F.col(created) / cell))
    w = Window.partitionBy(priority, "_cell").orderBy(created, row_id).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    totals = placed.groupBy(priority, "_cell").agg(F.sum(size).alias("_size"))
    ahead = Window.orderBy(priority, "_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(priority, "_cell", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start"), F.sum("_size").over(Window.partitionBy()).alias("_all"))
    out = within.join(starts, [priority, "_cell"]).withColumn("evict", F.col("_all") - F.col("_start") - F.col("_before") > quota)
    return out.select(*segments.columns, "evict")


def expire_stored(table: VersionedTable, time: str, now_us: int, age_s: int, protected: DataFrame | None = None, key: str | None = None) -> tuple[list[str], list[str]]:
    """Expire rows of a table whose partitions are UTC days: whole days go unread, only border days are rewritten.

    Rows older than ``age_s`` go, but for those whose ``key`` is among ``protected`` (rows with ``key`` and ``time``).  A day before the
    cut-off without protected rows is dropped from the table; the cut-off's day and days with protected
    rows are rewritten; all others keep their files, as do rows without a time.  Returns the dropped and the rewritten days.
    """
    cut = now_us - age_s * 1_000_000
    border = dt.datetime.fromtimestamp(cut // 1_000_000, dt.UTC).strftime("%Y-%m-%d")
    days = [d for d in table.manifest().parts if d != "null"]
    kept: set[str] = set()
    if protected is not None:
        day = F.date_format(F.timestamp_micros(time), "yyyy-MM-dd")
        kept = {r[0] for r in protected.where(F.col(time) < cut).select(day).distinct().collect()}  # days, no rows
    gone = sorted(d for d in days if d < border and d not in kept)
    edited = sorted(d for d in days if d == border or (d < border and d in kept))
    if gone:
        table.drop(gone)

    def young(rows: DataFrame) -> DataFrame:
        stays = F.col(time) >= cut
        if protected is None:
            return rows.where(stays)
        marked = rows.join(protected.select(F.col(key).alias("_k"), F.lit(True).alias("_keep")).distinct(), F.col(key) == F.col("_k"), "left")
        return marked.where(stays | F.coalesce("_keep", F.lit(False))).drop("_k", "_keep")

    if edited:
        table.rewrite(edited, young)
    return gone, edited
