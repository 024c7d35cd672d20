"""Sinks and pinned reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versioned import VersionedTable


def upsert_days(results: DataFrame, path: str, day: str = "report_date") -> None:
    """Replace the days that ``results`` has and leave the others: running a day again gives the same table."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def upsert_versioned_days(results: DataFrame, table: VersionedTable) -> int:
    """:func:`upsert_days` as a new version: readers of an older one keep the rows they have.  Returns the version."""
    return table.replace(results)


def watermark(events: DataFrame, row_id: str, time: str) -> tuple[int, int]:
    """Largest id and time now: the version that all reads of a report are pinned to."""
    r = events.agg(F.max(row_id), F.max(time)).first()
    return r[0], r[1]


def pinned(events: DataFrame, row_id: str, upto: int | None) -> DataFrame:
    return events.where(F.col(row_id) <= upto) if upto is not None else events.limit(0)


def day_reports(days: DataFrame, day: str, sections: dict[str, DataFrame], required: tuple[str, ...] = ()) -> DataFrame:
    """One JSON document per day with a list of rows for each section; a raw chat column is refused."""
    missing = set(required) - set(sections)
    if missing:
        raise ValueError(f"sections are missing: {sorted(missing)}")
    out = days.select(day).distinct()
    for name, rows in sections.items():
        if "message" in rows.columns:
            raise ValueError(f"section {name} holds raw chat")
        body = F.struct(*(c for c in rows.columns if c != day))
        out = out.join(rows.groupBy(day).agg(F.array_sort(F.collect_list(body)).alias(name)), day, "left")
    return out.select(day, F.to_json(F.struct(F.lit(1).alias("schema_version"), *sections)).alias("report"))


def write_reports(reports: DataFrame, path: str, day: str = "report_date") -> None:
    reports.select(day, F.col("report").alias("value")).write.mode("overwrite").partitionBy(day).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
