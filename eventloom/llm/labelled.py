"""Labelled rows for learning: the held-out fold and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(row_id: Column) -> Column:
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit(""))) % FOLDS


def held_out(row_id: Column) -> Column:
    """Rows of fold 0 are never learned from."""
    return fold(row_id) == 0


def learnable(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id and y (0 or 1) of the rows to learn from: one label per id (the larger), none held out, no nulls."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))


def class_sample(rows: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each class, by a hash of the id, with the weight each stands for."""
    parts = []
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    for y in (0, 1):
        total = totals.get(y, 0)
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        parts.append(part.withColumn("weight", F.lit(max(1.0, total / per_class))))
    return parts[0].unionByName(parts[1])
