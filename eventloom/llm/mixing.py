"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source documents are ordered by
key, a distributed prefix sum of their sizes runs along that order, and the source is
cut where its budget ends; a budget above the source's size takes whole epochs first.

The order is cut into equal ranges of the key (cells), about ``cell_rows`` rows each
over all sources, so that a large source is spread over many tasks: one exchange by
(source, cell), a running sum inside each cell, and cell totals summed per source.

Defined results: a null text has size 0; null sources form one source of their own,
last in order; rows without an id are placed by their text; rows that repeat an id follow each other (so they
share a cell), and those that repeat the text as well are taken in any order (they are equal); an empty table gives an empty
result.  Sources are few: their targets are found in one task, with one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(row_id: Column, tag: Column) -> Column:
    """60 hash bits, the same on every run and engine: the first 15 hex digits of the id's MD5; rows without an id are spread by their text."""
    return F.conv(F.substring(F.md5(F.coalesce(row_id.cast("string"), tag.cast("string"))), 1, KEY_BITS // 4), 16, 10).cast("long")


def text_tag(text: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(text, F.octet_length(text))


def cycled_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .. ``cycle``, repeating, over the sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    return sources.withColumn("weight", ((rank - 1) % cycle + 1).cast("double"))


def fill_targets(sources: DataFrame, total: Column | None = None, max_epochs: int = 3) -> DataFrame:
    """Share ``total`` (default: all sizes) by weight; no target above ``max_epochs`` times its source's size.

    The excess of capped sources goes to the others by weight until none is above its
    cap.  In order of cap / weight this is the first level at which the rest fits.
    The table has one row per source.
    """
    everyone = Window.partitionBy()
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        sources.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("total", (F.sum("source_size").over(everyone) if total is None else total).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level")))
        .withColumn("level", F.coalesce(F.min("fits").over(everyone)["level"], F.max("ratio").over(everyone)))
        .withColumn("target", F.round(F.least("cap", F.col("level") * F.col("weight")), 6))
        .select("source", "weight", "source_size", "target")
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3, max_epochs: int = 3, cell_rows: int = 50_000) -> DataFrame:
    """How much of each document the mix takes: id, source, size, source_size, target, taken, and the text's tag.

    ``taken`` counts words over all epochs; the document at a source's cut is taken in part,
    so that the taken words of a source are its target, rounded.
    """
    sized = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), text_tag(F.col(text_col))).alias("key"), text_tag(F.col(text_col)).alias("tag")), "sizes")
    cells = max(1, -(-sized.count() // cell_rows))
    sized = sized.withColumn("cell", F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * cells).cast("long"))
    name, none = F.coalesce("source", F.lit("")), F.col("source").isNull()
    sized = sized.withColumns({"name": name, "none": none})

    totals = stage(sized.groupBy("name", "none", "cell").agg(F.sum("size").alias("cell_size")), "cells")
    sources = totals.groupBy("name", "none").agg(F.sum("cell_size").alias("source_size")).select(F.when(~F.col("none"), F.col("name")).alias("source"), "source_size")
    targets = fill_targets(cycled_weights(sources, cycle), max_epochs=max_epochs).withColumns({"name": name, "none": none})
    ahead = Window.partitionBy("name", "none").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        totals.withColumn("start", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)))
        .join(targets.drop("source"), ["name", "none"])
        .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .select("name", "none", "cell", "source_size", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("start")).alias("rest"))
    )
    along = Window.partitionBy("name", "none", "cell").orderBy("key", "id", "size", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("before", F.sum("size").over(along) - F.col("size"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.join(plan, ["name", "none", "cell"]).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"), "tag")
