"""Sharding by histogram sort.

Rows are ordered by a key of 60 bits: 40 hash bits of the text, then 20 of the id, so
equal texts stand together.  The splitters between shards are found by counting, not by
sorting: each round counts the exact bytes between candidate boundaries (probes) over
all partitions and refines the probes where a splitter must lie.  A splitter is done
when a group of equal texts holds it that is small enough to stay whole, or one row.
Groups above ``group_tolerance`` of a shard are cut inside, so that a very frequent text
can't unbalance a shard.  Then the rows are exchanged once.

Defined results: a null text is empty (size 1); rows with null or repeated ids are rows
like others (rows equal in id and text stay together); an empty table gives an empty
result; size, shard and slot take the place of input columns with their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

TEXT_BITS, ID_BITS = 40, 20
PROBES = 256


@dataclass
class Zone:
    """Keys in (low, high] hold splitter number ``j``; ``below`` and ``above`` are the bytes up to low and high."""

    j: int
    goal: float
    low: int
    high: int
    below: int
    above: int
    rows: int

    def edge(self) -> int:
        return self.low if self.goal - self.below < self.above - self.goal else self.high


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def order_key(row_id: Column, text: Column) -> Column:
    of_text = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - TEXT_BITS)
    return F.shiftleft(of_text, ID_BITS).bitwiseOR(F.xxhash64(row_id).bitwiseAND((1 << ID_BITS) - 1))


def find_splitters(keys: DataFrame, shards: int, group_tolerance: float = 0.05) -> list[int]:
    """Ascending keys k_1 .. k_(shards-1): shard i takes the keys in (k_i, k_(i+1)].

    ``keys`` has key and size.  Every round is one aggregation with at most
    shards * PROBES result rows; there are eight rounds at most.
    """
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    top = (1 << (TEXT_BITS + ID_BITS)) - 1
    open_zones = [Zone(j, j * total / shards, -1, top, 0, total, rows) for j in range(1, shards)]
    found: dict[int, int] = {}
    while open_zones:
        spans = sorted({(z.low, z.high) for z in open_zones})
        step = max(1, -(-(spans[0][1] - spans[0][0]) // PROBES))
        which, place = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (low, high) in enumerate(spans):
            within = (F.col("key") > low) & (F.col("key") <= high)
            which = F.when(within, F.lit(i)).otherwise(which)
            place = F.when(within, F.expr(f"(key - ({low}L) - 1) div {step}L")).otherwise(place)
        counted = keys.select(which.alias("i"), place.alias("p"), "size").where("i is not null").groupBy("i", "p").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        cells: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r.i, r.p)):
            cells.setdefault(r.i, []).append(r)
        still = []
        for z in open_zones:
            low = z.low
            sofar = z.below
            for r in cells.get(spans.index((z.low, z.high)), []):
                if sofar + r.bytes >= z.goal:
                    low = z.low + r.p * step
                    z = Zone(z.j, z.goal, low, min(low + step, z.high), sofar, sofar + r.bytes, r.rows)
                    break
                sofar += r.bytes
            small = step <= 1 << ID_BITS and z.above - z.below <= group_tolerance * total / shards
            if z.rows <= 1 or step == 1 or small:
                found[z.j] = z.edge()
            else:
                still.append(z)
        open_zones = still
    return [found[j] for j in sorted(found)]


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", group_tolerance: float = 0.05, part_bytes: int = 64 << 20) -> DataFrame:
    """Add size, shard and slot (gapless within a shard) to the rows, shards of near equal bytes.

    A group of equal texts lies in one shard if it has at most ``group_tolerance`` of a shard's
    bytes; a larger one may be dealt to several.  A shard is dealt in parts of about
    ``part_bytes`` bytes; rows of one part lie in one partition of the result, in key order.
    """
    keys = stage(docs.select(order_key(F.col(id_col), F.col(text_col)).alias("key"), size_of(F.col(text_col)).alias("size")), "keys")
    splitters = find_splitters(keys, shards, group_tolerance)
    shard = sum((F.when(F.col("_key") > k, 1).otherwise(0) for k in splitters), F.lit(0))
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, -(-total // (shards * part_bytes)))
    part = F.shiftright(F.col("_key").bitwiseAND((1 << ID_BITS) - 1) * parts, ID_BITS).cast("int")
    counts = keys.withColumnRenamed("key", "_key").groupBy(shard.alias("shard"), part.alias("_part")).count()
    ahead = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"))
    rows = docs.drop("shard", "slot").withColumns({"size": size_of(F.col(text_col)), "_key": order_key(F.col(id_col), F.col(text_col))})
    rows = rows.withColumns({"shard": shard.cast("int"), "_part": part})
    own = Window.partitionBy("shard", "_part").orderBy("_key", F.col(id_col), "size")
    rows = rows.withColumn("_nth", F.row_number().over(own) - 1)
    return rows.join(starts, ["shard", "_part"]).withColumn("slot", F.col("_start") + F.col("_nth")).drop("_key", "_part", "_nth", "_start")
