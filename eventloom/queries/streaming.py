"""Queries that run a stream over the given tables until it is drained."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import local_dir
from ..streaming import events as st
from .shapes import Shapes, query
from .timeseries import rounded


def _folder(s: Shapes) -> str:
    base = s.spark.conf.get("spark.checkpoint.dir", None) or s.spark.sparkContext.getCheckpointDir() or local_dir(s.spark)
    return f"{base.rstrip('/')}/eventloom-stream-{uuid.uuid4().hex[:12]}"


def _stream(s: Shapes) -> DataFrame:
    rows = st.event_source(s.spark, f"{s.sf_dir}/events.parquet")
    return rows.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "user_id", "event_type", "value", F.lit("srv").alias("server"), F.date_format("ts", "yyyy-MM-dd").alias("round_id"), (F.col("event_id") + 1).alias("seq"))


@query("st02_stream_totals", "select epoch_us(ts) // 3600000000 * 3600000000 as start_us, event_type, count(*) as n, round(sum(value), 6) as total, round(max(value), 6) as high from events group by 1, 2")
def totals(s):
    at = _folder(s)
    out = st.drain(st.window_totals(st.with_event_time(_stream(s), "t_us"), ["event_type"], "value", "1 hour"), f"{at}/rows", f"{at}/checkpoint", "update")
    return rounded(st.latest_per_key(out, ["start_us", "event_type"]))


@query("st02_batch_totals", "select epoch_us(ts) // 3600000000 * 3600000000 as start_us, event_type, count(*) as n, round(sum(value), 6) as total, round(max(value), 6) as high from events group by 1, 2")
def batch_totals(s):
    return rounded(st.batch_totals(s.events.withColumn("t_us", F.unix_micros(F.col("ts").cast("timestamp"))), ["event_type"], "value", 3_600_000_000))


@query("st04_stream_dedupe", "select event_id from events")
def dedupe(s):
    at = _folder(s)
    twice = _stream(s).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return st.drain(st.without_repeats(st.with_event_time(twice, "t_us"), ["server", "seq"]), f"{at}/rows", f"{at}/checkpoint").select("event_id")


@query("st04_stream_gaps", "with u as (select event_id + 1 as seq from events where event_id % 50 <> 7), g as (select lag(seq, 1, 0) over (order by seq) + 1 as expected, seq as observed from u) select 'srv' as server, expected, observed, observed - expected as missing from g where expected < observed")
def gaps(s):
    at = _folder(s)
    return st.drain(st.sequence_gaps(_stream(s).where("event_id % 50 <> 7")), f"{at}/rows", f"{at}/checkpoint")


@query("st05_entity_deltas", "select event_id, round(sqrt(power(value - lag(value) over w, 2) + power(event_id % 10 - lag(event_id % 10) over w, 2)), 6) as distance from events window w as (partition by user_id order by ts, event_id)")
def deltas(s):
    at = _folder(s)
    rows = _stream(s).select("event_id", "t_us", F.col("user_id").alias("session_id"), F.col("value").alias("x"), (F.col("event_id") % 10).cast("double").alias("y"))
    return rounded(st.drain(st.entity_deltas(rows), f"{at}/rows", f"{at}/checkpoint"))


@query("st06_stream_episodes")
def episodes(s):
    at = _folder(s)
    return st.drain(st.promote_episodes(_stream(s), 3_600_000, 5, ("error",)), f"{at}/rows", f"{at}/checkpoint")


@query("st06_batch_episodes")
def batch_episodes(s):
    rows = s.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "event_type", F.lit("srv").alias("server"), F.date_format("ts", "yyyy-MM-dd").alias("round_id"))
    return st.promote_episodes_batch(rows, 3_600_000, 5, ("error",))
