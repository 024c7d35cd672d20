"""Queries that run streams with state over several batches of the given events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ordered import ordered_stream
from ..sources.versioned import VersionedTable
from ..streaming import events as st
from ..streaming import live
from .shapes import Shapes, query
from .streaming import _folder
from .timeseries import rounded

HOUR_US, GAP_MS = 3_600_000_000, 3_600_000
#: Rows of a micro-batch, which costs some seconds whatever it holds; NUMBERED rows make a numbered batch.
BATCH, NUMBERED = 500_000, 2000


def _rows(events: DataFrame) -> DataFrame:
    server = F.concat(F.lit("s"), F.col("user_id") % 4)
    return events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "user_id", "event_type", "value", server.alias("server"), F.date_format("ts", "yyyy-MM-dd").alias("round_id"))


def _stream(s: Shapes) -> DataFrame:
    """All events in batches of ``BATCH`` by id, as rounds of a day on four servers."""
    return _rows(ordered_stream(s.spark, f"{s.sf_dir}/events.parquet", BATCH, unbounded=True))


def _by_time(s: Shapes) -> DataFrame:
    """The same rows in order of time, from a sorted copy: none comes late, whatever the order of ids."""
    at = f"{_folder(s)}/sorted"
    _rows(s.events).where("t_us is not null").orderBy("t_us").write.option("maxRecordsPerFile", BATCH // 2).parquet(at)
    return ordered_stream(s.spark, at, BATCH, "t_us", unbounded=True)


def _run(stream: DataFrame, at: str, schema: str, clock: bool = False) -> DataFrame:
    writer = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(processingTime="0 seconds")
    live.run_until_idle(writer.start, clock)
    return stream.sparkSession.read.schema(schema).parquet(f"{at}/rows")


@query("st01_ordered_batches", "select event_id, (row_number() over (order by event_id) - 1) // 2000 as batch from events")
def batches(s):
    at = _folder(s)

    def each(rows: DataFrame, batch_id: int) -> None:
        nth = F.row_number().over(Window.orderBy("event_id")) - 1  # a micro-batch is bounded and holds whole batches
        rows.select("event_id", (F.lit(batch_id * (BATCH // NUMBERED)) + F.floor(nth / NUMBERED)).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{at}/rows/n={batch_id}")

    live.run_until_idle(lambda: st.fan_out(_stream(s), f"{at}/checkpoint", {"rows": each}, "0 seconds"))
    return s.spark.read.schema("event_id long, batch long").option("recursiveFileLookup", "true").parquet(f"{at}/rows")


@query("st02_stored_totals", "select epoch_us(ts) // 3600000000 * 3600000000 as start_us, event_type, count(*) as n, round(sum(value), 6) as total, round(min(value), 6) as low, round(max(value), 6) as high from events group by 1, 2")
def stored(s):
    at = _folder(s)
    totals = live.minute_totals(VersionedTable(s.spark, f"{at}/totals", "day"), ["event_type"], "value", 2)
    live.run_until_idle(lambda: live.store_totals(_stream(s), f"{at}/checkpoint", totals, width_us=HOUR_US, every="0 seconds"))
    return rounded(totals.read().drop("day"))


@query(
    "st04_open_gaps",
    "with u as (select 's' || event_id % 4 as server, xor(event_id // 4, 1023) + 1 as seq from events where event_id % 50 <> 7), g as (select server, lag(seq, 1, 0) over (partition by server order by seq) + 1 as expected, seq as observed from u) select server, expected, observed, observed - expected as missing from g where expected < observed",
)
def gaps(s):
    seq = F.shiftright("event_id", 2).bitwiseXOR(F.lit(1023)) + 1  # a source's numbers come backwards, by the thousand
    rows = _stream(s).where("event_id % 50 <> 7").withColumns({"server": F.concat(F.lit("s"), F.col("event_id") % 4), "seq": seq})
    return live.gaps_now(_run(live.open_gaps(rows), _folder(s), "server string, expected long, observed long, missing long, change int"))


@query(
    "st05_scene_deltas",
    "with s as (select event_id, 's' || user_id % 4 as server, strftime(ts, '%Y-%m-%d') as round_id, user_id, epoch_us(ts) / 1000.0 as ms, value as x, (event_id % 10)::double as y, value / 10 as vx, (event_id % 7)::double as vy from events) "
    "select event_id, round(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 6) as distance, round(sqrt(vx * vx + vy * vy), 6) as intensity, round(sqrt(power(vx - lag(vx) over w, 2) + power(vy - lag(vy) over w, 2)) / greatest((ms - lag(ms) over w) / 1000, 0.001), 6) as acceleration from s window w as (partition by server, round_id, user_id order by event_id)",
)
def scene(s):
    rows = _stream(s).withColumns(
        {"kind": F.lit("object"), "object_id": F.col("user_id"), "game_ms": F.col("t_us") / 1000.0, "x": F.col("value"), "y": (F.col("event_id") % 10).cast("double"), "vx": F.col("value") / 10, "vy": (F.col("event_id") % 7).cast("double")}
    )
    rows = rows.withColumn("place", F.concat_ws("|", "server", "round_id"))  # a round that comes back goes on
    return rounded(_run(live.scene_deltas(rows, "place"), _folder(s), "event_id long, distance double, intensity double, acceleration double"))


_EVENTS = "e as (select event_id, epoch_us(ts) as t_us, 's' || user_id % 4 as server, strftime(ts, '%Y-%m-%d') as round_id, event_type from events)"
_THIN = """c as (select *, row_number() over (partition by server, round_id order by t_us, event_id) as rn from {candidates}),
r(server, round_id, rn, last, opened) as (select server, round_id, rn, t_us, true from c where rn = 1
  union all select c.server, c.round_id, c.rn, case when sampled or t_us - last >= 3600000000 then t_us else last end, sampled or t_us - last >= 3600000000 from r join c on c.server = r.server and c.round_id = r.round_id and c.rn = r.rn + 1)"""


@query(
    "st06_thinned_episodes",
    f"with recursive {_EVENTS}, f as (select *, event_type = 'click' and event_id % 100 = 0 as sampled, list(case when event_type in ('click', 'view') then event_id end) over (partition by server, round_id order by t_us, event_id rows between unbounded preceding and 1 preceding) as seen from e), "
    + _THIN.format(candidates="f where (event_type = 'error' or sampled) and t_us < (select (max(t_us) // 1000 - 600000) // 60000 * 60000000 from e)")
    + " select c.server, c.round_id, c.event_id, c.t_us, case when sampled then 'sampled' else 'critical' end as reason, coalesce(array_to_string(list_filter(seen, lambda x: x is not null)[-5:], ','), '') as context from c join r on c.server = r.server and c.round_id = r.round_id and c.rn = r.rn where opened",
)
def thinned(s):
    rows = st.with_event_time(_by_time(s), "t_us", "10 minutes")
    found = _run(live.thinned_episodes(rows, GAP_MS, 5, ("error",), ("click",), ("click", "view"), 60_000), _folder(s), live.EPISODE)
    return found.withColumn("context", F.array_join("context", ","))


def _review(s: Shapes) -> live.Review:
    at = _folder(s)
    state = live.Review(s.spark, f"{at}/review", GAP_MS, critical=("error",))
    live.run_until_idle(lambda: live.review(_by_time(s).withColumn("signature", F.col("user_id").cast("string")), f"{at}/checkpoint", state, "0 seconds"))
    return state


@query("st10_review_patterns", "select user_id::varchar as signature, count(*) as occurrences, case when count(*) >= 12 then 'confirmed' else 'candidate' end as state from events group by 1")
def patterns(s):
    return _review(s).patterns().select("signature", "occurrences", "state")


@query(
    "st10_review_episodes",
    f"with recursive {_EVENTS}, " + _THIN.format(candidates="(select *, false as sampled from e where event_type = 'error')") + " select c.server, c.round_id, c.event_id, c.t_us as created_us from c join r on c.server = r.server and c.round_id = r.round_id and c.rn = r.rn where opened",
)
def reviewed(s):
    return _review(s).episodes().select("server", "round_id", "event_id", "created_us")
