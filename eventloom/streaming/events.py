"""Structured Streaming forms of the event operators.

All of them take a streaming DataFrame with event_id, t_us, t (timestamp) and keys, and give a
streaming DataFrame; :func:`drain` runs one to the end of what is there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.minute import bucket

#: Event types that always open an episode.
CRITICAL = ("player_death", "explosion_hit")


def event_source(spark: SparkSession, path: str, max_files: int = 8) -> DataFrame:
    """A Parquet table (a folder, or one file) as a stream in bounded batches; the schema is the table's own."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def with_event_time(stream: DataFrame, time: str, delay: str = "2 hours") -> DataFrame:
    """Add t (timestamp of the epoch microseconds) and a watermark on it."""
    return stream.withColumn("t", F.timestamp_micros(F.col(time))).withWatermark("t", delay)


def window_totals(stream: DataFrame, keys: Sequence[str], value: str, width: str = "1 minute") -> DataFrame:
    """Tumbling totals per key; late events change their own window as long as the watermark allows."""
    out = stream.groupBy(F.window("t", width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("high"))
    return out.select(F.unix_micros("window.start").alias("start_us"), *keys, "n", "total", "high")


def batch_totals(rows: DataFrame, keys: Sequence[str], value: str, width_us: int = 60_000_000) -> DataFrame:
    """The batch form of :func:`window_totals`."""
    return rows.groupBy(bucket("t_us", width_us).alias("start_us"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("high"))


def without_repeats(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def chat_windows(stream: DataFrame, width: str = "300 seconds", least_messages: int = 2, least_actors: int = 2, least_chars: int = 32) -> DataFrame:
    """Chat windows worth a look, each once when the watermark has passed it (append mode)."""
    out = stream.groupBy(F.window("t", width)).agg(F.count("*").alias("messages"), F.approx_count_distinct("player_id", 0.01).alias("actors"), F.sum(F.length("message")).alias("chars"))
    out = out.where((F.col("messages") >= least_messages) | (F.col("actors") >= least_actors) | (F.col("chars") >= least_chars))
    return out.select(F.unix_seconds("window.start").alias("start_s"), "messages", "actors", "chars")


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of numbers as disjoint ranges in order, with neighbours joined."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1] + 1) if len(lo) else np.zeros(0, bool)
    return lo[new], hi[np.append(new[1:], True)] if len(lo) else hi


def sequence_gaps(stream: DataFrame, source: str = "server", seq: str = "seq") -> DataFrame:
    """Missing ranges as they appear: per source the highest sequence so far is the state.

    Sequences travel and are kept as ranges without a gap, so a task holds a micro-batch's
    gaps and not its rows; sequences that come in no order at all have more ranges until they join.
    """

    def ranges(frames):
        for f in frames:
            f = f.dropna(subset=[seq])
            out = []
            for key, values in f.groupby(source, dropna=False, sort=False)[seq]:
                v = values.to_numpy(np.int64)
                lo, hi = _merged(v, v)
                out.append(pd.DataFrame({source: None if pd.isna(key) else key, "lo": lo, "hi": hi}))
            if out:
                yield pd.concat(out)

    def step(key, frames, state):
        last = state.get[0] if state.exists else 0
        lo = hi = np.zeros(0, np.int64)
        for f in frames:
            lo, hi = _merged(np.append(lo, f["lo"].to_numpy(np.int64)), np.append(hi, f["hi"].to_numpy(np.int64)))
        out = []
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            if a > last + 1:
                out.append((key[0], last + 1, a, a - last - 1))
            last = max(last, b)
        state.update((last,))
        yield pd.DataFrame(out, columns=[source, "expected", "observed", "missing"])

    runs = stream.select(source, F.col(seq).cast("long").alias(seq)).mapInPandas(ranges, f"{source} string, lo long, hi long")
    return runs.groupBy(source).applyInPandasWithState(step, f"{source} string, expected long, observed long, missing long", "last long", "append", "NoTimeout")


def entity_deltas(stream: DataFrame, key: str = "session_id", time: str = "t_us", row_id: str = "event_id") -> DataFrame:
    """Distance to the same entity's previous sample (x, y); its last position is the state."""

    def step(k, frames, state):
        rows = pd.concat(list(frames)).sort_values([time, row_id])
        px, py, seen = (*state.get, True) if state.exists else (0.0, 0.0, False)
        out = []
        for r, x, y in zip(rows[row_id], rows["x"], rows["y"], strict=True):
            out.append((r, ((x - px) ** 2 + (y - py) ** 2) ** 0.5 if seen else None))
            px, py, seen = float(x), float(y), True
        state.update((px, py))
        yield pd.DataFrame(out, columns=[row_id, "distance"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{row_id} long, distance double", "x double, y double", "append", "NoTimeout")


def _thin(rows: pd.DataFrame, last: int | None, ring: list[int], gap_us: int, frames: int, critical: Sequence[str]):
    """Greedy thinning in (time, id) order: an episode opens if none did within the gap; the ring is its context."""
    out = []
    for t, i, kind in zip(rows["t_us"], rows["event_id"], rows["event_type"], strict=True):
        if kind in critical and (last is None or t - last >= gap_us):
            out.append((i, t, list(ring)))
            last = int(t)
        ring = [*ring, int(i)][-frames:]
    return out, last, ring


_EPISODE = "server string, round_id string, event_id long, t_us long, context array<long>"


def promote_episodes(stream: DataFrame, gap_ms: int = 1000, frames: int = 60, critical: Sequence[str] = CRITICAL) -> DataFrame:
    """Critical events as episodes, at most one per ``gap_ms`` in a (server, round), with the ring of events before."""

    def step(key, parts, state):
        last, ring = state.get if state.exists else (None, [])
        rows = pd.concat(list(parts)).sort_values(["t_us", "event_id"])
        out, last, ring = _thin(rows, last, list(ring), gap_ms * 1000, frames, critical)
        state.update((last, ring))
        yield pd.DataFrame([(*key, *o) for o in out], columns=["server", "round_id", "event_id", "t_us", "context"])

    return stream.groupBy("server", "round_id").applyInPandasWithState(step, _EPISODE, "last long, ring array<long>", "append", "NoTimeout")


def promote_episodes_batch(rows: DataFrame, gap_ms: int = 1000, frames: int = 60, critical: Sequence[str] = CRITICAL) -> DataFrame:
    """The batch form; which event opens an episode depends on the one before, so a round is one sorted run that streams by."""

    def run(batches):
        now, last, ring = None, None, []
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(["server", "round_id"], dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key != now:
                    now, last, ring = key, None, []
                opened, last, ring = _thin(part, last, ring, gap_ms * 1000, frames, critical)
                out += [(*key, *o) for o in opened]
            yield pd.DataFrame(out, columns=["server", "round_id", "event_id", "t_us", "context"])

    runs = rows.select("server", "round_id", "event_id", "t_us", "event_type").repartition("server", "round_id")
    return runs.sortWithinPartitions("server", "round_id", F.asc_nulls_last("t_us"), F.asc_nulls_last("event_id")).mapInPandas(run, _EPISODE)


def fan_out(stream: DataFrame, checkpoint: str, sinks: dict[str, Callable[[DataFrame, int], None]], every: str | None = None) -> StreamingQuery:
    """One pass over each batch for several sinks, which must be idempotent in (name, batch id)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for write in sinks.values():
                write(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def periodic_review(stream: DataFrame, checkpoint: str, episodes: Callable[[DataFrame, int], None], patterns: Callable[[DataFrame, int], None], gap_ms: int = 1000, least: int = 12, every: str | None = "5 minutes", critical: Sequence[str] = CRITICAL) -> StreamingQuery:
    """Every so often: the new events' episodes are closed and their signatures' counts confirmed, in two idempotent sinks.

    The stream has server, round_id, event_id, t_us, event_type and signature.  What earlier batches had counts: it is
    kept below the checkpoint (:class:`.live.Review`).  The sinks get a batch's own episodes, and its signatures with their
    occurrences in the batch and the state that all batches so far give them.
    """
    from .live import Review

    state = Review(stream.sparkSession, f"{checkpoint.rstrip('/')}/review", gap_ms, least, critical)

    def review(batch: DataFrame, batch_id: int) -> None:
        state.add(batch, batch_id)
        episodes(state.episodes(batch_id), batch_id)
        counted = batch.groupBy("signature").agg(F.count("*").alias("occurrences"))
        patterns(counted.join(state.patterns().select("signature", "state"), "signature", "left"), batch_id)

    return fan_out(stream, checkpoint, {"review": review}, every)


def keyed_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink whose files are replaced when a batch is written again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available and return what was written; update mode keeps each batch's rows apart by batch_id."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).outputMode("append").start()
    else:
        query = writer.foreachBatch(keyed_sink(path)).outputMode(mode).start()
    query.awaitTermination()
    spark = stream.sparkSession
    schema = stream.schema if mode == "append" else stream.schema.add("batch_id", "integer")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def latest_per_key(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version of each key of an update-mode sink."""
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")
