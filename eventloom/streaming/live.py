"""Operators whose state outlives a batch and stays bounded.

Keyed state is held by ``transformWithState`` (RocksDB, part of the checkpoint, so it survives a restart);
totals and what a periodic review carries are versioned tables (:mod:`..sources.versioned`), which a batch changes once.

* :func:`scene_deltas`: the last sample of each entity of a server's round, forgotten with the round;
* :func:`open_gaps`: missing sequence ranges as a change log, so that a late sequence closes what it fills;
* :func:`thinned_episodes`: events in event-time order behind the watermark, thinned, with the ring of frames before;
* :func:`store_totals`: totals per key and minute that batches add to;
* :func:`review`: what is opened and confirmed over all batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.minute import bucket
from ..plans.report import close_episodes, confirm_patterns
from ..sources.versioned import KeyedTotals, VersionedTable, least, most, total
from .events import CRITICAL, _merged, fan_out

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event types of ordinary frames, of which one in a hundred opens an episode, and frames that a ring keeps.
ORDINARY = ("scene_highres_batch", "highres_state_sample")
FRAMES = ("state_sample", "highres_state_sample", "scene_frame_batch", "scene_highres_batch")


def with_state_store(stream: DataFrame) -> DataFrame:
    """The stream, with its session set to the state store that keyed state of several kinds needs."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return stream


class _SceneState(StatefulProcessor):
    """State of one share of a server's entities: the round, the number of entities, and each one's last sample."""

    def __init__(self, most: int | None, ttl_ms: int | None, columns: Sequence[str]):
        self.most, self.ttl_ms, self.columns = most, ttl_ms, list(columns)

    def init(self, handle) -> None:
        self.about = handle.getValueState("about", "round string, n long", self.ttl_ms)
        self.last = handle.getMapState("last", "entity string", "x double, y double, vx double, vy double, at double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        row_id, time, round_col = self.columns
        frame = pd.concat(list(rows)).sort_values(row_id, kind="stable")
        current, n = self.about.get() if self.about.exists() else (None, 0)
        fresh: dict[str, tuple] = {}  # entities of this batch
        stored = True  # whether entities that aren't in fresh may be in the state
        out = []
        for i, r, e, at, x, y, vx, vy in frame[[row_id, round_col, "entity", time, "x", "y", "vx", "vy"]].itertuples(index=False):
            if r != current:
                current, n, stored, fresh = r, 0, False, {}
            before = fresh.get(e)
            if before is None and stored and self.last.containsKey((e,)):
                before = tuple(self.last.getValue((e,)))
            if before is None:
                if self.most is not None and n >= self.most:
                    n, stored, fresh = 0, False, {}
                n += 1
                out.append((i, None, (vx * vx + vy * vy) ** 0.5, None))
            else:
                seconds = max((at - before[4]) / 1000.0, 0.001)
                out.append((i, ((x - before[0]) ** 2 + (y - before[1]) ** 2) ** 0.5, (vx * vx + vy * vy) ** 0.5, ((vx - before[2]) ** 2 + (vy - before[3]) ** 2) ** 0.5 / seconds))
            fresh[e] = (float(x), float(y), float(vx), float(vy), float(at))
        if not stored:
            self.last.clear()
        for e, sample in fresh.items():
            self.last.updateValue((e,), sample)
        self.about.update((current, n))
        yield pd.DataFrame(out, columns=[row_id, "distance", "intensity", "acceleration"])

    def close(self) -> None:
        pass


def scene_deltas(stream: DataFrame, server: str = "server", round_col: str = "round_id", entity: Sequence[str] = ("kind", "object_id"), time: str = "game_ms", row_id: str = "event_id", limit: int | None = None, spread: int = 16, ttl: int | None = None) -> DataFrame:
    """Per sample (x, y, vx, vy): distance to its entity's last one, speed, and change of velocity over 1 ms or more.

    A server's entities are dealt to ``spread`` states, each with all entities of one round; a sample of another round makes a state forget
    all it has.  The state store keeps entities on disk, a task holds those of a batch.  The first
    sample of an entity has no distance.  Samples of a batch are taken by id; a state's share of a batch is
    held at once, so batches must be bounded (``ordered_events`` is).  Nulls in coordinates count as 0.

    Only where they are given: with ``limit`` a state forgets all it has at one entity more than ``limit / spread``,
    and with ``ttl`` what isn't touched for as many ms goes by itself (Spark then runs batches without end).
    """
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (time, "x", "y", "vx", "vy")]
    rows = stream.select(F.col(server).alias("_server"), F.col(round_col).cast("string").alias(round_col), F.col(row_id).cast("long").alias(row_id), F.to_json(F.struct(*entity)).alias("entity"), *columns)
    rows = rows.withColumn("_share", F.pmod(F.xxhash64("entity"), F.lit(spread)))
    processor = _SceneState(None if limit is None else max(1, limit // spread), ttl, (row_id, time, round_col))
    return with_state_store(rows).groupBy("_server", "_share").transformWithStateInPandas(processor, f"{row_id} long, distance double, intensity double, acceleration double", "append", "None" if ttl is None else "ProcessingTime")


class _Gaps(StatefulProcessor):
    def __init__(self, source: str):
        self.source = source

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "last long, lo array<long>, hi array<long>")

    def handleInputRows(self, key, rows, timerValues):
        last, lo, hi = self.known.get() if self.known.exists() else (0, [], [])
        lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
        before = set(zip(lo.tolist(), hi.tolist(), strict=True))
        got_lo = got_hi = np.zeros(0, np.int64)
        for f in rows:
            got_lo, got_hi = _merged(np.append(got_lo, f["lo"].to_numpy(np.int64)), np.append(got_hi, f["hi"].to_numpy(np.int64)))
        if len(got_lo) and got_hi[-1] > last:  # all beyond the last one is missing at first
            lo, hi, last = np.append(lo, last + 1), np.append(hi, got_hi[-1]), int(got_hi[-1])
        lo, hi = _without(lo, hi, got_lo, got_hi)
        after = set(zip(lo.tolist(), hi.tolist(), strict=True))
        self.known.update((last, lo.tolist(), hi.tolist()))
        changes = [(*g, -1) for g in sorted(before - after)] + [(*g, 1) for g in sorted(after - before)]
        yield pd.DataFrame([(key[0], a, b + 1, b + 1 - a, c) for a, b, c in changes], columns=[self.source, "expected", "observed", "missing", "change"])

    def close(self) -> None:
        pass


def _without(lo: np.ndarray, hi: np.ndarray, gone_lo: np.ndarray, gone_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ascending ranges less other such ranges."""
    # the complement of what is gone, cut with each range: pieces start at a range's start or behind a gone range
    starts = np.concatenate([lo, gone_hi + 1])
    starts = np.unique(starts[_inside(starts, lo, hi) & ~_inside(starts, gone_lo, gone_hi)])
    ends = np.concatenate([hi, gone_lo - 1])
    ends = np.unique(ends[_inside(ends, lo, hi) & ~_inside(ends, gone_lo, gone_hi)])
    return starts, ends


def _inside(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    if not len(lo):
        return np.zeros(len(x), bool)
    at = np.searchsorted(lo, x, "right") - 1
    return (at >= 0) & (x <= hi[np.maximum(at, 0)])


def open_gaps(stream: DataFrame, source: str = "server", seq: str = "seq") -> DataFrame:
    """Changes of the missing ranges of each source's sequence, which starts at 1: expected, observed, missing, change.

    Change is 1 where a range opens and -1 where it closes; a sequence that fills part of a range closes it and opens what is left of it.
    Summed over changes, the ranges with 1 are the gaps of all sequences seen so far, whatever their order
    (:func:`gaps_now`).  State is a source's open ranges.  Sequences below 1 and nulls are ignored.
    """

    def ranges(frames):
        for f in frames:
            out = []
            for key, values in f.groupby(source, dropna=False, sort=False)[seq]:
                v = values.to_numpy(np.int64)
                lo, hi = _merged(v, v)
                out.append(pd.DataFrame({source: None if pd.isna(key) else key, "lo": lo, "hi": hi}))
            if out:
                yield pd.concat(out)

    runs = stream.select(F.col(source).cast("string").alias(source), F.col(seq).cast("long").alias(seq)).where(F.col(seq) >= 1).mapInPandas(ranges, f"{source} string, lo long, hi long")
    return with_state_store(runs).groupBy(source).transformWithStateInPandas(_Gaps(source), f"{source} string, expected long, observed long, missing long, change int", "append", "None")


def gaps_now(changes: DataFrame, source: str = "server") -> DataFrame:
    """The ranges that are open after all changes."""
    return changes.groupBy(source, "expected", "observed", "missing").agg(F.sum("change").alias("_open")).where("_open = 1").drop("_open")


class _Episodes(StatefulProcessor):
    """Events wait in slots of time until the watermark has passed the slot; then they are thinned in order."""

    def __init__(self, gap_us: int, frames: int, critical: Sequence[str], ordinary: Sequence[str], kept: Sequence[str], slot_ms: int):
        self.gap_us, self.frames, self.slot_ms = gap_us, frames, slot_ms
        self.critical, self.ordinary, self.kept = set(critical), set(ordinary), set(kept)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", "t array<long>, id array<long>, type array<string>")
        self.state = handle.getValueState("state", "last long, ring array<long>")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for slot, part in frame.groupby(frame["t_us"] // (self.slot_ms * 1000), sort=False):
                slot = int(slot)
                new = [part["t_us"].tolist(), part["event_id"].tolist(), part["event_type"].tolist()]
                if self.waiting.containsKey((slot,)):
                    new = [[*a, *b] for a, b in zip(self.waiting.getValue((slot,)), new, strict=True)]
                else:
                    self.handle.registerTimer((slot + 1) * self.slot_ms)
                self.waiting.updateValue((slot,), tuple(new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = expiredTimerInfo.getExpiryTimeInMs() // self.slot_ms - 1
        if not self.waiting.containsKey((upto,)):  # taken by the first timer of this watermark
            return
        upto = max(upto, timerValues.getCurrentWatermarkInMs() // self.slot_ms - 1)
        last, ring = self.state.get() if self.state.exists() else (None, [])
        out, ring = [], list(ring)
        for slot in sorted(k for (k,) in self.waiting.keys() if k <= upto):
            for t, i, kind in sorted(zip(*self.waiting.getValue((slot,)), strict=True)):
                sampled = kind in self.ordinary and i % 100 == 0
                if sampled or (kind in self.critical and (last is None or t - last >= self.gap_us)):
                    out.append((*key, i, t, "sampled" if sampled else "critical", list(ring)))
                    last = t
                if kind in self.kept:
                    ring = [*ring, i][-self.frames :]
            self.waiting.removeKey((slot,))
        self.state.update((last, ring))
        yield pd.DataFrame(out, columns=["server", "round_id", "event_id", "t_us", "reason", "context"])

    def close(self) -> None:
        pass


EPISODE = "server string, round_id string, event_id long, t_us long, reason string, context array<long>"


def thinned_episodes(stream: DataFrame, gap_ms: int = 1000, frames: int = 60, critical: Sequence[str] = CRITICAL, ordinary: Sequence[str] = ORDINARY, kept: Sequence[str] = FRAMES, slot_ms: int = 1000) -> DataFrame:
    """Critical events as episodes unless one opened less than ``gap_ms`` before in the same (server, round); sampled ordinary ones always.

    The stream has server, round_id, event_id, t_us, event_type and a watermark.  Whatever the order and the batches that
    events come in, they are taken by (time, id) once the watermark has passed their slot of ``slot_ms``; events behind the watermark are dropped.
    ``context`` has the last ``frames`` frames (``kept`` types) before.  A task holds a slot, a ring and one time for each round; events that
    play no part (neither critical, ordinary nor frames) don't enter the state.
    """
    kinds = list(dict.fromkeys([*critical, *ordinary, *kept]))
    rows = stream.where(F.col("event_type").isin(kinds) & F.col("t_us").isNotNull() & F.col("event_id").isNotNull())
    rows = rows.select("server", F.col("round_id").cast("string").alias("round_id"), "event_id", "t_us", "event_type", "t")
    return with_state_store(rows).groupBy("server", "round_id").transformWithStateInPandas(_Episodes(gap_ms * 1000, frames, critical, ordinary, kept, slot_ms), EPISODE, "append", "EventTime")


def minute_totals(table: VersionedTable, keys: Sequence[str], value: str, most_deltas: int = 8) -> KeyedTotals:
    """Stored totals by start_us and ``keys``: n, total, low, high; the table's partitions are days."""
    measures = [total("n", F.lit(1)), total("total", F.col(value)), least("low", F.col(value)), most("high", F.col(value))]
    return KeyedTotals(table, [table.partition, "start_us", *keys], measures, most_deltas)


def store_totals(stream: DataFrame, checkpoint: str, totals: KeyedTotals, time: str = "t_us", width_us: int = 60_000_000, every: str | None = None) -> StreamingQuery:
    """Add each batch to stored totals: a late event changes its own minute, however late, and a repeated batch counts once."""

    def add(batch: DataFrame, batch_id: int) -> None:
        start = bucket(time, width_us)
        totals.add(batch.withColumn("start_us", start).withColumn(totals.table.partition, F.date_format(F.timestamp_micros(start), "yyyy-MM-dd")), batch_id)

    return fan_out(stream, checkpoint, {"totals": add}, every)


class Review:
    """What a periodic review knows over batches: counts of signatures, the last episode of each round, the episodes.

    All three are versioned tables below ``path`` that take a batch once, so a batch that is run again changes nothing.
    """

    def __init__(self, spark, path: str, gap_ms: int = 1000, least_seen: int = 12, critical: Sequence[str] = CRITICAL):
        self.gap_ms, self.least_seen, self.critical = gap_ms, least_seen, tuple(critical)
        self.seen = KeyedTotals(VersionedTable(spark, f"{path}/signatures", "share"), ["share", "signature"], [total("occurrences", F.col("n"))])
        self.last = KeyedTotals(VersionedTable(spark, f"{path}/last", "share"), ["share", "server", "round_id"], [most("t_us", F.col("created_us"))])
        self.opened = VersionedTable(spark, f"{path}/episodes", "day")

    def patterns(self) -> DataFrame:
        """All signatures with their occurrences over all batches; confirmed from ``least_seen`` on."""
        counted = self.seen.read().select("signature", "occurrences").withColumn("state", F.lit("candidate"))
        return confirm_patterns(counted, self.least_seen)

    def episodes(self, batch_id: int | None = None) -> DataFrame:
        """The episodes of all batches, or of one."""
        rows = self.opened.read().drop("day")
        return (rows if batch_id is None else rows.where(F.col("batch") == batch_id)).drop("batch")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Open and close a batch's episodes, count its signatures."""
        counts = batch.where("signature is not null").groupBy("signature").agg(F.count("*").alias("n"))
        self.seen.add(counts.withColumn("share", F.pmod(F.xxhash64("signature"), F.lit(16))), batch_id)
        rows = batch.select("server", "round_id", "event_id", "t_us", "event_type")
        carried = None if self.last.empty() or self.opened.manifest().tokens.get("review", -1) >= batch_id else self.last.read().select("server", "round_id", "t_us")
        now = batch.agg(F.max("t_us")).first()[0]
        opened = open_after(rows, carried, self.gap_ms, self.critical).select("server", "round_id", "event_id", F.col("t_us").alias("created_us"))
        opened = opened.withColumns({"status": F.lit("selected"), "closed_us": F.lit(None).cast("long")})
        closed = close_episodes(opened, (now or 0) + 1).withColumn("batch", F.lit(batch_id).cast("long")).withColumn("day", F.date_format(F.timestamp_micros("created_us"), "yyyy-MM-dd"))
        self.opened.append(closed, "review", batch_id)
        # from what is stored, of the batch's days: a batch that failed in between gives the same
        days = [r[0] for r in batch.select(F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd")).distinct().collect()]
        mine = self.opened.read(parts=days)
        mine = mine.groupBy("server", "round_id").agg(F.max("created_us").alias("created_us"))
        self.last.add(mine.withColumn("share", F.pmod(F.xxhash64("server", "round_id"), F.lit(16))), batch_id)


def open_after(rows: DataFrame, carried: DataFrame | None, gap_ms: int, critical: Sequence[str]) -> DataFrame:
    """Critical events that open an episode, given the last episode (server, round_id, t_us) of each round so far.

    A round is one sorted run that streams by; rows without a time or an id open nothing.
    """
    gap = gap_ms * 1000
    wanted = rows.where(F.col("event_type").isin(*critical) & F.col("t_us").isNotNull() & F.col("event_id").isNotNull()).select("server", "round_id", "event_id", "t_us")
    if carried is not None:
        wanted = wanted.unionByName(carried.join(wanted.select("server", "round_id").distinct(), ["server", "round_id"], "left_semi"), allowMissingColumns=True)

    def run(batches):
        now = known = recent = None
        first = True
        for pdf in batches:
            keep = []
            for server, round_id, i, t in zip(pdf["server"], pdf["round_id"], pdf["event_id"], pdf["t_us"], strict=True):
                key = tuple(None if pd.isna(k) else k for k in (server, round_id))
                if first or key != now:
                    now, known, recent, first = key, None, None, False
                if pd.isna(i):
                    known = t
                    keep.append(False)
                    continue
                opens = (recent is None or t - recent >= gap) and (known is None or abs(t - known) >= gap)
                recent = t if opens else recent
                keep.append(opens)
            yield pdf[keep].astype({"event_id": "int64"})

    dealt = wanted.repartition("server", "round_id").sortWithinPartitions("server", "round_id", F.col("event_id").isNotNull(), "t_us", "event_id")
    return dealt.mapInPandas(run, "server string, round_id string, event_id long, t_us long")


def review(stream: DataFrame, checkpoint: str, state: Review, every: str | None = "5 minutes") -> StreamingQuery:
    """Run :class:`Review` on a stream of server, round_id, event_id, t_us, event_type and signature."""
    return fan_out(stream, checkpoint, {"review": state.add}, every)


def run_until_idle(start: Callable[[], StreamingQuery], clock: bool = False) -> None:
    """Process all that a source has, batch by batch, and stop.

    With ``clock`` the query's state has times to live, for which Spark runs batches without end.  Every batch but the first after a
    restart (which may be an old one run again) asks the source first, so after three batches without rows it has nothing left.
    A query that has no times after all waits for data instead.
    """
    query = start()
    try:
        if not clock:
            query.processAllAvailable()
        while clock and not query.awaitTermination(0.1):
            last = [p["numInputRows"] for p in query.recentProgress[-3:]]
            if last == [0, 0, 0] or query.status["message"] == "Waiting for data to arrive":
                break
    finally:
        query.stop()
