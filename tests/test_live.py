"""Ordered source, versioned tables and state over batches: batches cut anywhere give what one pass gives."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators.quality import sequence_gaps
from eventloom.sources.ordered import OrderedReader, ordered_stream
from eventloom.sources.versioned import KeyedTotals, VersionedTable, least, most, total
from eventloom.streaming import events as st
from eventloom.streaming import live


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, t_us long, server string, round_id string, event_type string, signature string, seq long, object_id long, x double, y double, vx double, vy double, value double")


def row(i, t_ms, server="s", round_id="r", kind="player_death", signature="a", seq=None, obj=1, x=0.0, y=0.0, vx=0.0, vy=0.0, value=1.0):
    return (i, t_ms * 1000, server, round_id, kind, signature, seq or i + 1, obj, x, y, vx, vy, value)


class Feed:
    """A table that grows, and a stream over it that is stopped and started again."""

    def __init__(self, spark, path, batch_rows=500):
        self.spark, self.path, self.batch_rows = spark, str(path), batch_rows
        self.times = 0

    def add(self, rows):
        events(self.spark, rows).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def stream(self):
        return ordered_stream(self.spark, f"{self.path}/in", self.batch_rows, unbounded=True)

    def run(self, result, each=None, clock=False):
        """``result(stream)`` to a folder (or to ``each``) until the source is idle; a new query each time."""
        writer = result(self.stream()).writeStream.option("checkpointLocation", f"{self.path}/checkpoint").trigger(processingTime="0 seconds")
        writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{self.path}/out").outputMode("append")
        live.run_until_idle(writer.start, clock)

    def out(self, schema):
        return self.spark.read.schema(schema).parquet(f"{self.path}/out")


def test_batches_are_bounded_and_in_order(spark, tmp_path):
    feed, seen = Feed(spark, tmp_path, 500), []

    def each(batch, number):
        seen.append((number, *batch.agg(F.count("*"), F.min("event_id"), F.max("event_id")).first()))

    feed.add([row(i, i) for i in range(1000, 1700)])
    feed.add([row(i, i) for i in range(0, 1000, 2)])
    feed.run(lambda s: s, each)
    assert seen == [(0, 500, 0, 998), (1, 500, 1000, 1499), (2, 200, 1500, 1699)]
    feed.run(lambda s: s, each)
    assert len(seen) == 3  # nothing new
    feed.add([row(i, i) for i in range(1700, 2300)] + [row(2300, 1), row(2300, 2)])
    feed.run(lambda s: s, each)
    assert seen[3:] == [(3, 500, 1700, 2199), (4, 102, 2200, 2300)]
    assert OrderedReader(f"{tmp_path}/in", "event_id", 100).next_offset(2300) == 2300


def test_batch_size_is_held_to_its_range(spark, tmp_path):
    feed, seen = Feed(spark, tmp_path), []
    feed.add([row(i, i) for i in range(1100)])
    query = ordered_stream(spark, f"{tmp_path}/in", 3).writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="0 seconds")
    live.run_until_idle(query.start)
    assert seen == [500, 500, 100]


def test_readers_of_a_version_are_not_disturbed(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "day")
    frame = lambda rows: spark.createDataFrame(rows, "day string, k long, v long")
    first = table.replace(frame([("d1", 1, 1), ("d2", 1, 2), (None, 9, 9)]))
    pinned = table.read(first)
    second = table.replace(frame([("d2", 1, 3), ("d2", 2, 4)]))
    table.append(frame([("d3", 1, 5)]))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(pinned) == rows(table.read(first)) == sorted([("d1", 1, 1), ("d2", 1, 2), (None, 9, 9)], key=str)
    assert rows(table.read()) == sorted([("d1", 1, 1), ("d2", 1, 3), ("d2", 2, 4), ("d3", 1, 5), (None, 9, 9)], key=str)
    assert rows(table.read(parts=["d2"])) == [("d2", 1, 3), ("d2", 2, 4)] and rows(table.read(parts=["null"])) == [(None, 9, 9)]
    # what isn't written keeps its files
    assert table.manifest(first).parts["d1"] == table.manifest(second).parts["d1"] and table.manifest(first).parts["d2"] != table.manifest(second).parts["d2"]
    table.drop(["d1", "nowhere"])
    assert [r.day for r in table.read().where("day = 'd1'").collect()] == [] and rows(pinned)[0][0] == "d1"
    assert table.vacuum(1) == 2 and table.versions() == [4] and table.read().count() == 4
    assert table.read(parts=[]).count() == 0
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, f"file://{tmp_path}/none", "day").read()


def test_two_writers_at_once_and_tokens(spark, tmp_path):
    a, b = (VersionedTable(spark, f"file://{tmp_path}/t", "day") for _ in range(2))
    frame = spark.createDataFrame([("d", 1)], "day string, v long")
    a.append(frame, "one", 0)
    commit, lost = b._commit, []

    def beaten(manifest):
        if not lost:  # the other writer takes the version first
            lost.append(manifest.version)
            a.append(frame, "two", 5)
        return commit(manifest)

    b._commit = beaten
    b.append(frame, "one", 1)
    assert lost == [2] and a.versions() == [1, 2, 3] and a.read().count() == 3
    for token in (0, 1):
        a.append(frame, "one", token)  # again
    assert a.read().count() == 3 and a.manifest().tokens == {"one": 1, "two": 5}


def test_totals_merge_late_events_and_repeated_batches(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "day")
    totals = KeyedTotals(table, ["day", "k"], [total("n", F.lit(1)), total("s", F.col("v")), least("low", F.col("v")), most("high", F.col("v"))], most_deltas=2)
    rnd, every = random.Random(1), []
    for batch in range(7):
        rows = [(rnd.choice(["d1", "d2"]) if batch < 5 else "d1", rnd.randrange(3), rnd.randrange(100)) for _ in range(20)]
        every += rows
        for _ in range(2):  # each batch twice
            totals.add(spark.createDataFrame(rows, "day string, k long, v long"), batch)
        assert all(len(folders) <= 2 for folders in table.manifest().parts.values())
    want = {}
    for d, k, v in every:
        n, s, low, high = want.get((d, k), (0, 0, v, v))
        want[(d, k)] = (n + 1, s + v, min(low, v), max(high, v))
    assert {(r.day, r.k): (r.n, r.s, r.low, r.high) for r in totals.read().collect()} == want
    totals.compact()
    assert table.read().count() == len(want) and len(os.listdir(f"{tmp_path}/t/versions")) <= 4  # grows with keys


def test_stored_minutes(spark, tmp_path):
    feed = Feed(spark, tmp_path, 3)
    totals = live.minute_totals(VersionedTable(spark, f"file://{tmp_path}/minutes", "day"), ["event_type"], "value", 2)

    def run():
        query = lambda: live.store_totals(feed.stream(), f"{tmp_path}/checkpoint", totals, every="0 seconds")
        live.run_until_idle(query)

    feed.add([row(i, 60_000 * (i // 4), value=float(i)) for i in range(10)])
    run()
    late = [row(10, 1_000, value=100.0), row(11, 60_000 * 3000)]  # into the first minute, and days later
    feed.add(late)
    run()
    got = {(r.start_us // 60_000_000, r.event_type): (r.n, r.total, r.low, r.high) for r in totals.read().collect()}
    assert got == {(0, "player_death"): (5, 106.0, 0.0, 100.0), (1, "player_death"): (4, 22.0, 4.0, 7.0), (2, "player_death"): (2, 17.0, 8.0, 9.0), (3000, "player_death"): (1, 1.0, 1.0, 1.0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_close_in_any_order(spark, tmp_path, seed):
    rnd, feed = random.Random(seed), Feed(spark, tmp_path, 25)
    seqs = [(s, q) for s in ("a", "b", None) for q in range(1, 60) if rnd.random() < 0.8]
    rnd.shuffle(seqs)
    seqs += seqs[:10]
    feed.add([row(i, i, server=s, seq=q) for i, (s, q) in enumerate(seqs[:100])])
    feed.run(live.open_gaps)
    feed.add([row(100 + i, i, server=s, seq=q) for i, (s, q) in enumerate(seqs[100:])])
    feed.run(live.open_gaps)  # goes on after a restart
    changes = feed.out("server string, expected long, observed long, missing long, change int")
    got = sorted((tuple(r) for r in live.gaps_now(changes).collect()), key=str)
    want = sequence_gaps(spark.createDataFrame(seqs, "server string, seq long"), "server", "seq")
    assert got == sorted((tuple(r) for r in want.collect()), key=str) and changes.where("change = -1").count() > 10


def test_scene_state_is_bounded_and_forgets_rounds(spark, tmp_path):
    feed = Feed(spark, tmp_path, 4)
    deltas = lambda s, **kw: live.scene_deltas(s.withColumn("kind", F.lit("object")).withColumn("game_ms", F.col("t_us") / 1000), **kw)
    schema = "event_id long, distance double, intensity double, acceleration double"
    feed.add([row(0, 0), row(1, 100, x=1.0, vx=1.0), row(2, 200, x=4.0, y=4.0, vx=1.0), row(3, 200, obj=2), row(4, 200, x=5.0, y=4.0)])
    feed.run(deltas, clock=True)
    feed.add([row(5, 300, x=5.0, y=5.0), row(6, 0, round_id="r2"), row(7, 100, round_id="r2", x=2.0), row(8, 400, server="s2"), row(9, 400, obj=2, round_id="r2")])
    feed.run(deltas, clock=True)  # state kept over a restart
    got = {r.event_id: (r.distance, r.intensity, r.acceleration) for r in feed.out(schema).collect()}
    assert got[0] == (None, 0.0, None) and got[1] == (1.0, 1.0, 10.0) and got[2] == (5.0, 1.0, 0.0) and got[3][0] is None
    assert got[4] == (1.0, 0.0, 1000.0)  # no time between: one millisecond
    assert got[5][0] == 1.0 and got[6][0] is None and got[7][0] == 2.0 and got[8][0] is None and got[9][0] is None
    small = Feed(spark, tmp_path / "small", 3)
    small.add([row(i, i, obj=o, x=float(i)) for i, o in enumerate([1, 2, 1, 3, 1, 2, 3])])
    small.run(lambda s: deltas(s, limit=2, spread=1), clock=True)
    got = {r.event_id: r.distance for r in small.out(schema).collect()}
    # the third entity makes the state forget the two others
    assert got == {0: None, 1: None, 2: 2.0, 3: None, 4: None, 5: None, 6: None}


def test_scene_state_keeps_every_entity(spark, tmp_path):
    """Two entities of 1,000 share one of 50,000 states now and then; none forgets the other, within a batch and over batches."""
    feed, n = Feed(spark, tmp_path, 700), 1000
    feed.add([row(i, 100 * i, obj=i % n, x=float(i // n)) for i in range(3 * n)])
    feed.run(lambda s: live.scene_deltas(s.withColumn("kind", F.lit("object")).withColumn("game_ms", F.col("t_us") / 1000), spread=50_000))
    got = {r.event_id: r.distance for r in feed.out("event_id long, distance double").collect()}
    assert got == {i: 1.0 if i >= n else None for i in range(3 * n)}


def thinned(rows, gap_us, frames, kept, upto):
    last, ring, out = {}, {}, []
    for i, t, server, round_id, kind, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (server, round_id)
        sampled = kind == "highres_state_sample" and i % 100 == 0
        if t < upto and (sampled or (kind == "player_death" and (key not in last or t - last[key] >= gap_us))):
            out.append((server, round_id, i, t, "sampled" if sampled else "critical", ring.get(key, [])[-frames:]))
            last[key] = t
        if kind in kept:
            ring[key] = [*ring.get(key, []), i]
    return out


@pytest.mark.parametrize("batch_rows", [17, 1000])
def test_thinning_in_event_time(spark, tmp_path, batch_rows):
    rnd = random.Random(3)
    rows = [row(i, 100 * i + rnd.randrange(-2000, 2000) + 10_000, round_id=rnd.choice(["r1", "r2"]), kind=rnd.choice(["player_death", "highres_state_sample", "state_sample", "chat"]) if i % 100 else "highres_state_sample") for i in range(300)]
    feed = Feed(spark, tmp_path, batch_rows)
    episodes = lambda s: live.thinned_episodes(st.with_event_time(s, "t_us", "10 seconds"), 1000, 3)
    feed.add(rows[:170])
    feed.run(episodes)
    feed.add(rows[170:])
    feed.run(episodes)
    got = sorted(tuple(r) for r in feed.out(live.EPISODE).collect())
    newest = max(r[1] for r in rows)
    passed = (newest // 1000 - 10_000) // 1000 * 1_000_000  # the watermark, by whole slots
    want = thinned(rows, 1_000_000, 3, live.FRAMES, passed)
    assert got == sorted(want) and {r[4] for r in got} == {"critical", "sampled"}


def test_review_goes_on_over_batches(spark, tmp_path):
    state = live.Review(spark, f"file://{tmp_path}/review")
    batches = [[row(i, 10_000 * i, signature="a") for i in range(5)], [row(5 + i, 60_000 + 10_000 * i, signature="a") for i in range(4)]]
    batches += [[row(9, 90_500, signature="a"), *[row(10 + i, 200_000 + i, kind="chat", signature="a") for i in range(2)], row(20, 300_000, signature="b")]]
    for number, rows in enumerate(batches):
        for _ in range(2):  # again: nothing changes
            state.add(events(spark, rows), number)
        counts = {r.signature: (r.occurrences, r.state) for r in state.patterns().collect()}
        assert counts["a"][1] == ("confirmed" if number == 2 else "candidate")
    assert counts == {"a": (12, "confirmed"), "b": (1, "candidate")}
    opened = sorted(r.event_id for r in state.episodes().collect())
    assert opened == [*range(9), 20]  # 9 is half a second behind 8, of the batch before
    assert all(r.closed_us is not None for r in state.episodes().collect())


def test_review_as_a_stream(spark, tmp_path):
    feed, state = Feed(spark, tmp_path, 3), live.Review(spark, f"file://{tmp_path}/review", least_seen=6)
    rows = [row(i, 400 * i) for i in range(10)]
    feed.add(rows)
    live.run_until_idle(lambda: live.review(feed.stream(), f"{tmp_path}/checkpoint", state, "0 seconds"))
    assert [r.event_id for r in state.episodes().orderBy("event_id").collect()] == [0, 3, 6, 9]
    assert [tuple(r) for r in state.patterns().select("signature", "occurrences", "state").collect()] == [("a", 10, "confirmed")]
    assert json.dumps(state.opened.manifest().tokens) == '{"review": 3}'
