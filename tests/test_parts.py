"""Brute-force and property tests of the operators that parts of queries use."""

import random

from pyspark.sql import functions as F

from eventloom.operators import anomaly as am
from eventloom.operators import annotate as an
from eventloom.operators import quality as ql
from eventloom.operators import scene as sc
from eventloom.plans import report as rp
from eventloom.streaming import events as st


def test_nearest_rows_against_a_loop(spark):
    rnd = random.Random(1)
    left = [(i, rnd.choice(["a", "b", None]), rnd.randrange(40), float(rnd.randrange(60))) for i in range(80)]
    left[0] = (0, *left[1][1:])  # a repeated row but for its id
    right = [(i, rnd.choice(["a", "b", None]), rnd.randrange(40) if i % 9 else None, float(rnd.randrange(60)), float(i)) for i in range(400)]
    spans = {"before": (-5.0, 0.0, True), "after": (0.0, 5.0, False), "later": (10.0, 20.0, False)}
    got = sc.nearest_within(spark.createDataFrame(left, "id long, r string, e long, t double"), spark.createDataFrame(right, "rid long, r string, e long, t double, v double"), ["r", "e"], "id", "t", "t", "rid", ["v"], spans)
    found = {x.id: tuple(x[n].v if x[n] else None for n in spans) for x in got.collect()}
    for i, r, e, t in left:
        want = []
        for low, high, latest in spans.values():
            met = [(rt, rid, v) for rid, rr, re, rt, v in right if r is not None and rr == r and re == e and t + low <= rt <= t + high]
            want.append((max(met) if latest else min(met))[2] if met else None)
        assert found.get(i, (None,) * 3) == tuple(want)


def test_gaps_and_numbers_do_not_depend_on_cells(spark):
    rnd = random.Random(2)
    rows = [(s, q) for s in ("a", "b") for q in sorted(rnd.sample(range(1, 400), 150))]
    df = spark.createDataFrame(rows + rows[:20], "s string, q long")
    want = sorted(map(tuple, ql.sequence_gaps(df, "s", "q", 1 << 20).collect()))
    assert want and want == sorted(map(tuple, ql.sequence_gaps(df, "s", "q", 7).collect()))
    ids = df.select("q").distinct()
    assert sorted((r.q, r.nth) for r in ql.numbered(ids, "q", cell=16).collect()) == [(q, k + 1) for k, q in enumerate(sorted({q for _, q in rows}))]


def test_isolation_flags_the_far_points(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(990)] + [(1000 + i, 30.0 + i, -40.0) for i in range(10)]
    got = am.isolation_scores(spark.createDataFrame(rows, "i long, x double, y double"), "i", ["x", "y"]).collect()
    flagged = {r.i for r in got if r.outlier}
    scores = sorted(r.score for r in got)
    at = 999 * 0.99
    cut = scores[int(at)] + (scores[int(at) + 1] - scores[int(at)]) * (at - int(at))
    assert flagged == {r.i for r in got if r.score > cut} and len(flagged & set(range(1000, 1010))) >= 8


def test_superseding_spares_what_was_sent(spark):
    rows = [(1, "gameplay", "queued", "old@v2", "{}"), (2, "gameplay", "done", "old", "{}"), (3, "gameplay", "queued", "new", '{"a":{"Session_id":1}}'), (4, "gameplay", "queued", "new", '{"a":1}'), (5, "chat", "queued", "old", "{}"), (6, "gameplay", "queued", "new", '{"session'), (7, "gameplay", "queued", "new", None), (8, "gameplay", "queued", None, "{}")]
    got = {r.id: r.status for r in an.supersede(spark.createDataFrame(rows, "id long, source_type string, status string, kind string, payload string"), "old").collect()}
    assert got == {1: "superseded", 2: "done", 3: "superseded", 4: "queued", 5: "queued", 6: "queued", 7: "queued", 8: "queued"}


def test_scene_matches_and_review(spark):
    rows = spark.createDataFrame([(1, "high"), (2, "medium"), (3, "low"), (4, "insufficient")], "interaction_id long, confidence string")
    assert {(r.interaction_id, r.confidence) for r in sc.scene_pattern_matches(rows).collect()} == {(1, 1.0), (2, 0.65)}
    candidates = spark.createDataFrame([("a", 12, "candidate"), ("b", 11, "candidate"), ("c", 1, "confirmed")], "signature string, occurrences long, state string")
    assert {r.signature: r.state for r in rp.confirm_patterns(candidates).collect()} == {"a": "confirmed", "b": "candidate", "c": "confirmed"}
    assert {r.signature: r.state for r in rp.confirm_patterns(candidates, 1).collect()}["c"] == "confirmed"


def test_fan_out_writes_a_batch_again_without_repeats(spark, tmp_path):
    rows = spark.range(40).selectExpr("'s' as server", "'r' as round_id", "id as event_id", "id * 700000 as t_us", "if(id % 4 = 0, 'player_death', 'x') as event_type", "cast(id % 3 as string) as signature")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    calls = []

    def twice(name):
        write = st.keyed_sink(f"{tmp_path}/{name}")

        def again(batch, batch_id):
            calls.append((name, batch_id))
            write(batch, batch_id)
            write(batch, batch_id)

        return again

    st.periodic_review(stream, f"{tmp_path}/c", twice("episodes"), twice("patterns"), every=None).awaitTermination()
    episodes, patterns = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("episodes", "patterns"))
    assert len({b for _, b in calls}) > 1 and patterns.agg(F.sum("occurrences")).first()[0] == 40
    kept = [r.event_id for r in episodes.collect()]
    assert len(kept) == len(set(kept)) and all(r.closed_us is not None and r.closed_us > r.created_us for r in episodes.collect())
    calls.clear()
    st.periodic_review(stream, f"{tmp_path}/c", twice("episodes"), twice("patterns"), every=None).awaitTermination()
    assert not calls and spark.read.parquet(f"{tmp_path}/patterns").agg(F.sum("occurrences")).first()[0] == 40
