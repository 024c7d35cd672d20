import json

from pyspark.sql import functions as F

from eventloom.operators import annotate as an
from eventloom.operators import anomaly as ab
from eventloom.operators import retention as rt
from eventloom.operators import scene as sc


def test_categories(spark):
    df = spark.createDataFrame([("OilBarrel01",), ("Crate",), (None,), ("Lift",), ("Chair",), ("BombX",)], "n string")
    assert [r.c for r in df.select(sc.object_category(F.col("n")).alias("c")).collect()] == ["barrel", "crate", "other", "platform", "furniture", "explosive"]


def test_half_even_cells(spark):
    df = spark.createDataFrame([(25.0, 75.0)], "x double, y double")
    assert tuple(sc.heatmap(df).first())[:2] == (0.0, 100.0)


def test_motifs_respect_span(spark):
    df = spark.createDataFrame([("p", 0.0, 1, "a"), ("p", 1000.0, 2, "b"), ("p", 9000.0, 3, "c")], "p string, t double, i long, a string")
    assert {(r.motif, r.n) for r in sc.motifs(df, ["p"], "t", "i", "a").collect()} == {("a>b", 1)}


def test_boost_levels(spark):
    rows = [(1.0, 0.6, 0.6, 0.3), (0.5, 9.0, 9.0, 9.0), (1.0, 0.3, 0.3, 0.0), (1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "c double, i double, g double, d double")
    assert [r.b for r in df.select(sc.boost_confidence(F.col("c"), F.col("i"), F.col("g"), F.col("d")).alias("b")).collect()] == ["high", "insufficient", "medium", "low"]


def test_robust_z_guards(spark):
    few = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert [r.robust_z for r in ab.robust_z(few, "v").collect()] == [None, None]
    flat = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (9.0,)], "v double")
    assert {r.robust_z for r in ab.robust_z(flat, "v").collect()} == {0.0}


def test_isolation_forest_finds_the_odd_one(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(300)] + [(999, 500.0, 500.0)]
    got = ab.isolation_scores(spark.createDataFrame(rows, "i long, a double, b double"), "i", ["a", "b"]).where("outlier").collect()
    assert 999 in {r.i for r in got} and len(got) <= 4


def test_chat_cores_are_disjoint(spark):
    df = spark.createDataFrame([(1, i) for i in range(25)], "room long, chat_id long")
    got = an.chat_contexts(df, "room", "chat_id").collect()
    cores = {w: [r.chat_id for r in got if r.window == w and r.is_core] for w in (0, 1)}
    assert (len(cores[0]), len(cores[1]), len({r.window for r in got})) == (20, 5, 2)
    assert sum(r.window == 0 for r in got) == 25 and sum(r.window == 1 for r in got) == 10


def test_packs_and_halving(spark):
    df = spark.createDataFrame([("c", 1, "x" * 50), ("c", 2, "y" * 500), ("c", 3, "z")], "s string, i long, t string")
    got = an.pack_messages(df, "s", "i", "t", 2, 150).orderBy("i").collect()
    assert [(r.pack, r.bytes) for r in got] == [(0, 50), (1, 125), (1, 1)]


def test_greedy_admission_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("q", 1, 5, 1), ("q", 2, 50, 1), ("q", 3, 4, 1)], "q string, i long, t long, b long")
    got = an.admit_greedy(df, "q", "i", "t", "b", 10, 10, 100).orderBy("i").collect()
    assert [r.admitted for r in got] == [True, False, True]


def test_payloads_lose_identifiers_and_fit(spark):
    payload = json.dumps({"session_id": "s", "a": {"Identity": 1, "deep": {"x": {"y": {"z": 1}}}}, "text": "t" * 5000, "list": list(range(50))})
    got = an.compact_payloads(spark.createDataFrame([(1, payload), (2, "{bad")], "i long, p string"), "p", 700).orderBy("i").collect()
    assert len(got[0].p.encode()) <= 700 and "session" not in got[0].p and "Identity" not in got[0].p and got[1].p is None


def test_strict_annotations(spark):
    rows = [(1, '{"chat_id":1,"toxicity":0.5,"category":"c"}'), (2, '{"chat_id":2,"toxicity":0.5,"category":"c","x":1}'), (3, '{"chat_id":4,"toxicity":0.5,"category":"c"}'), (4, '{"chat_id":4,"toxicity":2,"category":"c"}'), (5, "{"), (6, None)]
    got = an.validate_annotations(spark.createDataFrame(rows, "i long, b string"), "b", "i").orderBy("i").collect()
    assert [r.valid for r in got] == [True, False, False, False, False, False]


def test_eviction_order(spark):
    df = spark.createDataFrame([(1, 10, 0, 1), (2, 10, 0, 2), (3, 10, 1, 0)], "i long, size long, priority long, created long")
    got = rt.evict_over_quota(df, "size", "priority", "created", "i", 20).orderBy("i").collect()
    assert [r.evict for r in got] == [True, False, False]


def test_whole_episodes(spark):
    episodes = spark.createDataFrame([(1, "r", 10_000.0, ["a", "b", None]), (2, "r", 10_500.0, []), (3, None, 1.0, ["a"]), (4, "q", None, ["a"]), (5, "q", 0.0, None)], "episode_id long, round_id string, game_ms double, entities array<string>")
    rows = [(i, "r", e, 5_000.0 + 100 * (i // 2)) for i, e in enumerate(["a", "b", "c", None] * 40)] + [(900, "q", "a", -5000.0), (901, "q", "a", 2000.0), (902, "q", "a", 2000.1), (903, None, "a", 1.0), (904, "q", "a", None)]
    df = spark.createDataFrame(rows, "id long, round_id string, e string, game_ms double")
    sources = {"own": sc.EpisodeSource(df, "id", ["e"], 7, "e"), "any": sc.EpisodeSource(df, "id", ["e", "id"], None), "few": sc.EpisodeSource(df, "id", ["id"], 3)}
    got = sorted((r.episode_id, r.source, r.nth, r.row_id, r.offset_ms, json.loads(r.value)) for r in sc.whole_episodes(episodes, sources, cells=3).collect())
    want = []
    for i, round_id, at, own in [(1, "r", 10_000.0, {"a", "b"}), (2, "r", 10_500.0, set()), (5, "q", 0.0, set())]:
        for name, limit in (("own", 7), ("any", None), ("few", 3)):
            near = sorted((t - at, j, e) for j, r, e, t in rows if r == round_id and t is not None and -5000 <= t - at <= 2000 and (name != "own" or e in own))
            for n, (off, j, e) in enumerate(near[:limit]):
                value = {"e": e} if name == "own" else {"id": j} | ({"e": e} if name == "any" else {})
                want.append((i, name, n + 1, j, off, {k: v for k, v in value.items() if v is not None}))
    assert got == sorted(want)
