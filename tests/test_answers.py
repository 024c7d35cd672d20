"""Validation by shape, import of a batch's answers, stored retention."""

import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import answers as an
from eventloom.operators import retention as rt
from eventloom.sources.sinks import upsert_versioned_days
from eventloom.sources.versioned import VersionedTable


def annotation(chat_id, **more):
    base = {"chat_id": chat_id, "language": "en", "intent": None, "sentiment": 0.5, "topics": [], "toxicity": dict.fromkeys(an.TOXICITY_KEYS, 0.1), "target_actor_keys": [1], "reply_to_chat_id": None}
    return base | {"explicit_leave_reason": {"present": False, "category": None}, "confidence": 1, "evidence_chat_ids": ["a"]} | more


def narrative(**more):
    return {"headline": "h"} | {k: ["x"] for k in an.NARRATIVE_LISTS} | more


def window(window_id, **more):
    free = dict.fromkeys(["classification", "mechanic_family", "advantage_observed", "advantage_description", "known_pattern_id", "candidate_signature_features", "should_create_candidate"], "x")
    return free | {"window_id": window_id, "novelty_score": 0, "confidence": 0.5, "observations": [], "evidence_event_ids": [1, 2]} | more


def without(value, key):
    return {k: v for k, v in value.items() if k != key}


CASES = [
    ("annotation", annotation(1), True),
    ("annotation", annotation(1, extra=1), False),
    ("annotation", without(annotation(1), "intent"), False),
    ("annotation", annotation(1, confidence=1.5), False),
    ("annotation", annotation(1, confidence=-0.1), False),
    ("annotation", annotation(1, confidence="high"), False),
    ("annotation", annotation(1, topics="none"), False),
    ("annotation", annotation(1, toxicity={"score": 1}), False),
    ("annotation", annotation(1, toxicity=dict.fromkeys([*an.TOXICITY_KEYS, "more"], 1)), False),
    ("annotation", annotation(1, explicit_leave_reason=None), False),
    ("narrative", narrative(), True),
    ("narrative", narrative(limitations=[]), True),
    ("narrative", narrative(limitations=[1]), False),
    ("narrative", narrative(limitations=["a", 1]), False),
    ("narrative", narrative(headline=3), False),
    ("narrative", narrative(more=[]), False),
    ("gameplay", window("w"), True),
    ("gameplay", window("v"), False),
    ("gameplay", window("w", novelty_score=2), False),
    ("gameplay", window("w", observations={}), False),
]


def test_shapes(spark):
    rows = [(k, json.dumps(v), ok) for k, v, ok in CASES] + [(k, b, False) for k in ("annotation", "narrative", "gameplay") for b in ("{", None, "[]", "3", "")]
    df = spark.createDataFrame(rows, "kind string, body string, ok boolean")
    shapes = {"annotation": an.ANNOTATION, "narrative": an.NARRATIVE, "gameplay": an.gameplay(F.lit("w"))}
    for kind, shape in shapes.items():
        for r in df.where(F.col("kind") == kind).withColumn("got", an.valid(F.col("body"), shape)).collect():
            assert r.got == r.ok, r


def response(answer, tokens=None):
    text = answer if isinstance(answer, str) else json.dumps(answer)
    body = {"output": [{"content": [{"type": "output_text", "text": text}]}]} if tokens else {"output_text": text}
    return json.dumps(body | ({"usage": {"total_tokens": tokens}} if tokens else {}))


def test_import_routes_every_answer(spark):
    cases = {
        "c1": ("chat", "1,2", 0, {"annotations": [annotation(2), annotation(1)]}, "complete"),
        "c2": ("chat", "1,2", 0, {"annotations": [annotation(1)]}, "queued"),  # one is missing
        "c3": ("chat", "1", 3, {"annotations": [annotation(1, extra=1)]}, "malformed"),  # tried often enough
        "c4": ("chat", "1", 0, {"other": []}, "malformed"),  # no annotations at all
        "c5": ("chat", "1", 2, {"annotations": [annotation(1), annotation(1)]}, "queued"),  # one twice
        "n1": ("narrative", "2026-01-01", 0, narrative(), "complete"),
        "n2": ("narrative", "2026-01-02", 0, "not json", "queued"),
        "g1": ("gameplay", "w1", 0, window("w1"), "complete"),
        "g2": ("gameplay", "w2", 3, window("w1"), "malformed"),
        "x1": ("other", "?", 0, {}, "queued"),
    }
    requests = spark.createDataFrame([(h, t, i, "m", n) for h, (t, i, n, _, _) in cases.items()] + [("open", "chat", "9", "m", 0)], "request_hash string, source_type string, source_id string, model string, attempts int")
    responses = spark.createDataFrame([(h, response(a, 7 if h == "c1" else None)) for h, (*_, a, _) in cases.items()] + [("unknown", response({})), ("n1x", None)], "request_hash string, body string")
    out = an.import_answers(responses, requests)
    assert {r.request_hash: r.status for r in out.requests.collect()} == {h: c[-1] for h, c in cases.items()}
    assert sorted((r.chat_id, r.request_hash, json.loads(r.annotation)["language"]) for r in out.annotations.collect()) == [(1, "c1", "en"), (2, "c1", "en")]
    assert [(r.report_date, json.loads(r.narrative)) for r in out.narratives.collect()] == [("2026-01-01", narrative())]
    assert [(r.window_id, json.loads(r.gameplay)["confidence"]) for r in out.gameplay.collect()] == [("w1", 0.5)]
    assert {r.request_hash: r.total_tokens for r in out.ledger.collect() if r.total_tokens} == {"c1": 7}
    assert {r.request_hash: r.status for r in out.all.collect() if r.source_type is None} == {"unknown": "malformed", "n1x": "malformed"}


def test_narratives_go_into_the_newest_report(spark):
    reports = [("d1", 3, '{"a":1}', "pending"), ("d1", 4, '{"a":"x","b":{"c":[1]}}', "pending"), ("d2", 4, '{"narrative":1,"a":2}', "pending"), ("d3", 1, "{}", "pending"), ("d4", 1, "{}", "pending")]
    df = spark.createDataFrame(reports, "report_date string, metric_version int, report string, llm_status string")
    told = spark.createDataFrame([("d1", '{"headline":"h"}'), ("d2", '{"headline":"i"}'), ("d3", '{"headline":"j"}'), ("none", "{}")], "report_date string, narrative string")
    got = {(r.report_date, r.metric_version): (json.loads(r.report), r.llm_status) for r in an.merge_narratives(df, told).collect()}
    assert got[("d1", 3)] == ({"a": 1}, "pending") and got[("d4", 1)] == ({}, "pending")
    assert got[("d1", 4)] == ({"a": "x", "b": {"c": [1]}, "narrative": {"headline": "h"}}, "complete")
    assert got[("d2", 4)] == ({"a": 2, "narrative": {"headline": "i"}}, "complete") and got[("d3", 1)] == ({"narrative": {"headline": "j"}}, "complete")


DAY = 86_400_000_000


@pytest.fixture
def days(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "day")
    rows = spark.range(100).select("id", (F.col("id") * (DAY // 10)).alias("t_us"))  # ten days of ten rows
    more = spark.createDataFrame([(1000, None)], "id long, t_us long")
    table.replace(rows.unionByName(more).withColumn("day", F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd")))
    return table


def test_retention_touches_only_the_days_concerned(spark, days):
    before = days.manifest()
    kept = spark.createDataFrame([(15, 15 * (DAY // 10)), (42, 42 * (DAY // 10)), (77, 77 * (DAY // 10))], "id long, t_us long")
    pinned = days.read()
    gone, edited = rt.expire_stored(days, "t_us", 10 * DAY, int(4.5 * 86400), kept, "id")
    assert gone == ["1970-01-01", "1970-01-03", "1970-01-04"] and edited == ["1970-01-02", "1970-01-05", "1970-01-06"]
    assert sorted(r.id for r in days.read().collect()) == [15, 42, *range(55, 100), 1000]
    after = days.manifest()
    for day in ["null", *(f"1970-01-{d:02d}" for d in range(7, 11))]:
        assert after.parts[day] == before.parts[day]  # the same files
    assert pinned.count() == 101  # a reader of the version before
    assert rt.expire_stored(days, "t_us", 0, 86400) == ([], [])
    assert rt.expire_stored(days, "t_us", 100 * DAY, 86400)[1] == [] and [r.id for r in days.read().collect()] == [1000]


def test_versioned_days(spark, days):
    first = days.manifest().version
    upsert_versioned_days(spark.createDataFrame([(5, 3 * DAY, "1970-01-04")], "id long, t_us long, day string"), days)
    assert days.read(first).count() == 101 and days.read().count() == 92
