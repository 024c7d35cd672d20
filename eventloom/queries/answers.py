"""Queries of answers, stored retention and versions.

Answers are made from ``labels``: a chat, narrative or gameplay answer for each labelled document, some of them broken.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers as an
from ..operators import retention as rt
from ..sources.sinks import upsert_versioned_days
from ..sources.versioned import VersionedTable
from .shapes import Shapes, query
from .streaming import _folder

_ANNOTATION = {"chat_id": "@", "language": "en", "intent": None, "sentiment": 0.5, "topics": [], "toxicity": dict.fromkeys(an.TOXICITY_KEYS, 0.1), "target_actor_keys": [], "reply_to_chat_id": None, "explicit_leave_reason": {"present": False, "category": None}, "confidence": 0.75, "evidence_chat_ids": [1]}
_NARRATIVE = {"headline": "a day"} | {k: ["x"] for k in an.NARRATIVE_LISTS}
_FREE = ["classification", "mechanic_family", "advantage_observed", "advantage_description", "known_pattern_id", "candidate_signature_features", "should_create_candidate"]
_GAMEPLAY = {"window_id": "w@", "novelty_score": 0.5, "confidence": 0.75, "observations": [], "evidence_event_ids": [1]} | dict.fromkeys(_FREE, "x")

#: What is broken, by the document's id: cut short, a key too many, a value out of its range or of another type.
_BROKEN = "doc_id % 11 = 0 or doc_id % 7 = 0 or doc_id % 13 = 0"
_GOOD = f"not ({_BROKEN})"


def _filled(template: dict, row_id, bad: str) -> F.Column:
    """The template as JSON text for an id, broken by the rules above; ``bad`` is the value's text for the third."""
    text = json.dumps(template, separators=(",", ":"))
    whole = F.replace(F.replace(F.lit(text), F.lit('"@"'), row_id.cast("string")), F.lit("@"), row_id.cast("string"))
    wrong = F.replace(F.replace(whole, F.lit('"confidence":0.75'), F.lit(bad)), F.lit('"limitations":["x"]'), F.lit('"limitations":[1]'))
    doc = F.col("doc_id")
    more = F.concat(F.lit('{"more":1,'), F.substr(whole, F.lit(2)))
    return F.when(doc % 11 == 0, F.substring(whole, 1, 20)).when(doc % 7 == 0, more).when(doc % 13 == 0, wrong).otherwise(whole)


def _answers(s: Shapes) -> DataFrame:
    i = F.col("doc_id")
    pair = F.concat(F.lit('{"annotations":['), _filled(_ANNOTATION, i, '"confidence":2'), F.lit(","), _filled(_ANNOTATION, i + 1, '"confidence":2'), F.lit("]}"))
    rows = s.labels.select("doc_id", F.element_at(F.array(F.lit("chat"), F.lit("narrative"), F.lit("gameplay")), (i % 3 + 1).cast("int")).alias("source_type"))
    answer = F.when(i % 3 == 0, pair).when(i % 3 == 1, _filled(_NARRATIVE, i, "")).otherwise(_filled(_GAMEPLAY, i, '"confidence":2'))
    source = F.when(i % 3 == 0, F.concat_ws(",", i, i + 1)).when(i % 3 == 1, F.concat(F.lit("day"), i)).otherwise(F.concat(F.lit("w"), i))
    return rows.select("doc_id", "source_type", source.alias("source_id"), answer.alias("answer"))


@query("sc27_validate_narratives", f"select doc_id, {_GOOD} as valid from labels where doc_id % 3 = 1")
def narratives(s):
    return _answers(s).where("source_type = 'narrative'").select("doc_id", an.valid(F.col("answer"), an.NARRATIVE).alias("valid"))


@query("sc27_validate_gameplay", f"select doc_id, {_GOOD} as valid from labels where doc_id % 3 = 2")
def gameplay(s):
    return _answers(s).where("source_type = 'gameplay'").select("doc_id", an.valid(F.col("answer"), an.gameplay(F.col("source_id"))).alias("valid"))


def _imported(s: Shapes) -> an.Imported:
    """All answers but every fourth one's request is unknown."""
    rows = _answers(s).withColumn("request_hash", F.sha2(F.col("doc_id").cast("string"), 256))
    responses = rows.select("request_hash", F.to_json(F.struct(F.col("answer").alias("output_text"), F.struct(F.col("doc_id").alias("total_tokens")).alias("usage"))).alias("body"))
    requests = rows.where("doc_id % 4 <> 1").select("request_hash", "source_type", "source_id", F.lit("m").alias("model"), (F.col("doc_id") % 5).cast("int").alias("attempts"))
    return an.import_answers(responses, requests)


# a chat answer that is cut short has no list of annotations
_STATUS = f"case when {_GOOD} then 'complete' when doc_id % 3 = 0 and doc_id % 11 = 0 then 'malformed' when doc_id % 5 < 3 then 'queued' else 'malformed' end"


@query("job11_import_requests", f"select sha256(doc_id::varchar) as request_hash, {_STATUS} as status from labels where doc_id % 4 <> 1")
def statuses(s):
    return _imported(s).requests


@query("job11_import_annotations", f"select unnest([doc_id, doc_id + 1]) as chat_id, sha256(doc_id::varchar) as request_hash from labels where doc_id % 4 <> 1 and doc_id % 3 = 0 and {_GOOD}")
def annotations(s):
    return _imported(s).annotations.select("chat_id", "request_hash")


@query("job11_import_ledger", f"select ['chat', 'narrative', 'gameplay'][doc_id % 3 + 1] as source_type, {_STATUS} as status, count(*) as requests, sum(doc_id)::bigint as tokens from labels where doc_id % 4 <> 1 group by 1, 2")
def ledger(s):
    return _imported(s).ledger.groupBy("source_type", "status").agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"))


@query(
    "job11_narrative_merge",
    f"select 'day' || doc_id as report_date, v as metric_version, v = 2 and {_GOOD} and doc_id % 4 <> 1 as told, case when v = 2 and {_GOOD} and doc_id % 4 <> 1 then 'complete' else 'pending' end as llm_status from labels, (values (1), (2)) t(v) where doc_id % 3 = 1",
)
def merged(s):
    of = s.labels.where("doc_id % 3 = 1").select(F.concat(F.lit("day"), "doc_id").alias("report_date"), F.explode(F.array(F.lit(1), F.lit(2))).alias("metric_version"), F.to_json(F.struct("quality", "toxic")).alias("report"), F.lit("pending").alias("llm_status"))
    out = an.merge_narratives(of, _imported(s).narratives)
    return out.select("report_date", "metric_version", (F.coalesce(F.get_json_object("report", "$.narrative.headline"), F.lit("")) == "a day").alias("told"), "llm_status")


def _stored(s: Shapes) -> VersionedTable:
    table = VersionedTable(s.spark, f"{_folder(s)}/combat", "day")
    upsert_versioned_days(s.combat_events.select("event_id", "t_us", "damage", F.col("round_id").alias("day")), table)
    return table


@query("job15_stored_retention", "select event_id from combat_events where t_us >= 1706767200000000 - 604800000000 or event_id % 500 = 0")
def stored_retention(s):
    table = _stored(s)
    rt.expire_stored(table, "t_us", 1_706_767_200_000_000, 604_800, s.combat_events.where("event_id % 500 = 0").select("event_id", "t_us"), "event_id")
    return table.read().select("event_id")


@query(
    "src26_day_versions",
    "select 1 as version, round_id as day, count(*) as n, round(sum(damage), 6) as damage from combat_events group by 2 union all select 2, round_id, count(*), round(sum(case when round_id >= '2024-01-10' then 2 * damage else damage end), 6) from combat_events where not (round_id >= '2024-01-10' and event_id % 2 = 1) group by 2",
)
def versions(s):
    table = _stored(s)
    again = s.combat_events.where("round_id >= '2024-01-10' and event_id % 2 = 0").select("event_id", "t_us", (2 * F.col("damage")).alias("damage"), F.col("round_id").alias("day"))
    first = table.read(1)  # a reader that holds the first version
    upsert_versioned_days(again, table)
    both = first.withColumn("version", F.lit(1)).unionByName(table.read().withColumn("version", F.lit(2)))
    return both.groupBy("version", "day").agg(F.count("*").alias("n"), F.round(F.sum("damage"), 6).alias("damage"))
