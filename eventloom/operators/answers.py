"""Answers of a model: strict validation by a declared shape, and their import in one pass.

A shape is compiled to column expressions over JSON text, so validation is part of the plan: an object has
exactly its keys, numbers lie in their range, lists hold what they should.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import checkpointed
from .annotate import response_text

Check = Callable[[Column, str], Column]  # (JSON text of the whole object, path of the value) to true, false or null


def _kind(body: Column, path: str) -> Column:
    """The type's name of the value at a path, e.g. STRING, BIGINT, DECIMAL(2,1), ARRAY<STRING>, OBJECT<..>, VOID; null if there is none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), path, "variant"))


def anything(body: Column, path: str) -> Column:
    return F.lit(True)


def text(body: Column, path: str) -> Column:
    return _kind(body, path) == "STRING"


def flag(body: Column, path: str) -> Column:
    return _kind(body, path) == "BOOLEAN"


def number(low: float | None = None, high: float | None = None) -> Check:
    def check(body: Column, path: str) -> Column:
        value = F.try_variant_get(F.try_parse_json(body), path, "double")
        ok = _kind(body, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        ok = ok if low is None else ok & (value >= low)
        return ok if high is None else ok & (value <= high)

    return check


def a_list(of: str | None = None) -> Check:
    """A list; of STRING or BIGINT if that is given.  An empty one is a list of anything."""

    def check(body: Column, path: str) -> Column:
        kind = _kind(body, path)
        return kind.startswith("ARRAY<") if of is None else kind.isin(f"ARRAY<{of}>", "ARRAY<VOID>")

    return check


def equal_to(value: Column) -> Check:
    return lambda body, path: F.get_json_object(body, path) == value.cast("string")


def shaped(fields: dict[str, Check]) -> Check:
    """An object with exactly these keys, whose values pass their checks."""

    def check(body: Column, path: str) -> Column:
        keys = F.json_object_keys(body if path == "$" else F.get_json_object(body, path))
        ok = F.array_sort(keys) == F.array(*(F.lit(k) for k in sorted(fields)))
        for name, rule in fields.items():
            ok = ok & rule(body, f"{path}.{name}")
        return ok

    return check


def valid(body: Column, shape: Check) -> Column:
    """Whether the JSON text has the shape; false for malformed text and nulls."""
    return F.coalesce(shape(body, "$"), F.lit(False))


# The keys of the three kinds of answers.
TOXICITY_KEYS = ["score", "profanity", "harassment", "threat", "hate", "sexual", "spam", "targeted"]
NARRATIVE_LISTS = ["server_health", "player_experience", "map_findings", "network_findings", "player_highlights", "pattern_findings", "chat_findings", "possible_factors", "limitations"]

ANNOTATION = shaped(
    {
        "chat_id": number(),
        "language": anything,
        "intent": anything,
        "sentiment": anything,
        "topics": a_list(),
        "toxicity": shaped({k: anything for k in TOXICITY_KEYS}),
        "target_actor_keys": a_list(),
        "reply_to_chat_id": anything,
        "explicit_leave_reason": shaped({"present": anything, "category": anything}),
        "confidence": number(0, 1),
        "evidence_chat_ids": a_list(),
    }
)
NARRATIVE = shaped({"headline": text} | {k: a_list("STRING") for k in NARRATIVE_LISTS})


def gameplay(window_id: Column) -> Check:
    free = ["classification", "mechanic_family", "advantage_observed", "advantage_description", "known_pattern_id", "candidate_signature_features", "should_create_candidate"]
    ranged = {"novelty_score": number(0, 1), "confidence": number(0, 1), "observations": a_list(), "evidence_event_ids": a_list()}
    return shaped({"window_id": equal_to(window_id)} | ranged | {k: anything for k in free})


def annotations_of(answer: Column) -> Column:
    """The objects of an answer's list of annotations as JSON texts; null if there is no such list."""
    listed = F.get_json_object(answer, "$.annotations")
    return F.when(_kind(answer, "$.annotations").startswith("ARRAY<"), F.from_json(listed, "array<string>"))


def valid_annotations(answer: Column, expected: Column) -> Column:
    """Whether the annotations are all valid and for exactly the ``expected`` chat ids (an array of numbers), each once."""
    each = annotations_of(answer)
    ids = F.transform(each, lambda a: F.get_json_object(a, "$.chat_id").try_cast("long"))
    return F.coalesce((F.array_sort(ids) == F.array_sort(F.array_distinct(expected))) & F.forall(each, lambda a: valid(a, ANNOTATION)), F.lit(False))


@dataclass
class Imported:
    """Where the answers of a batch go: new states of requests, rows of each kind, and ledger entries."""

    requests: DataFrame
    annotations: DataFrame
    narratives: DataFrame
    gameplay: DataFrame
    ledger: DataFrame
    all: DataFrame = field(repr=False)


def import_answers(responses: DataFrame, requests: DataFrame, most_attempts: int = 3) -> Imported:
    """Route the answers of a batch, in one pass over them.

    ``responses``: request_hash and body (the response's JSON); ``requests``: request_hash, source_type (chat, narrative or
    gameplay), source_id (chat ids with commas, a date, a window's id), model and attempts.  A valid answer completes its request; an
    answer to no known request and a chat answer without annotations are malformed; others are queued again
    until ``most_attempts``, then malformed.  The joined and judged rows are checkpointed once and every output is a filter of them.
    """
    known = requests.select("request_hash", "source_type", "source_id", "model", "attempts", F.lit(True).alias("_known"))
    rows = responses.join(known, "request_hash", "left").withColumn("answer", response_text(F.col("body")))
    ids = F.transform(F.split(F.coalesce("source_id", F.lit("")), ","), lambda i: i.try_cast("long"))
    kind = F.col("source_type")
    good = (
        F.when(kind == "chat", valid_annotations(F.col("answer"), ids))
        .when(kind == "narrative", valid(F.col("answer"), NARRATIVE))
        .when(kind == "gameplay", valid(F.col("answer"), gameplay(F.col("source_id"))))
        .otherwise(False)
    )
    lost = F.col("_known").isNull() | ((kind == "chat") & annotations_of(F.col("answer")).isNull())
    status = F.when(lost, "malformed").when(good, "complete").when(F.col("attempts") < most_attempts, "queued").otherwise("malformed")
    judged = checkpointed(rows.withColumn("status", status))
    done = judged.where("status = 'complete'")
    each = done.where("source_type = 'chat'").select("request_hash", "model", F.explode(annotations_of(F.col("answer"))).alias("annotation"))
    tokens = F.get_json_object("body", "$.usage.total_tokens").try_cast("long")
    return Imported(
        judged.where("_known").select("request_hash", "status"),
        each.select(F.get_json_object("annotation", "$.chat_id").cast("long").alias("chat_id"), "model", "annotation", "request_hash"),
        done.where("source_type = 'narrative'").select(F.col("source_id").alias("report_date"), F.col("answer").alias("narrative")),
        done.where("source_type = 'gameplay'").select(F.col("source_id").alias("window_id"), F.col("answer").alias("gameplay")),
        judged.where("_known").select("request_hash", "source_type", "source_id", "model", "status", tokens.alias("total_tokens")),
        judged.drop("_known"),
    )


def merge_narratives(reports: DataFrame, narratives: DataFrame) -> DataFrame:
    """Reports (report_date, metric_version, report, llm_status) whose newest version of a day takes its narrative.

    The narrative is put into the report's JSON object, in place of one that is there; the status becomes complete.
    """
    one = narratives.groupBy("report_date").agg(F.max("narrative").alias("_narrative"))
    newest = reports.groupBy("report_date").agg(F.max("metric_version").alias("_newest"))
    rows = reports.join(newest, "report_date").join(one, "report_date", "left")
    take = F.col("_narrative").isNotNull() & (F.col("metric_version") == F.col("_newest"))
    others = F.map_filter(F.from_json("report", "map<string,variant>"), lambda k, v: k != "narrative")
    merged = F.to_json(F.map_concat(others, F.create_map(F.lit("narrative"), F.try_parse_json("_narrative"))))
    return rows.select("report_date", "metric_version", F.when(take, merged).otherwise(F.col("report")).alias("report"), F.when(take, "complete").otherwise(F.col("llm_status")).alias("llm_status"))
