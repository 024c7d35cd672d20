"""Preparing, budgeting, validating and accounting annotation requests for language models."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFYING = "session|identity"
ANNOTATION = T.StructType([T.StructField("chat_id", T.LongType()), T.StructField("toxicity", T.DoubleType()), T.StructField("category", T.StringType())])


def estimated_tokens(text: Column) -> Column:
    """One token for four bytes, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def request_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON, keys in order."""
    return F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields.items())))), 256)


def logical_key(*parts: Column) -> Column:
    """Parts joined by |: tells requests apart whatever model answers them."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def versioned_name(name: Column, version: Column, default: str = "v1") -> Column:
    return F.when(version == default, name).otherwise(F.concat_ws("@", name, version))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, "@[^@]*$", "")


def version_of(name: Column, default: str = "v1") -> Column:
    return F.when(name.contains("@"), F.regexp_extract(name, "@([^@]*)$", 1)).otherwise(F.lit(default))


def chat_windows(chat: DataFrame, conversation: str, row_id: str, core: int = 20) -> DataFrame:
    """Messages with their window: cores of ``core`` messages in order, which never overlap."""
    w = Window.partitionBy(conversation).orderBy(row_id)
    return chat.withColumn("nth", F.row_number().over(w)).withColumn("window", F.floor((F.col("nth") - 1) / core))


def chat_contexts(chat: DataFrame, conversation: str, row_id: str, core: int = 20, context: int = 5, limit: int = 30) -> DataFrame:
    """(conversation, window, message, is_core): each core with ``context`` messages around it, at most ``limit``."""
    rows = chat_windows(chat, conversation, row_id, core)
    spread = F.explode(F.array_distinct(F.array(F.col("window"), F.floor((F.col("nth") - 1 - context) / core), F.floor((F.col("nth") - 1 + context) / core))))
    near = rows.withColumn("of", spread).withColumn("last", F.max("nth").over(Window.partitionBy(conversation)))
    near = near.where((F.col("of") >= 0) & (F.col("of") * core < F.col("last")))
    w = Window.partitionBy(conversation, "of").orderBy(row_id)
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(conversation, F.col("of").alias("window"), row_id, (F.col("of") == F.col("window")).alias("is_core"))


def new_requests(requests: DataFrame, history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Requests with status 'queued' (first of a key that history lacks) or 'deduped'."""
    w = Window.partitionBy(key).orderBy(*order)
    known = history.select(F.col(key).alias("_k"), F.lit(True).alias("_known")).distinct()
    rows = requests.withColumn("_n", F.row_number().over(w)).join(known, F.col(key) == F.col("_k"), "left")
    return rows.withColumn("status", F.when((F.col("_n") == 1) & F.col("_known").isNull(), "queued").otherwise("deduped")).drop("_n", "_k", "_known")


def admit_first_fit(requests: DataFrame, shard: str, order: list[str], tokens: str, limit: int) -> DataFrame:
    """Requests of each shard in order until the first one that would exceed the token budget."""
    w = Window.partitionBy(shard).orderBy(*order)
    upto = requests.withColumn("spent", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return upto.withColumn("admitted", F.col("spent") <= limit)


def admit_greedy(requests: DataFrame, shard: str, row_id: str, tokens: str, size: str, count_limit: int, token_limit: int, size_limit: int) -> DataFrame:
    """Requests of each shard in order of id, skipping those that don't fit.

    What fits depends on all before it, so a shard (one queue of one model and day) is one
    sorted run; its rows stream by and only the three sums are kept.
    """

    def run(batches):
        shard_now, n, t, b = None, 0, 0, 0
        for pdf in batches:
            admitted = []
            for key, tok, byt in zip(pdf[shard], pdf[tokens], pdf[size], strict=True):
                key = None if pd.isna(key) else key
                if key != shard_now:
                    shard_now, n, t, b = key, 0, 0, 0
                fits = n < count_limit and t + tok <= token_limit and b + byt <= size_limit
                if fits:
                    n, t, b = n + 1, t + tok, b + byt
                admitted.append(bool(fits))
            yield pdf.assign(admitted=admitted)

    rows = requests.select(shard, row_id, tokens, size)
    runs = rows.repartition(shard).sortWithinPartitions(shard, F.asc_nulls_last(row_id))
    return runs.mapInPandas(run, T.StructType(rows.schema.fields + [T.StructField("admitted", T.BooleanType())]))


def pack_messages(messages: DataFrame, shard: str, row_id: str, text: str, max_messages: int = 20, max_bytes: int = 4000) -> DataFrame:
    """Greedy packs of consecutive messages of a shard (conversation); an over-long message is halved until it fits."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out, number, count, used = [], 0, 0, 0
        for key, row, value in zip(pdf[shard], pdf[row_id], pdf[text].fillna(""), strict=True):
            while len(value.encode()) > max_bytes:
                value = value[: len(value) // 2]
            n = len(value.encode())
            if count and (count >= max_messages or used + n > max_bytes):
                number, count, used = number + 1, 0, 0
            count, used = count + 1, used + n
            out.append((key, row, number, n))
        return pd.DataFrame(out, columns=[shard, row_id, "pack", "bytes"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack(pdf.sort_values(row_id))

    kinds = {f: messages.schema[f].dataType.simpleString() for f in (shard, row_id)}
    return messages.select(shard, row_id, text).groupBy(shard).applyInPandas(run, f"{shard} {kinds[shard]}, {row_id} {kinds[row_id]}, pack int, bytes int")


def without_identifiers(bag: Column) -> Column:
    """A flat map without raw payloads and keys that identify someone."""
    return F.map_filter(bag, lambda k, v: ~F.lower(k).rlike(IDENTIFYING) & ~k.isin("raw", "raw_json", "data_json"))


def contains_identifier(payload: Column) -> Column:
    """Whether JSON text has a key that identifies someone, at any depth."""
    return payload.rlike('(?i)"[^"]*(session|identity)[^"]*"\\s*:')


def _compact(value, depth: int, items: int, chars: int, deepest: int):
    if isinstance(value, dict):
        if depth >= deepest:
            return {"_keys": sorted(value)[:items]}
        return {k: _compact(v, depth + 1, items, chars, deepest) for k, v in list(value.items())[:items]}
    if isinstance(value, list):
        return [] if depth >= deepest else [_compact(v, depth + 1, items, chars, deepest) for v in value[:items]]
    return value[:chars] if isinstance(value, str) else value


def _scrub(value):
    if isinstance(value, dict):
        return {k: _scrub(v) for k, v in value.items() if k not in ("raw", "raw_json", "data_json") and not any(w in k.lower() for w in ("session", "identity"))}
    if isinstance(value, list):
        return [_scrub(v) for v in value]
    return value[:240] if isinstance(value, str) else value


def compact_payloads(rows: DataFrame, payload: str, max_bytes: int = 4000, items: int = 10, chars: int = 600, depth: int = 3) -> DataFrame:
    """JSON payloads without identifiers, shortened until they fit ``max_bytes``.

    Items and characters are halved step by step; what still doesn't fit keeps its section names.
    Malformed JSON gives null.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf[payload]:
                try:
                    value = _scrub(json.loads(text))
                except (TypeError, ValueError):
                    out.append(None)
                    continue
                n, c = items, chars
                short = json.dumps(_compact(value, 0, n, c, depth), ensure_ascii=False)
                while len(short.encode()) > max_bytes and (n > 1 or c > 20):
                    n, c = max(1, n // 2), max(20, c // 2)
                    short = json.dumps(_compact(value, 0, n, c, depth), ensure_ascii=False)
                if len(short.encode()) > max_bytes:
                    short = json.dumps({"sections": sorted(value)[:items] if isinstance(value, dict) else []})
                out.append(short)
            yield pdf.assign(**{payload: out})

    return rows.mapInPandas(run, rows.schema)


def request_bodies(requests: DataFrame, kinds: DataFrame) -> DataFrame:
    """JSON bodies from requests (request_id, kind, model, payload) and a table of kinds (kind, prompt, max_output)."""
    rows = requests.join(kinds, "kind")
    body = F.struct("model", F.col("prompt").alias("instructions"), F.col("payload").alias("input"), F.col("max_output").alias("max_output_tokens"))
    return rows.select("request_id", F.to_json(body).alias("body"))


def response_text(body: Column) -> Column:
    """The answer's text: ``output_text``, else the first output content of that type."""
    schema = "output_text string, output array<struct<content:array<struct<type:string,text:string>>>>"
    parsed = F.from_json(body, schema)
    nested = F.filter(F.flatten(F.transform(parsed["output"], lambda o: o["content"])), lambda c: c["type"] == "output_text")
    return F.coalesce(parsed["output_text"], F.get(nested, F.lit(0))["text"])


def validate_annotations(rows: DataFrame, body: str, expected_id: str, keys: list[str] | None = None) -> DataFrame:
    """Parse annotation JSON strictly: exact keys, toxicity in [0, 1], matching id; adds annotation and valid."""
    wanted = sorted(keys or ANNOTATION.fieldNames())
    parsed = F.from_json(F.col(body), ANNOTATION)
    same_keys = F.array_sort(F.json_object_keys(F.col(body))) == F.array(*map(F.lit, wanted))
    out = rows.withColumn("annotation", parsed)
    ok = same_keys & F.col("annotation.toxicity").between(0, 1) & F.col("annotation.category").isNotNull() & (F.col("annotation.chat_id") == F.col(expected_id))
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def exact_cover(answers: DataFrame, expected: DataFrame, request: str, item: str) -> DataFrame:
    """Per expected request: whether the answered items are exactly the expected ones (nulls and repeats don't count)."""
    side = lambda df, e: df.select(request, item, F.lit(e).alias("_e"), F.lit(not e).alias("_a"))
    items = side(expected, True).unionByName(side(answers, False)).groupBy(request, item).agg(F.bool_or("_e").alias("_e"), F.bool_or("_a").alias("_a"))
    same = F.bool_and(F.when(F.col(item).isNotNull(), F.col("_e") == F.col("_a")))
    both = items.groupBy(request).agg(F.bool_or("_e").alias("_e"), F.bool_or("_a").alias("_a"), same.alias("_same"))
    return both.where("_e").select(request, (F.col(request).isNotNull() & F.col("_a") & F.coalesce("_same", F.lit(True))).alias("covers"))


def import_status(rows: DataFrame, attempts: str = "attempts", most: int = 3) -> DataFrame:
    """Validated rows with their next status: done, retry or malformed."""
    return rows.withColumn("status", F.when(F.col("valid"), "done").when(F.col(attempts) < most, "retry").otherwise("malformed"))


def supersede(requests: DataFrame, legacy: str, source_type: str = "gameplay") -> DataFrame:
    """Requests (source_type, status, kind, payload) with unsent ones of an old kind or with identifiers retired.

    Only queued requests of ``source_type`` change: their status becomes superseded and ``response`` says why;
    what a service has accepted stays.  ``kind`` may carry a version; malformed payloads hold no identifier.
    """
    sound = F.coalesce(F.try_parse_json("payload").isNotNull(), F.lit(False))
    retire = (F.col("source_type") == source_type) & (F.col("status") == "queued") & ((base_name(F.col("kind")) == legacy) | (sound & contains_identifier(F.col("payload"))))
    retire = F.coalesce(retire, F.lit(False))
    reason = F.to_json(F.struct(F.lit("superseded").alias("status"), F.lit(f"legacy_{source_type}_payload").alias("reason")))
    return requests.withColumns({"status": F.when(retire, "superseded").otherwise(F.col("status")), "response": F.when(retire, reason)})


def merge_ledger(entries: DataFrame, key: str = "ledger_key", order: str = "entry_id") -> DataFrame:
    """One row per key: last status and model, last known tokens, largest estimate and retries."""
    last_known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return entries.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max_by("model", order).alias("model"), last_known("tokens").alias("tokens"), F.max("estimate").alias("estimate"), F.max("retries").alias("retries"))


def token_usage(ledger: DataFrame) -> DataFrame:
    """Requests and tokens by status; a request without known tokens counts its estimate."""
    return ledger.groupBy("status").agg(F.count("*").alias("requests"), F.sum(F.coalesce("tokens", "estimate")).alias("tokens"))


def chat_signals(chat: DataFrame, width_s: int = 300, most: int = 20, least_messages: int = 2, least_actors: int = 2, least_chars: int = 32) -> DataFrame:
    """Complete tumbling windows of chat (t_s, chat_id, player_id, message) that are worth a look."""
    w = Window.partitionBy("start_s").orderBy("chat_id")
    rows = chat.withColumn("start_s", F.floor(F.col("t_s") / width_s) * width_s).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    out = rows.groupBy("start_s").agg(F.count("*").alias("messages"), F.count_distinct("player_id").alias("actors"), F.sum(F.length("message")).alias("chars"))
    return out.where((F.col("messages") >= least_messages) | (F.col("actors") >= least_actors) | (F.col("chars") >= least_chars))
