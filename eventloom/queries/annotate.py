"""Queries of the minute, retention and annotation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as an
from ..operators import minute as mi
from ..operators import retention as rt
from .shapes import query
from .timeseries import rounded

HOUR = 3_600_000_000


@query(
    "agg36_hour_metrics",
    """with r as (select t_us // 3600000000 * 3600000000 as start_us, attacker_id, damage, event_type from combat_events),
l as (select start_us, attacker_id, 'damage' as name, sum(damage) as value from r group by 1, 2 union all select start_us, attacker_id, 'damage_max', max(damage) from r group by 1, 2 union all select start_us, attacker_id, 'damage_min', min(damage) from r group by 1, 2)
select start_us, attacker_id, name, round(value, 6) as value from l""",
)
def metrics(s):
    rows = s.combat_events.withColumns({"damage_min": F.col("damage"), "damage_max": F.col("damage")})
    return rounded(mi.merge_metrics(mi.metric_rows(rows, ["attacker_id"], "t_us", ["damage", "damage_min", "damage_max"], HOUR), ["attacker_id"]))


@query("agg36_server_minutes", "select t_us // 60000000 * 60000000 as start_us, 'damage=' || printf('%.2f', sum(damage)) || ',events=' || printf('%.2f', count(*)::double) as metrics from combat_events group by 1")
def bags(s):
    rows = mi.merge_metrics(mi.metric_rows(s.combat_events.withColumn("events", F.lit(1)), [], "t_us", ["damage", "events"]), [])
    text = F.array_join(F.transform(F.map_entries("metrics"), lambda e: F.concat_ws("=", e["key"], F.format_string("%.2f", e["value"]))), ",")
    return mi.bags(rows, []).select("start_us", text.alias("metrics"))


@query("agg37_ping_moments", "select t_us // 3600000000 * 3600000000 as start_us, session_id, count(*) as n, round(sum(ping), 6) as total, round(min(ping), 6) as low, round(max(ping), 6) as high, round(sum(ping * ping), 6) as squares from network_samples group by 1, 2")
def moments(s):
    return rounded(mi.ping_moments(s.network_samples, "session_id", "t_us", "ping", HOUR))


_HIST = "h as (select t_us // 3600000000 * 3600000000 as start_us, session_id, (floor(ping / 10) * 10)::bigint as band, count(*) as n from network_samples group by 1, 2, 3)"


@query("agg37_ping_histogram", f"with {_HIST} select * from h")
def histogram(s):
    return mi.ping_histogram(s.network_samples, "session_id", "t_us", "ping", 10, HOUR)


@query(
    "agg38_histogram_quantiles",
    f"with {_HIST}, m as (select session_id, band, sum(n) as n from h group by 1, 2), c as (select *, sum(n) over (partition by session_id order by band) as upto, sum(n) over (partition by session_id) as al from m) select session_id, max(al)::bigint as n, min(band) filter (where upto >= greatest(1, ceil(al * 0.5::double))) + 5.0::double as p50, min(band) filter (where upto >= greatest(1, ceil(al * 0.95::double))) + 5.0::double as p95 from c group by 1",
)
def quantiles(s):
    return mi.histogram_quantiles(mi.ping_histogram(s.network_samples, "session_id", "t_us", "ping", 10, HOUR), "session_id")


@query("st11_live_window", f"with {_HIST} select start_us, sum(n)::bigint as n from h where start_us >= (select max(start_us) from h) - 10800000000 group by 1")
def live(s):
    rows = mi.ping_histogram(s.network_samples, "session_id", "t_us", "ping", 10, HOUR).groupBy("start_us").agg(F.sum("n").alias("n"))
    return mi.live_window(rows)


@query("st09_reconcile", f"with {_HIST} select start_us, sum(n)::bigint as n from h group by 1")
def reconciled(s):
    hours = lambda rows: rows.groupBy(mi.bucket("t_us", HOUR).alias("start_us")).agg(F.count("*").alias("n"))
    now = 1_706_000_000_000_000
    stored = hours(s.network_samples.where("sample_id % 2 = 0 or t_us < 1705000000000000")).unionByName(hours(s.network_samples.where("sample_id % 2 = 1 and t_us >= 1705000000000000 and t_us < 1705600000000000")))
    stored = stored.groupBy("start_us").agg(F.sum("n").alias("n"))
    return mi.reconcile(stored, s.network_samples, hours, "t_us", now, 1_000_000.0, HOUR)


@query("agg44_window_population", "select count(*) as sessions, count(p.session_id) as mapped, count(distinct identity_id) as identities, count(*) filter (where not is_bot) as humans, count(*) filter (where is_bot) as bots, count(*) filter (where p.session_id is null) as unknown from (select distinct session_id from network_samples) n left join player_sessions p using (session_id)")
def window_population(s):
    return mi.window_population(s.network_samples, s.player_sessions)


@query("job15_retention", "select event_id from combat_events where (case weapon when 'view' then t_us >= 1706745600000000 - 604800000000 when 'click' then t_us >= 1706745600000000 - 86400000000 else true end) or event_id % 500 = 0")
def retention(s):
    keep = s.combat_events.where("event_id % 500 = 0").select("event_id")
    return rt.expire(s.combat_events, "weapon", "t_us", 1_706_745_600_000_000, {"view": 604_800, "click": 86_400}, keep, "event_id").select("event_id")


@query(
    "win18_quota_eviction",
    "with d as (select doc_id, n_chars, doc_id % 5 as priority, doc_id as created from documents), c as (select doc_id, sum(n_chars) over () as al, coalesce(sum(n_chars) over (order by priority, created, doc_id rows between unbounded preceding and 1 preceding), 0) as before from d) select doc_id, al - before > 1000000 as evict from c",
)
def eviction(s):
    rows = s.documents.select("doc_id", "n_chars", (F.col("doc_id") % 5).alias("priority"), F.col("doc_id").alias("created"))
    return rt.evict_over_quota(rows, "n_chars", "priority", "created", "doc_id", 1_000_000, 100).select("doc_id", "evict")


@query("sc17_token_estimate", "select doc_id, greatest(1, ceil(strlen(text) / 4))::bigint as tokens from documents")
def tokens(s):
    return s.documents.select("doc_id", an.estimated_tokens(F.col("text")).alias("tokens"))


@query("sc14_request_hash", "select doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}') as hash from documents")
def hashes(s):
    return s.documents.select("doc_id", an.request_hash({"lang": F.col("lang"), "doc_id": F.col("doc_id"), "n": F.col("n_chars")}).alias("hash"))


@query("sc15_logical_key", "select doc_id, 'request|doc|' || doc_id || '|' || lang as key from documents")
def keys(s):
    return s.documents.select("doc_id", an.logical_key(F.lit("request"), F.lit("doc"), F.col("doc_id"), F.col("lang")).alias("key"))


@query("sc16_versioned_names", "select doc_id, case when doc_id % 3 = 0 then lang else lang || '@v' || (doc_id % 3 + 1) end as name, lang as base, 'v' || (doc_id % 3 + 1) as version from documents")
def names(s):
    rows = s.documents.select("doc_id", an.versioned_name(F.col("lang"), F.concat(F.lit("v"), (F.col("doc_id") % 3 + 1).cast("string"))).alias("name"))
    return rows.withColumns({"base": an.base_name(F.col("name")), "version": an.version_of(F.col("name"))})


@query(
    "job07_chat_contexts",
    """with m as (select chat_id, round_id % 10 as room, row_number() over (partition by round_id % 10 order by chat_id) as nth from chat_messages),
w as (select *, (nth - 1) // 20 as win from m), x as (select distinct room, chat_id, nth, win, unnest([win, (nth - 6) // 20, (nth + 4) // 20]) as ofw from w), l as (select room, max(nth) as last from m group by 1),
y as (select x.*, row_number() over (partition by x.room, ofw order by chat_id) as place from x join l on x.room = l.room where nth - 6 >= 0 or ofw = win or (nth + 4) // 20 = ofw),
z as (select *, row_number() over (partition by room, ofw order by chat_id) as p2 from y join l using (room) where ofw >= 0 and ofw * 20 < last)
select room, ofw::bigint as "window", chat_id, ofw = win as is_core from z where p2 <= 30""",
)
def contexts(s):
    return an.chat_contexts(s.chat_messages.withColumn("room", F.col("round_id") % 10), "room", "chat_id")


@query(
    "job09_new_requests",
    "with r as (select doc_id, text, row_number() over (partition by text order by doc_id) as n from documents), h as (select distinct text from documents where doc_id % 10 = 0) select doc_id, case when n = 1 and h.text is null then 'queued' else 'deduped' end as status from r left join h using (text)",
)
def requests(s):
    docs = s.documents.select("doc_id", "text")
    return an.new_requests(docs, docs.where("doc_id % 10 = 0"), "text", ["doc_id"]).select("doc_id", "status")


@query("jn11_unannotated", "select chat_id from chat_messages where chat_id not in (select doc_id from labels)")
def unannotated(s):
    return s.chat_messages.join(s.labels.select(F.col("doc_id").alias("chat_id")), "chat_id", "left_anti").select("chat_id")


@query("win19_admission", "with t as (select doc_id, lang, greatest(1, ceil(strlen(text) / 4))::bigint as tokens from documents), c as (select *, sum(tokens) over (partition by lang order by doc_id rows unbounded preceding) as spent from t) select doc_id, spent::bigint as spent, spent <= 10000 as admitted from c")
def admission(s):
    rows = s.documents.select("doc_id", "lang", an.estimated_tokens(F.col("text")).alias("tokens"))
    return an.admit_first_fit(rows, "lang", ["doc_id"], "tokens", 10_000).select("doc_id", "spent", "admitted")


@query(
    "win19_greedy_admission",
    """with recursive d as (select doc_id, concat_ws(':', source, lang) as queue, greatest(1, ceil(strlen(text) / 4))::bigint as tokens, strlen(text)::int as size from documents),
o as (select *, row_number() over (partition by queue order by doc_id) as k from d),
r as (select queue, doc_id, tokens, size, k, tokens <= 10000 and size <= 40000 as admitted, case when tokens <= 10000 and size <= 40000 then 1 else 0 end as n, case when tokens <= 10000 and size <= 40000 then tokens else 0 end as t, case when tokens <= 10000 and size <= 40000 then size else 0 end as b from o where k = 1
union all select o.queue, o.doc_id, o.tokens, o.size, o.k, r.n < 20 and r.t + o.tokens <= 10000 and r.b + o.size <= 40000,
 r.n + case when r.n < 20 and r.t + o.tokens <= 10000 and r.b + o.size <= 40000 then 1 else 0 end, r.t + case when r.n < 20 and r.t + o.tokens <= 10000 and r.b + o.size <= 40000 then o.tokens else 0 end, r.b + case when r.n < 20 and r.t + o.tokens <= 10000 and r.b + o.size <= 40000 then o.size else 0 end
 from r join o on o.queue = r.queue and o.k = r.k + 1)
select doc_id, queue, tokens, size, admitted from r""",
)
def greedy(s):
    rows = s.documents.select("doc_id", F.concat_ws(":", "source", "lang").alias("queue"), an.estimated_tokens(F.col("text")).alias("tokens"), F.octet_length("text").alias("size"))
    return an.admit_greedy(rows, "queue", "doc_id", "tokens", "size", 20, 10_000, 40_000)


@query("job08_packs")
def packs(s):
    return an.pack_messages(s.chat_messages, "round_id", "chat_id", "message", 5, 600)


@query("sc23_compact_payloads")
def compact(s):
    rows = s.documents.select("doc_id", F.to_json(F.struct("text", "source", "lang", "n_chars", F.col("doc_id").alias("session_id"))).alias("payload"))
    return an.compact_payloads(rows, "payload", 800)


@query("sc24_safe_projection", "select doc_id, 'lang=' || lang || ',source=' || source as kept, doc_id % 2 = 0 as identifying from documents")
def safe(s):
    bag = F.create_map(F.lit("lang"), F.col("lang"), F.lit("session_id"), F.col("doc_id").cast("string"), F.lit("source"), F.col("source"), F.lit("raw"), F.col("text"))
    text = F.array_join(F.transform(F.map_entries(an.without_identifiers(bag)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    payload = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("doc_id").alias("player_Session_id")))).otherwise(F.to_json(F.struct("lang")))
    return s.documents.select("doc_id", text.alias("kept"), an.contains_identifier(payload).alias("identifying"))


@query("sc25_request_bodies", "select doc_id as request_id, '{\"model\":\"m\",\"instructions\":\"rate ' || lang || '\",\"input\":\"' || source || '\",\"max_output_tokens\":' || case lang when 'en' then 100 else 200 end || '}' as body from documents where lang in ('en', 'de')")
def bodies(s):
    kinds = s.spark.createDataFrame([("en", "rate en", 100), ("de", "rate de", 200)], "kind string, prompt string, max_output int")
    rows = s.documents.select(F.col("doc_id").alias("request_id"), F.col("lang").alias("kind"), F.lit("m").alias("model"), F.col("source").alias("payload"))
    return an.request_bodies(rows, kinds)


def _answers(s):
    """Annotation JSON from labels, every eleventh one malformed, every seventh one with a key too many."""
    good = F.to_json(F.struct(F.col("doc_id").alias("chat_id"), F.col("toxic").cast("double").alias("toxicity"), F.lit("chat").alias("category")))
    more = F.to_json(F.struct(F.col("doc_id").alias("chat_id"), F.col("toxic").cast("double").alias("toxicity"), F.lit("chat").alias("category"), F.lit(1).alias("extra")))
    return s.labels.select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit('{"chat_id":')).when(F.col("doc_id") % 7 == 0, more).otherwise(good).alias("body"), (F.col("doc_id") % 4).alias("attempts"))


@query("sc27_validate_annotations", "select doc_id, doc_id % 11 <> 0 and doc_id % 7 <> 0 as valid from labels")
def validated(s):
    return an.validate_annotations(_answers(s), "body", "doc_id").select("doc_id", "valid")


@query("job11_import_status", "select case when doc_id % 11 <> 0 and doc_id % 7 <> 0 then 'done' when doc_id % 4 < 3 then 'retry' else 'malformed' end as status, count(*) as n from labels group by 1")
def imported(s):
    return an.import_status(an.validate_annotations(_answers(s), "body", "doc_id")).groupBy("status").agg(F.count("*").alias("n"))


@query("sc26_response_text", "select doc_id, case when doc_id % 5 = 0 then null else lang end as answer from documents")
def answers(s):
    item = lambda kind: F.struct(F.array(F.struct(F.lit(kind).alias("type"), F.col("lang").alias("text"))).alias("content"))
    nested = F.to_json(F.struct(F.array(item("reasoning"), item("output_text")).alias("output")))
    flat = F.to_json(F.struct(F.col("lang").alias("output_text")))
    return s.documents.select("doc_id", an.response_text(F.when(F.col("doc_id") % 5 == 0, F.lit("{}")).when(F.col("doc_id") % 2 == 0, flat).otherwise(nested)).alias("answer"))


@query("set05_exact_cover", "select distinct lang as request, not bool_or(doc_id % 97 = 5) as covers from documents group by 1")
def covers(s):
    rows = s.documents.select(F.col("lang").alias("request"), F.col("doc_id").alias("item"))
    return an.exact_cover(rows.where("item % 97 <> 5"), rows, "request", "item")


_LEDGER = "l as (select doc_id % 300 as ledger_key, doc_id as entry_id, case doc_id % 3 when 0 then 'queued' when 1 then 'done' else 'failed' end as status, lang as model, case when doc_id % 2 = 0 then n_chars end as tokens, n_chars // 2 as estimate, doc_id % 4 as retries from documents), m as (select ledger_key, arg_max(status, entry_id) as status, arg_max(model, entry_id) as model, arg_max(tokens, entry_id) filter (where tokens is not null) as tokens, max(estimate) as estimate, max(retries) as retries from l group by 1)"


def _ledger(s):
    i = F.col("doc_id")
    return an.merge_ledger(s.documents.select((i % 300).alias("ledger_key"), i.alias("entry_id"), F.when(i % 3 == 0, "queued").when(i % 3 == 1, "done").otherwise("failed").alias("status"), F.col("lang").alias("model"), F.when(i % 2 == 0, F.col("n_chars")).alias("tokens"), F.floor(F.col("n_chars") / 2).alias("estimate"), (i % 4).alias("retries")))


@query("agg43_ledger", f"with {_LEDGER} select * from m")
def ledger(s):
    return _ledger(s)


@query("agg42_token_usage", f"with {_LEDGER} select status, count(*) as requests, sum(coalesce(tokens, estimate))::bigint as tokens from m group by 1")
def usage(s):
    return an.token_usage(_ledger(s))


@query(
    "st07_chat_signals",
    "with r as (select *, t_s // 300 * 300 as start_s, row_number() over (partition by t_s // 300 order by chat_id) as nth from chat_messages), g as (select start_s, count(*) as messages, count(distinct player_id) as actors, sum(length(message))::bigint as chars from r where nth <= 20 group by 1) select * from g where messages >= 2 or actors >= 2 or chars >= 32",
)
def signals(s):
    return an.chat_signals(s.chat_messages)


@query("set01_cohort_active", "select o_custkey as id from orders where o_orderkey % 2 = 0 intersect select o_custkey from orders where o_orderkey % 3 = 0")
def both(s):
    return s.orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id")).intersect(s.orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id")))


@query("set02_unmapped_sessions", "select distinct session_id from network_samples except select session_id from player_sessions")
def unmapped(s):
    return s.network_samples.select("session_id").distinct().join(s.player_sessions, "session_id", "left_anti")


@query("set02_sessions_without_samples", "select distinct session_id from player_sessions except select session_id from network_samples")
def without_samples(s):
    return s.player_sessions.select("session_id").distinct().join(s.network_samples.select("session_id"), "session_id", "left_anti")


@query("set03_pattern_union", "select weapon as family, 'window' as origin, count(*) as n from combat_events group by 1 union all select interaction, 'scene', count(*) from scene_interactions group by 1")
def union(s):
    windows = s.combat_events.groupBy(F.col("weapon").alias("family")).agg(F.lit("window").alias("origin"), F.count("*").alias("n"))
    scenes = s.scene_interactions.groupBy(F.col("interaction").alias("family")).agg(F.lit("scene").alias("origin"), F.count("*").alias("n"))
    return windows.unionByName(scenes, allowMissingColumns=True)


@query("flt08_samples", "select event_id from events where event_id % 100 = 0")
def sample(s):
    return s.events.where(F.pmod("event_id", F.lit(100)) == 0).select("event_id")


@query("flt09_missing_values", "select doc_id, coalesce(try_cast(case when doc_id % 4 = 0 then 'x' when doc_id % 4 = 1 then '1.5' when doc_id % 4 = 2 then null else '7' end as double), 0) as v from documents")
def missing(s):
    from ..operators.timeseries import finite

    i = F.col("doc_id") % 4
    return s.documents.select("doc_id", finite(F.when(i == 0, "x").when(i == 1, "1.5").when(i == 3, "7").when(F.lit(False), "NaN")).alias("v"))


@query("flt02_day_bounds", "select d.day::varchar as day, epoch_us(timezone('Europe/Warsaw', d.day::timestamp)) as start_us, epoch_us(timezone('Europe/Warsaw', (d.day + 1)::timestamp)) as end_us from (select distinct cast(o_orderdate as date) as day from orders) d")
def bounds(s):
    from ..operators.sessions import day_bounds

    days = s.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    return day_bounds(days, "day", "Europe/Warsaw").withColumn("day", F.col("day").cast("string"))


@query("flt04_event_types", "select event_type, count(*) as n from combat_events where event_type in ('player_damage', 'melee_action') or event_type like '%death%' or event_type like 'projectile_%' group by 1")
def predicates(s):
    t = F.col("event_type")
    return s.combat_events.where(t.isin("player_damage", "melee_action") | t.contains("death") | t.startswith("projectile_")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("top03_latest_episodes", "select event_id, t_us, victim_id from combat_events where event_type = 'player_death' order by t_us desc, event_id desc limit 200")
def latest(s):
    return s.combat_events.where("event_type = 'player_death'").orderBy(F.desc("t_us"), F.desc("event_id")).limit(200).select("event_id", "t_us", "victim_id")
