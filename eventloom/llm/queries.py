"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_classifier, quality_rules, toxicity
from .fill_in_middle import fill_in_middle, restore_texts
from .labelled import held_out
from .mixing import mix_sources
from .ngram_join import link_components
from .piece_lattice import encode_texts
from .ranked_search import rank_documents
from .session import table
from .sharding import shard_documents
from .staging import drop_at_exit, new_path
from .substring_dedup import remove_known_windows
from .suffix_dedup import remove_repeated_bytes
from .token_files import read_token_files, write_token_files
from .vector_graph import nearest

#: DuckDB has no crc32: its reflected polynomial applied to the digits of the id, bit by bit.
_NOT_HELD_OUT = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b:
  list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda r, z: case when r & 1 = 1 then xor(r >> 1, 3988292384::bigint) else r >> 1 end)), 4294967295::bigint) % 5 <> 0"""
WORDS = r"'[^\x20\x09-\x0D]+'"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::bigint as size,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source is null, source) - 1) % 3 + 1)::double as weight from s),
c as (select *, source_size::double * 3 as cap, source_size::double * 3 / weight as ratio, (sum(source_size) over ())::double as total from w),
l as (select *, (total - coalesce(sum(cap) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level
  from c window b as (order by ratio, source nulls first rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, round(least(cap, weight * coalesce((select level from l where level <= ratio order by ratio, source nulls first limit 1), (select max(ratio) from l))), 6) as target from l),
b as (select *, floor(target + 0.5)::bigint as budget from t),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from b),
p as (select d.*, sum(d.size) over (partition by d.source order by key, doc_id, size rows unbounded preceding) - d.size as before from d)
select p.doc_id, p.size, e.source_size, e.target,
  (e.epochs * p.size + greatest(0, least(p.size, e.budget - e.epochs * e.source_size - p.before)))::bigint as taken
from p join e on p.source is not distinct from e.source
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op2_sql() -> str:
    rules = quality_rules.RULES
    reached = ", ".join("(" + " + ".join(f"(100 * {a} >= {c} * {b})::int" for c in cuts) + f") as r_{r}" for r, (a, b, cuts) in rules.items())
    risk, level, steps = 0.05 / len(rules), 0.05, max(len(c) for _, _, c in rules.values())
    tests = " union all ".join(f"select stratum, '{r}' as rule, r_{r} as reached from good" for r in rules)
    cuts = ", ".join(f"max(case when rule = '{r}' then ({list(c)})[step] end) as cut_{r}" for r, (_, _, c) in rules.items())
    refused = " or ".join(f"coalesce(100 * {a} >= cut_{r} * {b}, false)" for r, (a, b, _) in rules.items())
    return f"""
with recursive d as (select doc_id, lang, coalesce(text, '') as t from documents),
w as (select doc_id, lang, t, regexp_extract_all(t, {WORDS}) as w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from d),
x as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w),
g as (select doc_id, i, w[i:i + 2] as g from x),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1),
cover as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from rep) group by doc_id),
s as (select w.doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, len(lines)::bigint as n_lines,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words from w left join cover on w.doc_id = cover.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
good as (select lang as stratum, {reached} from f join labels using (doc_id) where quality = 1 and not base_failed and {_NOT_HELD_OUT}),
cnt as (select stratum, rule, reached, count(*) as c from ({tests}) group by all),
k as (select stratum, rule, step, sum(c)::bigint as n, coalesce(sum(c) filter (where reached >= step), 0)::bigint as k from cnt, range(1, {steps + 1}) r(step) group by all),
p as (select *, (select count(*) from (select distinct stratum, rule from k)) as m,
  case when k >= n * {risk!r} then 1 else list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln({1 - risk!r})))) end as p from k),
strict as (select stratum, rule, coalesce(max(step) filter (where p > {level} / m), 0) + 1 as step from p group by all),
cut as (select stratum, {cuts} from strict where step <= {steps} group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({refused}) as kept
from f left join cut on f.lang is not distinct from cut.stratum
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = quality_classifier.describe(table(spark, sf_dir, "documents"))
    model = quality_classifier.train(described, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(described, model)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_known_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) as w from documents),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, len(w) as n from d),
win as (select doc_id, i, list(word) over (partition by doc_id order by i rows between current row and 12 following) as g, n from x),
ok as (select * from win where i + 12 <= n),
first as (select g, min(doc_id) as lo from ok group by g),
bad as (select ok.doc_id, ok.i from ok join first using (g) where first.lo < ok.doc_id),
cut as (select distinct doc_id, unnest(range(i, i + 13)) as i from bad),
kept as (select x.doc_id, count(*) as n_kept, string_agg(x.word, ' ' order by x.i) as t from x anti join cut on x.doc_id = cut.doc_id and x.i = cut.i group by x.doc_id)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(n_kept, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) as w from documents),
g as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from d),
s as (select doc_id, unnest(g) as x from g),
n as (select doc_id, len(g)::bigint as n from g),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
e as (select a, b from pair join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n + nb.n - c)),
sym as (select a, b from e union all select b, a from e),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, sym.b from reach r join sym on r.y = sym.a)
select x as doc_id, n.n as n_shingles, min(y) as component_id from reach join n on n.doc_id = x group by x, n.n
"""


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "score", "nbest_ids", "nbest_scores", "round_trip")


def op9_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep_columns=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    arranged = fill_in_middle(table(spark, sf_dir, "documents"))
    return restore_texts(arranged).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP11_SQL = """
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as k, sha256('1:' || doc_id::varchar) as h from documents),
n as (select doc_id, t, k, len(k)::bigint as n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) as h from d),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from n),
p as (select *, array_to_string(k[1:a], '') as p, array_to_string(k[a + 1:b], '') as m, array_to_string(k[b + 1:n], '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from p
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
with d as (select doc_id, {_TERMS} as w from documents),
s as (select doc_id, len(w)::bigint as n from d where len(w) > 0),
g as (select count(*)::bigint as docs, sum(n)::bigint as length from s),
tf as (select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(w) as term from d) group by all),
df as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, g group by term, docs),
q as (select item_id, term, count(*)::bigint as c from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
x as (select tf.doc_id, tf.term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length)) as x from tf join s using (doc_id), g where tf.term in (select term from q)),
r as (select item_id, doc_id, sum(c * w * x)::bigint as score from q join df using (term) join x using (term) group by all having sum(c * w * x) > 0)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r) where rank <= 10
"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, drop_at_exit(spark, path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_histogram_shards": op6_histogram_shards,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_piece_lattice": op8_piece_lattice,
    "op9_vector_graph": op9_vector_graph,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_files": op13_token_files,
}
SQL: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op2_quality_rules": _op2_sql(), "op4_substring_dedup": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op11_fill_in_middle": OP11_SQL, "op12_ranked_search": OP12_SQL}
