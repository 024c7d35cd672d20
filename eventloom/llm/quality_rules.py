"""Quality rules with risk-controlled cutoffs.

Four shares of a text (symbols, repeated lines, words in repeated windows, long words)
are each compared with a cutoff.  Cutoffs are selected on a labelled holdout: going from
lenient to strict, a cutoff stands while the exact binomial test rejects that more than
``risk`` of the good documents of the stratum would be refused by that rule.  The tests
of one rule in one stratum form a fixed sequence, and the level is divided by the number
of such sequences, so with probability 1 - ``level`` no selected cutoff exceeds its risk.
A stratum with too few labelled documents gets no cutoff and loses no document.

Everything is DataFrame expressions.  Words are ``[^\\x20\\x09-\\x0D]+``.

Defined results: a null text has no words and fails the base rule; labels that are null or
whose document is missing don't count; of several labels of one id the largest counts, once,
for the document with the most words; an empty table gives an empty result; result columns
take the place of input columns with their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: rule: share of (numerator, denominator) in per cent, and its candidate cutoffs, strict to lenient.
RULES = {
    "symbols": ("n_symbols", "word_chars", [2, 5, 10, 15, 20, 25, 30, 40, 50]),
    "lines": ("n_dup_lines", "n_lines", [5, 10, 20, 30, 40, 50, 60, 70, 80]),
    "repeats": ("n_repeat_words", "n_words", [5, 10, 15, 20, 25, 30, 35, 40, 45]),
    "length": ("word_chars", "n_words", [700, 800, 900, 1000, 1200, 1500, 2000, 3000, 5000]),
}

_STATS = r"""
transform(array(coalesce(text, '')), t ->
transform(array(array_remove(split(t, '[\\x20\\x09-\\x0D]+'), '')), w ->
named_struct(
  'n_words', cast(size(w) as bigint),
  'word_chars', cast(length(translate(t, ' \t\n\u000B\u000C\r', '')) as bigint),
  'n_symbols', cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint),
  'lines', transform(array(filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')), l -> named_struct('all', cast(size(l) as bigint), 'other', cast(size(array_distinct(l)) as bigint)))[0],
  'n_repeat_words', case when size(w) < 3 then 0L else
    transform(array(sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('h', xxhash64(w[i], w[i + 1], w[i + 2]), 'i', i)))), s ->
      aggregate(
        array_sort(transform(filter(s, (x, k) -> (k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(s) and s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i)),
        named_struct('n', 0L, 'last', -3),
        (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p),
        a -> a.n))[0]
  end))[0])[0]
"""


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    A window of three words is compared by a 64-bit hash, within one text only.
    """
    found = docs.withColumn("_s", F.expr(_STATS.replace("coalesce(text, '')", f"coalesce(cast(`{text_col}` as string), '')")))
    return found.select(
        *docs.columns,
        F.col("_s.n_words").alias("n_words"),
        F.col("_s.word_chars").alias("word_chars"),
        F.col("_s.n_symbols").alias("n_symbols"),
        F.col("_s.lines.all").alias("n_lines"),
        (F.col("_s.lines.all") - F.col("_s.lines.other")).alias("n_dup_lines"),
        F.col("_s.n_repeat_words").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, risk: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, risk), summed exactly in logarithms; 1 where k is not below n * risk."""
    ratio = f"{risk!r}D / {1 - risk!r}D"
    return F.expr(
        f"case when {k} >= {n} * {risk!r}D then 1D else aggregate(sequence(0, {k}), named_struct('t', {n} * ln({1 - risk!r}D), 's', 0D), "
        f"(a, i) -> named_struct('t', a.t + ln(({n} - i) / (i + 1D) * ({ratio})), 's', a.s + exp(a.t)), a -> a.s) end"
    )


def select_cutoffs(stats: DataFrame, labels: DataFrame, id_col: str, stratum: str, label_col: str, risk: float, level: float) -> DataFrame:
    """One row per stratum: for each rule the selected cutoff in per cent, null if none is safe.

    ``risk`` is shared out evenly to the rules, so the refused share of good documents of
    a stratum stays below it for all rules together.
    """
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y")).where("_y = 1")
    needed = [stratum, *dict.fromkeys(c for a, b, _ in RULES.values() for c in (a, b))]
    labelled = stats.join(good, stats[id_col] == good["_id"]).groupBy("_id").agg(F.max_by(F.struct(*needed), F.struct("n_words", *needed)).alias("s"))
    held = labelled.select("s.*").where(~base_failed()).select(F.col(stratum).alias("stratum"), *_reached())
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"r_{r}").alias("reached")) for r in RULES)))
    counted = held.select("stratum", pairs.alias("p")).groupBy("stratum", "p.rule", "p.reached").count()
    grid = max(len(c) for _, _, c in RULES.values())
    of_rule = Window.partitionBy("stratum", "rule")
    tests = (
        counted.groupBy("stratum", "rule")
        .agg(F.sum("count").alias("n"), F.collect_list(F.struct("reached", "count")).alias("h"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(grid))))
        .withColumn("k", F.expr("aggregate(h, 0L, (a, x) -> a + if(x.reached >= step, x.count, 0L))"))
        .withColumn("sequences", F.size(F.collect_set(F.struct(F.coalesce("stratum", F.lit("")), F.col("stratum").isNull(), "rule")).over(Window.partitionBy())))
        .withColumn("safe", binomial_tail("n", "k", risk / len(RULES)) <= F.lit(level) / F.col("sequences"))
        .withColumn("strict", F.coalesce(F.max(F.when(~F.col("safe"), F.col("step"))).over(of_rule), F.lit(0)) + 1)
        .where(F.col("step") == F.col("strict"))
    )
    cutoffs = [F.max(F.when(F.col("rule") == r, F.element_at(F.array(*map(F.lit, c)), F.col("step")))).alias(f"cut_{r}") for r, (_, _, c) in RULES.items()]
    return tests.groupBy("stratum").agg(*cutoffs)


def _reached() -> list[Column]:
    """For each rule how many of its cutoffs, strict to lenient, the text reaches."""
    return [sum((F.when(100 * F.col(a) >= c * F.col(b), 1).otherwise(0) for c in cuts), F.lit(0)).alias(f"r_{r}") for r, (a, b, cuts) in RULES.items()]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", label_col: str = "quality", risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """Statistics of each document, base_failed, the cutoffs of its stratum and the verdict ``kept``.

    Cutoffs are selected on the label rows whose crc32(id as text) mod 5 is not 0; the
    others stay untouched for measuring the outcome.
    """
    stats = stage(text_stats(docs.select(id_col, F.col(stratum).cast("string").alias(stratum), text_col), text_col).drop(text_col), "stats")
    holdout = labels.where(F.crc32(F.col(id_col).cast("string")) % 5 != 0)
    cutoffs = stage(select_cutoffs(stats, holdout, id_col, stratum, label_col, risk, level), "cutoffs")
    refused = F.lit(False)
    for r, (a, b, _) in RULES.items():
        refused = refused | F.coalesce(100 * F.col(a) >= F.col(f"cut_{r}") * F.col(b), F.lit(False))
    judged = stats.join(cutoffs, stats[stratum].eqNullSafe(cutoffs["stratum"]), "left").drop("stratum")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~refused)
