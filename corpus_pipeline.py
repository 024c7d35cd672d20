"""A training-data pipeline of five corpus operators over ``documents``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm import toxicity
from eventloom.llm.mixing import mix_sources, text_tag
from eventloom.llm.ngram_join import linked_rows
from eventloom.llm.piece_lattice import encode_texts
from eventloom.llm.session import table
from eventloom.llm.staging import stage
from eventloom.llm.substring_dedup import key_columns
from eventloom.llm.suffix_dedup import remove_repeated_bytes

#: Names that no column of ``documents`` has.
TOXICITY, ROW, TIMES, COPY, ID, DOC, TAG = (f"_corpus_pipeline_{n}" for n in ("toxicity", "row", "times", "copy", "id", "doc", "tag"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col=TOXICITY).where(F.col(TOXICITY) < 0.5).drop(TOXICITY)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (Jaccard 0.8 or more) one: the one with the smallest id.

    Documents without an id are linked like others and come last in their group, by their text's hash; of rows that
    repeat id and text one stays.  Documents without words are linked with nothing and all stay.
    """
    groups = linked_rows(docs, size=5, num=80, den=100)
    first = groups.where("component is not null").groupBy("component").agg(F.min(F.struct("doc", "tag")).alias("k")).select(F.col("k.doc").alias(DOC), F.col("k.tag").alias(TAG))
    key, tag = key_columns("doc_id", "text")
    rows = docs.withColumns({ID: key, ROW: tag})
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = rows.where(~wordless).join(first, (F.col(ID) == F.col(DOC)) & (F.col(ROW) == F.col(TAG)), "left_semi").dropDuplicates([ID, ROW, "text"])
    return one.unionByName(rows.where(wordless)).select(*docs.columns)


def cut_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 200 or more that occur elsewhere; documents left without a word go.

    Bytes of a character that was cut in two go as well.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias(ROW))
    cut = remove_repeated_bytes(rows, keep_columns=[ROW])
    before, kept = F.col(f"{ROW}.text"), F.col("kept").cast("string")
    text = F.when(F.col("n_removed") > 0, F.try_validate_utf8(kept)).otherwise(before)
    text = F.coalesce(text, F.make_valid_utf8(F.regexp_replace(F.make_valid_utf8(kept), "�", "")))
    cut = cut.withColumn("kept", F.when(before.isNotNull(), text))
    stay = (F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.where(stay).select(*(changed.get(c, F.col(f"{ROW}.{c}")).alias(c) for c in docs.columns))


def mix_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole, once for each epoch; a source's last one if half of it is taken.

    Every row has its own number of copies, also without an id or with a repeated one; rows equal in id, source and text share
    theirs as evenly as whole numbers can.
    """
    taken = mix_sources(docs.select("doc_id", "text", "source"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).otherwise(1)
    key = [F.col("doc_id").alias(ID), F.col("source").alias(DOC), F.col("tag").alias(TAG)]
    times = taken.groupBy(*key).agg(F.sum(copies).alias(TIMES), F.count("*").alias(ROW)).where(F.col(TIMES) > 0)
    same = F.col("doc_id").eqNullSafe(F.col(ID)) & F.col("source").eqNullSafe(F.col(DOC)) & (text_tag(F.col("text")) == F.col(TAG))
    mixed = docs.join(times, same)
    nth = F.row_number().over(Window.partitionBy(ID, DOC, TAG).orderBy(ID))
    single, several = mixed.where(F.col(ROW) == 1), mixed.where(F.col(ROW) > 1).withColumn(COPY, nth)
    share = F.floor(F.col(TIMES) / F.col(ROW)) + (F.col(COPY) <= F.col(TIMES) % F.col(ROW)).cast("int")
    every = single.unionByName(several.withColumn(TIMES, share).where(F.col(TIMES) > 0).drop(COPY))
    return every.withColumn(COPY, F.explode(F.sequence(F.lit(1), F.col(TIMES).cast("int")))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, its three best paths with their scores, and whether decoding gives the text."""
    return encode_texts(docs, keep_columns=["doc_id", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("suffix_array_dedup", cut_long_repeats),
    ("mixing", mix_by_weight),
    ("piece_encoding", encode_pieces),
]

#: SQL can't express the trained model or the piece lattice; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is staged before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
