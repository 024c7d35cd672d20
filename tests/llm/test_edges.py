"""Nulls, empty and long texts, ties, repeated rows, extra columns and empty tables, for every operator."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import quality_classifier, quality_rules, staging, toxicity
from eventloom.llm.mixing import mix_sources
from eventloom.llm.ngram_join import link_components
from eventloom.llm.piece_lattice import DEFAULT_MODEL, decode_ids, encode_texts
from eventloom.llm.sharding import shard_documents
from eventloom.llm.substring_dedup import remove_known_windows
from eventloom.llm.suffix_dedup import remove_repeated_bytes
from eventloom.llm.vector_graph import nearest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
# columns that operators add or use themselves
EXTRA = {"size": "long", "shard": "int", "slot": "long", "score": "double", "ids": "string", "nbest_ids": "int", "round_trip": "string", "target": "string", "taken": "string", "kept": "string", "kept_text": "string", "n_words": "string", "n_removed": "string", "n_spans": "string", "n_bytes": "string", "_row": "string", "d": "long", "tag": "string", "doc": "string", "node": "string", "n": "string", "key": "string"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {t}" for c, t in EXTRA.items())


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "alpha beta gamma " * 6, "en", "a"), (1, "alpha beta gamma " * 6, "en", "a"), (2, None, None, None), (None, "no id here at all", "en", "b"), (3, "", "en", "b"), (4, " \n\t ", "de", "b"), (5, LONG, "en", "a"), (6, LONG + " tail", "en", "a"), (7, "ünïcödé ☃ " * 5, "fr", "b"), (8, "one two", None, "a"), (2, "another text with the same id", "en", "b")]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), *({"string": "x", "double": -5.0}.get(k, -5) for k in EXTRA.values())) for i, t, g, s in texts], SCHEMA).repartition(2).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(None, 1, 1), (5, None, None), (999, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


def empty(docs):
    return docs.limit(0)


def test_mixing(docs):
    rows = mix_sources(docs).collect()
    assert len(rows) == 11 and all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in by.values()) and None in by
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs.repartition(3), cell_rows=2).collect()))
    assert mix_sources(empty(docs)).count() == 0


def test_quality_rules(docs, labels):
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == 11 and all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert quality_rules.judge(empty(docs), labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).where("not base_failed and not kept").count() == 0


def test_quality_classifier(docs, labels):
    described = quality_classifier.describe(docs)
    for rows in (labels, labels.limit(0)):
        scores = [r.score for r in quality_classifier.score(described, quality_classifier.train(described, rows)).collect()]
        assert len(scores) == 11 and all(0 <= x <= 1 for x in scores)
    none = quality_classifier.describe(empty(docs))
    assert quality_classifier.score(none, quality_classifier.train(none, labels)).count() == 0


def test_toxicity(docs, labels):
    for rows in (labels, labels.limit(0)):
        scored = toxicity.score(docs, toxicity.train(docs, rows))
        got = scored.collect()  # the model's score takes the place of the input's -5
        assert len(got) == 11 and all(0 <= r.score <= 1 for r in got) and sorted(scored.columns) == sorted(docs.columns)
    assert toxicity.score(empty(docs), toxicity.train(empty(docs), labels)).count() == 0


def test_substring_dedup(docs):
    rows = remove_known_windows(docs, keep_columns=docs.columns)
    assert sorted(rows.columns) == sorted(docs.columns)
    got = {(r.doc_id, r.n_words): r.n_removed for r in rows.collect()}
    assert got[(6, 30_001)] == 30_000 and got[(5, 30_000)] == 0 and got[(1, 18)] == 0 and got[(2, 0)] == 0
    assert remove_known_windows(empty(docs)).count() == 0


def test_suffix_dedup(docs):
    rows = remove_repeated_bytes(docs, window=60, gram=24).collect()
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in rows}
    n = len(LONG)
    assert len(rows) == 11 and got[(5, n)] == n and got[(6, n + 5)] == n and got[(1, 102)] == 102 and got[(3, 0)] == 0
    assert remove_repeated_bytes(empty(docs)).count() == 0


def test_ngram_join(docs):
    rows = link_components(docs).collect()
    got = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert len(rows) == 11 and got[(6, 29_999)] == 5 and got[(2, 0)] == 2 and got[(4, 0)] == 4 and got[(1, 3)] == 1
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert link_components(empty(docs)).count() == 0


def test_sharding(docs):
    rows = shard_documents(docs, 4).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.size == len((r.text or "").encode()) + 1
    assert len(rows) == 11 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(empty(docs), 4).count() == 0


@pytest.mark.skipif(not __import__("os").path.exists(DEFAULT_MODEL), reason="no vocabulary here")
def test_pieces(docs):
    got = decode_ids(encode_texts(docs)).collect()
    assert len(got) == 11 and all(r.round_trip and r.decoded == (r.text or "") for r in got)
    assert encode_texts(empty(docs)).count() == 0


def test_vectors(spark):
    e = [(i, [float(i % 5), 1.0, 0.0]) for i in range(1, 41)] + [(20, [0.0, 1.0, 0.0]), (60, None), (80, [0.0, 0.0, 0.0]), (100, [float("nan"), 1.0, 1.0]), (120, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (140, [1.0]), (160, [])]
    df = spark.createDataFrame(e, "vec_id long, embedding array<double>").withColumn("h", F.lit(1)).withColumn("v", F.lit(2))
    got = nearest(df).collect()
    assert {r.query_id for r in got} == {20, 40} and all(r.vec_id != r.query_id for r in got)
    ranks = [r["rank"] for r in got if r.query_id == 40]
    assert sorted(ranks) == list(range(1, 21))
    assert nearest(df.limit(0)).count() == 0


def test_pipeline_on_odd_rows(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "mixing", "piece_encoding"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "ids", "round_trip"} <= set(out.columns) and out.where("not round_trip").count() == 0


def test_null_ids_with_colliding_hashes_keep_their_own_cuts(spark):
    seen, pair = {}, None
    texts = (f"{k:x} text" for k in range(400_000))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "hash(t) h").collect()
    for r in rows:  # two short texts with one 32-bit hash
        if r.h in seen:
            pair = (seen[r.h], r.t)
            break
        seen[r.h] = r.t
    assert pair
    long = " ".join(f"word{k}" for k in range(300))
    df = spark.createDataFrame([(None, pair[0]), (None, pair[1]), (None, long), (None, long + " and more"), (1, long)], "doc_id long, text string")
    assert sorted(r.n_removed for r in remove_known_windows(df).collect()) == [0, 0, 0, 300, 300]
    assert sorted(r.n_removed for r in remove_repeated_bytes(df).collect()) == [0, 0, *[len(long)] * 3]
    assert sorted(r.n_shingles for r in link_components(df).collect()) == [1, 1, 298, 298, 300]


def test_very_long_texts(spark):
    base = " ".join(f"w{k % 9973}x{k % 7919}" for k in range(350_000))  # 4 MB, many pieces
    other = "start " + base[1_000_000:3_000_000] + " end"
    df = spark.createDataFrame([(1, base), (2, other), (3, "=" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_known_windows(df, batches=2).collect()}
    inner = len(base[1_000_000:3_000_000].split())
    assert got[1][0] == 350_000 and inner - 2 <= got[2][1] <= inner and got[3] == (1, 0)
    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in remove_repeated_bytes(df).collect()}
    assert 2_000_000 <= cut[2][1] <= 2_000_002 and cut[3] == (2_000_000, 2_000_000)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in link_components(df).collect()}
    assert found[1][1] == 1 and found[2][1] == 2 and found[3] == (1, 3)


class Unset:
    """A session without ``spark.checkpoint.dir``, under a given master."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    def __init__(self, master):
        self.sparkContext = self
        self.master, self.chosen = master, None

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, path):
        self.chosen = path


def test_no_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            staging.shared_dir(Unset(master))
    local = Unset("local[4]")
    assert staging.shared_dir(local) == staging.shared_dir(local) == local.chosen


def test_operators_start_without_a_setting(tmp_path):
    """In a session of its own, with no Spark settings at all, staged operators and the pipeline run."""
    script = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", "{tmp_path}").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import corpus_pipeline
from eventloom.llm.mixing import mix_sources
docs = spark.createDataFrame([(i, f"text number {{i}}", "en", "ab"[i % 2], 10) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
assert mix_sources(docs).count() == 20
docs.write.parquet("{tmp_path}/documents.parquet")
spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet("{tmp_path}/labels.parquet")
rows = corpus_pipeline.run(spark, "{tmp_path}").collect()
assert rows and all(r.round_trip for r in rows)
"""
    os.makedirs(tmp_path / "conf")
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(Path(corpus_pipeline.__file__).parent)}
    done = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
