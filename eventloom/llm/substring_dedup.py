"""Substring deduplication with a log-structured fingerprint index.

The index is a folder of immutable runs.  A run holds, for one batch of documents, each
fingerprint once with the smallest document that has it, as a Parquet table bucketed and
sorted by fingerprint.  A new batch is fingerprinted and written as a run of its own,
merge-joined bucket by bucket with the runs before it (history isn't exchanged: what a
batch moves grows with the batch), verified and judged; if there are more than ``max_runs``
runs when a batch comes, the two smallest are compacted into one first, bucket by bucket.  An index
stays where it is and can be opened again by its path.

Fingerprints are anchored runs of windows (see :mod:`.anchors`): one row stands
for all consecutive windows that share an anchor.  A window counts as known if 128 bits
agree: a run's anchor and digest, or, where one anchor has different digests, its anchor
and the window's own hash, which the index keeps.  No earlier text is read again.

Defined results: a null text has no words; a null id counts as larger than any id;
rows that repeat an id never remove each other's words; an empty table gives an
empty result; result columns take the place of input columns with their names.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from . import textcodes as tc
from .staging import discard, new_path, settings, shuffle_files_freed, stage

LAST_ID = (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (never null), tag (tells rows of one id apart by text) and text, nothing else."""
    return docs.select(*key_columns(id_col, text_col), F.col(text_col).cast("string").alias("text"))


def key_columns(id_col: str, text_col: str) -> list[Column]:
    """The id, and a hash of the text with its length, which tells null and repeated ids apart."""
    text = F.col(text_col).cast("string")
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text, F.octet_length(text)).alias("tag")]


class FingerprintIndex:
    """Log-structured index of the window fingerprints of all documents added so far, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 13, gram: int = 4, max_runs: int = 2, buckets: int | None = None):
        if not 1 <= gram <= window or window - gram + 1 > 62:
            raise ValueError("1 <= gram <= window and window - gram < 62")
        self.spark, self.path, self.max_runs = spark, path or new_path(spark, "index"), max_runs
        self.tables: dict[str, str] = {}  # run folder: table of this session
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        found = self._settings()
        if found is None:
            found = (window, gram, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
            spark.createDataFrame([found], "window int, gram int, buckets int").coalesce(1).write.parquet(f"{self.path}/settings")
        self.window, self.gram, self.buckets = found
        if (self.window, self.gram) != (window, gram):
            raise ValueError(f"the index has window {self.window} and gram {self.gram}")

    def _exists(self, name: str) -> bool:
        return self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def _settings(self) -> tuple[int, int, int] | None:
        if not self._exists("settings/_SUCCESS"):
            return None
        return tuple(self.spark.read.parquet(f"{self.path}/settings").first())

    def runs(self) -> list[str]:
        """Folders of the complete runs, oldest first."""
        listed = [s.getPath().getName() for s in self._files.listStatus(self._hadoop)]
        return sorted(n for n in listed if n.startswith("run-") and self._exists(f"{n}/_SUCCESS"))

    def table(self, run: str) -> DataFrame:
        """A run as a bucketed table, registered in this session when it is first used."""
        if run not in self.tables:
            name = f"eventloom_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"create table {name} (f bigint, d bigint, doc bigint, hi bigint, hs binary) using parquet "
                f"options (path '{self.path}/{run}') clustered by (f) sorted by (f, d) into {self.buckets} buckets"
            )
            self.tables[run] = name
        return self.spark.table(self.tables[run])

    def _write(self, rows: DataFrame) -> str:
        """A new run from rows that are dealt to buckets: one sorted file each; of equal fingerprints the smallest document stays."""
        run = f"run-{len(self.runs()):04d}-{uuid.uuid4().hex[:12]}"
        name = f"eventloom_run_{uuid.uuid4().hex}"
        with shuffle_files_freed(self.spark):
            _firsts(rows).write.bucketBy(self.buckets, "f").sortBy("f", "d").option("path", f"{self.path}/{run}").option("compression", "zstd").saveAsTable(name)
        self.tables[run] = name
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"drop table if exists {self.tables.pop(run)}") if run in self.tables else None
        self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run}"), True)

    def compact(self) -> None:
        """Merge the two smallest runs into one: each fingerprint keeps its smallest document."""
        size = lambda run: self._files.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run}")).getLength()
        old = sorted(self.runs(), key=size)[:2]
        if len(old) == 2:
            self._write(self.table(old[0]).unionByName(self.table(old[1])))
            for run in old:
                self._drop(run)

    def close(self, delete: bool = False) -> None:
        """Forget the tables of this session, and with ``delete`` the index itself."""
        for name in self.tables.values():
            self.spark.sql(f"drop table if exists {name}")
        self.tables = {}
        if delete:
            self._files.delete(self._hadoop, True)

    def met(self, fresh: DataFrame, runs: list[str]) -> list[DataFrame]:
        """What ``runs`` have under the anchors of the run ``fresh``; a join of buckets, without an exchange."""
        wanted = fresh.select("f").distinct()
        return [self.table(run).join(wanted.hint("merge"), "f", "left_semi") for run in runs]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch (see :func:`keyed`) and judge its windows.

        Returns doc, tag and spans: the word runs of the batch that documents with smaller ids
        have, as (pos, cnt, mask); a null mask stands for all ``cnt`` windows from ``pos`` on.
        """
        while len(self.runs()) > self.max_runs:  # before the batch takes room of its own
            self.compact()
        texts = batch.select("doc", "tag", "text")
        earlier = self.runs()
        rows = texts.mapInArrow(anchors.word_runs(self.window, self.gram, True), anchors.INDEX_SCHEMA)
        fresh = self.table(self._write(rows.repartition(self.buckets, "f").sortWithinPartitions("f", "d", "doc")))
        parts = [fresh, *self.met(fresh, earlier)]
        # without the windows' hashes, which are read only where an anchor has several digests
        light = functools.reduce(DataFrame.unionByName, [p.select("f", "d", "doc", "hi", F.lit(p is fresh).alias("new")) for p in parts])
        mine = F.min(F.when(F.col("new"), F.col("doc")))
        light = stage(light.groupBy("f", "d").agg(F.min("doc").alias("doc"), F.max("hi").alias("hi"), F.coalesce(mine == F.min("doc"), F.lit(False)).alias("new")), "light")
        settled = stage(self._settled(light, parts), "settled")
        discard(light)
        rows = texts.mapInArrow(anchors.word_runs(self.window, self.gram), anchors.RUN_SCHEMA)
        low = F.col("at").bitwiseAND(0xFFFFFFFF).cast("int")
        marks = (
            rows.join(settled, ["f", "d"])
            .where("first < doc or (first = doc and mask is not null)")
            .select("doc", "tag", F.struct(F.shiftright("at", 32).cast("int").alias("pos"), low.alias("cnt"), F.when(F.col("first") == F.col("doc"), F.col("mask")).alias("mask")).alias("span"))
        )
        out = stage(marks.groupBy("doc", "tag").agg(F.collect_set("span").alias("spans")), "marks")
        discard(settled)
        return out

    def _settled(self, light: DataFrame, parts: list[DataFrame]) -> DataFrame:
        """f, d, first and mask of the runs that some document may lose words by.

        Documents above ``first`` lose the whole run; ``mask`` has the windows that are known from
        documents below ``first``, found by comparing single windows where an anchor has several digests.
        """
        # a digest that an earlier run has of a smaller document is settled by it; its windows only count as what others may repeat
        several = light.groupBy("f").agg(F.count("*").alias("n"), F.max("new").alias("new")).where("n > 1 and new").select("f")
        firsts = stage(light.join(several, "f", "left_semi").select("f", "d", "doc", "new"), "several")
        with settings(self.spark, spark__sql__requireAllClusterKeysForCoPartition="false"):  # buckets by f serve a join by f, d and doc
            hashed = [p.select("f", "d", "doc", "hs").join(firsts.hint("merge"), ["f", "d", "doc"]) for p in parts]
            windows = stage(functools.reduce(DataFrame.unionByName, hashed).mapInArrow(tc.tidy(anchors.single_windows), "f long, d long, doc long, new boolean, off int, h long"), "windows")
        smallest = windows.groupBy("f", "h").agg(F.min("doc").alias("lo"), F.max(F.when(F.col("new"), F.col("doc"))).alias("most")).where("lo < most").select("f", "h", "lo")
        known = windows.where("new").join(smallest, ["f", "h"]).where("lo < doc").groupBy("f", "d").agg(F.max("doc").alias("first"), F.expr("bit_or(shiftleft(1L, off))").alias("mask"))
        known = stage(known, "known")
        discard(firsts, windows)
        whole = light.where("hi > doc").select("f", "d", F.col("doc").alias("first"), F.lit(None).cast("long").alias("mask"))
        return whole.unionByName(known).groupBy("f", "d").agg(F.max("first").alias("first"), F.max("mask").alias("mask"))


def _firsts(rows: DataFrame) -> DataFrame:
    """Each fingerprint with its smallest document, the largest one that has it, and its windows' hashes."""
    return rows.groupBy("f", "d").agg(F.min("doc").alias("doc"), F.max("hi").alias("hi"), F.first("hs").alias("hs"))


def _kept_words(window: int):
    """Cut the marked words out of each text; the other columns stay as they are."""

    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "_text"):
                buf, offs = tc.text_buffers(part.column("_text"))
                a, e, first = tc.word_bounds(buf, offs)
                spans = part.column("_spans")
                own = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
                flat = spans.flatten()
                pos, cnt = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("pos", "cnt"))
                whole = flat.field("mask").is_null().to_numpy(zero_copy_only=False)
                at = first[own] + pos
                change = np.zeros(len(a) + 1, np.int32)
                np.add.at(change, at[whole], 1)
                np.add.at(change, at[whole] + cnt[whole] + window - 1, -1)
                mask = flat.field("mask").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                row, off = np.nonzero(mask[:, None] >> np.arange(62) & 1)
                np.add.at(change, at[row] + off, 1)
                np.add.at(change, at[row] + off + window, -1)
                stay = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int32) == 0)
                kept = np.searchsorted(stay, first)
                joint = np.ones(len(stay), np.int64)  # a space behind each word but a text's last
                joint[kept[1:][kept[1:] > kept[:-1]] - 1] = 0
                data, total = tc.gather(np.append(buf, np.uint8(32)), a[stay], e[stay] - a[stay] + joint)
                data[total[1:][joint == 1] - 1] = 32
                texts = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(total[kept].astype(np.int32)), pa.py_buffer(data)])
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(n), pa.array(n - np.diff(kept)), texts], names=["_row", "n_words", "n_removed", "kept_text"])

    return run


def remove_known_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 4, batches: int = 4, max_runs: int = 2, keep_columns: list[str] | None = None, index_path: str | None = None) -> DataFrame:
    """Remove each word covered by a ``window``-word window that also starts in a document with a smaller id.

    The documents enter the index in ``batches`` batches of ascending ids.  An index at ``index_path``
    counts with all it holds, and stays; without a path the index is deleted in the end.  Returns
    ``keep_columns`` (default: the id) with n_words, n_removed and kept_text (kept
    words joined by one space).
    """
    index = FingerprintIndex(docs.sparkSession, index_path, window, gram, max_runs)
    texts = keyed(docs, id_col, text_col)
    cuts = []
    if batches > 1:
        found = texts.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000)).first()[0]
        cuts = sorted(set(found or []))
    bounds, marks = [None, *cuts, None], []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = texts if high is None else texts.where(F.col("doc") <= high)
        marks.append(index.add(part if low is None else part.where(F.col("doc") > low)))
    index.close(delete=index_path is None)
    names = [c for c in keep_columns or [id_col] if c not in ("n_words", "n_removed", "kept_text")]
    whole = docs.select(*key_columns(id_col, text_col), F.col(text_col).cast("string").alias("_text"), F.struct(*names).alias("_row"))
    spans = functools.reduce(DataFrame.unionByName, marks).withColumnRenamed("spans", "_spans")
    joined = whole.join(spans, ["doc", "tag"], "left").select("_row", "_text", F.coalesce("_spans", F.expr("array()")).alias("_spans"))
    schema = joined.select("_row").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return joined.mapInArrow(_kept_words(window), schema).select("_row.*", "n_words", "n_removed", "kept_text")
