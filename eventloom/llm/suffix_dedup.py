"""Removal of every long repeated byte string, with run-length BWT blocks.

A byte goes if some ``window``-byte string that covers it also starts anywhere
else in the corpus, in the same text or another one.

1. Every text is cut into anchored runs of windows (:mod:`.anchors`).  Equal windows have
   equal anchors at equal offsets, so only runs of one anchor can share a window.
2. Of every anchor that occurs twice or more, each different run is fetched once as bytes
   (its *context*), and a second time if it occurs more often: from its first and its last
   place, so that the index sees two texts.  Digests only say what to fetch.
3. An anchor's contexts, aligned at the anchor, go into one block's index
   (:class:`RunLengthIndex`): the Burrows-Wheeler transform of each column, stored as its
   equal-letter runs with the common prefix sampled where a run starts behind the end of
   another.  Streaming the columns leftwards moves whole runs and gives every context's
   matching statistics, which mark the windows that another context shares.
4. The marked windows' bytes are cut out of the texts in one more pass.

A block holds many anchors.  An anchor with more than ``block_rows`` contexts is split by
the bytes that its windows have in common: windows are classed by the anchor's offset in
them, in ranges of 16 offsets, and the bytes that all windows of a range cover are part of the
key.  Keys that are still too large are split by the whole window; what is equal there is
dealt into pieces that all get one of the contexts.  So every window meets another that
equals it, and no task holds an unbounded group.

Defined results: a null text is empty; null ids and rows that repeat an id are
documents of their own (equal texts remove each other); an empty table gives an
empty result; result columns take the place of input columns with their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors
from . import textcodes as tc
from .ngram_join import whole_groups
from .staging import discard, stage
from .substring_dedup import key_columns, keyed

NO_BYTE = 256
#: Offsets per class when a frequent anchor is split; 1 is the window itself.
CLASSES = (16, 1)


@dataclass
class RunLengthIndex:
    """Aligned contexts as run-compressed transforms, one for each column, from the right.

    ``starts``: where runs of equal (group, letter) start in the order of the column to the
    right; ``move``: the runs in this column's order; ``sample``: the common prefix of a run's
    first context with the last one of the run before it, -1 for runs past a context's end.
    """

    rows: int
    starts: list[np.ndarray]
    move: list[np.ndarray]
    sample: list[np.ndarray]

    @classmethod
    def build(cls, group: np.ndarray, grid: np.ndarray) -> RunLengthIndex:
        """``group`` ascends; ``grid`` has a context in each row, NO_BYTE around it."""
        n, width = grid.shape
        index = cls(n, [], [], [])
        code = np.cumsum(np.append(0, group[1:] != group[:-1])) * (NO_BYTE + 1)
        order = np.arange(n)
        for column in range(width - 1, -1, -1):
            key = code[order] + grid[order, column]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            move = np.argsort(key[start], kind="stable")
            key, (take, head) = key[start][move], _moved(start, move, n)
            order = order[take]
            blank = key % (NO_BYTE + 1) == NO_BYTE
            sample = np.where(blank, -1, 0).astype(np.int32)
            ends = np.flatnonzero(np.append(False, key[1:] == key[:-1]) & ~blank)
            if len(ends):
                a, b = grid[order[head[ends]], column:], grid[order[head[ends] - 1], column:]
                differ = (a != b) | (a == NO_BYTE)
                sample[ends] = np.where(differ.any(axis=1), differ.argmax(axis=1), width - column)
            index.starts.append(start.astype(np.int32))
            index.move.append(move.astype(np.int32))
            index.sample.append(sample)
        return index

    def statistics(self):
        """For each column, from the right: contexts in its order and the longest prefix each shares with a neighbour."""
        order, common = np.arange(self.rows), np.zeros(self.rows, np.int32)
        for start, move, sample in zip(self.starts, self.move, self.sample, strict=True):
            take, head = _moved(start, move, self.rows)
            order, common = order[take], common[take] + 1
            common[head] = sample
            if (sample < 0).any():
                common[np.repeat(sample < 0, np.diff(np.append(head, self.rows)))] = 0
            yield order, np.maximum(common, np.append(common[1:], 0))


def _moved(start: np.ndarray, move: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all rows when runs move as a whole, and where each run starts then."""
    size = np.diff(np.append(start, n))[move]
    head = np.cumsum(size) - size
    return np.repeat(start[move] - head, size) + np.arange(n), head


def shared_windows(group: np.ndarray, data: np.ndarray, lengths: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of aligned contexts some other context of the same group shares.

    ``group`` ascends, ``data`` has all contexts' bytes, ``left`` the bytes before the
    anchor.  Returns rows, first window starts and numbers of consecutive windows.
    """
    n, pad = len(group), int(left.max())
    width = pad + int((lengths - left).max())
    grid = np.full((n, width), NO_BYTE, np.uint16)
    begin = np.arange(n) * width + pad - left
    grid.ravel()[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(data))] = data
    shared = np.zeros((n, int(lengths.max()) - window + 3), bool)  # a column that stays false on either side
    for k, (order, longest) in enumerate(RunLengthIndex.build(group, grid).statistics()):
        hit = order[longest >= window]
        shared[hit, width - k - pad + left[hit]] = True
    rows, first = np.nonzero(shared[:, 1:] & ~shared[:, :-1])
    _, last = np.nonzero(shared[:, :-1] & ~shared[:, 1:])
    return rows, first, last - first


def _contexts(window: int):
    """For mapInArrow over texts with the runs asked of them: one row for each run's bytes."""

    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "text"):
                buf, offs = tc.text_buffers(part.column("text"))
                want = part.column("want")
                own = np.repeat(np.arange(len(want)), np.diff(want.offsets.to_numpy()))
                flat = want.flatten()
                f, d, at = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("f", "d", "at"))
                low = at & 0xFFFFFFFF
                count, left = low & ((1 << anchors.ANCHOR_SHIFT) - 1), low >> anchors.ANCHOR_SHIFT
                for i in range(0, len(f), 4096):
                    some = slice(i, i + 4096)
                    data, total = tc.gather(buf, offs[own[some]] + (at[some] >> 32), count[some] + window - 1)
                    context = pa.Array.from_buffers(pa.binary(), len(f[some]), [None, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([pa.array(f[some]), pa.array(d[some]), pa.array(left[some].astype(np.int32)), context], names=["f", "d", "left", "context"])

    return run


def _blocks(window: int, rows: int):
    """For mapInArrow over contexts sorted by key: f, d and the ranges of their shared windows."""

    @tc.tidy
    def run(batches):
        for got in whole_groups(batches, "key", rows):
            f, d, base = (got.column(k).to_numpy() for k in ("f", "d", "base"))
            context = got.column("context").combine_chunks()
            offs = np.frombuffer(context.buffers()[1], np.int32, len(context) + 1, context.offset * 4)
            data = np.frombuffer(context.buffers()[2], np.uint8)[offs[0] : offs[-1]]
            row, first, many = shared_windows(got.column("key").to_numpy(), data, np.diff(offs).astype(np.int64), got.column("left").to_numpy().astype(np.int64), window)
            yield pa.RecordBatch.from_arrays([pa.array(f[row]), pa.array(d[row]), pa.array((first + base[row]).astype(np.int32)), pa.array(many.astype(np.int32))], names=["f", "d", "off", "many"])

    return run


def _split(rows: DataFrame, window: int, width: int) -> DataFrame:
    """Contexts by ranges of ``width`` anchor offsets, keyed by the bytes that all windows of a range cover."""
    last = F.col("left") - (F.length("context") - window)  # the anchor's offset in the last window
    each = rows.withColumn("low", last).withColumn("c", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"left div {width}"))))
    each = each.withColumns({"a": F.greatest("low", F.col("c") * width), "b": F.least("left", F.col("c") * width + width - 1)})
    core = F.expr(f"substring(context, left - c * {width} + 1, {window - width + 1})")
    return each.select(
        F.xxhash64("f", F.lit(width), "c", core).alias("key"), "f", "d", F.expr("base + left - b").cast("int").alias("base"),
        F.col("b").cast("int").alias("left"), F.expr(f"substring(context, left - b + 1, {window} + b - a)").alias("context"),
    )


def _indexable(contexts: DataFrame, window: int, block_rows: int) -> DataFrame:
    """Contexts keyed so that no key has many more than ``block_rows`` rows and equal windows meet under some key."""
    rows, parts = contexts.select(F.col("f").alias("key"), "f", "d", F.lit(0).alias("base"), "left", "context"), []
    for width in CLASSES:
        large = stage(rows.groupBy("key").count().where(F.col("count") > block_rows).select("key"), "large")
        parts.append(rows.join(large, "key", "left_anti"))
        rows = _split(rows.join(large, "key", "left_semi"), window, width)
    # under these keys all windows are equal: each piece gets the same one of them
    pieces = rows.groupBy("key").agg(F.min("d").alias("hub"), F.ceil(F.count("*") / block_rows).cast("int").alias("n"))
    salt = F.when(F.col("d") == F.col("hub"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.pmod(F.xxhash64("d"), F.col("n")).cast("int")))
    dealt = rows.join(pieces, "key").withColumn("salt", F.explode(salt))
    parts.append(dealt.select(F.xxhash64("key", "salt").alias("key"), *rows.columns[1:]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _cut_bytes(window: int):
    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "_text"):
                buf, offs = tc.text_buffers(part.column("_text"))
                spans = part.column("_spans")
                own = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
                flat = spans.flatten()
                change = np.zeros(len(buf) + 1, np.int32)
                if len(flat):
                    at = offs[own] + flat.field("pos").to_numpy(zero_copy_only=False)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + flat.field("len").to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(change[:-1], dtype=np.int32) > 0
                before = np.append(0, np.cumsum(gone))
                removed = before[offs[1:]] - before[offs[:-1]]
                edge = np.zeros(len(buf) + 1, bool)
                edge[offs] = True
                opens = gone.copy()
                opens[1:] &= ~gone[:-1] | edge[1 : len(buf)]
                opened = np.append(0, np.cumsum(opens))
                total = np.append(0, np.cumsum(np.diff(offs) - removed)).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(total), pa.py_buffer(np.ascontiguousarray(buf[~gone]))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(np.diff(offs)), pa.array(removed.astype(np.int64)), pa.array((opened[offs[1:]] - opened[offs[:-1]]).astype(np.int64)), kept],
                    names=["_row", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 64, block_rows: int = 8192, keep_columns: list[str] | None = None) -> DataFrame:
    """Cut every byte covered by a ``window``-byte string that occurs twice or more.

    Returns ``keep_columns`` (default: the id) with n_bytes, n_removed, n_spans
    (maximal removed runs) and kept (binary: the remaining bytes, concatenated).
    """
    if not 8 <= gram < window or window - gram >= 1 << 15 or window < max(CLASSES):
        raise ValueError("8 <= gram < window and window - gram < 32768")
    texts = keyed(docs, id_col, text_col)
    rows = texts.mapInArrow(anchors.byte_runs(window, gram), anchors.RUN_SCHEMA)
    place = F.struct("doc", "tag", "at")
    runs = stage(rows.groupBy("f", "d").agg(F.count("*").alias("c"), F.min(place).alias("lo"), F.max(place).alias("hi")), "runs")
    several = runs.groupBy("f").agg(F.sum("c").alias("n")).where("n > 1").select("f")
    asked = runs.join(several, "f", "left_semi").select("f", "d", F.explode(F.when(F.col("c") > 1, F.array("lo", "hi")).otherwise(F.array("lo"))).alias("k"))
    asked = asked.groupBy("k.doc", "k.tag").agg(F.collect_list(F.struct("f", "d", "k.at")).alias("want"))
    once = texts.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "tag").orderBy("doc"))).where("nth = 1").drop("nth")
    contexts = stage(once.join(asked, ["doc", "tag"]).select("text", "want").mapInArrow(_contexts(window), "f long, d long, left int, context binary"), "contexts")
    blocks = _indexable(contexts, window, block_rows).repartition("key").sortWithinPartitions("key")
    hits = blocks.mapInArrow(_blocks(window, block_rows), "f long, d long, off int, many int")
    shared = stage(hits.groupBy("f", "d").agg(F.collect_set(F.struct("off", "many")).alias("hits")), "hits")

    once = runs.where("c = 1").join(shared, ["f", "d"]).select("lo.*", "hits")
    more = rows.join(shared.join(runs.where("c > 1").select("f", "d"), ["f", "d"]), ["f", "d"]).select("doc", "tag", "at", "hits")
    marks = once.unionByName(more).select("doc", "tag", F.shiftright("at", 32).cast("int").alias("pos"), F.explode("hits").alias("h"))
    span = F.struct((F.col("pos") + F.col("h.off")).alias("pos"), (F.col("h.many") + window - 1).alias("len"))
    spans = stage(marks.groupBy("doc", "tag").agg(F.collect_set(span).alias("_spans")), "spans")
    discard(runs, contexts, shared)

    keep = [c for c in keep_columns or [id_col] if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    whole = docs.select(*key_columns(id_col, text_col), F.col(text_col).cast("string").alias("_text"), F.struct(*keep).alias("_row"))
    joined = whole.join(spans, ["doc", "tag"], "left").select("_row", "_text", "_spans")
    schema = joined.select("_row").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return joined.mapInArrow(_cut_bytes(window), schema).select("_row.*", "n_bytes", "n_removed", "n_spans", "kept")
