"""N-gram Jaccard self-join by prefix trees, and the components of its links.

Two documents link when their sets of distinct word n-grams have a Jaccard similarity of
``num / den`` or more.  Documents with equal sets are one node.

*Global order.*  Grams are ordered by falling document frequency, ties by hash.  The
frequencies are counted by one exchange of packed grams by hash range (``gram_rows``).
A gram of a single node can't be shared, so it only counts in its set's length; the
others (*live* grams) come back to their nodes in global order.  Grams that hold more than
``hot_share`` of all occurrences are found in the first pass (any such gram is that frequent
in some slice of texts) and aren't exchanged by hash, so a very frequent gram fills no task;
there are at most ``2 / hot_share`` of them.

*Candidates.*  Two sets can only link if they share one of the rarest
``size - ceil(size * num / den) + 1`` grams of each (prefix filtering, from the
order's rare end).  Nodes that share such a gram, directly or by a chain, form a cluster.

*Tries.*  Each cluster's sets go into a trie in global order (:mod:`.shingle_trie`), which
is traversed once per probe with shared overlaps and length bounds.  A cluster of more than
``block_items`` grams is dealt into pieces, which all get its smallest node.  What a piece
leaves apart from that node then meets every piece: of two sets not yet connected one at
least is such a straggler, so no link is lost, and no task holds more than one piece and
as many stragglers' grams.

Defined results: a null or word-less text has the empty set and links with nothing; null
ids take part and count as larger than any id; rows that repeat an id are rows like
others; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcodes as tc
from .components import connected_components
from .shingle_trie import block_components
from .staging import discard, stage
from .substring_dedup import LAST_ID, key_columns

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
EMPTY = 0x5851F42D4C957F2D
#: Frequencies only order grams; larger ones count as this.
MOST = (1 << 31) - 1


def gram_sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of each text, all texts after another, and each text's first."""
    buf, offs = tc.text_buffers(part.column("text"))
    buf = _LOWER[buf]
    a, e, first = tc.word_bounds(buf, offs)
    words = tc.span_hashes(buf, a, e)
    texts, count = part.num_rows, np.diff(first)
    own, grams = [], []
    if len(words) >= size:
        at = np.flatnonzero(tc.inside(first, len(words), size))
        own.append(tc.owners(first, len(words))[at])
        grams.append(tc.gram_hashes(words, size)[at])
    for n in range(1, size):  # shorter texts: the whole sequence
        short = np.flatnonzero(count == n)
        if len(short):
            own.append(short)
            grams.append(tc.gram_hashes(words, n)[first[short]])
    if not own:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    own_all, grams_all = np.concatenate(own), np.concatenate(grams)
    order = np.lexsort((grams_all, own_all))
    own_all, grams_all = own_all[order], grams_all[order]
    new = np.ones(len(order), bool)
    new[1:] = (own_all[1:] != own_all[:-1]) | (grams_all[1:] != grams_all[:-1])
    own_all, grams_all = own_all[new], grams_all[new]
    return grams_all, np.searchsorted(own_all, np.arange(texts + 1))


def _digests(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 63-bit digest of each set."""
    c = np.append(_U(0), np.cumsum(tc.mix(grams ^ _U(EMPTY)), dtype=np.uint64))
    return (tc.mix((c[first[1:]] - c[first[:-1]]) + np.diff(first).astype(np.uint64)) >> _U(1)).astype(np.int64)


def _described(size: int, hot_share: float):
    """For mapInArrow over (doc, tag, text): set size and node of each text, and the slice's frequent grams in its first row."""

    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "text"):
                grams, first = gram_sets(part, size)
                ordered = np.sort(grams)
                cut = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
                count = np.diff(np.append(cut, len(ordered)))
                often = np.flatnonzero(count >= max(2.0, hot_share * len(ordered)))
                at = np.full(part.num_rows + 1, len(often), np.int32)
                at[0] = 0
                frequent = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (ordered[cut[often]].view(np.int64), count[often])]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("tag"), pa.array(np.diff(first)), pa.array(_digests(grams, first)), *frequent], names=["doc", "tag", "n", "node", "often", "times"])

    return run


def _packed(size: int, buckets: int, hot: np.ndarray, slices: int, k: int):
    """For mapInArrow over texts: for each bucket of the hash range a slice's grams, and the nodes and sizes they belong to.

    Frequent grams are left out of the buckets; bucket -1 has them.
    """

    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "text"):
                grams, first = gram_sets(part, size)
                node, own = _digests(grams, first), tc.owners(first, len(grams))
                length = np.diff(first)
                bucket = ((grams >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                if len(hot):
                    bucket[hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams] = -1
                use = np.flatnonzero(np.where(bucket < 0, k == 0, bucket % slices == k))
                use = use[np.argsort(bucket[use], kind="stable")]
                if not len(use):
                    continue
                b, g, o = bucket[use], grams[use].view(np.int64), own[use]
                cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])).astype(np.int32)
                at = pa.array(np.append(cut, len(b)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (g, node[o], length[o].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(b[cut]), *lists], names=["bucket", "grams", "nodes", "sizes"])

    return run


def whole_groups(batches, key: str, rows: int):
    """Re-cut batches that come sorted by ``key`` so that no key is split and tables have about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            got = pa.Table.from_batches(held).combine_chunks()
            keys = got.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield got.slice(0, cut)
                got = got.slice(cut)
            held, count = got.to_batches(), got.num_rows
            if not cut:
                count = 0  # one large key so far: wait for as many rows again
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _counted(hot: np.ndarray, times: np.ndarray):
    """For mapInArrow over packed grams sorted by bucket: (node, gram, n << 32 | frequency) of the live grams."""

    @tc.tidy
    def run(batches):
        for got in whole_groups(batches, "bucket", 1):
            bucket = got.column("bucket").to_numpy()
            for low in np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])):
                mine = got.slice(low, int(np.searchsorted(bucket, bucket[low], "right")) - low)
                gram, node, size = (mine.column(c).combine_chunks().flatten().to_numpy() for c in ("grams", "nodes", "sizes"))
                if bucket[low] < 0:
                    count = times[np.searchsorted(hot, gram.view(np.uint64))]
                else:
                    order = np.lexsort((node, gram))
                    gram, node, size = gram[order], node[order], size[order]
                    new = np.append(True, gram[1:] != gram[:-1])
                    once = new | np.append(True, node[1:] != node[:-1])
                    gram, node, size, new = gram[once], node[once], size[once], new[once]
                    first = np.flatnonzero(new)
                    of = np.diff(np.append(first, len(gram)))
                    count = np.repeat(of, of)
                live = count > 1
                packed = size[live].astype(np.int64) << 32 | np.minimum(count[live], MOST)
                yield pa.RecordBatch.from_arrays([pa.array(node[live]), pa.array(gram[live]), pa.array(packed)], names=["node", "gram", "packed"])

    return run


def _prefixed(num: int, den: int):
    """For mapInArrow over live grams sorted by node and falling frequency: the nodes whose prefix holds a live gram."""

    @tc.tidy
    def run(batches):
        for got in whole_groups(batches, "node", 1 << 17):
            node, gram, packed = (got.column(c).to_numpy() for c in ("node", "gram", "packed"))
            once = np.append(True, (node[1:] != node[:-1]) | (gram[1:] != gram[:-1]))  # rows that repeat an id and text
            node, gram, packed = node[once], gram[once], packed[once]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            live = np.diff(np.append(first, len(node)))
            n = packed[first] >> 32
            prefix = n + (-n * num) // den + 1 - (n - live)
            keep = prefix > 0
            inside = np.repeat(keep, live)
            at = pa.array(np.append(0, np.cumsum(live[keep])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (gram[inside], (packed[inside] & MOST).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(node[first[keep]]), pa.array(n[keep]), pa.array(prefix[keep].astype(np.int32)), *lists], names=["node", "n", "prefix", "grams", "times"])

    return run


def _join_blocks(num: int, den: int):
    """For mapInArrow over sets sorted by block: an edge from each set to its component's root in the block."""

    @tc.tidy
    def run(batches):
        for got in whole_groups(batches, "block", 1):
            block, node, n = (got.column(c).to_numpy() for c in ("block", "node", "n"))
            lists = got.column("grams").combine_chunks()
            offs, grams = lists.offsets.to_numpy(), lists.values.to_numpy()
            times = got.column("times").combine_chunks().values.to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            us, vs = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = a + np.unique(node[a:b], return_index=True)[1]
                at = np.append(0, np.cumsum(offs[rows + 1] - offs[rows]))
                take = np.repeat(offs[rows] - at[:-1], np.diff(at)) + np.arange(at[-1])
                root = block_components(grams[take], times[take], at, n[rows], num, den)
                joined = root != np.arange(len(rows))
                us.append(node[rows][joined])
                vs.append(node[rows[root[joined]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def live_grams(texts: DataFrame, base: DataFrame, size: int, gram_rows: int, slices: int, hot_share: float) -> list[DataFrame]:
    """node, gram and n << 32 | frequency of every gram that several nodes have, in staged parts; ``base``: see :func:`_described`."""
    often = base.select(F.explode(F.arrays_zip("often", "times")).alias("o")).groupBy("o.often").agg(F.sum("o.times").alias("times"))
    total = base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most 2 / hot_share sums of counts can reach this
    found = often.where(F.col("times") >= max(2.0, hot_share * total / 2)).collect()
    hot = np.array([r.often for r in found], np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, times = hot[order], np.array([r.times for r in found], np.int64)[order]
    buckets = max(1, total // gram_rows)
    of_node = base.where("n > 0").groupBy("node").agg(F.min(F.struct("doc", "tag")).alias("k")).select("k.*")
    once = texts.join(of_node.hint("merge"), ["doc", "tag"], "left_semi").select("text")
    parts = []
    for k in range(slices):
        packed = once.mapInArrow(_packed(size, buckets, hot, slices, k), "bucket long, grams array<long>, nodes array<long>, sizes array<int>")
        deal = F.when(F.col("bucket") < 0, F.xxhash64("grams")).otherwise(F.col("bucket"))
        live = packed.repartition(deal).sortWithinPartitions("bucket").mapInArrow(_counted(hot, times), "node long, gram long, packed long")
        parts.append(stage(live, "live"))
    return parts


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100, block_items: int = 1 << 20, gram_rows: int = 1 << 19, slices: int = 3, hot_share: float = 1e-5) -> DataFrame:
    """One row per document: id, n_shingles and component_id (the smallest id reachable by links)."""
    rows = linked_rows(docs, id_col, text_col, size, num, den, block_items, gram_rows, slices, hot_share)
    smallest = rows.groupBy("component").agg(F.min("doc").alias("least"))
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    out = rows.join(smallest, "component", "left").select(real("doc").alias(id_col), F.col("n").alias("n_shingles"), real("least").alias("least"), "doc")
    return out.select(id_col, "n_shingles", F.coalesce("least", F.col(id_col)).alias("component_id"))


def linked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100, block_items: int = 1 << 20, gram_rows: int = 1 << 19, slices: int = 3, hot_share: float = 1e-5) -> DataFrame:
    """One row per document by its row key (see :func:`.substring_dedup.key_columns`): doc, tag, n (set size) and component.

    Rows with one component are linked; a document without words has none.  Rows without an id or with a repeated one are told apart.
    """
    if not 0 < num < den or size < 1:
        raise ValueError("0 < num < den and size >= 1")
    texts = docs.select(*key_columns(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    base = stage(texts.mapInArrow(_described(size, hot_share), "doc long, tag long, n long, node long, often array<long>, times array<long>"), "described")
    parts = live_grams(texts, base, size, gram_rows, slices, hot_share)
    live = functools.reduce(DataFrame.unionByName, parts)
    falling = F.col("packed").bitwiseAND(MOST).desc()
    sets = live.repartition("node").sortWithinPartitions("node", falling, "gram").mapInArrow(_prefixed(num, den), "node long, n long, prefix int, grams array<long>, times array<int>")
    sets = stage(sets, "sets")
    discard(*parts)

    rare = sets.select("node", F.explode(F.expr("slice(grams, -prefix, prefix)")).alias("gram"))
    first = rare.groupBy("gram").agg(F.min("node").alias("v"), F.max("node").alias("hi")).where("v < hi").select("gram", "v")
    edges = rare.join(first, "gram").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    found = connected_components(edges).withColumnRenamed("component", "cluster")
    items = F.size("grams").cast("long")
    members = stage(found.join(sets, "node").withColumn("items", items), "members")
    scratch = [base, sets, members]
    per = members.groupBy("cluster").agg(F.ceil(F.sum("items") / block_items).cast("int").alias("pieces"))
    members = members.join(per, "cluster").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))

    def joined(rows: DataFrame) -> DataFrame:
        rows = rows.select("block", "node", "n", "grams", "times").repartition("block").sortWithinPartitions("block")
        scratch.append(stage(rows.mapInArrow(_join_blocks(num, den), "u long, v long"), "links"))
        return scratch[-1]

    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    dealt = members.withColumn("piece", F.explode(F.when(F.col("node") == F.col("cluster"), every).otherwise(F.array("piece"))))
    links = joined(dealt.withColumn("block", F.xxhash64("cluster", "piece")))
    if members.where("pieces > 1").limit(1).count():
        label = stage(connected_components(links), "labels")
        apart = members.where("pieces > 1").join(label, "node", "left").where(F.coalesce("component", "node") != F.col("cluster"))
        groups = apart.groupBy("cluster").agg(F.ceil(F.sum("items") / block_items).cast("int").alias("groups"))
        group = F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int")
        asking = apart.join(groups, "cluster").withColumn("group", group).withColumn("piece", F.explode(every))
        asked = members.join(groups, "cluster").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        both = [t.withColumn("block", F.xxhash64("cluster", "piece", "group")) for t in (asking.select(asked.columns), asked)]
        links = links.unionByName(joined(both[0].unionByName(both[1])))
    labels = connected_components(links)

    rows = base.select("doc", "tag", "n", "node").join(labels, "node", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "node"))
    rows = stage(rows.select("doc", "tag", "n", own.alias("component")), "rows")
    discard(*scratch)
    return rows
