"""Ranked lexical search over posting lists that are blocked by document similarity.

A document is a sparse vector of integer impacts, one for each of its terms; its score for an item is the sum over
the item's terms (repeats included) of weight times impact.  The index covers every document and the terms of
one block of items.  Documents lie in the order of a similarity code (signs of random projections of
their vectors), so that neighbours are alike, and are dealt along that order to shards.  In a shard every
term's posting list is cut along the order into blocks, and a block keeps the coordinatewise maximum of its documents'
vectors as its summary.  The product of an item with a summary bounds the score of every document in the block.

Terms are numbered from rare to frequent.  A document is looked for in the list of the rarest term that it
shares with an item, so a block's summary needs only the coordinates from its own term on, and the
suffix sums of the shard's maxima bound whole lists.  A list or block is skipped only if its bound is below the score of
the k-th document found so far; nothing is pruned otherwise, so the result is exact.  The first
pass scores the most promising block of each item's rarest list in every shard, which gives the second pass its thresholds.

Items are taken in blocks of about ``block_terms`` terms, whose terms and weights every task gets; each block
of items is one pass over the documents.

Defined results: null texts have no terms and are neither counted nor found; items without terms have no rows; items
equal in id and text count once, and different texts of one id are ranked apart; null document ids come
last among equal scores; rows that repeat an id are ranked each; empty tables give an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcodes as tc
from .staging import discard, stage

LAST_ID = (1 << 63) - 1
#: Bytes that end a term: ASCII other than digits and letters.
NO_TERM = np.zeros(256, bool)
NO_TERM[:128] = True
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

CODE_BITS = 24
BLOCK_DOCS = 64
#: A shard ends with the document that brings it to one of these.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 16
SHARDS_A_PART = 4
#: Entries that are sorted at once when summaries are made.
TOGETHER = 1 << 22
VECTORS = "doc long, n long, terms array<int>, tf array<int>"
POINTS = "code int, doc long, terms array<int>, impacts array<int>"
#: Arrays of 32-bit (docs: 64-bit) numbers as bytes: a shard is one row, and readers hold plain bytes better than nested numbers.
ARRAYS = ("docs", "row_at", "terms", "impacts", "block_term", "block_at", "members", "summary_at", "summary_terms", "summary_max")
SHARDS = ", ".join(f"{c} binary" for c in ARRAYS)
FOUND = "item int, doc long, score long"


def _lists(at: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


def _term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, bounds of all terms, their hashes and each text's first term."""
    buf, offs = tc.text_buffers(column)
    buf = _LOWER[buf]
    a, e, first = tc.word_bounds(buf, offs, NO_TERM)
    return buf, a, e, tc.span_hashes(buf, a, e), first


def _item_terms(batches):
    """For mapInArrow over (id, text): the terms of each text as two hashes, in order and with repeats."""
    for batch in batches:
        buf, a, e, h, first = _term_hashes(batch.column("text"))
        second = tc.span_hashes(buf, a, e, True)
        yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(first, h.view(np.int64)), _lists(first, second.view(np.int64))], names=["id", "h", "g"])


def _vectors(vocabulary):
    """For mapInArrow over (doc, text): number of terms, and term numbers of the vocabulary with their counts."""

    @tc.tidy
    def run(batches):
        known, second = vocabulary.value
        for batch in batches:
            for part in tc.slices(batch, "text"):
                buf, a, e, h, first = _term_hashes(part.column("text"))
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                hit = hit[second[at[hit]] == tc.span_hashes(buf, a[hit], e[hit], True)]
                own, n = tc.owners(first, len(a))[hit], np.diff(first)
                keys, tf = np.unique(own * len(known) + at[hit], return_counts=True)
                row, term = keys // len(known), (keys % len(known)).astype(np.int32)
                ends = np.searchsorted(row, np.arange(len(n) + 1))
                rows = pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n), _lists(ends, term), _lists(ends, tf.astype(np.int32))], names=["doc", "n", "terms", "tf"])
                yield rows.filter(pa.array(n > 0))

    return run


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L; in whole numbers throughout."""
    tf, n = tf.astype(np.int64), n.astype(np.int64)
    if int(n.max(initial=0)) * 75 * documents >= 1 << 63:
        m = np.array([25 + 75 * k * documents // length for k in n.tolist()], np.int64)
    else:
        m = 25 + 75 * n * documents // length
    return 10**9 * tf // (1000 * tf + 8 * m)


def _points(ranks, documents: int, length: int, seed: int = 20240607):
    """For mapInArrow over vectors: the similarity code and the impacts by rank; vectors without a term that weighs go."""

    @tc.tidy
    def run(batches):
        rank, weight = ranks.value
        signs = np.random.default_rng(seed).integers(0, 2, (len(weight), CODE_BITS)) * 2.0 - 1.0
        for batch in batches:
            terms, count = batch.column("terms"), np.diff(batch.column("terms").offsets.to_numpy())
            row = np.repeat(np.arange(len(count)), count)
            x = impact(batch.column("tf").flatten().to_numpy(), batch.column("n").to_numpy()[row], documents, length)
            term = rank[terms.flatten().to_numpy()].astype(np.int64)
            use = np.flatnonzero((term >= 0) & (x > 0))
            use = use[np.argsort(row[use] * len(weight) + term[use])]
            row, term, x = row[use], term[use], x[use]
            rows, at = np.unique(row, return_index=True)
            if not len(rows):
                continue
            code = np.zeros(len(rows), np.int64)
            for k in range(CODE_BITS):  # one projection at a time: memory of one number a posting
                code = code << 1 | (np.add.reduceat(x * weight[term] * signs[term, k], at) > 0)
            ends = np.append(at, len(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(code.astype(np.int32)), batch.column("doc").take(pa.array(rows)), _lists(ends, term.astype(np.int32)), _lists(ends, x.astype(np.int32))],
                names=["code", "doc", "terms", "impacts"],
            )

    return run


def make_blocks(row_at: np.ndarray, terms: np.ndarray, impacts: np.ndarray, block_docs: int = BLOCK_DOCS) -> dict[str, np.ndarray]:
    """Posting lists of one shard, cut into blocks of neighbours, with their summaries.

    ``terms`` ascend within a row.  A summary has, for each term from the block's own on that one of its documents
    has, the largest impact.
    """
    row = np.repeat(np.arange(len(row_at) - 1), np.diff(row_at))
    by_term = np.argsort(terms, kind="stable")  # rows stay in their order
    term = terms[by_term].astype(np.int64)
    fresh = np.append(True, term[1:] != term[:-1])
    place = np.arange(len(term)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    new = fresh | (place % block_docs == 0)
    block, block_at = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(term))
    rest = row_at[1:][row[by_term]] - by_term  # entries from this posting to its row's end
    ends = np.cumsum(rest)
    at, found, width = 0, [], int(terms.max()) + 1
    while at < len(term):  # whole blocks, about TOGETHER entries at once
        to = np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")
        to = max(block_at[np.searchsorted(block_at, to, "right") - 1], block_at[block[at] + 1])
        entry = _ranges(by_term[at:to], rest[at:to])
        # block (less the first one here), term and impact (below 2**20) in one number, so that one plain sort does
        packed = np.sort((np.repeat(block[at:to] - block[at], rest[at:to]) * width + terms[entry]) << 20 | impacts[entry])
        packed = packed[np.append(packed[1:] >> 20 != packed[:-1] >> 20, True)]
        found.append((packed // (width << 20) + block[at], (packed >> 20) % width, packed & 0xFFFFF))
        at = to
    blocks, summary_terms, summary_max = (np.concatenate(x) for x in zip(*found, strict=True))
    return {
        "block_term": term[block_at[:-1]], "block_at": block_at, "members": row[by_term],
        "summary_at": np.searchsorted(blocks, np.arange(len(block_at))), "summary_terms": summary_terms, "summary_max": summary_max,
    }


def _shards(shard_docs: int, block_docs: int):
    """For mapInArrow over points in the order of their code: a row for each shard."""

    @tc.tidy
    def run(batches):
        waiting: list[pa.RecordBatch] = []
        docs = postings = 0

        def shard():
            table = pa.Table.from_batches(waiting).combine_chunks()
            terms = table.column("terms").combine_chunks()
            at = terms.offsets.to_numpy().astype(np.int64)
            arrays = {"docs": table.column("doc").fill_null(LAST_ID).to_numpy(), "row_at": at - at[0], "terms": terms.flatten().to_numpy(), "impacts": table.column("impacts").combine_chunks().flatten().to_numpy()}
            arrays |= make_blocks(arrays["row_at"], arrays["terms"], arrays["impacts"].astype(np.int64), block_docs)
            columns = [pa.array([(arrays[c] if c == "docs" else arrays[c].astype(np.int32)).tobytes()], pa.binary()) for c in ARRAYS]
            return pa.RecordBatch.from_arrays(columns, names=list(ARRAYS))

        for batch in batches:
            sizes = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                room = np.searchsorted(sizes, before + SHARD_POSTINGS - postings) + 1 - at  # with the row that fills it
                n = int(min(batch.num_rows - at, shard_docs - docs, max(1, room)))
                waiting.append(batch.slice(at, n).select(["doc", "terms", "impacts"]))
                docs, postings, at = docs + n, postings + int(sizes[at + n - 1] - before), at + n
                if docs >= shard_docs or postings >= SHARD_POSTINGS:
                    yield shard()
                    waiting, docs, postings = [], 0, 0
        if waiting:
            yield shard()

    return run


class Shard:
    """One shard's lists, read from its row."""

    def __init__(self, row: dict[str, np.ndarray]):
        self.__dict__ |= row
        self.list_at = np.searchsorted(self.block_term, np.arange(int(self.block_term[-1]) + 2))
        self.largest = np.zeros(len(self.list_at) - 1, np.int64)
        np.maximum.at(self.largest, self.terms, self.impacts)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        entry = _ranges(self.row_at[docs], self.row_at[docs + 1] - self.row_at[docs])
        size = self.row_at[docs + 1] - self.row_at[docs]
        return np.add.reduceat(weight[self.terms[entry]] * self.impacts[entry], np.cumsum(size) - size)

    def bounds(self, low: int, high: int, weight: np.ndarray) -> np.ndarray:
        """Bounds of the blocks low to high - 1."""
        a, b = self.summary_at[low], self.summary_at[high]
        return np.add.reduceat(weight[self.summary_terms[a:b]] * self.summary_max[a:b], self.summary_at[low:high] - a)

    def documents(self, blocks: np.ndarray) -> np.ndarray:
        entry = _ranges(self.block_at[blocks], self.block_at[blocks + 1] - self.block_at[blocks])
        return np.unique(self.members[entry])


class Best:
    """The k best (score, document) so far; equal scores by the smaller document."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, max(1, threshold)
        self.score = self.doc = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        use = score >= self.threshold
        score, doc = np.append(self.score, score[use]), np.append(self.doc, doc[use])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]
        if len(order) == self.k:
            self.threshold = max(self.threshold, int(self.score[-1]))


def search_shard(shard: Shard, item: tuple[np.ndarray, np.ndarray], weight: np.ndarray, best: Best, first_only: bool = False) -> int:
    """Add the shard's documents that may be among the item's best; returns how many were scored.

    ``item`` has ascending terms and their weights with repeats; ``weight`` is a zero vector over all terms, and so again after.
    """
    terms, own = item
    known = terms < len(shard.largest)
    terms, own = terms[known], own[known]
    within = shard.largest[terms] > 0
    terms, own = terms[within], own[within]
    suffix = np.cumsum((own * shard.largest[terms])[::-1])[::-1]
    lists = terms[suffix >= best.threshold]  # the rest can't reach the threshold without the rarer ones
    if not len(lists):
        return 0
    weight[terms] = own
    spans = [(int(shard.list_at[t]), int(shard.list_at[t + 1])) for t in (lists[:1] if first_only else lists)]
    bound = np.concatenate([shard.bounds(low, high, weight) for low, high in spans])
    blocks = np.concatenate([np.arange(low, high) for low, high in spans])
    order = np.argsort(-bound, kind="stable")
    bound, blocks = bound[order], blocks[order]
    seen = np.zeros(len(shard.docs), bool)
    at, step = 0, 1
    while at < len(blocks) and bound[at] >= best.threshold:
        to = min(at + step, int(np.searchsorted(-bound, -best.threshold, "right")))
        docs = shard.documents(blocks[at:to])
        docs = docs[~seen[docs]]
        seen[docs] = True
        if len(docs):
            best.add(shard.scores(docs, weight), shard.docs[docs])
        if first_only:
            break
        at, step = to, step * 4
    weight[terms] = 0
    return int(seen.sum())


def _search(items, k: int, first_only: bool):
    """For mapInArrow over shards: the best documents of each item in the partition."""

    @tc.tidy
    def run(batches):
        asked, size, thresholds = items.value
        best = [Best(k, t) for t in thresholds]
        weight = np.zeros(size, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard({c: np.frombuffer(batch.column(c)[r].as_buffer(), np.int64 if c == "docs" else np.int32).astype(np.int64) for c in ARRAYS})
                for item, found in zip(asked, best, strict=True):
                    search_shard(shard, item, weight, found, first_only)
        number = np.repeat(np.arange(len(best)), [len(b.doc) for b in best])
        columns = [number.astype(np.int32), *(np.concatenate([np.zeros(0, np.int64), *(getattr(b, c) for b in best)]) for c in ("doc", "score"))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "doc", "score"])

    return run


@dataclass
class RankedIndex:
    """Shards of all documents over a vocabulary; ``rank`` gives each vocabulary term its number from rare to frequent, -1 if it weighs nothing."""

    shards: DataFrame
    rank: np.ndarray
    weight: np.ndarray
    documents: int
    length: int


def build_index(docs: DataFrame, vocabulary: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, block_docs: int = BLOCK_DOCS) -> RankedIndex:
    """Index every document over ``vocabulary``: ascending hashes of terms, and their second hashes."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    vectors = stage(texts.mapInArrow(_vectors(known), VECTORS), "vectors")
    documents, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary[0]), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most one row for each term of the vocabulary
        df[r.term] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * f + 1))) if f else 0 for f in df.tolist()], np.int64)
    order = np.argsort(df, kind="stable")
    order = order[weight[order] > 0]
    rank = np.full(len(df), -1, np.int32)
    rank[order] = np.arange(len(order))
    ranks = spark.sparkContext.broadcast((rank, weight[order]))
    points = vectors.where(F.size("terms") > 0).mapInArrow(_points(ranks, documents, length), POINTS)
    # a few shards a partition: their rows are large
    rows, postings = vectors.where(F.size("terms") > 0).agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    parts = max(1, -(-rows // (SHARDS_A_PART * shard_docs)), -(-postings // (SHARDS_A_PART * SHARD_POSTINGS)))
    points = points.repartitionByRange(parts, "code", "doc").sortWithinPartitions("code", "doc")
    shards = stage(points.mapInArrow(_shards(shard_docs, block_docs), SHARDS), "shards")
    discard(vectors)
    return RankedIndex(shards, rank, weight[order], documents, length)


def search(index: RankedIndex, asked: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """item (place in ``asked``), doc, score and rank of each item's ``k`` best documents.

    An item has ascending terms, as the index numbers them, and how often it has each.
    """
    spark = index.shards.sparkSession
    items = [(terms, count * index.weight[terms]) for terms, count in asked]
    size = len(index.weight) + 1
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc")

    def found(thresholds: list[int], first_only: bool) -> DataFrame:
        known = spark.sparkContext.broadcast((items, size, thresholds))
        rows = index.shards.mapInArrow(_search(known, k, first_only), FOUND)
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    thresholds = [0] * len(items)
    for r in found(thresholds, True).where(F.col("rank") == k).collect():  # at most one row for each item of the block
        thresholds[r["item"]] = r["score"]
    return found(thresholds, False)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = 1 << 16, shard_docs: int = SHARD_DOCS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``item_col``, rank, ``id_col`` and score of each item's ``k`` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    rows = items.select(F.col(item_col).alias("id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")).distinct()
    id_type = rows.schema["id"].dataType.simpleString()
    terms = stage(rows.mapInArrow(tc.tidy(_item_terms), f"id {id_type}, h array<long>, g array<long>").where(F.size("h") > 0), "items")
    total = terms.agg(F.coalesce(F.sum(F.size(F.array_distinct("h"))), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_terms)) if total > block_terms else 1
    out = []
    for number in range(blocks):
        asked = terms.where(F.pmod(F.xxhash64("id", "h"), F.lit(blocks)) == number).collect()  # about block_terms / 2 terms
        if not asked:
            continue
        pairs = sorted({p for r in asked for p in zip(np.array(r.h, np.int64).view(np.uint64).tolist(), np.array(r.g, np.int64).view(np.uint64).tolist(), strict=True)})
        known = np.array([p[0] for p in pairs], np.uint64)
        index = build_index(docs, (known, np.array([p[1] for p in pairs], np.uint64)), id_col, text_col, shard_docs, block_docs)
        wanted = []
        for r in asked:
            number_of = index.rank[np.searchsorted(known, np.array(r.h, np.int64).view(np.uint64))]
            wanted.append(tuple(x.astype(np.int64) for x in np.unique(number_of[number_of >= 0], return_counts=True)))
        ids = spark.createDataFrame([(k, r["id"]) for k, r in enumerate(asked)], f"item int, {item_col} {id_type}")
        out.append(search(index, wanted, k).join(F.broadcast(ids), "item"))
    if not out:
        ids = spark.createDataFrame([], f"{item_col} {id_type}")
        return ids.select(item_col, F.lit(0).alias("rank"), F.lit(0).cast("long").alias(id_col), F.lit(0).cast("long").alias("score"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.select(item_col, "rank", F.when(F.col("doc") != LAST_ID, F.col("doc")).alias(id_col), "score")
