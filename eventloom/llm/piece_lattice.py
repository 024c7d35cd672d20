"""SentencePiece N-best encoding and decoding over the lattice of vocabulary pieces.

A text is written with ``\\u2581`` for each space and one in front, cut before words (no
piece has a space mark after another character, so no path crosses such a cut) and at
line feeds, and every part spans a lattice of vocabulary pieces.  A character that
no piece covers is spelled by byte pieces.  The best path maximises the sum of the
pieces' scores (first of equals: the shortest last piece); the next best ones come
from a backward A* search whose exact heuristic is the forward Viterbi score.  As the
heuristic is exact, every entry of the agenda stands for one whole path with exactly its
score, so the agenda never needs more than N entries.  Parts are independent, so a
text's N best paths combine its parts' best ones.

The different parts of a slice of texts are searched together, place by place; parts of more
than ``TOGETHER`` characters one by one, in time and memory linear in their length.
Nothing is kept from one slice to the next.

The vocabulary file is read by the ``sentencepiece`` library; for BPE vocabularies its own
greedy merging may cut differently than the best path of this lattice.  Decoding gives
back the text byte for byte.  A literal U+2581 in a text is spelled by its bytes.

Defined results: null and empty texts have no pieces, score 0 and one path; an empty table
gives an empty result; result columns take the place of input columns with their names.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from . import textcodes as tc

MARK = "▁"
#: Stands for a literal mark in a text: a character that no vocabulary holds.
LITERAL = "\U0010fffe"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Longer parts are searched one by one.
TOGETHER = 24
_PART = re.compile(MARK + "*[^" + MARK + "\n]+|" + MARK + "+|\n")
_LOWEST = float("-inf")


class PieceTrie:
    """The vocabulary by character, as a table of transitions: (node, character) to node."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        nodes = {"": 0}
        for piece in pieces:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        self.id, self.score = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes))
        for piece, (i, score) in pieces.items():
            self.id[nodes[piece]], self.score[nodes[piece]] = i, score
        self.bits = max(4, (4 * len(nodes)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left = [(nodes[text[:-1]] << 21 | ord(text[-1]), node) for text, node in nodes.items() if text]
        key, node = (np.array(x, np.int64) for x in zip(*left, strict=True))
        at = self._slot(key)
        while len(key):
            free = self.keys[at] < 0
            self.keys[at[free]], self.to[at[free]] = key[free], node[free]
            lost = self.keys[at] != key
            key, node, at = key[lost], node[lost], (at[lost] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node after ``char``, -1 where no piece goes on."""
        key = node.astype(np.int64) << 21 | char
        at, out = self._slot(key), np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
        return out


@dataclass
class Searched:
    """Best paths of many parts: score, ids (``flat`` between ``at``) and what the second best path falls short of it."""

    score: np.ndarray
    flat: np.ndarray
    at: np.ndarray
    gap: np.ndarray


class PieceLattice:
    """Lattice search over one SentencePiece vocabulary."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.spelling: list[bytes] = []
        self.byte_ids = [-1] * 256
        self.table: dict[str, tuple[int, float]] = {}
        lowest = 0.0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelling.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.spelling.append(b"")
            else:
                score = sp.get_score(i)
                self.table[piece] = (i, score)
                self.spelling.append(piece.replace(MARK, " ").encode())
                if score > -1e8:
                    lowest = min(lowest, score)
        if min(self.byte_ids) < 0:
            raise ValueError("the vocabulary needs a piece for every byte")
        self.longest = max(map(len, self.table))
        self.spelled = lowest - 10.0
        self.trie = PieceTrie(self.table)
        self._spell_at = np.append(0, np.cumsum([len(x) for x in self.spelling]))
        self._spell = np.frombuffer(b"".join(self.spelling), np.uint8)
        self._bytes = np.array(self.byte_ids, np.int32)

    def edges_from(self, part: str, s: int) -> list[tuple[int, int, float]]:
        """(end, id, score) of the pieces from place ``s``; id -1 spells the character by bytes."""
        found = []
        for e in range(s + 1, min(len(part), s + self.longest) + 1):
            hit = self.table.get(part[s:e])
            if hit is not None:
                found.append((e, *hit))
        if not found or found[0][0] != s + 1:
            found.insert(0, (s + 1, -1, self.spelled))
        return found

    def edges_into(self, part: str, e: int) -> list[tuple[int, int, float]]:
        """(start, id, score) of the pieces that end at place ``e``."""
        found = []
        for s in range(e - 1, max(0, e - self.longest) - 1, -1):
            hit = self.table.get(part[s:e])
            if hit is not None:
                found.append((s, *hit))
        if not found or found[0][0] != e - 1:
            found.insert(0, (e - 1, -1, self.spelled))
        return found

    def ids_of(self, part: str, path) -> list[int]:
        """Piece ids of a path of (start, id)."""
        out: list[int] = []
        for s, i in path:
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in (MARK if part[s] == LITERAL else part[s]).encode())
        return out

    def forward(self, part: str) -> tuple[array, array]:
        """The best score from the start to each place, and the length of the last piece on the way."""
        ahead, last = array("d", [0.0] + [_LOWEST] * len(part)), array("i", bytes(4 * (len(part) + 1)))
        for s in range(len(part)):
            a = ahead[s]
            for e, _, score in self.edges_from(part, s):
                if a + score >= ahead[e]:
                    ahead[e], last[e] = a + score, e - s
        return ahead, last

    def search_one(self, part: str) -> tuple[float, list[int], float]:
        """Viterbi forwards, then the best completion from each place backwards, which gives the runner-up."""
        n = len(part)
        ahead, last = self.forward(part)
        taken, path, at = array("i", bytes(4 * (n + 1))), [], n
        while at:
            s = at - last[at]
            taken[s] = last[at]
            path.append((s, self.table.get(part[s:at], (-1,))[0]))
            at = s
        behind, second = array("d", [_LOWEST] * n + [0.0]), _LOWEST
        for s in range(n - 1, -1, -1):
            for e, _, score in self.edges_from(part, s):
                score += behind[e]
                if score > behind[s]:
                    behind[s] = score
                if score + ahead[s] > second and taken[s] != e - s:
                    second = score + ahead[s]
        path.reverse()
        return ahead[n], self.ids_of(part, path), ahead[n] - second

    def search(self, parts: list[str]) -> Searched:
        """Best paths of all parts."""
        length = np.array([len(p) for p in parts], np.int64)
        short = np.flatnonzero(length <= TOGETHER)
        score, gap = np.zeros(len(parts)), np.full(len(parts), np.inf)
        pieces = np.zeros(len(parts), np.int64)
        score[short], gap[short], flat, pieces[short] = self._search_together([parts[k] for k in short], length[short])
        long = np.flatnonzero(length > TOGETHER).tolist()
        if long:
            ids = {}
            for k in long:
                score[k], ids[k], gap[k] = self.search_one(parts[k])
                pieces[k] = len(ids[k])
            at, all_ids = np.append(0, np.cumsum(pieces)), np.empty(int(pieces.sum()), np.int32)
            all_ids[np.repeat(length <= TOGETHER, pieces)] = flat
            for k in long:
                all_ids[at[k] : at[k + 1]] = ids[k]
            flat = all_ids
        return Searched(score, flat, np.append(0, np.cumsum(pieces)), gap)

    def _search_together(self, parts: list[str], length: np.ndarray):
        """The same as :meth:`search_one` for many parts, place by place."""
        count = len(parts)
        if not count:
            return np.zeros(0), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64)
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        own = np.repeat(np.arange(count), length)
        first = np.cumsum(length) - length
        place = np.arange(len(chars)) + own  # a part of n characters has n + 1 places
        stop = (first + length)[own]
        at, node, depth, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0, []
        single = np.zeros(len(chars), bool)
        while len(at):
            node = self.trie.step(node, chars[at + depth])
            at, node = at[node >= 0], node[node >= 0]
            depth += 1
            hit = self.trie.id[node] >= 0
            if depth == 1:
                single[at[hit]] = True
            found.append((at[hit], np.full(int(hit.sum()), depth), self.trie.id[node[hit]], self.trie.score[node[hit]]))
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        lone = np.flatnonzero(~single)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1, np.int32), np.full(len(lone), self.spelled)))
        start, size, piece, score = (np.concatenate(x) for x in zip(*found, strict=True))
        step = start - first[own[start]]
        order = np.argsort(step.astype(np.int16), kind="stable")
        start, size, piece, score, step = start[order], size[order], piece[order], score[order], step[order]
        cut = np.searchsorted(step, np.arange(int(length.max(initial=0)) + 1))
        a, e, of = place[start], place[start] + size, own[start]

        places = len(chars) + count
        ahead, back = np.full(places, _LOWEST), np.zeros(places, np.int64)
        begin = first + np.arange(count)
        ahead[begin] = 0.0
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            value = ahead[a[i:j]] + score[i:j]
            better = np.flatnonzero(value >= ahead[e[i:j]])
            ahead[e[i:j][better]], back[e[i:j][better]] = value[better], better + i
        end = begin + length
        now, live, steps, taken = end.copy(), np.flatnonzero(length > 0), [], np.zeros(len(a), bool)
        while len(live):
            edge = back[now[live]]
            steps.append((live, edge))
            taken[edge] = True
            now[live] = a[edge]
            live = live[now[live] > begin[live]]
        behind = np.full(places, _LOWEST)
        behind[end] = 0.0
        second = np.full(count, _LOWEST)
        for i, j in zip(cut[-2::-1], cut[:0:-1], strict=True):
            value = score[i:j] + behind[e[i:j]]
            np.maximum.at(behind, a[i:j], value)
            other = ~taken[i:j]
            np.maximum.at(second, of[i:j][other], value[other] + ahead[a[i:j][other]])
        top = ahead[end]

        who = np.concatenate([x[0] for x in steps]) if steps else np.zeros(0, np.int64)
        edge = np.concatenate([x[1] for x in steps]) if steps else np.zeros(0, np.int64)
        order = np.lexsort((a[edge], who))
        who, edge = who[order], edge[order]
        ids, spelled = piece[edge], np.flatnonzero(piece[edge] < 0)
        many = np.ones(len(edge), np.int64)
        texts = [(MARK if c == LITERAL else c).encode() for c in map(chr, chars[start[edge[spelled]]].tolist())]
        many[spelled] = [len(t) for t in texts]
        flat = np.repeat(ids, many)
        flat[np.repeat(ids < 0, many)] = self._bytes[np.frombuffer(b"".join(texts), np.uint8)]
        return top, top - second, flat.astype(np.int32), np.bincount(who, many, count).astype(np.int64)

    def paths(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best paths, best first, by backward A* from the end of the part."""
        ahead, _ = self.forward(part)
        # (minus the path's score, place, score behind it, path behind it); of equals the newest goes on
        agenda, out = [(-ahead[-1], len(part), 0.0, ())], []
        while agenda and len(out) < n:
            _, at, done, path = agenda.pop(0)
            if not at:
                out.append((done, self.ids_of(part, _unlink(path))))
                continue
            for s, i, score in self.edges_into(part, at):
                whole = -(ahead[s] + score + done)
                bisect.insort_left(agenda, (whole, s, done + score, ((s, i), path)), key=lambda x: x[0])
                del agenda[n - len(out) :]
        return out

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, LITERAL)
        return _PART.findall(MARK + text.replace(" ", MARK))

    def encode(self, text: str, n: int = 1) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a text as (score, ids), best first."""
        return self.encode_all([text], n)[0]

    def encode_all(self, texts: list[str], n: int) -> list[list[tuple[float, np.ndarray]]]:
        """The ``n`` best segmentations of each text."""
        split = [self.parts(t) for t in texts]
        number: dict[str, int] = {}
        codes = np.array([number.setdefault(p, len(number)) for parts in split for p in parts], np.int64)
        different = list(number)
        found = self.search(different)
        size = np.diff(found.at)[codes]
        flat, piece_at = tc.gather(found.flat, found.at[codes], size)
        first = np.append(0, np.cumsum([len(p) for p in split]))
        several = functools.lru_cache(4096)(lambda code: self.paths(different[code], n))
        out = []
        for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            mine = codes[low:high]
            total = float(np.cumsum(found.score[mine])[-1]) if len(mine) else 0.0
            base = piece_at[low]
            ids = flat[base : piece_at[high]]
            each = [(total, ids)]
            for score, changed in self._alternatives(found, mine, total, n, several):
                parts, done = [], 0
                for k, other in sorted(changed.items()):
                    parts += [ids[done : piece_at[low + k] - base], np.array(other, np.int32)]
                    done = piece_at[low + k + 1] - base
                each.append((score, np.concatenate([*parts, ids[done:]])))
            out.append(each)
        return out

    def _alternatives(self, found: Searched, codes: np.ndarray, total: float, n: int, several) -> list[tuple[float, dict[int, list[int]]]]:
        """Scores of the second to ``n``-th best paths of a text and the parts they change.

        Only the n - 1 parts whose second best paths fall least short can be changed.
        """
        if n < 2 or not len(codes):
            return []
        lists = []
        choice = _smallest(found.gap[codes], n - 1)
        for code in codes[choice].tolist():
            best = found.flat[found.at[code] : found.at[code + 1]].tolist()
            # among equals the Viterbi path comes first
            lists.append([(float(found.score[code]), best), *(p for p in several(code) if p[1] != best)][:n])
        out, seen, agenda = [], {(0,) * len(lists)}, [(0.0, (0,) * len(lists))]
        while agenda and len(out) < n:
            loss, ranks = agenda.pop(0)
            out.append((total - loss, {int(k): paths[r][1] for k, paths, r in zip(choice, lists, ranks, strict=True) if r}))
            for k, paths in enumerate(lists):
                if ranks[k] + 1 < len(paths):
                    after = ranks[:k] + (ranks[k] + 1,) + ranks[k + 1 :]
                    if after not in seen:
                        seen.add(after)
                        bisect.insort(agenda, (loss + paths[ranks[k]][0] - paths[ranks[k] + 1][0], after))
        return out[1:]

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids) -> bytes:
        """The text's bytes: pieces spelled out, without the mark in front."""
        ids = np.asarray(ids, np.int64)
        return tc.gather(self._spell, self._spell_at[ids], np.diff(self._spell_at)[ids])[0].tobytes()[1:]


def _unlink(path) -> list[tuple[int, int]]:
    out = []
    while path:
        step, path = path
        out.append(step)
    return out


def _smallest(values: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n smallest values, ties by index, smallest first."""
    if len(values) <= n:
        return np.argsort(values, kind="stable")
    few = np.flatnonzero(values <= np.partition(values, n - 1)[n - 1])
    return few[np.argsort(values[few], kind="stable")][:n]


@functools.lru_cache(2)
def lattice(model_file: str) -> PieceLattice:
    return PieceLattice(model_file)


def encode_texts(docs: DataFrame, text_col: str = "text", model_file: str = DEFAULT_MODEL, n: int = 3, keep_columns: list[str] | None = None) -> DataFrame:
    """``keep_columns`` (default: all) with ids (best path), score, nbest_ids, nbest_scores and round_trip.

    ``nbest_ids`` has the ids of the ``n`` best paths, best first, as ``nbest_scores`` has their scores.
    ``round_trip`` tells that decoding ids gives the text's bytes.  The vocabulary file must
    be at ``model_file`` on every executor.
    """
    if not os.path.basename(model_file):
        raise ValueError("model_file names no file")
    own = ["ids", "score", "nbest_ids", "nbest_scores", "round_trip"]
    keep = [c for c in keep_columns or docs.columns if c not in own]
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).cast("string").alias("text"))

    @tc.tidy
    def run(batches):
        search = lattice(model_file)
        for batch in batches:
            for part in tc.slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = search.encode_all(texts, n)
                best = [paths[0][1] for paths in found]
                every = [ids for paths in found for _, ids in paths]
                scores = pa.array([paths[0][0] for paths in found], pa.float64())
                nbest = pa.array([[x for x, _ in paths] for paths in found], pa.list_(pa.float64()))
                at = pa.array(np.append(0, np.cumsum([len(paths) for paths in found])).astype(np.int32))
                same = pa.array([search.decode_bytes(ids) == t.encode() for ids, t in zip(best, texts, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("_row"), _lists(best), scores, pa.ListArray.from_arrays(at, _lists(every)), nbest, same], names=["_row", *own])

    schema = rows.select("_row").schema.add("ids", ArrayType(IntegerType())).add("score", "double").add("nbest_ids", ArrayType(ArrayType(IntegerType()))).add("nbest_scores", ArrayType(DoubleType())).add("round_trip", "boolean")
    return rows.mapInArrow(run, schema).select("_row.*", *own)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    at = np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def decode_ids(encoded: DataFrame, ids_col: str = "ids", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """Add ``decoded``: the text that the ids spell."""
    keep = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(F.struct(*keep).alias("_row"), F.coalesce(ids_col, F.expr("array()")).cast("array<int>").alias("ids"))

    @tc.tidy
    def run(batches):
        search = lattice(model_file)
        for batch in batches:
            texts = [search.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "decoded"])

    return rows.mapInArrow(run, rows.select("_row").schema.add("decoded", "string")).select("_row.*", "decoded")
