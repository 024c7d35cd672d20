"""Token ids of texts by the ``tokenizers`` library, a slice of texts at a time.

A byte-level tokenizer cuts a text into pre-tokens before it merges, and some of these cuts can be
told from the bytes alone: none of its pre-tokens goes on from a character that is no white space into
white space, nor from a letter or digit into punctuation, and what follows such a cut doesn't depend on what is before it.
So texts are cut there, equal chunks are encoded once by the library (a worker remembers a bounded number of them),
and ids are put together from the chunks'.  Where a tokenizer is of another kind, whole texts are encoded.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Callable

import numpy as np

from . import textcodes as tc

#: Texts and pieces of long texts are encoded in slices of about this many bytes.
SLICE_BYTES = 1 << 23
#: Distinct chunks that the library gets at once, and that a worker remembers (about 40 bytes each).
TOGETHER, REMEMBERED = 1 << 14, 1 << 20

_WHITE = tc.SPACE
#: Bytes after which a cut is sure: ASCII other than white space and the separators 1C to 1F, which count as white space too.
_SOLID = np.zeros(256, bool)
_SOLID[:128] = ~_WHITE[:128]
_SOLID[0x1C:0x20] = False
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[0x21:0x7F] = ~_WORD[0x21:0x7F]


def chunk_starts(buf: np.ndarray, offs: np.ndarray, joined: frozenset[bytes] = frozenset()) -> np.ndarray:
    """Starts of the chunks, every text's start among them; a chunk ends where the next one starts.

    Pairs of bytes in ``joined`` (those inside added tokens) are never cut.
    """
    before = np.zeros(len(buf), bool)
    before[1:] = _SOLID[buf[:-1]]
    # two-byte characters from U+00C0 on are no white space
    before[2:] |= (buf[:-2] >= 0xC3) & (buf[:-2] <= 0xDF) & ((buf[1:-1] & 0xC0) == 0x80)
    cut = before & _WHITE[buf]
    cut[1:] |= _WORD[buf[:-1]] & _PUNCTUATION[buf[1:]]
    for pair in joined:
        cut[1:] &= (buf[:-1] != pair[0]) | (buf[1:] != pair[1])
    cut[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """A tokenizer file with what is known about it."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        about = json.loads(self.library.to_str())
        pre, added = about.get("pre_tokenizer") or {}, about.get("added_tokens") or []
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
        self.chunked = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not about.get("normalizer") and not about.get("truncation") and plain
        pairs = {c[k : k + 2] for c in (t["content"].encode() for t in added) for k in range(len(c) - 1)}
        self.joined = frozenset(p for p in pairs if _WORD[p[0]] and _PUNCTUATION[p[1]])
        self._forget()
        self.dtype = np.uint16 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32

    def _forget(self) -> None:
        """Remember no chunk: their hashes (ascending by the first), where their ids stand in ``flat``, and how many."""
        self.first = self.second = np.zeros(0, np.uint64)
        self.at = self.many = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _known(self, first: np.ndarray, second: np.ndarray, texts: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of chunks stand in ``flat``, and how many; ``texts`` gives the chunks that must be encoded. ``first`` ascends."""
        if len(self.first) + len(first) > REMEMBERED:
            self._forget()
        at, many = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        place = np.minimum(np.searchsorted(self.first, first), max(0, len(self.first) - 1))
        old = (self.first[place] == first) & (self.second[place] == second) if len(self.first) else np.zeros(len(first), bool)
        at[old], many[old] = self.at[place[old]], self.many[place[old]]
        new = np.flatnonzero(~old)
        flat, counts = self._ids(texts(new))
        at[new], many[new] = len(self.flat) + np.cumsum(counts) - counts, counts
        self.flat = np.append(self.flat, flat).astype(self.dtype)
        to = np.searchsorted(self.first, first[new])
        self.first, self.second, self.at, self.many = (np.insert(x, to, y) for x, y in ((self.first, first[new]), (self.second, second[new]), (self.at, at[new]), (self.many, many[new])))
        return at, many

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each."""
        ids, counts = [], []
        for k in range(0, len(texts), TOGETHER):
            found = [e.ids for e in self.library.encode_batch_fast(texts[k : k + TOGETHER], add_special_tokens=False)]
            counts += map(len, found)
            ids.append(np.fromiter(itertools.chain.from_iterable(found), self.dtype))
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.array(counts, np.int64)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice one after another, and the number of each."""
        data, count = buf.tobytes(), len(offs) - 1
        if not self.chunked:
            return self._ids([data[a:b].decode() for a, b in itertools.pairwise(offs.tolist())])
        starts = chunk_starts(buf, offs, self.joined)
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        out, counts = [], np.zeros(count, np.int64)
        # pieces of about SLICE_BYTES, so that one long text needs no more than many short ones
        border = np.searchsorted(starts, np.arange(0, len(buf) + SLICE_BYTES, SLICE_BYTES)) if len(buf) else np.zeros(1, np.int64)
        for i, j in itertools.pairwise(np.unique(np.append(border, len(starts)))):
            a, e = starts[i:j], ends[i:j]
            first, second = tc.span_hashes(buf, a, e), tc.span_hashes(buf, a, e, True)
            order = np.argsort(first, kind="stable")
            new = np.append(True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0))
            which = np.empty(j - i, np.int64)
            which[order] = np.cumsum(new) - 1
            sample = order[new]
            at, many = self._known(first[sample], second[sample], lambda k: [data[x:y].decode() for x, y in zip(a[sample[k]].tolist(), e[sample[k]].tolist(), strict=True)])
            ids, _ = tc.gather(self.flat, at[which], many[which])
            out.append(ids)
            np.add.at(counts, np.searchsorted(offs, a, "right") - 1, many[which])
        return np.concatenate([np.zeros(0, self.dtype), *out]), counts


@functools.lru_cache(1)
def encoder(file: str) -> Encoder:
    return Encoder(file)
