"""Window fingerprints: anchored runs of windows.

A text has one window for each start of ``window`` consecutive items (words or
bytes).  The anchor of a window is the leftmost smallest hash of the ``gram``-item
grams in it (winnowing), so equal windows have equal anchors at equal offsets.
Consecutive windows with one anchor form a *run*:

* ``f``    hash of the anchor gram,
* ``d``    digest of all items that the run's windows cover (and of its length),
* ``at``   first window's start and, in the lower half, the number of windows (byte runs:
  the anchor's offset in the upper 16 bits of that half),
* ``hs``   (rows of the word index) a hash of each window (8 bytes), independent of ``f``.

Runs with one ``f`` and ``d`` hold the same windows, so most repeats are settled by one
row for several windows.  Long texts are cut into pieces; a run that a piece's
border cuts in two is two runs, whose windows are then compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textcodes as tc

RUN_SCHEMA = "f long, d long, doc long, tag long, at long"
INDEX_SCHEMA = "f long, d long, doc long, hi long, hs binary"
ANCHOR_SHIFT = 16
PIECE_WORDS = 1 << 17
PIECE_BYTES = 1 << 19


def runs_of(grams: np.ndarray, prefix: np.ndarray, down: np.ndarray, ok: np.ndarray, window: int, gram: int):
    """Starts, counts, anchors' indices and digests of all runs of one piece; ``ok`` marks the windows' starts."""
    starts = np.flatnonzero(ok)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    anchor = tc.leftmost_minima(grams, window - gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    at, count = starts[first], np.diff(np.append(first, len(starts)))
    digest = tc.mix((prefix[at + count + window - 1] - prefix[at]) * down[at] + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # the anchor's offset within the run is part of what two equal runs share
    digest = tc.mix(digest ^ tc.mix((anchor[first] - at).astype(np.uint64) + np.uint64(window)))
    return at, count, anchor[first], digest


def prefix_sums(items: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = tc.powers(base, len(items) + 1)
    c = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * up[: len(items)], out=c[1:])
    return c, down


def pieces(first: np.ndarray, count: int, limit: int, window: int):
    """(low, high, bounds of texts): one piece for a usual slice, overlapping pieces of a slice that is one long text."""
    if count <= 2 * limit:
        if count >= window:
            yield 0, count, first
        return
    for low in range(0, count - window + 1, limit):
        high = min(count, low + limit + window - 1)
        yield low, high, np.array([0, high - low])


def word_runs(window: int, gram: int, windows: bool = False):
    """For mapInArrow over (doc, tag, text): a row for each run of word windows.

    Anchors and digests come from independent hashes of the words.  With ``windows`` the
    rows have ``hs``, and of a slice's equal runs the one of the smallest document is enough.
    """

    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "text"):
                buf, offs = tc.text_buffers(part.column("text"))
                a, e, first = tc.word_bounds(buf, offs)
                words, others = tc.span_hashes(buf, a, e), tc.span_hashes(buf, a, e, True)
                for low, high, bounds in pieces(first, len(a), PIECE_WORDS, window):
                    prefix, down = prefix_sums(others[low:high], tc.BASE_WORD2)
                    grams, ok = tc.gram_hashes(words[low:high], gram), tc.inside(bounds, high - low, window)
                    at, count, anchor, digest = runs_of(grams, prefix, down, ok, window, gram)
                    own = tc.owners(bounds, high - low)[at]
                    columns, names = _columns(part, own, at - bounds[own] + low, count, grams[anchor], digest)
                    if not windows:
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        continue
                    f, d, doc = (c.to_numpy() for c in columns[:3])
                    order = np.lexsort((doc, d, f))
                    new = np.flatnonzero(np.append(True, (f[order][1:] != f[order][:-1]) | (d[order][1:] != d[order][:-1]))) if len(f) else order
                    hi = doc[order][np.append(new[1:], len(order)) - 1] if len(f) else doc
                    use = order[new]
                    values = tc.gram_hashes(others[low:high], window, True)[np.flatnonzero(ok)]
                    begin = np.cumsum(count) - count
                    taken, ends = tc.gather(values, begin[use], count[use])
                    hs = pa.Array.from_buffers(pa.binary(), len(use), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(taken)])
                    yield pa.RecordBatch.from_arrays([pa.array(f[use]), pa.array(d[use]), pa.array(doc[use]), pa.array(hi), hs], names=["f", "d", "doc", "hi", "hs"])

    return run


def single_windows(batches):
    """For mapInArrow over (f, d, doc, new, hs): a row for each window."""
    for batch in batches:
        hs = batch.column("hs")
        offs = np.frombuffer(hs.buffers()[1], np.int32, len(hs) + 1, hs.offset * 4).astype(np.int64)
        h = np.frombuffer(hs.buffers()[2], np.uint8)[offs[0] : offs[-1]].copy().view(np.int64) if offs[-1] > offs[0] else np.zeros(0, np.int64)
        count = np.diff(offs) // 8
        row = np.repeat(np.arange(len(hs)), count)
        off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        same = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[row]) for c in ("f", "d", "doc", "new")]
        yield pa.RecordBatch.from_arrays([*same, pa.array(off.astype(np.int32)), pa.array(h)], names=["f", "d", "doc", "new", "off", "h"])


def byte_runs(window: int, gram: int):
    """For mapInArrow over (doc, tag, text): a row for each run of byte windows."""

    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "text", PIECE_BYTES):
                buf, offs = tc.text_buffers(part.column("text"))
                for low, high, bounds in pieces(offs, len(buf), PIECE_BYTES, window):
                    prefix, down = prefix_sums(tc._TABLE[buf[low:high]], tc.BASE_BYTE)
                    grams = tc.mix((prefix[gram:] - prefix[:-gram]) * down[: high - low - gram + 1])
                    at, count, anchor, digest = runs_of(grams, prefix, down, tc.inside(bounds, high - low, window), window, gram)
                    own = tc.owners(bounds, high - low)[at]
                    columns, names = _columns(part, own, at - bounds[own] + low, count | (anchor - at) << ANCHOR_SHIFT, grams[anchor], digest)
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _columns(part: pa.RecordBatch, own, pos, count, f, d) -> tuple[list[pa.Array], list[str]]:
    doc, tag = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[own] for c in ("doc", "tag"))
    return [pa.array(x) for x in (f.view(np.int64), d.view(np.int64), doc, tag, pos << 32 | count)], ["f", "d", "doc", "tag", "at"]
