"""Fill-in-middle transformation on a piece table.

The texts of a slice and the sentinels are two immutable buffers.  A document is a list of
descriptors (buffer, start, length): at first one over its text.  Cutting splits descriptors, the
arrangement appends three sentinel descriptors and permutes all six, hashes run along
descriptors, and no byte moves until an output is wanted as a column.  Restoring parses an
output back into six descriptors at its sentinels and applies the inverse permutation.

A text that contains a sentinel stays plain, so an output that isn't plain holds each sentinel once:
an occurrence that lay across a border would need its ``<`` in a part and then begin a sentinel
again, and no sentinel has ``<`` after its first byte.

Defined results: a null text is empty, and an empty text is plain; a null id counts as the empty string in the
hash that decides; rows with repeated ids are treated alike; an empty table gives an empty result; result
columns take the place of input columns with their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from . import textcodes as tc

# The three sentinels, in the order prefix, suffix, middle.
SENTINELS = (b"<P>", b"<S>", b"<M>")
TEXT, MARKS = 0, 1
#: Descriptors before the arrangement: prefix, middle, suffix, <P>, <S>, <M>; an arrangement says which comes where.
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
#: The sentinels' letters as they follow each other in an output.
_LETTERS = {form: tuple(SENTINELS[k - 3][1] for k in order[::2]) for form, order in ORDERS.items()}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class PieceTable:
    """Descriptors of the documents of one slice over the text buffer and the sentinel buffer."""

    def __init__(self, text: np.ndarray, which: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray):
        self.buffers = (memoryview(np.ascontiguousarray(text)), memoryview(b"".join(SENTINELS)))
        self.which, self.start, self.length, self.first = which, start, length, first

    @classmethod
    def of_texts(cls, text: np.ndarray, offs: np.ndarray) -> PieceTable:
        n = len(offs) - 1
        return cls(text, np.full(n, TEXT, np.int8), offs[:-1].copy(), np.diff(offs), np.arange(n + 1))

    def cut(self, docs: np.ndarray, at: np.ndarray) -> None:
        """Split, in each of the ascending ``docs``, the last descriptor that begins at or before byte ``at`` of the document."""
        ahead = np.cumsum(self.length) - self.length
        begin = ahead - np.repeat(np.append(ahead, 0)[self.first[:-1]], np.diff(self.first))  # within the document
        # the last descriptor of the document with begin <= at: documents and places make one ascending key
        own, span = tc.owners(self.first, len(self.which)), int(max(begin.max(initial=0), at.max(initial=0))) + 1
        found = np.searchsorted(own * span + begin, docs * span + at, "right") - 1
        left = at - begin[found]
        copies = np.ones(len(self.which), np.int64)
        copies[found] = 2
        to = np.cumsum(copies) - copies
        self.which, self.start, self.length = (np.repeat(x, copies) for x in (self.which, self.start, self.length))
        self.start[to[found] + 1] += left
        self.length[to[found] + 1] -= left
        self.length[to[found]] = left
        self.first = np.append(to, len(self.which))[self.first]

    def append_sentinels(self, docs: np.ndarray) -> None:
        """Three descriptors over the sentinel buffer behind the last one of each of ``docs``."""
        at = np.repeat(self.first[docs + 1], len(SENTINELS))
        size = np.array([len(s) for s in SENTINELS])
        self.which = np.insert(self.which, at, MARKS)
        self.start = np.insert(self.start, at, np.tile(np.cumsum(size) - size, len(docs)))
        self.length = np.insert(self.length, at, np.tile(size, len(docs)))
        more = np.zeros(len(self.first), np.int64)
        more[docs + 1] = len(SENTINELS)
        self.first = self.first + np.cumsum(more)

    def permute(self, docs: np.ndarray, order: tuple[int, ...]) -> None:
        """Put descriptor ``order[k]`` of each of ``docs`` in place k; these documents have len(order) descriptors."""
        to = self.first[docs][:, None] + np.arange(len(order))
        source = self.first[docs][:, None] + np.array(order)
        for column in (self.which, self.start, self.length):
            column[to] = column[source]

    def digests(self) -> list[str]:
        """The hex SHA-256 of each document, streamed over its descriptors."""
        out, which, start, end = [], self.which.tolist(), self.start.tolist(), (self.start + self.length).tolist()
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            h = hashlib.sha256()
            for k in range(a, b):
                h.update(self.buffers[which[k]][start[k] : end[k]])
            out.append(h.hexdigest())
        return out

    def texts(self) -> pa.Array:
        """The documents' bytes along their descriptors, as strings."""
        spans = zip(self.which.tolist(), self.start.tolist(), (self.start + self.length).tolist(), strict=True)
        data = b"".join(self.buffers[w][a:b] for w, a, b in spans)
        at = np.append(0, np.cumsum(self.length))[self.first]
        return pa.Array.from_buffers(pa.large_string(), len(self.first) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(order.index(k) for k in range(len(order)))


def _units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units (runs of A-Z and a-z, other code points one by one) start, and each text's first unit."""
    letter = _LETTER[buf]
    starts = (buf & 0xC0) != 0x80
    inner = np.zeros(len(buf) + 1, bool)
    inner[1 : len(buf)] = letter[1:] & letter[:-1]
    inner[offs] = False
    at = np.flatnonzero(starts & ~inner[:-1])
    return at, np.searchsorted(at, offs)


def _marked(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the sentinels in the texts, ascending; none lies across two texts."""
    if len(buf) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((buf[:-2] == ord("<")) & (buf[2:] == ord(">")) & np.isin(buf[1:-1], [s[1] for s in SENTINELS]))
    ends = offs[np.searchsorted(offs, at, "right")] if len(at) else at
    return at[at + 3 <= ends]


def decisions(row_id: Column) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of SHA-256 of ``1:`` and the id, as numbers."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


_OWN = ["n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10, spm_percent: int = 20, keep_columns: list[str] | None = None) -> DataFrame:
    """``keep_columns`` (default: the id) with the rearranged text and how it came about.

    ``n`` units are cut by two of the id's hashes into prefix, middle and suffix; ``form`` is plain
    (``plain_percent`` of the documents, the empty ones and those that hold a sentinel), psm or spm
    (``spm_percent`` of the others).  ``pieces`` has the output's descriptors as (buffer, start, length),
    buffer 0 being the text's bytes and 1 the sentinels; ``output`` is their text and
    ``output_sha256`` their hash.
    """
    keep = [c for c in keep_columns or [id_col] if c not in _OWN]
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).cast("string").alias("_text"), *decisions(F.col(id_col)))

    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "_text"):
                buf, offs = tc.text_buffers(part.column("_text"))
                count = len(offs) - 1
                h1, h2, h3, h4 = (part.column(f"_h{k}").to_numpy() for k in (1, 2, 3, 4))
                units, first = _units(buf, offs)
                n = np.diff(first)
                marked = np.zeros(count, bool)
                marked[np.searchsorted(offs, _marked(buf, offs), "right") - 1] = True
                plain = (n == 0) | marked | (h3 % 100 >= 100 - plain_percent)
                spm = ~plain & (h4 % 100 < spm_percent)
                cuts = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
                place = np.append(units, len(buf))
                # bytes from the text's start up to unit number k; k = n is the text's end
                bytes_at = [np.where(k < n, place[first[:-1] + np.minimum(k, np.maximum(n - 1, 0))], offs[1:]) - offs[:-1] for k in cuts]
                table = PieceTable.of_texts(buf, offs)
                moved = np.flatnonzero(~plain)
                for at in bytes_at:
                    table.cut(moved, at[moved])
                chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
                ends = [chars[offs[:-1] + at] for at in bytes_at]
                table.append_sentinels(moved)
                for form, these in (("psm", ~plain & ~spm), ("spm", spm)):
                    table.permute(np.flatnonzero(these), ORDERS[form])
                own = offs[:-1][tc.owners(table.first, len(table.which))]
                pieces = pa.StructArray.from_arrays(
                    [pa.array(table.which.astype(np.int32)), pa.array(table.start - np.where(table.which == TEXT, own, 0)), pa.array(table.length)], names=["buffer", "start", "length"]
                )
                form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
                columns = [
                    part.column("_row"), pa.array(n), form, pa.array(ends[0] - chars[offs[:-1]], mask=plain), pa.array(ends[1] - ends[0], mask=plain),
                    pa.ListArray.from_arrays(pa.array(table.first.astype(np.int32)), pieces), table.texts().cast(pa.string()), pa.array(table.digests(), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", *_OWN])

    schema = rows.select("_row").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long")
    schema = schema.add("pieces", ArrayType(StructType().add("buffer", "integer").add("start", "long").add("length", "long"))).add("output", "string").add("output_sha256", "string")
    return rows.mapInArrow(run, schema).select("_row.*", *_OWN)


def restore_texts(arranged: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """Add ``restored``, the text before the arrangement, and ``restored_sha256``, from nothing but output and form.

    A null output or a form that is neither psm nor spm gives the output itself (null as empty); where the
    output doesn't hold its form's sentinels, each once and in order, both are null.
    """
    added = ["restored", "restored_sha256"]
    keep = [c for c in arranged.columns if c not in added]
    rows = arranged.select(F.struct(*keep).alias("_row"), F.col(output_col).alias("_output"), F.col(form_col).alias("_form"))

    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "_output"):
                buf, offs = tc.text_buffers(part.column("_output"))
                form = np.array(part.column("_form").to_pylist(), object)
                table, marked = PieceTable.of_texts(buf, offs), _marked(buf, offs)
                own, wanted = np.searchsorted(offs, marked, "right") - 1, np.isin(form, list(ORDERS))
                three = np.bincount(own, minlength=len(form)) == len(SENTINELS)
                places, letters = np.zeros((len(form), len(SENTINELS)), np.int64), np.zeros((len(form), len(SENTINELS)), np.uint8)
                places[three] = marked[three[own]].reshape(-1, len(SENTINELS)) - offs[:-1][three][:, None]
                letters[three] = buf[marked[three[own]] + 1].reshape(-1, len(SENTINELS))
                sound = three & (places[:, 0] == 0) & (letters == [_LETTERS.get(f, (0, 0, 0)) for f in form]).all(axis=1)
                moved = np.flatnonzero(wanted & sound)
                for k in range(len(SENTINELS)):  # sentinel, part, sentinel, part, sentinel, part
                    if k:
                        table.cut(moved, places[moved, k])
                    table.cut(moved, places[moved, k] + len(SENTINELS[k]))
                text = np.ones(len(table.which), bool)
                for name, order in ORDERS.items():
                    these = np.flatnonzero((form == name) & sound)
                    table.permute(these, inverse(order))
                    gone = table.first[these][:, None] + np.arange(len(SENTINELS), 2 * len(SENTINELS))
                    text[gone] = False
                table.length = np.where(text, table.length, 0)
                null = wanted & ~sound
                digests = pa.array(np.array(table.digests(), object), pa.string(), mask=null)
                texts = pc.if_else(pa.array(null), None, table.texts().cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("_row"), texts, digests], names=["_row", *added])

    return rows.mapInArrow(run, rows.select("_row").schema.add("restored", "string").add("restored_sha256", "string")).select("_row.*", *added)
