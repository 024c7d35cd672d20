"""Token ids as Arrow files of equal-length sequences: the data source ``token_ids``.

A folder has one Arrow IPC file for each partition that was written (the stream format with a footer
over its batches) and a manifest.  The ids of all documents, each with an end id behind it, are one
sequence of ids in the order of the written rows; a file cuts its share into rows of

* ``ids``   fixed-size list of ``length`` ids, two bytes each where the vocabulary allows it,
* ``mask``  fixed-size list of bits: false where the last row of a file is padding,
* ``docs``  the documents that end in the row: id and how many of the row's ids there are up to its end.

All batches of a file but the last have ``BATCH`` rows and nothing is compressed, so sequence number k is found by
arithmetic and read from a mapped file without a copy (:class:`TokenFiles`).

A task writes a file of its own name and the manifest names the files of the tasks that counted, so a
repeated task leaves nothing in the result; where a task fails the files are deleted.  Nothing is kept
but one row's rest and one slice, whatever the size of documents and partitions.

Defined results: a null text is empty, so it has the end id only; null ids come last; rows with one id
follow each other by their text's hash; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import textcodes as tc
from .token_ids import SLICE_BYTES, encoder

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BATCH = 256
MANIFEST = "manifest.json"
_DOC = pa.struct([("doc_id", pa.int64()), ("end", pa.int32())])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path)
    return (pafs.LocalFileSystem(use_mmap=True), at) if isinstance(fs, pafs.LocalFileSystem) else (fs, at)


def file_schema(length: int, dtype: type) -> pa.Schema:
    ids = pa.from_numpy_dtype(dtype)
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length)), ("docs", pa.list_(_DOC))])


class SequenceFile:
    """Packs documents' ids into rows of ``length`` and writes whole batches as they fill."""

    def __init__(self, sink, length: int, dtype: type, end_id: int):
        self.length, self.dtype, self.end_id = length, dtype, end_id
        self.schema = file_schema(length, dtype)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.ids: list[np.ndarray] = []  # not yet written
        self.doc_ids: list[pa.Array] = []
        self.ends: list[np.ndarray] = []  # in ids since the last written row
        self.waiting = self.tokens = self.sequences = self.documents = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with their ids one after another; an end id goes behind each."""
        ends = np.cumsum(counts + 1)
        stream = np.full(len(ids) + len(counts), self.end_id, self.dtype)
        body = np.ones(len(stream), bool)
        body[ends - 1] = False
        stream[body] = ids
        self.ids.append(stream)
        self.doc_ids.append(doc_ids)
        self.ends.append(ends + self.waiting)
        self.waiting += len(stream)
        self.tokens += len(stream)
        self.documents += len(counts)
        if self.waiting >= BATCH * self.length:
            self._write(self.waiting // (BATCH * self.length) * BATCH)

    def _write(self, rows: int) -> None:
        stream, ends, doc_ids = np.concatenate(self.ids), np.concatenate(self.ends), pa.concat_arrays(self.doc_ids)
        for at in range(0, rows, BATCH):
            n, low = min(BATCH, rows - at), at * self.length
            part = stream[low : low + n * self.length]
            mask = np.arange(n * self.length) < len(part)
            part = np.append(part, np.full(n * self.length - len(part), self.end_id, self.dtype)) if len(part) < len(mask) else part
            a, b = np.searchsorted(ends, [low, low + n * self.length], "right")
            inner = ends[a:b] - low
            row = (inner - 1) // self.length
            docs = pa.StructArray.from_arrays([doc_ids[a:b], pa.array((inner - row * self.length).astype(np.int32))], fields=list(_DOC))
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(part), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), docs),
            ]
            self.file.write_batch(pa.record_batch(columns, schema=self.schema))
        done = rows * self.length
        rest = np.searchsorted(ends, done, "right")
        self.ids, self.ends, self.doc_ids = [stream[done:].copy()], [ends[rest:] - done], [doc_ids[rest:]]
        self.waiting = max(0, self.waiting - done)
        self.sequences += rows

    def close(self) -> None:
        if self.waiting:
            self._write(-(-self.waiting // self.length))
        self.file.close()


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    tokens: int
    documents: int
    sequences: int


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.tokenizer = options["path"].rstrip("/"), options.get("tokenizer", DEFAULT_TOKENIZER)
        self.length, self.end_id = int(options.get("length", 2048)), int(options.get("end_id", 0))
        if self.length < 1:
            raise ValueError("length must be positive")
        fs, at = _open(self.path)
        if fs.get_file_info(f"{at}/{MANIFEST}").type != pafs.FileType.NotFound:
            if not overwrite:
                raise ValueError(f"{self.path} has token files; write with mode overwrite")
            self._delete(f["file"] for f in read_manifest(self.path)["files"])
            fs.delete_file(f"{at}/{MANIFEST}")
        fs.create_dir(at, recursive=True)

    def write(self, iterator):
        from pyspark import TaskContext

        part, name, out = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}.arrow", None
        fs, at = _open(self.path)
        search = encoder(self.tokenizer)
        sink = None
        for batch in iterator:
            for texts in tc.slices(batch, "text", SLICE_BYTES):
                if out is None:
                    sink = fs.open_output_stream(f"{at}/{name}")
                    out = SequenceFile(sink, self.length, search.dtype, self.end_id)
                out.add(texts.column("doc_id").cast(pa.int64()), *search.encode(*tc.text_buffers(texts.column("text"))))
        if out is None:
            return Written(part, "", 0, 0, 0)
        out.close()
        sink.close()
        return Written(part, name, out.tokens, out.documents, out.sequences)

    def _delete(self, names) -> None:
        fs, at = _open(self.path)
        for name in names:
            if fs.get_file_info(f"{at}/{name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{at}/{name}")

    def commit(self, messages) -> None:
        found = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.part)
        tokens = itertools.accumulate((m.tokens for m in found), initial=0)
        sequences = itertools.accumulate((m.sequences for m in found), initial=0)
        files = [{"file": m.file, "start": s, "first_sequence": q, "tokens": m.tokens, "documents": m.documents, "sequences": m.sequences} for m, s, q in zip(found, tokens, sequences, strict=False)]
        fs, at = _open(self.path)
        with fs.open_output_stream(f"{at}/{MANIFEST}") as out:
            out.write(json.dumps({"length": self.length, "end_id": self.end_id, "files": files}).encode())

    def abort(self, messages) -> None:
        self._delete(m.file for m in messages if m is not None and m.file)


def read_manifest(path: str) -> dict:
    """length, end_id and the files in order, each with the number of ids and of sequences before it."""
    fs, at = _open(path.rstrip("/"))
    with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


class TokenFiles:
    """Sequences by their number over all files; local files are mapped, and nothing is copied."""

    def __init__(self, path: str):
        self.path, self.manifest = path.rstrip("/"), read_manifest(path)
        self.firsts = [f["first_sequence"] for f in self.manifest["files"]]
        self.open: dict[int, pa.ipc.RecordBatchFileReader] = {}

    def __len__(self) -> int:
        return sum(f["sequences"] for f in self.manifest["files"])

    def _row(self, k: int) -> tuple[pa.RecordBatch, int]:
        if not 0 <= k < len(self):
            raise IndexError(k)
        which = bisect.bisect_right(self.firsts, k) - 1
        if which not in self.open:
            fs, at = _open(self.path)
            self.open[which] = pa.ipc.open_file(fs.open_input_file(f"{at}/{self.manifest['files'][which]['file']}"))
        batch, row = divmod(k - self.firsts[which], BATCH)
        return self.open[which].get_batch(batch), row

    def __getitem__(self, k: int) -> np.ndarray:
        """The ids of sequence ``k``, padding included, as a view of the file."""
        batch, row = self._row(k)
        return batch.column("ids").flatten().to_numpy()[row * self.manifest["length"] :][: self.manifest["length"]]

    def mask(self, k: int) -> pa.BooleanArray:
        """Which ids of sequence ``k`` count, as a view of the file's bits."""
        batch, row = self._row(k)
        return batch.column("mask").flatten().slice(row * self.manifest["length"], self.manifest["length"])


@dataclass
class FilePart(InputPartition):
    file: str
    start: int
    first_sequence: int


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
SEQUENCES = "sequence long, ids array<int>, mask array<boolean>"


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.view = options["path"].rstrip("/"), options.get("view", "documents")

    def partitions(self):
        found = [FilePart(f["file"], f["start"], f["first_sequence"]) for f in read_manifest(self.path)["files"]]
        return found or [FilePart("", 0, 0)]

    def read(self, partition: FilePart):
        if partition.file:
            fs, at = _open(self.path)
            with fs.open_input_file(f"{at}/{partition.file}") as source:
                yield from (self._sequences if self.view == "sequences" else self._documents)(pa.ipc.open_file(source), partition)

    def _sequences(self, file, partition: FilePart):
        number = partition.first_sequence
        for k in range(file.num_record_batches):
            batch = file.get_batch(k)
            ids = [pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * c.type.list_size), c.flatten()) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + batch.num_rows)), ids[0].cast(pa.list_(pa.int32())), ids[1]], names=["sequence", "ids", "mask"])
            number += batch.num_rows

    def _documents(self, file, partition: FilePart):
        """One row for each document; the checksum of one that goes on in the next batch is carried along."""
        start, crc, many = partition.start, 0, 0
        for k in range(file.num_record_batches):
            batch = file.get_batch(k)
            docs, length = batch.column("docs"), batch.column("ids").type.list_size
            data = memoryview(batch.column("ids").flatten().to_numpy().astype("<u4").tobytes())
            row = np.repeat(np.arange(batch.num_rows), np.diff(docs.offsets.to_numpy()))
            flat, at, out = docs.flatten(), 0, []
            for end in (flat.field("end").to_numpy(zero_copy_only=False) + row * length).tolist():
                crc = zlib.crc32(data[4 * at : 4 * end], crc)
                out.append((start, many + end - at, crc))
                start, at, crc, many = start + many + end - at, end, 0, 0
            crc, many = zlib.crc32(data[4 * at :], crc), many + batch.num_rows * length - at
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([flat.field("doc_id"), *columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


class TokenSource(DataSource):
    """``token_ids``: written from doc_id and text, read as documents (default) or, with option view, as sequences.

    Options: path; to write: tokenizer (a file that every executor has), length, end_id.
    """

    @classmethod
    def name(cls):
        return "token_ids"

    def schema(self):
        return SEQUENCES if self.options.get("view") == "sequences" else DOCUMENTS

    def reader(self, schema):
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite):
        return TokenWriter(dict(self.options), overwrite)


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, length: int = 2048, end_id: int = 0) -> None:
    """Write the ids of all documents, in ascending order of their ids, to the folder ``path``.

    One exchange by ranges of (id, text's hash), so that many rows of one id are spread.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenSource)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.format("token_ids").mode("append").option("tokenizer", tokenizer).option("length", length).option("end_id", end_id).save(path)


def read_token_files(spark: SparkSession, path: str, view: str = "documents") -> DataFrame:
    """The documents (doc_id, start, n_tokens, ids_crc32) or the sequences (sequence, ids, mask) of a folder."""
    spark.dataSource.register(TokenSource)
    return spark.read.format("token_ids").option("view", view).load(path)
