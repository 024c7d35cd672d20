"""The data source ``ordered_events``: a Parquet table as a stream in batches of a bounded number of rows, in id order.

The offset is an event id: a batch has the rows with ids above the last offset and up to the next one, and the
next one is the id of the ``batch_rows``-th row from there.  Footers tell which row groups hold such ids, so finding an offset
reads the id column of a few row groups, and a task reads the row groups that overlap its batch.  A restart goes
on at the offset in the checkpoint.  Files are opened with pyarrow's file systems.

    spark.dataSource.register(OrderedEvents)
    spark.readStream.format("ordered_events").option("batch_rows", 1000).load(path)

Rows without an id are never part of a batch; rows that share an id come in one batch, which may then be larger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LEAST_ROWS, MOST_ROWS = 500, 2000


@dataclass
class RowGroup(InputPartition):
    file: str
    group: int
    low: int
    high: int
    start: int = 0
    end: int = 0


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, at = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return fs, [at]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return fs, sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


class OrderedReader(DataSourceStreamReader):
    def __init__(self, path: str, id_col: str, batch_rows: int):
        self.path, self.id_col, self.batch_rows = path, id_col, batch_rows
        self.last: int | None = None  # the offset that was given out last
        self.known: dict[str, list[RowGroup]] = {}  # a file's row groups; files don't change

    def _groups(self) -> list[RowGroup]:
        fs, files = _files(self.path)
        for file in files:
            if file not in self.known:
                with fs.open_input_file(file) as source:
                    about = pq.ParquetFile(source)
                    column = about.schema_arrow.get_field_index(self.id_col)
                    self.known[file] = []
                    for g in range(about.num_row_groups):
                        stats = about.metadata.row_group(g).column(column).statistics
                        if stats is not None and stats.has_min_max:
                            low, high = stats.min, stats.max
                        else:
                            ids = about.read_row_group(g, [self.id_col]).column(0)
                            low, high = pc.min(ids).as_py(), pc.max(ids).as_py()
                        if low is not None:
                            self.known[file].append(RowGroup(file, g, low, high))
        return sorted((g for f in files for g in self.known[f]), key=lambda g: g.low)

    def _ids(self, group: RowGroup) -> np.ndarray:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(group.file) as source:
            ids = pq.ParquetFile(source).read_row_group(group.group, [self.id_col]).column(0)
        return ids.drop_null().to_numpy()

    def next_offset(self, last: int) -> int:
        """The id of the row ``batch_rows`` rows on; ``last`` where there is none above it."""
        found = np.zeros(0, np.int64)
        for group in self._groups():
            if group.high <= last:
                continue
            if len(found) >= self.batch_rows and group.low > found[self.batch_rows - 1]:
                break
            ids = self._ids(group)
            found = np.sort(np.append(found, ids[ids > last]))[: self.batch_rows]
        return int(found[-1]) if len(found) else last

    def initialOffset(self) -> dict:
        return {"id": -(1 << 62)}

    def latestOffset(self) -> dict:
        if self.last is None:
            self.last = self.initialOffset()["id"]
        self.last = self.next_offset(self.last)
        return {"id": self.last}

    def partitions(self, start: dict, end: dict):
        self.last = max(self.last or end["id"], end["id"])  # after a restart the checkpoint knows it
        found = [RowGroup(g.file, g.group, g.low, g.high, start["id"], end["id"]) for g in self._groups() if g.high > start["id"] and g.low <= end["id"]]
        return found or [RowGroup("", 0, 0, 0)]

    def read(self, partition: RowGroup):
        if not partition.file:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.file) as source:
            for batch in pq.ParquetFile(source).iter_batches(row_groups=[partition.group]):
                ids = batch.column(batch.schema.get_field_index(self.id_col))
                yield batch.filter(pc.fill_null(pc.and_(pc.greater(ids, partition.start), pc.less_equal(ids, partition.end)), False))


class OrderedEvents(DataSource):
    """Options: path, id_col (event_id), batch_rows (1,000; held to 500 .. 2,000 unless ``unbounded`` is true)."""

    @classmethod
    def name(cls):
        return "ordered_events"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        fs, files = _files(self.options["path"])
        with fs.open_input_file(files[0]) as source:
            return from_arrow_schema(pa.schema(pq.read_schema(source)), prefer_timestamp_ntz=True)

    def streamReader(self, schema):
        rows = int(self.options.get("batch_rows", 1000))
        if self.options.get("unbounded", "false") != "true":
            rows = min(MOST_ROWS, max(LEAST_ROWS, rows))
        return OrderedReader(self.options["path"], self.options.get("id_col", "event_id"), rows)


def ordered_stream(spark: SparkSession, path: str, batch_rows: int = 1000, id_col: str = "event_id", unbounded: bool = False) -> DataFrame:
    """The table at ``path`` as a stream in id order, ``batch_rows`` rows a batch."""
    spark.dataSource.register(OrderedEvents)
    reader = spark.readStream.format("ordered_events").option("batch_rows", batch_rows).option("id_col", id_col)
    return reader.option("unbounded", str(unbounded).lower()).load(path)
