"""A partitioned Parquet table with a manifest for each version.

A write adds files of its own and then a manifest, which names the folders of every partition; no file changes once
it is named.  So a reader that holds a version reads the same rows whatever is written after, a write that fails
leaves the table as it was, and what doesn't concern a partition leaves its files alone.  The folders that no kept
version names go with :meth:`vacuum`.

    <path>/data/<write>/_part=<partition>/part-*.parquet
    <path>/versions/<version>.json

A version number is taken by giving a finished manifest its name, which fails if another writer was faster; then
the commit is tried again on the newer version (on file systems that rename over files, one writer at a time).  ``token`` makes a write happen once: a batch number that the newest manifest has
for that writer, or a smaller one, is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "_part"


@dataclass
class Manifest:
    """Folders of each partition, oldest first, and the last batch of each writer."""

    version: int = 0
    schema: str = ""
    parts: dict[str, list[str]] = field(default_factory=dict)
    tokens: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """``partition`` is the column whose values (as strings; null is a partition too) are the table's partitions."""

    def __init__(self, spark: SparkSession, path: str, partition: str):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self._jvm = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._jvm(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        at = self._jvm(f"{self.path}/versions")
        if not self._files.exists(at):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._files.listStatus(at) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of ``version`` (default: the newest); an empty one for version 0."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _commit(self, new: Manifest) -> bool:
        """Write a manifest to a file of its own and give it its name, unless that name is taken."""
        hidden, name = self._jvm(f"{self.path}/versions/_{uuid.uuid4().hex}"), self._jvm(f"{self.path}/versions/{new.version:012d}.json")
        out = self._files.create(hidden, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        if self._files.exists(name) or not self._files.rename(hidden, name):
            self._files.delete(hidden, False)
            return False
        return True

    def change(self, edit: Callable[[Manifest], None], tries: int = 10) -> int:
        """Commit the newest manifest as ``edit`` leaves it; edited again if another writer was faster."""
        for _ in range(tries):
            new = self.manifest()
            new.version += 1
            edit(new)
            if self._commit(new):
                return new.version
        raise PySparkException(f"{self.path} is written by too many at once")

    # rows

    def read(self, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version (default: the newest now), of all partitions or of some."""
        found = self.manifest(version)
        if not found.schema:
            raise FileNotFoundError(f"{self.path} has no version {version}")
        schema = StructType.fromJson(json.loads(found.schema))
        dirs = [f"{self.path}/{d}" for p, ds in found.parts.items() if parts is None or p in parts for d in ds]
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*dirs)

    def store(self, rows: DataFrame) -> dict[str, str]:
        """Write files for ``rows`` and return the folder of each partition; no version has them yet."""
        where = f"data/{uuid.uuid4().hex}"
        part = F.coalesce(F.col(self.partition).cast("string"), F.lit("null"))
        dealt = rows.withColumn(PART, part)
        dealt.write.partitionBy(PART).option("compression", "zstd").parquet(f"{self.path}/{where}")
        names = [s.getPath().getName() for s in self._files.listStatus(self._jvm(f"{self.path}/{where}"))]
        return {self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(n[len(PART) + 1 :]): f"{where}/{n}" for n in names if n.startswith(f"{PART}=")}

    def _write(self, rows: DataFrame, put: Callable[[Manifest, dict[str, str]], None], writer: str, token: int | None) -> int:
        now = self.manifest()
        if token is not None and now.tokens.get(writer, -1) >= token:
            return now.version
        added = self.store(rows)

        def edit(m: Manifest) -> None:
            m.schema = m.schema or rows.schema.json()
            if token is None or m.tokens.get(writer, -1) < token:
                put(m, added)
                m.tokens |= {} if token is None else {writer: token}

        return self.change(edit)

    def append(self, rows: DataFrame, writer: str = "", token: int | None = None) -> int:
        """Add rows; partitions keep the files they have."""

        def put(m: Manifest, added: dict[str, str]) -> None:
            for part, folder in added.items():
                m.parts.setdefault(part, []).append(folder)

        return self._write(rows, put, writer, token)

    def replace(self, rows: DataFrame, writer: str = "", token: int | None = None) -> int:
        """Replace the partitions that ``rows`` has rows of; all others keep their files."""
        return self._write(rows, lambda m, added: m.parts.update({part: [folder] for part, folder in added.items()}), writer, token)

    def drop(self, parts: Sequence[str]) -> int:
        """Drop whole partitions without reading them."""

        def edit(m: Manifest) -> None:
            for part in parts:
                m.parts.pop(part, None)

        return self.change(edit)

    def rewrite(self, parts: Sequence[str], how: Callable[[DataFrame], DataFrame]) -> int:
        """Put ``how(rows)`` in the place of the rows of some partitions, which must stay in these partitions.

        Folders that another writer adds to such a partition meanwhile stay beside the new one.
        """
        before = self.manifest()
        of = {p: list(before.parts[p]) for p in parts if p in before.parts}
        if not of:
            return before.version
        added = self.store(how(self.read(before.version, list(of))))

        def edit(m: Manifest) -> None:
            for part, old in of.items():
                if m.parts.get(part, [])[: len(old)] != old:
                    raise PySparkException(f"partition {part} was rewritten by another writer")
                left = ([added[part]] if part in added else []) + m.parts[part][len(old) :]
                m.parts.pop(part) if not left else m.parts.update({part: left})

        return self.change(edit)

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` versions and delete the folders that only those had; returns how many."""
        known = self.versions()
        old, stay = known[:-keep], {d for v in known[-keep:] for ds in self.manifest(v).parts.values() for d in ds}
        gone = {d for v in old for ds in self.manifest(v).parts.values() for d in ds} - stay
        for v in old:
            self._files.delete(self._jvm(f"{self.path}/versions/{v:012d}.json"), False)
        for d in gone:
            self._files.delete(self._jvm(f"{self.path}/{d}"), True)
        return len(gone)


@dataclass
class Measure:
    """A column of totals: how rows become a partial total and how partial totals merge."""

    name: str
    partial: Column
    merge: Callable[[str], Column]


def total(name: str, value: Column) -> Measure:
    return Measure(name, F.sum(value), F.sum)


def least(name: str, value: Column) -> Measure:
    return Measure(name, F.min(value), F.min)


def most(name: str, value: Column) -> Measure:
    return Measure(name, F.max(value), F.max)


def latest(name: str, value: Column, order: Column) -> Measure:
    """The value of the largest order; stored as a struct of both."""
    return Measure(name, F.max(F.struct(order.alias("at"), value.alias("value"))), F.max)


class KeyedTotals:
    """Totals by key that batches add to: a batch's partial totals are appended, reading merges, compaction rewrites.

    A batch that is written again counts once.  A partition with more than ``most_deltas`` folders is
    merged into one when a batch has been added, so the table grows with its keys and not with its batches.
    """

    def __init__(self, table: VersionedTable, keys: Sequence[str], measures: Sequence[Measure], most_deltas: int = 8, writer: str = "totals"):
        self.table, self.keys, self.measures, self.most_deltas, self.writer = table, list(keys), list(measures), most_deltas, writer

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(m.merge(m.name).alias(m.name) for m in self.measures))

    def add(self, batch: DataFrame, batch_id: int) -> int:
        partial = batch.groupBy(*self.keys).agg(*(m.partial.alias(m.name) for m in self.measures))
        version = self.table.append(partial, self.writer, batch_id)
        many = [p for p, folders in self.table.manifest(version).parts.items() if len(folders) > self.most_deltas]
        return self.compact(many) if many else version

    def compact(self, parts: Sequence[str] | None = None) -> int:
        version = self.table.rewrite(list(self.table.manifest().parts) if parts is None else parts, self.merged)
        self.table.vacuum()
        return version

    def read(self, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        return self.merged(self.table.read(version, parts))

    def empty(self) -> bool:
        return self.table.manifest().version == 0

