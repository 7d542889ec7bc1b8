"""A table that is appended to atomically: numbered commits of part folders, each key once.

A part folder is written first; nothing reads it. A commit creates the next
numbered entry of the log, which only one writer can do; the entry names the
batch, the part and the schema. Readers read the parts of the log's entries. So

- a crash before the commit leaves a part that nobody reads,
- a batch that comes again is found in the log and changes nothing,
- of two writers one gets the number; the other looks at what the first has
  committed, drops the keys that it finds there and tries the next number.

Rows lie in folders by a hash of their key. Appending reads the keys of those
buckets alone that the new rows fall into, of old parts no other column.
The log is one small entry for each commit, listed and read on the driver.
A file system whose create without overwriting is atomic (HDFS) is needed where
writers run at the same time. An entry cut off while it was written is no
commit; its number stays unused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sinks import shape, written

BUCKETS = 64
BUCKET = "_bucket"


@dataclass(frozen=True)
class Entry:
    number: int
    batch: str
    part: str | None
    schema: str


class Ledger:
    """A table in a folder that all machines share. keys: columns that no two of its rows have equal (null equals null)."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/log"))
        self._known: dict[int, Entry] = {}

    def entries(self) -> list[Entry]:
        """The commits in order."""
        for s in self._fs.listStatus(self._path(f"{self.folder}/log")):
            name = s.getPath().getName()
            if name.isdigit() and int(name) not in self._known:
                stream = self._fs.open(s.getPath())
                try:
                    text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
                finally:
                    stream.close()
                if text.endswith("\n"):
                    self._known[int(name)] = Entry(int(name), **json.loads(text))
        return [self._known[n] for n in sorted(self._known)]

    def _last_number(self) -> int:
        return max((int(n) for s in self._fs.listStatus(self._path(f"{self.folder}/log")) if (n := s.getPath().getName()).isdigit()), default=0)

    def _create(self, number: int, entry: dict) -> bool:
        """Creates a log entry; False where another writer has that number."""
        try:
            out = self._fs.create(self._path(f"{self.folder}/log/{number:012d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
        out.close()
        return True

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _keys_in(self, parts: list[str], buckets: list[int]) -> DataFrame:
        """Keys that these parts hold in these buckets; the folders of others are not read."""
        rows = [self.spark.read.option("basePath", f"{self.folder}/{p}").parquet(f"{self.folder}/{p}") for p in parts]
        out = rows[0].where(F.col(BUCKET).isin(buckets)).select(*self.keys)
        for r in rows[1:]:
            out = out.unionByName(r.where(F.col(BUCKET).isin(buckets)).select(*self.keys))
        return out

    def _without(self, rows: DataFrame, parts: list[str]) -> DataFrame:
        if not parts:
            return rows
        buckets = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most self.buckets
        there = self._keys_in(parts, buckets).distinct()
        there = there.select(*[F.col(k).alias(f"_there{i}") for i, k in enumerate(self.keys)])
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_there{i}"))
        return rows.join(there, same, "left_anti")

    def append(self, batch: str, df: DataFrame) -> bool:
        """Appends the rows whose keys are not there yet, of rows with equal keys one; False if the batch is in the log."""
        seen: set[int] = set()
        rows, part = None, None
        while True:
            log = self.entries()
            if any(e.batch == batch for e in log):
                return False
            if log and json.loads(log[0].schema) != [list(x) for x in shape(df.schema)]:
                raise ValueError(f"schema differs: {json.loads(log[0].schema)} against {shape(df.schema)}")
            fresh = [e for e in log if e.number not in seen]
            seen |= {e.number for e in fresh}
            if rows is None:
                rows = written(self._bucketed(df.dropDuplicates(self.keys)), "ledger_rows")
            parts = [e.part for e in fresh if e.part]
            if part is None or parts:
                rows = written(self._without(rows, parts), "ledger_new") if parts else rows
                part = None
                if not rows.isEmpty():
                    part = f"part={uuid.uuid4().hex}"
                    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/{part}")
            self._before_commit()
            # the number after the last one of any kind: a commit made since the log was read is found by taking it first
            if self._last_number() > max(seen | self._broken(), default=0):
                continue
            if self._create(max(seen | self._broken(), default=0) + 1, {"batch": batch, "part": part, "schema": json.dumps(shape(df.schema))}):
                return True

    def _broken(self) -> set[int]:
        """Numbers whose entries were cut off."""
        known = {e.number for e in self.entries()}
        return {n for s in self._fs.listStatus(self._path(f"{self.folder}/log")) if (name := s.getPath().getName()).isdigit() and (n := int(name)) not in known}

    def _before_commit(self) -> None:
        """Tests let other writers in here."""

    def read(self, schema: StructType | str) -> DataFrame:
        """The committed rows, all parts in one scan."""
        empty = self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{e.part}" for e in self.entries() if e.part]
        return self.spark.read.schema(empty.schema).parquet(*[f"{p}/{BUCKET}=*" for p in paths]) if paths else empty
