r"""Co-bucketed table pair by a distributed sorted-key index.

Two tables lie in numbered Parquet files and are rewritten so that rows that
join lie in files of one number: bucket crc32("s" || id) mod BUCKETS. The
index of the first table's ids is a file for each bucket: sorted blocks of
unique ids with their counts, and the first id of every block. Lines probe it
by searchsorted. First only their keys do (starting file and id with a count):
that gives orphan flags, the joined rows of a bucket and how many rows go from
which starting file to which bucket, without joining or moving any payload. A
starting file with just the rows of one final file stays where it is. The
rows of the others are shuffled once by bucket and sorted; while a task writes
a bucket, the sorted ids go along the index, so what has no partner is set
aside and, that alone, shuffled once more to the orphans' file.

What goes through the driver, a broadcast or one task is bounded by the number
of buckets (paths and counts of files), but for a file that has to be whole:
one task writes it, streaming, from Spark's sort. Files get a new name
with every attempt; only those that Spark has committed to a manifest count, and
what else lies in the table's folder at the end is removed. Index files of a
bucket have the same content at every attempt and are moved into place whole.

Lines without a partner go to bucket BUCKETS, rows of either table without id to
BUCKETS + 1. Repeated rows and repeated ids stay and count as often as they
occur; fully equal rows are ties that need no order. Columns may have any names
and any types that can be sorted; extra columns are moved along. An empty table
has no files; without sales all lines with an id are orphans. There is no limit
on the length of texts in the rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window as W

from .common import filesystem, new_folder, staged

BUCKETS = 600
INDEX_BLOCK = 1 << 16
KEPT_BLOCKS = 16
ROW_GROUP = 1 << 26  # bytes of a row group before compression
FILES = "number int, path string, orphans boolean"
MOVES = "start int, bucket int, n long, n_joined long"


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of an id, were it to have a partner."""
    return F.when(F.col(key).isNull(), buckets + 1).otherwise(F.pmod(F.crc32(F.concat(F.lit("s"), F.col(key).cast("string")).cast("binary")), F.lit(buckets))).cast("int")


class Index:
    """Reads the index files of a folder, block by block, and keeps a few of them."""

    def __init__(self, folder: str):
        self.folder = folder
        self.fs, _ = filesystem(folder)
        self.heads: OrderedDict[int, tuple] = OrderedDict()
        self.blocks: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()

    @staticmethod
    def path(folder: str, bucket: int) -> str:
        return f"{folder}/{bucket:05d}.idx"

    def _head(self, bucket: int) -> tuple:
        """The open file, the first id of each block and the number of ids."""
        if bucket not in self.heads:
            _, path = filesystem(self.path(self.folder, bucket))
            if self.fs.get_file_info(path).is_file:
                file = self.fs.open_input_file(path)
                file.seek(file.size() - 16)
                n, blocks = np.frombuffer(file.read(16), "<i8").tolist()
                file.seek(16 * n)
                self.heads[bucket] = file, np.frombuffer(file.read(8 * blocks), "<i8"), n
            else:
                self.heads[bucket] = None, np.zeros(0, np.int64), 0
            if len(self.heads) > KEPT_BLOCKS:
                _, (old, _, _) = self.heads.popitem(last=False)
                if old is not None:
                    old.close()
        return self.heads[bucket]

    def _block(self, bucket: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        if (bucket, k) not in self.blocks:
            file, _, n = self._head(bucket)
            size = min(INDEX_BLOCK, n - k * INDEX_BLOCK)
            file.seek(16 * k * INDEX_BLOCK)
            both = np.frombuffer(file.read(16 * size), "<i8")
            self.blocks[bucket, k] = both[:size], both[size:]
            if len(self.blocks) > KEPT_BLOCKS:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end((bucket, k))
        return self.blocks[bucket, k]

    def counts(self, bucket: int, ids: np.ndarray) -> np.ndarray:
        """How often each of these ids occurs in the indexed table."""
        out = np.zeros(len(ids), np.int64)
        _, firsts, n = self._head(bucket)
        if not n:
            return out
        block = np.searchsorted(firsts, ids, side="right") - 1
        for k in np.unique(block[block >= 0]).tolist():
            keys, counts = self._block(bucket, k)
            at = np.flatnonzero(block == k)
            place = np.minimum(np.searchsorted(keys, ids[at]), len(keys) - 1)
            found = keys[place] == ids[at]
            out[at[found]] = counts[place[found]]
        return out


def build_index(df: DataFrame, key: str, folder: str, buckets: int = BUCKETS) -> str:
    """Writes the sorted unique ids of df with their counts, a file for each bucket that has any."""
    _, place = filesystem(folder)
    filesystem(folder)[0].create_dir(place)
    unique = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, now, file, written = filesystem(folder)[0], None, None, []

        def flush(waiting: list[np.ndarray], all_of_it: bool) -> list[np.ndarray]:
            nonlocal size
            ids, n = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else (np.zeros(0, np.int64),) * 2
            while len(ids) >= INDEX_BLOCK or all_of_it and len(ids):
                firsts.append(int(ids[0]))
                file.write(ids[:INDEX_BLOCK].astype("<i8").tobytes() + n[:INDEX_BLOCK].astype("<i8").tobytes())
                size += min(INDEX_BLOCK, len(ids))
                ids, n = ids[INDEX_BLOCK:], n[INDEX_BLOCK:]
            return [(ids, n)] if len(ids) else []

        def finish() -> None:
            flush(waiting, True)
            file.write(np.array([*firsts, size, len(firsts)], "<i8").tobytes())
            file.close()
            fs.move(at, filesystem(Index.path(folder, now))[1])
            written.append((now, size))

        for b in batches:
            bucket, ids, n = (b.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for i, j in pairwise(cuts):
                if i == j:
                    continue
                if bucket[i] != now:
                    if file is not None:
                        finish()
                    now, size, firsts, waiting = int(bucket[i]), 0, [], []
                    at = f"{place}/.{now}-{uuid.uuid4().hex}"
                    file = fs.open_output_stream(at)
                waiting.append((ids[i:j], n[i:j]))
                if sum(len(x) for x, _ in waiting) >= INDEX_BLOCK:
                    waiting = flush(waiting, False)
        if file is not None:
            finish()
        if written:
            yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in written], pa.int32()), pa.array([w[1] for w in written], pa.int64())], ["bucket", "n"])

    dealt = unique.select(bucket_of("id", buckets).alias("bucket"), "id", "n").repartition("bucket").sortWithinPartitions("bucket", "id")
    dealt.mapInArrow(run, "bucket int, n long").write.parquet(f"{folder}/built")
    return folder


def write_numbered(df: DataFrame, number: Column, key: str, folder: str, prefix: str = "", index: str | None = None, buckets: int = BUCKETS) -> list[tuple[int, str, bool]]:
    """Writes a sorted file for each number that occurs: (number, path, False). With index, rows without a partner go to files of their own: (number, path, True)."""
    own = "_number"
    while own in df.columns:
        own += "_"
    order = [F.asc(own), F.asc_nulls_first(key), *(F.asc_nulls_first(c) for c in df.columns if c != key)]
    aside = new_folder(df.sparkSession, "no_partner")
    for place in (folder, aside) if index else (folder,):
        fs, path = filesystem(place)
        fs.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Index(index) if index else None
        out: dict[bool, OneFile] = {}
        now, done = None, []

        def finish() -> None:
            for lone, file in out.items():
                file.close()
                done.append((now, file.uri, lone))
            out.clear()

        def put(rows: pa.RecordBatch, lone: bool) -> None:
            if rows.num_rows:
                if lone not in out:
                    out[lone] = OneFile(f"{aside if lone else folder}/{prefix}{now:05d}-{uuid.uuid4().hex}.parquet")
                out[lone].put(rows)

        for b in batches:
            numbers = b.column(b.num_columns - 1).to_numpy()
            rows = b.select(b.schema.names[:-1])
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, j in pairwise(cuts):
                if i == j:
                    continue
                if numbers[i] != now:
                    finish()
                    now = int(numbers[i])
                part = rows.slice(i, j - i)
                if found and now < buckets:
                    met = found.counts(now, part.column(rows.schema.get_field_index(key)).cast(pa.int64()).to_numpy()) > 0
                    put(part.filter(pa.array(~met)), True)
                    part = part.filter(pa.array(met))
                put(part, False)
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.bool_()), strict=True)], ["number", "path", "orphans"])

    numbered = df.withColumn(own, number).repartition(own).sortWithinPartitions(*order)
    return [tuple(r) for r in staged(numbered.mapInArrow(run, FILES), "files").collect()]


class OneFile:
    """A Parquet file written in row groups of bounded size."""

    def __init__(self, uri: str):
        self.uri, self.waiting, self.writer = uri, [], None

    def put(self, rows: pa.RecordBatch) -> None:
        self.waiting.append(rows)
        if sum(b.nbytes for b in self.waiting) >= ROW_GROUP:
            self._flush()

    def _flush(self) -> None:
        table = pa.Table.from_batches(self.waiting)
        if self.writer is None:
            fs, path = filesystem(self.uri)
            self.stream = fs.open_output_stream(path)
            self.writer = pq.ParquetWriter(self.stream, table.schema, compression="snappy")
        self.writer.write_table(table, row_group_size=table.num_rows)
        self.waiting = []

    def close(self) -> None:
        if self.waiting:
            self._flush()
        self.writer.close()
        self.stream.close()


def numbered_rows(spark: SparkSession, schema: S.StructType, paths: list[str], start: str) -> DataFrame:
    """The rows of files that write_numbered has written, with their file's number in column start."""
    if not paths:
        return spark.createDataFrame([], schema).withColumn(start, F.lit(None).cast("int"))
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)-[0-9a-f]+\.parquet$", 1).cast("int")
    return spark.read.schema(schema).parquet(*paths).withColumn(start, number)


def moves(rows: DataFrame, key: str, start: str, index: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """How many rows go from which starting file to which bucket, and how many they give when joined; keys alone are read.

    With index, ids probe it: what has no partner goes to the orphans' bucket.
    """
    keys = rows.groupBy(F.col(start).alias("start"), F.col(key).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    keys = keys.select("start", bucket_of("id", buckets).alias("bucket"), "n", "id")
    none = F.lit(0).cast("long").alias("n_joined")
    if index is None:
        found = keys.select("start", "bucket", "n", none)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sought = Index(index)
            for b in batches:
                bucket, n, ids = (b.column(i).to_numpy() for i in (1, 2, 3))
                partners = np.zeros(len(n), np.int64)
                for k in np.unique(bucket).tolist():
                    at = bucket == k
                    partners[at] = sought.counts(k, ids[at])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(partners > 0, bucket, buckets).astype(np.int32)), b.column(2), pa.array(n * partners)], ["start", "bucket", "n", "n_joined"])

        probed = keys.where("id IS NOT NULL").repartition("bucket").mapInArrow(run, MOVES)
        found = probed.unionByName(keys.where("id IS NULL").select("start", "bucket", "n", none))
    return staged(found.groupBy("start", "bucket").agg(F.sum("n").alias("n"), F.sum("n_joined").alias("n_joined")), "moves")


@dataclass
class Table:
    """A rewritten table: its final files (bucket, path, rewritten) and how its rows moved."""

    name: str
    files: list[tuple[int, str, bool]]
    moves: DataFrame


def rewrite(name: str, df: DataFrame, key: str, start: Column, folder: str, index: str | None = None, buckets: int = BUCKETS) -> Table:
    """Writes df in numbered starting files and brings those into buckets; afterwards folder holds the final files alone."""
    spark, schema, number = df.sparkSession, df.schema, "_start"
    while number in df.columns:
        number += "_"
    starting = {n: path for n, path, _ in write_numbered(df, start, key, folder, "start-")}
    moved = moves(numbered_rows(spark, schema, list(starting.values()), number), key, number, index, buckets)
    alone = [F.count(F.lit(1)).over(W.partitionBy(c)) for c in ("start", "bucket")]
    stay = {r.start: r.bucket for r in moved.select("start", "bucket", (alone[0] == 1).alias("a"), (alone[1] == 1).alias("b")).where("a AND b").collect()}
    rest = numbered_rows(spark, schema, [path for n, path in starting.items() if n not in stay], number).drop(number)
    written = write_numbered(rest, bucket_of(key, buckets), key, folder, "", index, buckets)
    files = [(stay[n], path, False) for n, path in starting.items() if n in stay] + [(n, path, True) for n, path, lone in written if not lone]
    if lone := [path for _, path, lone in written if lone]:
        orphans = numbered_rows(spark, schema, lone, number).drop(number)
        files += [(n, path, True) for n, path, _ in write_numbered(orphans, F.lit(buckets).cast("int"), key, folder, "", None, buckets)]
    fs, place = filesystem(folder)
    final = {filesystem(path)[1] for _, path, _ in files}
    for info in fs.get_file_info(FileSelector(place)):
        if info.is_file and info.path not in final:
            fs.delete_file(info.path)
    return Table(name, files, moved)


def read_back(files: DataFrame, key: str) -> DataFrame:
    """files (table_name, bucket, path, rewritten) with columns, ids_sha256 and n_rows as the files have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as stream:
                    file, digest, n = pq.ParquetFile(stream), hashlib.sha256(), 0
                    for part in file.iter_batches(columns=[key]):
                        ids = pc.fill_null(part.column(0).cast(pa.string()), "").to_pylist()
                        digest.update(("," * (n > 0) + ",".join(ids)).encode())
                        n += len(ids)
                    columns = ",".join(file.schema_arrow.names)
                yield pa.RecordBatch.from_pylist([row | {"columns": columns, "ids_sha256": digest.hexdigest(), "n_rows": n}], read)

    read = pa.schema([("table_name", pa.string()), ("bucket", pa.int64()), ("path", pa.string()), ("rewritten", pa.bool_()), ("columns", pa.string()), ("ids_sha256", pa.string()), ("n_rows", pa.int64())])
    return files.mapInArrow(run, "table_name string, bucket long, path string, rewritten boolean, columns string, ids_sha256 string, n_rows long")


def described(spark: SparkSession, tables: list[Table], key: str) -> DataFrame:
    """A row for each final file. tables: the indexed one first, then the one that probes it, whose moves hold the joined rows."""
    rows = [(t.name, *f) for t in tables for f in t.files]
    files = spark.createDataFrame(rows, "table_name string, bucket long, path string, rewritten boolean").repartition(max(1, min(len(rows), 200)))
    steps = F.array_sort(F.collect_list(F.struct("start", "n")))
    line = F.concat_ws(",", F.transform(steps, lambda x: F.concat_ws(":", x["start"], x["n"])))
    lineage = [t.moves.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.sha2(line, 256).alias("lineage_sha256")).withColumn("table_name", F.lit(t.name)) for t in tables]
    joined = tables[-1].moves.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.sum("n_joined").alias("n_joined"))
    out = read_back(files, key).join(reduce(DataFrame.unionByName, lineage), ["table_name", "bucket"]).join(joined, "bucket", "left")
    return out.select("table_name", "path", "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows", F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"), "rewritten")


def cobucket(left: DataFrame, right: DataFrame, key: str, starts: tuple[Column, Column], names: tuple[str, str], folder: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes left and right into folder, a subfolder for each, brings both into buckets by key and describes the final files."""
    spark = left.sparkSession
    one = rewrite(names[0], left, key, starts[0], f"{folder}/{names[0]}", None, buckets)
    paths = [path for _, path, _ in one.files]
    indexed = numbered_rows(spark, left.schema, paths, "_")
    index = build_index(indexed.select(key), key, new_folder(spark, "key_index"), buckets)
    two = rewrite(names[1], right, key, starts[1], f"{folder}/{names[1]}", index, buckets)
    return described(spark, [one, two], key)


def report(sales: DataFrame, lines: DataFrame, folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """sales and sale_lines in starting files by bucket (one in four a file too low) and by item, brought into buckets by sale_id."""
    b = bucket_of("sale_id", buckets)
    by_item = F.coalesce(F.pmod(F.crc32(F.col("item_id").cast("string").cast("binary")), F.lit(buckets)), F.lit(0)).cast("int")
    starts = b - (b % 4 == 1).cast("int"), by_item
    return cobucket(sales, lines, "sale_id", starts, ("sales", "sale_lines"), folder or new_folder(sales.sparkSession, "cobucketed"), buckets)
