r"""Token counts as delta-maintained rollups.

A batch of changes is a table (doc_id, source, lang, tokenizer, tokens, sign):
an insert is one row with sign +1, a delete the old row with sign -1, a revised
count the old row with -1 and the new one with +1; equal rows may come as one
with their number as sign. Totals by source, language and tokenizer version are
sums, so a batch reduces to one signed delta per key (map-side partial sums: a
hot source costs one row per task) and totals are the sum of the deltas.

A delta is written to a folder of its own that bears the batch id; an empty
marker file, created when all is written, is the commit. A lost executor or
driver before it leaves totals as they were. A repeat after it finds the batch
and changes nothing; where two committers of one batch do not see each other,
both folders are marked and one of them (the least by name) counts. No rename
is needed, so this holds on object stores too. ``compact`` replaces the deltas
so far by one folder of sums that lists the batches it stands for.

Null source or lang is a key of its own. A null or empty text has 0 tokens but
counts as a document; a text of any length is counted whole. Keys whose
documents and tokens sum to 0 leave the totals. A batch without rows commits
and changes nothing. Repeated rows each count. Extra columns, whatever their
names, are not read. An empty table gives empty totals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, new_folder, staged, text_of

KEYS = ["source", "lang", "tokenizer"]
#: Tokenizer versions: words are runs without blanks; v2 also splits letters and digits from other signs.
VERSIONS = {"words_v1": WORD, "words_v2": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"}


def count_of(text: Column, version: str) -> Column:
    return F.regexp_count(text, F.lit(VERSIONS[version])).cast("long")


def changes(df: DataFrame, version: str, sign: int, tokens: Column | None = None) -> DataFrame:
    return df.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), (count_of(text_of(), version) if tokens is None else tokens).cast("long").alias("tokens"), F.lit(sign).alias("sign"))


def signed_sums(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("n_tokens"))


class Rollup:
    """Totals kept in a folder that all machines share."""

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
    MARKER = "_COMMITTED"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _marked(self, kind: str) -> dict[str, str]:
        """Id -> folder of all marked folders of a kind; of several with one id the least by name."""
        out: dict[str, str] = {}
        for s in self._fs.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            if name.startswith(f"{kind}=") and self._fs.exists(self._path(f"{self.folder}/{name}/{self.MARKER}")):
                key = name.removeprefix(f"{kind}=").split(".")[0]
                out[key] = min(name, out.get(key, name))
        return {k: f"{self.folder}/{v}" for k, v in out.items()}

    def _mark(self, folder: str) -> None:
        self._fs.create(self._path(f"{folder}/{self.MARKER}"), False).close()

    def _base(self) -> tuple[str | None, set[str]]:
        """The folder of the last compaction and the batches it stands for."""
        found = self._marked("base")
        if not found:
            return None, set()
        last = found[max(found, key=int)]
        return f"{last}/sums", {r.batch for r in self.spark.read.schema("batch string").parquet(f"{last}/batches").collect()}

    def committed(self) -> set[str]:
        """Ids of the batches that count."""
        return set(self._marked("batch")) | self._base()[1]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once. False if it has been applied before."""
        if not batch or not batch.replace("_", "").replace("-", "").isalnum():
            raise ValueError("a batch id has letters, digits, '_' and '-'")
        if batch in self.committed():
            return False
        folder = f"{self.folder}/batch={batch}.{uuid.uuid4().hex}"
        signed_sums(changes).write.parquet(folder)
        self._mark(folder)
        return True

    def _listing(self) -> tuple[list[str], set[str]]:
        """The folders that make up the totals at one moment, and the batches they stand for. The base is read first: what it does not list is added from its own folder."""
        base, inside = self._base()
        rest = {batch: p for batch, p in sorted(self._marked("batch").items()) if batch not in inside}
        return [*rest.values(), *([base] if base else [])], inside | set(rest)

    def compact(self) -> None:
        """Sums up the batches of one listing; one that commits meanwhile keeps its own folder and counts beside the new base. Folders of the others may be removed by whoever knows that no reader is left; they count no more."""
        paths, done = self._listing()
        folder = f"{self.folder}/base={max(map(int, self._marked('base')), default=0) + 1}.{uuid.uuid4().hex}"
        self._sums(paths).write.parquet(f"{folder}/sums")
        self.spark.createDataFrame([(b,) for b in sorted(done)], "batch string").write.parquet(f"{folder}/batches")
        self._mark(folder)

    def deltas(self, paths: list[str] | None = None) -> DataFrame:
        paths = self._listing()[0] if paths is None else paths
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def _sums(self, paths: list[str] | None = None) -> DataFrame:
        return self.deltas(paths).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        return self._sums().where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def copies(table: DataFrame, version: str) -> DataFrame:
    """The changes that delete all but one row of each digest: that with the smallest doc_id (null last), then source and lang, stays.

    Equal (digest, source, lang) are counted first, map-side, so that no digest meets its first row more often than there
    are sources and languages.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "source", "lang")
    grouped = table.groupBy("digest", "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("least"), F.first(version).alias("tokens"))
    first = grouped.groupBy("digest").agg(F.min("least").alias("first"), F.sum("n").alias("rows")).where("rows > 1").select("digest", "first")
    stays = F.when(F.col("least") == F.col("first"), 1).otherwise(0)
    return grouped.join(first, "digest").select(F.col("least.doc_id").alias("doc_id"), "source", "lang", F.lit(version).alias("tokenizer"), "tokens", (stays - F.col("n")).alias("sign"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter under words_v1; their counts are revised to words_v2; later copies of a text are deleted; a batch is sent twice; deltas are compacted before the last ones."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    counted = docs.select("doc_id", "source", "lang", F.sha2(text_of().cast("binary"), 256).alias("digest"), *[count_of(text_of(), v).alias(v) for v in VERSIONS])
    table = staged(counted, "token_counts")
    book = Rollup(spark, new_folder(spark, "rollup"))
    rows = lambda v, sign: table.select("doc_id", "source", "lang", F.lit(v).alias("tokenizer"), F.col(v).alias("tokens"), F.lit(sign).alias("sign"))
    book.commit("load", rows("words_v1", 1))
    revised = rows("words_v1", -1).unionByName(rows("words_v2", 1))
    book.commit("retokenize", revised)
    book.compact()
    book.commit("delete_copies", copies(table, "words_v2"))
    book.commit("retokenize", revised)
    return book.totals()


SQL = r"""
WITH d AS (SELECT source, lang, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id, source NULLS FIRST, lang NULLS FIRST) AS k,
  len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) AS n FROM documents)
SELECT source, lang, 'words_v2' AS tokenizer, cast(count(*) AS BIGINT) AS n_docs, cast(sum(n) AS BIGINT) AS n_tokens FROM d WHERE k = 1 GROUP BY source, lang
"""
