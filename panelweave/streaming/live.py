"""Live variants: windowed totals under a watermark, an appending sink that repeats change nothing in, a level carried per county."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.ledger import Ledger
from ..sources.sinks import append_new


def daily_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Count and sum per day and event type; events later than ``late`` are left out in a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def append_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Writes each micro batch's new keys to a plain folder of one writer; a batch that comes again adds nothing."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_new(df.dropDuplicates(keys), path, keys) and None).trigger(availableNow=True).start()


def ledger_stream(rows: DataFrame, table: Ledger, checkpoint: str, name: str) -> StreamingQuery:
    """Commits each micro batch's new keys to a table under the stream's name and the batch's number; a batch that comes again adds nothing, keys are pruned by bucket."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: table.append(f"{name}-{n}", df) and None).trigger(availableNow=True).start()


def totals_stream(events: DataFrame, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Daily totals as they change: every batch writes the windows that it has changed to a folder of its own, which a repeat overwrites."""
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/changed={n}")
    return daily_totals(events, late).writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(write).trigger(availableNow=True).start()


def latest_totals(changes: DataFrame) -> DataFrame:
    """The last state of each window from what totals_stream has written."""
    last = changes.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select("day", "event_type", "x.n", "x.total")


def carried_levels(flows: DataFrame) -> DataFrame:
    """(fips, year, level) from a stream of (fips, year, flow, start): the first level is start, each later one adds its flow. Years of a county come in order."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("year")
        out = []
        for r in rows.itertuples(index=False):
            level = r.start if level is None else level + r.flow
            out.append((key[0], r.year, float(level)))
        state.update((float(level),))
        yield pd.DataFrame(out, columns=["fips", "year", "level"])

    return flows.groupBy("fips").applyInPandasWithState(step, "fips string, year int, level double", "level double", "append", GroupStateTimeout.NoTimeout)
