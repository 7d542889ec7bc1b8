"""Readers, sinks and streams on the driver's tables: each query writes to a folder of its own and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.nulls import safe_ln
from ..functions.vectors import column_moments
from ..operators import graph as G
from ..sources import files as S
from ..sources import sinks as K
from ..sources.ledger import Ledger
from ..streaming import live
from . import base as B
from .registry import query
from .relational import r


def folder(s, name):
    return f"{K.shared_folder(s)}/panelweave/{uuid.uuid4().hex}/{name}"


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def tsv_scan(s, d):
    path = folder(s, "tsv")
    B.table(s, d, "customer").select(F.col("c_custkey").alias(" ID "), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("SEGMENT ")).write.csv(path, sep="\t", header=True, compression="gzip")
    return S.read_tsv(s, path).select(F.col("id").cast("long").alias("id"), "name", "segment")


@query("SELECT p_partkey AS id, p_name || ' é' AS name FROM part")
def latin1_scan(s, d):
    path = folder(s, "latin1")
    B.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" é")).alias("name")).write.csv(path, header=True, encoding="ISO-8859-1")
    return S.read_latin1(s, path).select(F.col("id").cast("long").alias("id"), "name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def parquet_scan_where(s, d):
    return S.read_parquet(s, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"], F.col("o_orderstatus") == "F")


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS fips, 25 + s_suppkey % 25 + 0.5::DOUBLE AS lat, -(70 + s_suppkey % 50)::DOUBLE AS lon FROM supplier WHERE s_suppkey % 7 > 1")
def gazetteer_coordinates(s, d):
    k = F.col("s_suppkey")
    text = lambda c: F.when(k % 7 == 0, "nan").when(k % 7 == 1, "").otherwise(c.cast("string"))
    raw = B.table(s, d, "supplier").select(k.cast("string").alias("GEOID"), text(25 + k % 25 + 0.5).alias("INTPTLAT "), F.concat(F.lit(" "), (-(70 + k % 50)).cast("string")).alias("INTPTLONG"))
    return S.coordinates(raw)


@query("SELECT o_orderkey, o_custkey FROM orders")
def append_new_twice(s, d):
    """Half of the orders, then all of them, then all of them again: each key is there once."""
    path, o = folder(s, "appended"), B.table(s, d, "orders").select("o_orderkey", "o_custkey")
    for rows in (o.where("o_orderkey % 2 = 0"), o, o):
        K.append_new(rows, path, ["o_orderkey"])
    return s.read.parquet(path)


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) = 1998")
def partitioned_by_year(s, d):
    path = folder(s, "by_year")
    K.overwrite_by(B.table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), path, "year")
    return s.read.parquet(path).where("year = 1998")


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def daily_event_totals(s, d):
    t = live.daily_totals(B.table(s, d, "events"))
    return t.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", r("total", 3).alias("total"))


@query("SELECT event_id, user_id, event_type FROM events")
def streamed_append(s, d):
    """events as a stream, two times over with new checkpoints: the second run finds every key."""
    whole = B.table(s, d, "events")
    table = Ledger(s, folder(s, "events"), ["event_id"])
    for i in range(2):
        rows = s.readStream.schema(whole.schema).option("pathGlobFilter", "events.parquet").parquet(d).select("event_id", "user_id", "event_type")
        live.ledger_stream(rows, table, folder(s, f"checkpoint{i}"), f"run{i}").awaitTermination()
    return table.read(whole.select("event_id", "user_id", "event_type").schema)


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def streamed_daily_totals(s, d):
    """events in several files, a micro batch each, windowed under a watermark wide enough that nothing is late; the last state of every window."""
    events, source, out = B.table(s, d, "events").select("event_id", "ts", "event_type", "value"), folder(s, "event_files"), folder(s, "totals")
    events.repartition(3, "event_id").write.parquet(source)
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    live.totals_stream(stream, out, folder(s, "totals_checkpoint"), "4000 days").awaitTermination()
    t = live.latest_totals(s.read.parquet(out))
    return t.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", r("total", 3).alias("total"))


_ONLINE = "WITH " + B.PANEL + """, p AS (SELECT (ln(base) - 12) / 2 AS z, ln(truth) - ln(base) - 0.5 * (ln(base) - 12) / 2 - 0.1 AS t FROM panel),
 m AS (SELECT count(*)::DOUBLE AS n, covar_pop(z, t) / (var_pop(z) + 0.05) AS c, avg(t) AS mt, avg(z) AS mz FROM p), f AS (SELECT n, c, mt - c * mz AS i, sqrt(c * c + (mt - c * mz) * (mt - c * mz)) AS l, 0.05 * sqrt(0.26) AS most FROM m)
 SELECT n, l > most AS shortened, round(c * least(1, most / l), 6) AS delta, round(i * least(1, most / l), 6) AS shift FROM f"""


@query(_ONLINE)
def streamed_model_updates(s, d):
    """The panel in several files, a micro batch each: the last correction of a model with one feature, bounded."""
    import numpy as np

    from ..operators.models import Linear
    from ..streaming import online

    source, out = folder(s, "panel_files"), folder(s, "model_states")
    rows = B.panel(s, d).select("fips", F.array(F.log("base")).alias("x"), (F.log("truth") - F.log("base")).alias("y"))
    rows.repartition(3, "fips").write.parquet(source)
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    base = Linear(np.array([12.0]), np.array([2.0]), np.array([0.5]), 0.1, 1.0)
    online.update_stream(stream, base, out, folder(s, "model_checkpoint"), "panel", 0.05).awaitTermination()
    last = online.states(s, out).read(online.STATE)
    last = last.agg(*[F.max_by(c, "batch").alias(c) for c in ("n", "shortened", "delta", "shift")])
    return last.select("n", "shortened", r(F.col("delta")[0]).alias("delta"), r("shift").alias("shift"))


@query("SELECT o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY o_orderkey")
def ledger_appends(s, d):
    """Batches that overlap, one of them twice, an empty one: each key once."""
    o = B.table(s, d, "orders").select("o_orderkey", "o_custkey")
    table = Ledger(s, folder(s, "ledger"), ["o_orderkey"])
    for batch, rows in (("a", o.where("o_orderkey % 2 = 0")), ("b", o.where("o_orderkey % 3 = 0")), ("a", o), ("none", o.where("false")), ("c", o)):
        table.append(batch, rows)
    return table.read(o.schema)


@query("SELECT l_suppkey AS src, l_partkey % 100 AS dst, sum(l_linenumber)::DOUBLE AS weight FROM lineitem WHERE l_suppkey % 3 = 0 AND l_partkey % 100 % 3 = 0 GROUP BY ALL")
def restricted_edges(s, d):
    edges = B.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst")).agg(F.sum(F.col("l_linenumber").cast("double")).alias("weight"))
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().where("node % 3 = 0")
    return G.restricted(edges, ends)


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS log FROM customer")
def guarded_logarithm(s, d):
    return B.table(s, d, "customer").select("c_custkey", r(safe_ln(F.col("c_acctbal"))).alias("log"))


@query("WITH x AS (SELECT generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT CAST(pos AS INT) AS pos, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS scale FROM x GROUP BY pos")
def embedding_moments(s, d):
    m = column_moments(B.table(s, d, "embeddings"), "embedding")
    return m.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("pos", "z")).select("pos", r("z.mean", 5).alias("mean"), r("z.scale", 5).alias("scale"))
