"""Alignment, coordinates, graph runs and small encoders on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import zfill
from ..operators import align as A
from ..operators import epochs as E
from ..operators import losses as L
from ..sources.sinks import shared_folder
from . import base as B
from .registry import query
from .relational import r

CODE = "lpad(CAST({0} AS VARCHAR), CAST(greatest(5, length(CAST({0} AS VARCHAR))) AS INT), '0')"
PLACES = "(25 + s_suppkey * 7 % 25)::DOUBLE AS lat, -(70 + s_suppkey * 13 % 55)::DOUBLE AS lon"


def code(c):
    return zfill(F.col(c).cast("string"), 5)


def places(s, d):
    k = F.col("s_suppkey")
    return B.table(s, d, "supplier").select(code("s_suppkey").alias("fips"), (25 + k * 7 % 25).cast("double").alias("lat"), (-(70 + k * 13 % 55)).cast("double").alias("lon"))


@query("WITH " + B.COUNTIES + f""", e AS (SELECT {CODE.format('vec_id')} AS fips, embedding AS x FROM embeddings) SELECT c.fips, round(x[1]::DOUBLE, 6) AS first, x IS NOT NULL AS emb_mask, c.division <> 0 AS mem_mask, CASE WHEN c.division <> 0 THEN c.division::DOUBLE END AS mem
 FROM counties c LEFT JOIN e ON c.fips = e.fips""")
def aligned_modalities(s, d):
    c = B.counties(s, d)
    emb = B.table(s, d, "embeddings").select(code("vec_id").alias("fips"), F.col("embedding").alias("x"))
    mem = c.where("division <> 0").select("fips", F.array(F.col("division").cast("double")).alias("x"))
    out = A.with_modalities(c.select("fips"), {"emb": emb, "mem": mem})
    return out.select("fips", r(F.col("emb")[0].cast("double")).alias("first"), "emb_mask", "mem_mask", F.col("mem")[0].alias("mem"))


@query("WITH " + B.COUNTIES + f", p AS (SELECT {CODE.format('s_suppkey')} AS fips, {PLACES} FROM supplier) SELECT c.fips, coalesce(lat, 0) AS lat, coalesce(lon, 0) AS lon, lat IS NOT NULL AS valid FROM counties c LEFT JOIN p ON c.fips = p.fips")
def coordinates_with_validity(s, d):
    return A.coordinates_for(B.counties(s, d).select("fips"), places(s, d))


@query(f"SELECT {CODE.format('c_custkey')} AS fips FROM customer WHERE c_custkey IN (SELECT vec_id FROM embeddings) AND c_custkey IN (SELECT s_suppkey FROM supplier)")
def graph_pack_common(s, d):
    emb = B.table(s, d, "embeddings").select(code("vec_id").alias("fips"))
    return A.in_every(B.table(s, d, "customer").select(code("c_custkey").alias("fips")), [emb, places(s, d)])


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS down, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INT) AS up FROM orders")
def hard_ranks(s, d):
    o = B.table(s, d, "orders")
    return o.select("o_custkey", "o_orderkey", A.hard_rank("o_totalprice", "o_custkey", "o_orderkey", True).alias("down"), A.hard_rank("o_totalprice", "o_custkey", "o_orderkey").alias("up"))


@query("""WITH x AS (SELECT c_nationkey, CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE c_acctbal / 100 + CASE WHEN c_nationkey % 2 = 0 THEN 1e9 ELSE 0 END END AS x, (c_custkey % 7 + 1)::DOUBLE AS w FROM customer),
 m AS (SELECT c_nationkey, sum(w * (x - 1e9 * (1 - c_nationkey % 2))) / sum(w) + 1e9 * (1 - c_nationkey % 2) AS m, count(x) AS n FROM x WHERE x IS NOT NULL GROUP BY c_nationkey)
 SELECT x.c_nationkey, round(CASE WHEN max(n) <= 1 THEN 0 ELSE sqrt(sum(w * pow(x - m, 2)) / sum(w)) END, 4) AS deviation FROM x JOIN m ON x.c_nationkey = m.c_nationkey WHERE x IS NOT NULL GROUP BY x.c_nationkey""")
def weighted_deviation(s, d):
    """Some values are missing, half of the nations have means of 1e9."""
    k = F.col("c_nationkey")
    x = F.when(F.col("c_custkey") % 11 != 3, F.col("c_acctbal") / 100 + F.when(k % 2 == 0, 1e9).otherwise(0.0))
    out = A.weighted_deviations(B.table(s, d, "customer"), ["c_nationkey"], x, F.col("c_custkey") % 7 + 1)
    return out.select("c_nationkey", r("deviation", 4).alias("deviation"))


@query(f"""WITH p AS (SELECT {PLACES}, s_acctbal AS x FROM supplier), m AS (SELECT max(abs(lat)) AS lat, max(abs(lon)) AS lon, max(abs(x)) AS x FROM p), o AS (SELECT 'lat,lon' AS pair, lat AS a, lon AS b FROM m UNION ALL SELECT 'lon,lat', lon, lat FROM m UNION ALL SELECT 'x,lat', x, lat FROM m)
 SELECT pair, CASE WHEN a <= 90 AND b <= 180 THEN 'latlon_01' WHEN b <= 90 AND a <= 180 THEN 'latlon_10' ELSE 'xy' END AS mode FROM o""")
def coordinate_orders(s, d):
    p = places(s, d).join(B.table(s, d, "supplier").select(code("s_suppkey").alias("fips"), F.col("s_acctbal").alias("x")), "fips")
    parts = [A.coordinate_order(p, a, b).select(F.lit(f"{a},{b}").alias("pair"), "mode") for a, b in (("lat", "lon"), ("lon", "lat"), ("x", "lat"))]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""WITH p AS (SELECT s_suppkey, {PLACES} FROM supplier), m AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS e FROM p), h AS (SELECT s_suppkey, (lon - c) / greatest(e - c, 1e-9) AS h, 0.35 + 0.6::DOUBLE * (lat - a) / greatest(b - a, 1e-9) AS v FROM p, m),
 k AS (SELECT s_suppkey, v, fmod(5 + h * 6, 6) AS k5, fmod(3 + h * 6, 6) AS k3, fmod(1 + h * 6, 6) AS k1 FROM h)
 SELECT s_suppkey AS id, round(v - v * 0.75 * greatest(0, least(k5, 4 - k5, 1)), 6) AS red, round(v - v * 0.75 * greatest(0, least(k3, 4 - k3, 1)), 6) AS green, round(v - v * 0.75 * greatest(0, least(k1, 4 - k1, 1)), 6) AS blue FROM k""")
def geography_colours(s, d):
    return A.geography_colour(places(s, d)).select(F.col("fips").cast("long").alias("id"), *[r(c).alias(c) for c in ("red", "green", "blue")])


@query("WITH " + B.PANEL + """, t AS (SELECT fips, year, CASE WHEN year % 2 = 0 THEN truth END AS t, base AS p, (truth + 2 * base) / 3 AS c FROM panel)
 SELECT fips, year, round(ln(t) - ln(p), 6) AS resid_true, round(ln(c) - ln(p), 6) AS resid_pred, round(abs(p - t) / t * 100, 5) AS pep_ape, round(abs(c - t) / t * 100, 5) AS corrected_ape, round((abs(c - t) - abs(p - t)) / t * 100, 5) AS delta FROM t""")
def trajectory_errors(s, d):
    p = B.panel(s, d).select("fips", "year", F.when(F.col("year") % 2 == 0, F.log("truth")).alias("y_log"), F.log("base").alias("pep_log"), F.log((F.col("truth") + 2 * F.col("base")) / 3).alias("corrected_log"))
    t = A.trajectory_rows(p)
    return t.select("fips", "year", r("resid_true").alias("resid_true"), r("resid_pred").alias("resid_pred"), r("pep_ape_pct", 5).alias("pep_ape"), r("corrected_ape_pct", 5).alias("corrected_ape"), r("delta_ape_pct", 5).alias("delta"))


def topology_folder(s, d):
    """A run of 2020 in a folder of its own: suppliers and parts as nodes, weights 0 to 6, of which 6 stands for one that is not finite."""
    folder = f"{shared_folder(s)}/panelweave/{uuid.uuid4().hex}/topology"
    line = B.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst")).agg((F.sum(F.col("l_linenumber").cast("long")) % 7).cast("double").alias("w"))
    edges = line.select("src", "dst", F.when(F.col("w") == 6, float("inf")).otherwise(F.col("w")).alias("weight"))
    basis = B.table(s, d, "embeddings").select(F.col("vec_id").alias("fips"), F.slice("embedding", 1, 3).alias("basis"))
    A.write_topology(folder, {"graph_tag": "t", "graph_kind": "knn", "source_year": 2020, "train_loss": 0.5}, basis, edges)
    return folder


@query(f"SELECT {CODE.format('src')} AS src_fips, {CODE.format('dst')} AS dst_fips, w AS edge_weight FROM (SELECT l_suppkey AS src, l_partkey % 100 AS dst, CAST(sum(l_linenumber) % 7 AS DOUBLE) AS w FROM lineitem GROUP BY ALL) WHERE w NOT IN (0, 6)")
def topology_edge_scan(s, d):
    return A.topology_edges(s, topology_folder(s, d), "t", "knn", 2020)


@query(f"SELECT {CODE.format('vec_id')} AS fips, CAST(i - 1 AS INT) AS basis_index, round(embedding[i]::DOUBLE, 6) AS basis_value FROM embeddings, range(1, 4) AS t(i)")
def topology_basis_scan(s, d):
    return A.topology_basis(s, topology_folder(s, d), "t", "knn", 2020).select("fips", "basis_index", r(F.col("basis_value").cast("double")).alias("basis_value"))


@query("WITH " + B.YEARLY + ", y AS (SELECT year + 20 AS year, count(*) AS n FROM yearly GROUP BY ALL) SELECT year, n, CASE WHEN year = 2020 THEN 't' END AS graph_tag, CASE WHEN year = 2020 THEN 0.5::DOUBLE END AS train_loss FROM y")
def metrics_with_topology(s, d):
    y = B.yearly(s, d).groupBy((F.col("year") + 20).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return A.with_topology(y, s, topology_folder(s, d)).select("year", "n", "graph_tag", "train_loss")


@query("""SELECT n_nationkey, CAST(json_object('key', n_nationkey, 'name', n_name, 'region', n_regionkey) AS VARCHAR) AS payload, CAST(json_array(n_nationkey, n_regionkey, 1) AS VARCHAR) AS affine FROM nation""")
def json_encoded(s, d):
    n = B.table(s, d, "nation")
    cols = {"region": F.col("n_regionkey"), "name": F.col("n_name"), "key": F.col("n_nationkey")}
    return n.select("n_nationkey", F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)])).alias("payload"), F.to_json(F.array("n_nationkey", "n_regionkey", F.lit(1))).alias("affine"))


@query("""WITH c AS (SELECT count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL INTERSECT SELECT vec_id FROM embeddings)) SELECT CAST(e AS INT) AS epoch, n, n AS n_positions, CAST(0 AS BIGINT) AS low, n - 1 AS high, n AS n_agree, CAST(ceil(n / 64.0) AS BIGINT) AS n_batches FROM c, range(3) AS t(e)""")
def aligned_epochs(s, d):
    """Documents and embeddings of the same number as two modalities, three epochs: every sample once, at the same place in both."""
    texts = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang").dropDuplicates(["id"])
    vectors = B.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    frames = {"texts": texts, "vectors": vectors}
    index, n = E.numbered(E.common_samples(frames, ["id"]), ["id"])
    out = None
    for e in range(3):
        a, b = (E.in_order(f, index, n, ["id"], e, 64) for f in frames.values())
        both = a.join(b.select("id", F.col("position").alias("other")), "id")
        agree = F.sum((F.col("position") == F.col("other")).cast("long"))
        row = both.agg(F.lit(e).alias("epoch"), F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("n_positions"), F.min("position").alias("low"), F.max("position").alias("high"), agree.alias("n_agree"), F.countDistinct("batch").alias("n_batches"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), b AS (SELECT vec_id, 1 AS j, (vec_id % 7)::DOUBLE AS w FROM embeddings UNION ALL SELECT vec_id, 2, (vec_id % 11)::DOUBLE FROM embeddings),
 c AS (SELECT i, j, count(*) AS n, covar_pop(v, w) / stddev_pop(v) / stddev_pop(w) * count(*) / (count(*) - 1) AS c FROM x JOIN b USING (vec_id) GROUP BY i, j) SELECT max(n) AS n, round(avg(c * c), 8) AS penalty FROM c""")
def linear_dependence(s, d):
    e = B.table(s, d, "embeddings").select("embedding", F.array(F.col("vec_id") % 7, F.col("vec_id") % 11).alias("other"))
    return L.dependence(e, "embedding", "other").select("n", r("penalty", 8).alias("penalty"))


@query("""WITH p AS (SELECT l_suppkey AS src, l_partkey AS dst, max(l_extendedprice) AS sim, l_partkey * 7919 % 10007 + l_partkey / 100000.0 AS dist FROM lineitem GROUP BY ALL),
 k AS (SELECT src, count(*) OVER w AS n, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) - row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS off FROM p WINDOW w AS (PARTITION BY src)) SELECT src, n, round(avg(pow(off / (n - 1.0), 2)), 6) AS hard FROM k WHERE n >= 2 GROUP BY src, n""")
def geo_rank_hard_losses(s, d):
    """Parts as neighbours of their suppliers: how far the order by price is from the order by a made distance."""
    i = B.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.max("l_extendedprice").alias("similarity"))
    pairs = i.withColumn("distance", F.col("dst") * 7919 % 10007 + F.col("dst") / 100000.0)
    return L.geo_rank_losses(pairs, 0.1).select("src", "n", r("hard").alias("hard"))
