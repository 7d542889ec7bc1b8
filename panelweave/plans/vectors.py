"""Strings, vectors, graphs, space, statistics and models on the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.dates import month_start
from ..functions.geography import looked_up
from ..functions.measures import haversine_km
from ..functions.vectors import l2_normalised, pooled
from ..operators import folds as FO
from ..operators import graph as G
from ..operators import hypothesis as H
from ..operators import models as M
from ..operators import moments as MO
from ..operators import panel as P
from ..operators import spatial as S
from ..operators import spectral as SP
from . import base as B
from .registry import query
from .relational import PAIRS, pair_frame, r

# strings ---------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN length(k) < 6 THEN lpad(k, 6, '0') ELSE k END AS code, substr(CASE WHEN length(k) < 6 THEN lpad(k, 6, '0') ELSE k END, 1, 2) AS state FROM (SELECT c_custkey, CAST(c_custkey * 97 AS VARCHAR) AS k FROM customer)")
def zero_pad_codes(s, d):
    code = T.zfill((F.col("c_custkey") * 97).cast("string"), 6)
    return B.table(s, d, "customer").select("c_custkey", code.alias("code"), F.substring(code, 1, 2).alias("state"))


@query("SELECT c_custkey, CASE WHEN x = '' THEN '0' ELSE x END AS plain FROM (SELECT c_custkey, regexp_replace(substr(c_name, 10), '^0+', '') AS x FROM customer)")
def strip_leading_zeros(s, d):
    return B.table(s, d, "customer").select("c_custkey", T.strip_zeros(F.substring("c_name", 10, 100)).alias("plain"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\d+)', 1), '') AS host, coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1), ''), nullif(regexp_extract(url, '[?&]lang=([a-z]+)', 1), '')) AS lang,
 nullif(regexp_extract(url, '/(\d+)', 1), '') AS number FROM pages""")
def series_id_regex(s, d):
    u = F.col("url")
    return B.table(s, d, "pages").select("page_id", T.part(u, r"^https?://([^/]+)/([a-z]{2})/(\d+)", 1).alias("host"), T.first_part(u, (r"^https?://[^/]+/([a-z]{2})/", 1), (r"[?&]lang=([a-z]+)", 1)).alias("lang"), T.part(u, r"/(\d+)", 1).alias("number"))


_NAME = "regexp_replace(lower(trim(p_name || ' ' || p_brand || ' county')), '[^\\w\\s]', ' ', 'g')"
for _s in T.COUNTY_SUFFIXES:
    _NAME = f"regexp_replace({_NAME}, ' {_s}$', '')"


@query(f"SELECT p_partkey, trim(regexp_replace({_NAME}, '\\s+', ' ', 'g')) AS name FROM part")
def county_name_normalise(s, d):
    return B.table(s, d, "part").select("p_partkey", T.county_name(F.concat_ws(" ", "p_name", "p_brand", F.lit("county"))).alias("name"))


@query(r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS folded FROM documents")
def ascii_fold_documents(s, d):
    return B.table(s, d, "documents").select("doc_id", T.ascii_fold("text").alias("folded"))


@query("""SELECT o_orderkey, CAST(try_strptime(strftime(o_orderdate, '%Y%m'), '%Y%m') AS DATE) AS a, CAST(try_strptime(strftime(o_orderdate, '%Y-%m'), '%Y-%m') AS DATE) AS b, CAST(date_trunc('month', try_strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')) AS DATE) AS c,
 CAST(try_strptime(year(o_orderdate) || '13', '%Y%m') AS DATE) AS d, CAST(substr(strftime(o_orderdate, '%Y%m'), 1, 4) AS INT) AS y, CAST(substr(strftime(o_orderdate, '%Y%m'), 5, 2) AS INT) AS m FROM orders""")
def month_parse_fallback(s, d):
    o = B.table(s, d, "orders")
    f = lambda p: month_start(F.date_format("o_orderdate", p))
    return o.select("o_orderkey", f("yyyyMM").alias("a"), f("yyyy-MM").alias("b"), f("yyyy-MM-dd HH:mm:ss").alias("c"), month_start(F.concat(F.year("o_orderdate").cast("string"), F.lit("13"))).alias("d"), F.year(f("yyyyMM")).alias("y"), F.month(f("yyyyMM")).alias("m"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def props_json_extract(s, d):
    e = B.table(s, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'east' ELSE 'unknown' END AS region FROM nation")
def region_map_default(s, d):
    return B.table(s, d, "nation").select("n_nationkey", looked_up(F.col("n_regionkey").cast("string"), {"0": "south", "1": "west", "2": "east"}, "unknown").alias("region"))


# vectors ---------------------------------------------------------------------

_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


@query(f"WITH e AS ({_UNIT}), l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(x), 6) AS mean, round(max(x), 6) AS max FROM l GROUP BY label, pos")
def bag_mean_max_pool(s, d):
    p = pooled(B.table(s, d, "embeddings"), "label", "embedding")
    return p.select("label", F.posexplode(F.arrays_zip("mean", "max")).alias("pos", "z")).select("label", "pos", r("z.mean").alias("mean"), r("z.max").alias("max"))


@query(f"WITH e AS ({_UNIT}), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e) SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(v[i] / greatest(n, 1e-12), 6) AS x FROM n, range(1, 65) AS t(i)")
def embedding_l2_normalise(s, d):
    u = B.table(s, d, "embeddings").select("vec_id", F.posexplode(l2_normalised(F.col("embedding"))).alias("pos", "x"))
    return u.select("vec_id", "pos", r("x").alias("x"))


@query(f"WITH e AS ({_UNIT}) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id")
def cosine_pairs(s, d):
    return G.cosine_pairs(B.table(s, d, "embeddings"), "vec_id", "label", "embedding", 6)


# graphs ----------------------------------------------------------------------

K = 6
DIST = f"e AS ({_UNIT}), dist AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1 - list_cosine_similarity(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id), near AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM dist QUALIFY rn <= {K})"
BW = "bw AS (SELECT CASE WHEN median(dist) <= 1e-9 THEN 1 ELSE median(dist) END AS bw FROM near WHERE rn = 3), kg AS (SELECT src, dst, exp(-pow(dist / bw, 2)) AS w FROM near, bw), g AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS weight FROM kg)"


def near(s, d):
    from ..sources.sinks import written

    return written(G.vector_knn(B.table(s, d, "embeddings"), "vec_id", "embedding", K), "near")


def weighted(s, d):
    n = near(s, d)
    bw = F.broadcast(G.bandwidth(n, K, 3))
    return G.row_normalised(n.crossJoin(bw).select("src", "dst", F.exp(-F.pow(F.col("dist") / F.col("bw"), 2)).alias("weight")))


@query("WITH " + DIST + " SELECT src, dst, round(dist, 6) AS dist FROM near")
def knn_topk_edges(s, d):
    return near(s, d).select("src", "dst", r("dist").alias("dist"))


@query("WITH " + DIST + ", " + BW + " SELECT src, dst, round(weight, 6) AS weight FROM g")
def knn_gaussian_row_norm(s, d):
    return weighted(s, d).select("src", "dst", r("weight").alias("weight"))


@query("WITH " + DIST + " SELECT src, dst FROM near UNION SELECT dst, src FROM near")
def support_union_reverse(s, d):
    return G.symmetric_support(near(s, d))


@query("WITH " + DIST + ", " + BW + " SELECT a.src, a.dst, round(a.weight, 6) AS weight FROM g a JOIN g b ON a.src = b.dst AND a.dst = b.src")
def mutual_knn_edges(s, d):
    return G.mutual(weighted(s, d)).select("src", "dst", r("weight").alias("weight"))


SYM = "sy AS (SELECT src, dst, sum(weight) / 2 AS w FROM (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g) GROUP BY ALL), fin AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS weight FROM sy)"


@query("WITH " + DIST + ", " + BW + ", " + SYM + " SELECT src, dst, round(weight, 6) AS weight FROM fin")
def symmetrise_row_normalise(s, d):
    return G.finalised(weighted(s, d), K).select("src", "dst", r("weight").alias("weight"))


LEAK = """f AS (SELECT vec_id AS node, CAST(vec_id % 5 AS INT) AS fold FROM embeddings WHERE vec_id % 7 <> 0), j AS (SELECT g.*, a.fold AS sf, b.fold AS df FROM g LEFT JOIN f a ON g.src = a.node LEFT JOIN f b ON g.dst = b.node)"""


@query("WITH " + DIST + ", " + BW + ", " + LEAK + """, o AS (SELECT sf AS fold, avg(c / nullif(t, 0)) AS x FROM (SELECT src, sf, sum(weight) AS t, sum(CASE WHEN sf <> df THEN weight END) AS c FROM j WHERE sf IS NOT NULL GROUP BY ALL) GROUP BY sf),
 i AS (SELECT df AS fold, avg(c / nullif(t, 0)) AS x FROM (SELECT dst, df, sum(weight) AS t, sum(CASE WHEN sf <> df THEN weight END) AS c FROM j WHERE df IS NOT NULL GROUP BY ALL) GROUP BY df)
 SELECT o.fold, round(o.x, 6) AS outbound, round(i.x, 6) AS inbound, round((o.x + i.x) / 2, 6) AS bidirectional FROM o JOIN i ON o.fold = i.fold""")
def leakage_edge_form(s, d):
    return _leak(s, d, False)


@query("WITH " + DIST + ", " + BW + ", " + LEAK + """, k AS (SELECT * FROM j WHERE sf IS NOT NULL AND df IS NOT NULL), o AS (SELECT f.fold, avg(coalesce(c / nullif(t, 0), 0)) AS x FROM f LEFT JOIN (SELECT src, sum(weight) AS t, sum(CASE WHEN sf <> df THEN weight END) AS c FROM k GROUP BY ALL) z ON f.node = z.src GROUP BY f.fold),
 i AS (SELECT f.fold, avg(coalesce(c / nullif(t, 0), 0)) AS x FROM f LEFT JOIN (SELECT dst, sum(weight) AS t, sum(CASE WHEN sf <> df THEN weight END) AS c FROM k GROUP BY ALL) z ON f.node = z.dst GROUP BY f.fold)
 SELECT o.fold, round(o.x, 6) AS outbound, round(i.x, 6) AS inbound, round((o.x + i.x) / 2, 6) AS bidirectional FROM o JOIN i ON o.fold = i.fold""")
def leakage_matrix_form(s, d):
    return _leak(s, d, True)


def _leak(s, d, zeros):
    f = B.table(s, d, "embeddings").where("vec_id % 7 <> 0").select(F.col("vec_id").alias("node"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    return G.leakage(weighted(s, d), f, zeros).select("fold", *[r(c).alias(c) for c in ("outbound", "inbound", "bidirectional")])


@query("WITH " + DIST + ", " + BW + " SELECT dst AS node, round(sum(weight), 6) AS degree, count(*) AS n_edges FROM g GROUP BY dst")
def degree_by_node(s, d):
    back = weighted(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return G.degrees(back).select("node", r("degree").alias("degree"), "n_edges")


@query(f"WITH e AS ({_UNIT}), l AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e) SELECT vec_id, CAST(i AS INT) AS i, round(x, 6) AS x FROM l WHERE i < 5")
def basis_long_to_topk_array(s, d):
    long = B.table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("basis_index", "v")).select("vec_id", "basis_index", F.col("v").cast("double").alias("basis_value"))
    return G.basis_rows(long, ["vec_id"], 5).select("vec_id", F.posexplode("basis").alias("i", "x")).select("vec_id", "i", r("x").alias("x"))


# space -----------------------------------------------------------------------

POINTS = "pts AS (SELECT c_custkey AS id, 25 + (c_custkey * 7919 % 2400) / 100.0 AS lat, -124 + (c_custkey * 104729 % 5700) / 100.0 AS lon FROM customer)"
HAV = "2 * 6371.0 * asin(sqrt(least(greatest(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 0), 1)))"


def points(s, d):
    k = F.col("c_custkey")
    return B.table(s, d, "customer").select(k.alias("id"), (25 + (k * 7919 % 2400) / 100.0).alias("lat"), (-124 + (k * 104729 % 5700) / 100.0).alias("lon"))


@query(f"WITH {POINTS} SELECT a.id AS src, b.id AS dst, round({HAV}, 4) AS km FROM pts a JOIN pts b ON a.id <> b.id AND abs(a.lat - b.lat) < 2 WHERE {HAV} <= 60")
def haversine_range_join(s, d):
    return G.distances_within(points(s, d), 60.0, digits=4).withColumnRenamed("dist", "km")


@query(f"WITH {POINTS} SELECT id, CAST(floor(lon * 85 / 250) AS BIGINT)::VARCHAR || ':' || CAST(floor(lat * 111 / 250) AS BIGINT)::VARCHAR AS cell, round({HAV.replace('b.lat', '40.0').replace('b.lon', '(-100.0)')}, 4) AS km FROM pts a")
def spatial_block_assign(s, d):
    from ..operators.pairs import block_id

    p = points(s, d)
    cell = F.substring_index(block_id(F.lit("d"), F.col("lon") * 85, F.col("lat") * 111, 250.0), ":", -2)
    return p.select("id", cell.alias("cell"), r(haversine_km(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-100.0)), 4).alias("km"))


@query(f"WITH e AS ({_UNIT}), p AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e) SELECT vec_id, CAST(i // 8 // 4 AS INT) AS tile_row, CAST(i % 8 // 4 AS INT) AS tile_col, round(quantile_cont(x, 0.95), 6) AS p95, round(max(abs(x)), 6) AS top FROM p GROUP BY ALL HAVING max(abs(x)) > 0")
def tile_grid_from_pixels(s, d):
    px = S.pixels_of(B.table(s, d, "embeddings").withColumn("width", F.lit(8)), ["vec_id"], "embedding")
    t = S.tiles(px, ["vec_id"], 4)
    return t.select("vec_id", "tile_row", "tile_col", r("p95").alias("p95"), r(F.array_max(F.transform("tile", lambda x: F.abs(x)))).alias("top"))


@query(f"WITH e AS ({_UNIT}), t AS (SELECT label, count(CASE WHEN list_max(v) >= 0.2 THEN 1 END)::DOUBLE AS n FROM e GROUP BY label), c AS (SELECT quantile_cont(n, 0.995) AS cap FROM t), w AS (SELECT label, n, greatest(pow(least(n, cap), 0.5), 1e-6) AS w FROM t, c) SELECT CAST(label AS VARCHAR) AS fips, n, round(w / sum(w) OVER (), 8) AS probability FROM w")
def activity_weights(s, d):
    st = B.table(s, d, "embeddings").select(F.col("label").cast("string").alias("fips"), F.array_max("embedding").cast("double").alias("p95"))
    return S.activity_weights(st, 0.2).select("fips", "n", r("probability", 8).alias("probability"))


# statistics ------------------------------------------------------------------

BLOCKS = PAIRS + """, bx AS (SELECT *, substr(fips, length(fips) - 1) AS block_id, CAST(fold AS VARCHAR) AS dv, CAST(CAST(fips AS BIGINT) % 97 AS DOUBLE) * 20 AS x_km, CAST(CAST(fips AS BIGINT) % 89 AS DOUBLE) * 20 AS y_km FROM pa),
 bt AS (SELECT count(*) AS n, avg(adjusted_delta) AS mn, avg(baseline_ape) AS md, sum(baseline_ape) AS sd FROM bx), bi AS (SELECT bx.*, 100 * (adjusted_delta - mn / md * baseline_ape) / (md * n) AS psi, 100 * adjusted_delta / sd AS mass FROM bx, bt),
 bg AS (SELECT block_id, sum(psi) AS g, sum(mass) AS m, avg(x_km) AS x, avg(y_km) AS y, min(dv) AS division, count(*) AS n FROM bi GROUP BY block_id)"""


def blocked(s, d):
    k = F.col("fips").cast("long")
    p = pair_frame(s, d)
    return p.withColumns({"block_id": F.expr("substring(fips, length(fips) - 1, 100)"), "division": F.col("fold").cast("string"), "x_km": (k % 97).cast("double") * 20, "y_km": (k % 89).cast("double") * 20})


@query("WITH " + BLOCKS + " SELECT block_id, round(g, 6) AS g, round(m, 6) AS m, round(x, 4) AS x, round(y, 4) AS y, division, n FROM bg")
def block_influence_scores(s, d):
    b = H.block_sums(blocked(s, d), "adjusted_delta", "baseline_ape")
    return b.select("block_id", r("g").alias("g"), r("m").alias("m"), r("x", 4).alias("x"), r("y", 4).alias("y"), "division", "n")


@query("WITH " + BLOCKS + """ SELECT (SELECT count(*) FROM bg) AS n_blocks, round(greatest(0, (SELECT count(*) FROM bg)::DOUBLE / ((SELECT count(*) FROM bg) - 1) * sum(a.g * CASE WHEN a.block_id = b.block_id THEN 1 ELSE greatest(1 - sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 500, 0) END * b.g)), 6) AS variance
 FROM bg a JOIN bg b ON a.division = b.division""")
def hac_kernel_variance(s, d):
    return H.hac_variance(H.block_sums(blocked(s, d), "adjusted_delta", "baseline_ape"), 500.0).select("n_blocks", r("variance").alias("variance"))


@query("WITH " + PAIRS + " SELECT CAST(sum(CASE WHEN adjusted_delta > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN adjusted_delta < -1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS losses, CAST(sum(CASE WHEN abs(adjusted_delta) <= 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS ties FROM pa")
def sign_test_counts(s, d):
    return H.sign_counts(pair_frame(s, d), "adjusted_delta")


@query("""WITH c AS (SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (c_acctbal > 4500) AS k FROM customer GROUP BY ALL)
 SELECT nation, n, k, round(sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + n * ln(0.5))), 8) AS tail FROM c, range(0, (SELECT max(n) + 1 FROM c)) AS r(j) WHERE j BETWEEN k AND n GROUP BY ALL""")
def binomial_tail(s, d):
    """For each nation, how likely so many or more of its customers' balances lie over 4500 by chance."""
    c = B.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 4500).alias("k"))
    return c.select("nation", "n", "k", r(H.binomial_tail(F.col("k"), F.col("n"), F.lit(0.5)), 8).alias("tail"))


@query("""WITH c AS (SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (c_acctbal > 4500) AS k FROM customer GROUP BY ALL)
 SELECT nation, true AS low_holds, true AS high_holds FROM c""")
def binomial_interval(s, d):
    """The exact interval of each nation's share: at its ends the tails are half of alpha (0 and 1 where nothing or all was seen)."""
    c = B.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 4500).alias("k"))
    x = c.withColumn("x", H.binomial_interval(F.col("k"), F.col("n"), F.lit(0.05)))
    low = F.when(F.col("k") == 0, F.col("x.low") == 0).otherwise(F.abs(H.binomial_tail(F.col("k"), F.col("n"), F.col("x.low")) - 0.025) < 1e-6)
    high = F.when(F.col("k") == F.col("n"), F.col("x.high") == 1).otherwise(F.abs(1 - H.binomial_tail(F.col("k") + 1, F.col("n"), F.col("x.high")) - 0.025) < 1e-6)
    return x.select("nation", low.alias("low_holds"), high.alias("high_holds"))


@query()
def signflip_exact_states(s, d):
    """Every state and all of their signs; too many to enumerate in SQL."""
    rows = pair_frame(s, d).groupBy("state").agg(F.avg("adjusted_delta").alias("x")).orderBy("state").collect()  # one row per state
    return s.createDataFrame([(len(rows), 1 << len(rows), H.sign_flip_all(np.array([x.x for x in rows])))], "n_states int, n_flips long, p double")


@query(f"WITH e AS ({_UNIT}), n AS (SELECT label, sqrt(sum(x * x)) AS base FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL) GROUP BY label) SELECT label, round(base, 6) AS base, round(least(1.0, 0.05 * base / greatest(0.1 * (label + 1), 1e-12)), 6) AS shrink FROM n")
def capped_vector_norm(s, d):
    from ..functions.vectors import norm

    p = pooled(B.table(s, d, "embeddings"), "label", "embedding").withColumn("base", norm(F.col("mean")))
    return p.select("label", r("base").alias("base"), r(F.least(F.lit(1.0), 0.05 * F.col("base") / F.greatest(0.1 * (F.col("label") + 1), F.lit(1e-12)))).alias("shrink"))


# models ----------------------------------------------------------------------


def training(s, d):
    p = B.panel(s, d).where("year = 2000")
    return p.select("fold", F.array(F.log("base"), F.col("acctbal") / 1000).alias("x"), F.log("truth").alias("y"))


@query("WITH " + B.PANEL + """, t AS (SELECT fold, ln(base) AS x, ln(truth) AS y FROM panel WHERE year = 2000), m AS (SELECT fold, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM t GROUP BY fold),
 z AS (SELECT t.fold, (x - mx) / sx AS z, y - my AS y, n, my FROM t JOIN m USING (fold)) SELECT fold, n AS n_train, round(sum(z * y) / (sum(z * z) + 1.0), 6) AS coef, round(max(my), 6) AS intercept FROM z GROUP BY fold, n""")
def ridge_closed_form(s, d):
    t = training(s, d).withColumn("x", F.slice("x", 1, 1))
    return M.fits(t, "fold", "x", "y", "ridge", alpha=1.0).select("fold", "n_train", r(F.col("coef")[0]).alias("coef"), r("intercept").alias("intercept"))


@query("WITH " + B.PANEL + """, t AS (SELECT fold, ln(base) AS x, ln(truth) AS y FROM panel WHERE year = 2000), u AS (SELECT k, x, y FROM t, range(1, 6) AS f(k) WHERE fold <> k), m AS (SELECT k, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM u GROUP BY k),
 z AS (SELECT u.k, (x - mx) / sx AS z, y - my AS y, n, my FROM u JOIN m USING (k)) SELECT CAST(k AS INT) AS k, n AS n_train, round(sum(z * y) / (sum(z * z) + 1.0), 6) AS coef, round(max(my), 6) AS intercept FROM z GROUP BY k, n""")
def ridge_left_out_folds(s, d):
    """The model that each fold is scored by, trained on all other folds, from one pass of merged moments."""
    t = training(s, d).select(F.lit(0).alias("spec"), F.col("fold").cast("int").alias("fold"), F.slice("x", 1, 1).alias("x"), "y")
    m = MO.model_rows(MO.fold_fits(t, [1, 2, 3, 4, 5], "ridge", 1.0), s)
    return m.select("k", "n_train", r(F.col("coef")[0]).alias("coef"), r("intercept").alias("intercept"))


@query()
def huber_fit_by_fold(s, d):
    return M.fits(training(s, d), "fold", "x", "y", "huber", alpha=1e-4).select("fold", "n_train", F.col("coef"), "intercept", "sigma")


@query()
def moran_basis_topk(s, d):
    """The basis itself; moran_basis_checks holds it against its equation."""
    return SP.moran_basis_of(weighted(s, d), 8, 32).select("node", "basis_index", "basis_value", "eigenvalue")


@query("""WITH e AS (SELECT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
 SELECT CAST(i AS INT) AS basis_index, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n, 1.0::DOUBLE AS length, 0.0::DOUBLE AS mean, true AS solves, true AS falls FROM range(3) AS t(i)""")
def moran_basis_checks(s, d):
    """Which nations trade with which: every vector of the block iteration has length 1 and mean 0 and satisfies the equation, by a product of its own with the edges; eigenvalues fall."""
    from ..sources.sinks import written

    line, o, c, u = (B.table(s, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    met = line.join(o, line.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(u, F.col("l_suppkey") == u.s_suppkey)
    e = written(met.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg((F.count(F.lit(1)) / 100.0).alias("weight")), "trade")
    b = written(SP.moran_basis_of(e, 3, 4, small=0), "moran_basis")
    v = b.select(F.col("node").alias("dst"), "basis_index", F.col("basis_value").alias("v"))
    y = SP.symmetric_top(e, 4).join(v, "dst").groupBy(F.col("src").alias("node"), "basis_index").agg(F.sum(F.col("weight") * F.col("v")).alias("y"))
    both = b.join(y, ["node", "basis_index"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    mean = both.groupBy("basis_index").agg(F.avg("y").alias("m"))
    off = F.abs(F.col("y") - F.col("m") - F.col("eigenvalue") * F.col("basis_value"))
    out = both.join(mean, "basis_index").groupBy("basis_index").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(F.col("basis_value") ** 2)).alias("length"), F.abs(r(F.avg("basis_value"))).alias("mean"), (F.max(off) < 1e-8).alias("solves"), F.max("eigenvalue").alias("e"),
    )
    before = F.lag("e").over(W.partitionBy().orderBy("basis_index"))  # three rows
    return out.withColumn("falls", F.coalesce(before >= F.col("e"), F.lit(True))).drop("e")


@query()
def kmeans_clusters(s, d):
    return G.clusters(B.table(s, d, "embeddings"), "vec_id", "embedding", 5)


@query()
def bootstrap_mean(s, d):
    return H.cluster_bootstrap(pair_frame(s, d), "adjusted_delta", "state", "analysis_stratum", 200)


@query()
def state_folds(s, d):
    c = B.counties(s, d)
    names = {f"{k:02d}": str(v) for k, v in ((x.n_nationkey, x.n_regionkey) for x in B.table(s, d, "nation").collect())}  # one row per state
    order = sorted(set(names.values()))
    return FO.state_folds(c, 5, division_of=names, region_of=names, order=order)


def strict_panel(s, d):
    p = B.panel(s, d).where("year = 2000").select("fips", "state", "fold", F.log("truth").alias("y_log"), F.log("base").alias("pep_log"), F.array(F.col("acctbal") / 1000, F.log("base")).alias("embeddings"), F.array((F.col("division") * 1.0)).alias("mem"))
    return p


@query()
def strict_evaluation(s, d):
    from ..operators import evaluate as E

    e = E.strict_errors(strict_panel(s, d), [1, 2, 3, 4, 5], ["embeddings", "mem", "embeddings_mem", "embeddings_only", "embeddings_mem_only"], alpha=1e-3)
    leak = s.createDataFrame([(k, 0.05 * k) for k in range(1, 6)], "fold int, share double")
    m = E.fold_metrics(e, leak, ["mem", "embeddings_mem", "embeddings_mem_only"])
    return E.summary(m, ["mae_log", "mape_pop_pct", "crps", "residual_corr", "signal_corr", "adjusted_mape"])


@query()
def strict_kernels(s, d):
    """Kernel ridge on the blocks of every spec, by landmarks, with the training mean taken off."""
    from ..operators import evaluate as E

    e = E.strict_errors(strict_panel(s, d), [1, 2, 3, 4, 5], ["embeddings", "mem", "embeddings_mem_only"], "kernel_ridge", alpha=0.5, centre=True)
    return E.summary(E.fold_metrics(e, s.createDataFrame([(k, 0.05 * k) for k in range(1, 6)], "fold int, share double"), ["mem", "embeddings_mem_only"]), ["mae_log", "mape_pop_pct", "crps", "signal_corr", "adjusted_mape"])


@query()
def post_censal_trajectory(s, d):
    from ..operators import evaluate as E

    p = B.panel(s, d).where("year >= 1998")
    x = F.array(F.col("acctbal") / 1000, F.log("base"))
    rows = p.select("fips", "year", "fold", x.alias("x"), F.log("base").alias("pep_log"), F.when(F.col("year") == 1998, F.log("truth")).alias("y_log"), (F.col("truth") - F.col("base")).alias("flow"))
    return E.post_censal(rows, [1998, 1999, 2000])


@query()
def hypothesis_suite(s, d):
    from ..operators import pairs as PA

    p = blocked(s, d)
    t = B.panel(s, d).select("fips", "year", F.log("truth").alias("corrected_log"), F.log("base").alias("pep_log"))
    return H.suite(p, PA.state_pairs(p), PA.safety_rows(t, 1996, 2000))


@query("SELECT true AS near, 24::BIGINT AS trials, count(DISTINCT c_nationkey) AS nations FROM customer")
def searched_balance(s, d):
    """An adaptive search for the level from which all customers' balances lie least far (their median): within 4 per cent of the range after 24 trials."""
    import uuid

    from ..operators import search as SE
    from ..sources.sinks import shared_folder

    c = B.table(s, d, "customer").select(F.col("c_acctbal").alias("b"), "c_nationkey")

    def objective(trials):
        # trials are a round's few rows
        x = F.get_json_object("params", "$.x").cast("double")
        return c.crossJoin(F.broadcast(trials.select("trial", x.alias("x")))).groupBy("trial").agg((-F.avg(F.abs(F.col("b") - F.col("x")))).alias("score"))

    found = SE.search(s, {"x": {"type": "float", "low": -1000.0, "high": 10000.0}}, objective, f"{shared_folder(s)}/panelweave/{uuid.uuid4().hex}/trials", 4, 6)
    best = found.agg(F.max_by(F.get_json_object("params", "$.x").cast("double"), "score").alias("x"), F.count(F.lit(1)).alias("trials"))
    true = c.agg(F.median("b").alias("m"), F.countDistinct("c_nationkey").alias("nations"))
    both = best.crossJoin(F.broadcast(true))  # one row each
    return both.select((F.abs(F.col("x") - F.col("m")) < 440).alias("near"), "trials", "nations")


@query("WITH " + B.ORDERS + """, m AS (SELECT fips, year, month, translate(code, '12345', '34563') AS measure, CAST(sum(cents) AS DOUBLE) AS value FROM orders_ GROUP BY ALL),
 w AS (SELECT fips, year, month, max(value) FILTER (measure = '3') AS rate, max(value) FILTER (measure = '4') AS un, max(value) FILTER (measure = '5') AS emp, max(value) FILTER (measure = '6') AS lf FROM m GROUP BY ALL),
 a AS (SELECT fips, year, avg(rate) AS mean, stddev_samp(rate) AS std, avg(rate) FILTER (month >= 10) - avg(rate) FILTER (month <= 3) AS q4, max(rate) FILTER (month = 12) AS r12, max(un) FILTER (month = 12) AS u12, max(emp) FILTER (month = 12) AS e12, max(lf) FILTER (month = 12) AS l12 FROM w GROUP BY ALL)
 SELECT a.fips, a.year, round(a.mean, 2) AS laus_urate_mean, round(a.std, 2) AS laus_urate_std, round(a.q4, 2) AS laus_urate_q4_minus_q1, a.r12 - b.r12 AS laus_urate_dec_yoy,
  round((a.e12 - b.e12) / greatest(abs(b.e12), 1), 6) AS laus_emp_dec_yoy, round((a.l12 - b.l12) / greatest(abs(b.l12), 1), 6) AS laus_lf_dec_yoy, round(CASE WHEN a.l12 IS NOT NULL THEN a.u12 / greatest(a.l12, 1) END, 6) AS laus_unemp_to_lf_dec FROM a LEFT JOIN a b ON a.fips = b.fips AND a.year = b.year + 1""")
def labour_features(s, d):
    o = B.orders(s, d)
    months = o.groupBy("fips", "year", "month", F.translate("code", "12345", "34563").alias("measure")).agg(F.sum("cents").cast("double").alias("value"))
    f = P.labour_features(months)
    digits = dict.fromkeys(("laus_urate_mean", "laus_urate_std", "laus_urate_q4_minus_q1"), 2) | {"laus_urate_dec_yoy": 2}
    return f.select("fips", "year", *[r(c, digits.get(c, 6)).alias(c) for c in f.columns[2:]])
