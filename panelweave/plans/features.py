"""Feature builders, rollups, rasters and graph pieces of the library on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geography import DIVISIONS, with_geography
from ..functions.measures import albers, metres_per_degree, scalarised, tanh_score
from ..operators import embed as EM
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import pairs as PA
from ..operators import panel as P
from ..operators import relational as R
from ..operators import spatial as S
from . import base as B
from .registry import query
from .relational import FOLD_METRICS, STRATA_SQL_7, fold_frame, r
from .vectors import _UNIT, BW, DIST, weighted

MONTHS = B.ORDERS + """, mm AS (SELECT fips, year, month, CASE code WHEN '1' THEN 'rate' WHEN '2' THEN 'unemployed' WHEN '3' THEN 'employed' WHEN '4' THEN 'force' ELSE 'rate' END AS measure, CAST(sum(cents) AS DOUBLE) AS value FROM orders_ WHERE code <> '5' GROUP BY ALL),
 wide AS (SELECT fips, year, month, max(CASE WHEN measure = 'rate' THEN value END) AS rate, max(CASE WHEN measure = 'unemployed' THEN value END) AS unemployed, max(CASE WHEN measure = 'employed' THEN value END) AS employed, max(CASE WHEN measure = 'force' THEN value END) AS force FROM mm GROUP BY ALL),
 f AS (SELECT fips, year, avg(rate) AS m, stddev_samp(rate) AS s, avg(CASE WHEN month BETWEEN 10 AND 12 THEN rate END) - avg(CASE WHEN month BETWEEN 1 AND 3 THEN rate END) AS q, max(CASE WHEN month = 12 THEN rate END) AS r12, max(CASE WHEN month = 12 THEN unemployed END) AS u12, max(CASE WHEN month = 12 THEN employed END) AS e12, max(CASE WHEN month = 12 THEN force END) AS f12 FROM wide GROUP BY ALL)"""


@query("WITH " + MONTHS + """ SELECT a.fips, a.year, round(a.m, 2) AS mean, round(a.s, 2) AS std, round(a.q, 2) AS q4_minus_q1, round(a.r12 - b.r12, 2) AS dec_yoy, round((a.e12 - b.e12) / greatest(abs(b.e12), 1), 6) AS emp_yoy, round((a.f12 - b.f12) / greatest(abs(b.f12), 1), 6) AS force_yoy, round(a.u12 / CASE WHEN a.f12 IS NOT NULL THEN greatest(a.f12, 1) END, 6) AS share
 FROM f a LEFT JOIN f b ON a.fips = b.fips AND a.year = b.year + 1""")
def labour_feature_table(s, d):
    o = B.orders(s, d).where("code <> '5'")
    months = o.groupBy("fips", "year", "month", F.translate("code", "1234", "3456").alias("measure")).agg(F.sum("cents").cast("double").alias("value"))
    f = P.labour_features(months)
    return f.select("fips", "year", r("laus_urate_mean", 2).alias("mean"), r("laus_urate_std", 2).alias("std"), r("laus_urate_q4_minus_q1", 2).alias("q4_minus_q1"), r("laus_urate_dec_yoy", 2).alias("dec_yoy"), r("laus_emp_dec_yoy").alias("emp_yoy"), r("laus_lf_dec_yoy").alias("force_yoy"), r("laus_unemp_to_lf_dec").alias("share"))


TRACTS = """t AS (SELECT l_suppkey AS fips, CAST(l_quantity AS DOUBLE) AS addresses, CAST(l_linenumber AS DOUBLE) AS area, CAST(l_quantity AS BIGINT) % 7 / 10.0::DOUBLE AS flux, CAST(l_quantity AS BIGINT) % 5 * 1.0::DOUBLE AS bus, CAST(l_quantity AS BIGINT) % 3 * 1.0::DOUBLE AS oth, CAST(l_quantity AS BIGINT) % 11 * 1.0::DOUBLE AS res, CAST(l_linenumber AS DOUBLE) AS short_vacancy, CAST(l_quantity AS DOUBLE) AS long_vacancy, 1.0::DOUBLE AS nostat_res FROM lineitem)"""


@query("WITH " + TRACTS + """, g AS (SELECT fips, sum(addresses) AS a, greatest(sum(addresses), 1) AS ap, greatest(sum(area), 1e-6) AS land, sum(area) AS s, sum(addresses * flux) AS fl, sum(bus) AS bus, sum(oth) AS oth, CASE WHEN sum(res) > 0 THEN sum(res) ELSE greatest(sum(addresses) - sum(bus) - sum(oth), 0) END AS res, sum(addresses * addresses) AS a2,
 CASE WHEN count(*) < 2 THEN 0 ELSE quantile_cont(ln(1 + addresses / greatest(area, 1e-6)), 0.75) - quantile_cont(ln(1 + addresses / greatest(area, 1e-6)), 0.25) END AS iqr, sum(short_vacancy) AS sv, sum(long_vacancy) AS lv, sum(nostat_res) AS ns FROM t GROUP BY fips)
 SELECT fips, round(fl / a, 6) AS flux_rate, round(bus / ap, 6) AS comm, round(oth / ap, 6) AS inst, round(least(s / land, 1.05), 6) AS coverage, round(ln(1 + ap / land), 6) AS log_density, round(a2 / (ap * ap), 8) AS hhi, round(iqr, 6) AS iqr, round(res, 2) AS total_res, round(bus / greatest(res, 1), 6) AS b2r, round(sv / greatest(lv, 1), 6) AS aging, round(ns / greatest(res, 1), 6) AS dormancy FROM g""")
def address_feature_table(s, d):
    line = B.table(s, d, "lineitem")
    q, one = F.col("l_quantity").cast("long"), F.lit(1.0)
    t = line.select(F.col("l_suppkey").alias("fips"), F.col("l_quantity").cast("double").alias("addresses"), F.col("l_linenumber").cast("double").alias("area"), F.lit(None).cast("double").alias("land_area"), (q % 7 / 10.0).alias("flux"), (q % 5 * one).alias("bus"), (q % 3 * one).alias("oth"), (q % 11 * one).alias("res"), F.col("l_linenumber").cast("double").alias("short_vacancy"), F.col("l_quantity").cast("double").alias("long_vacancy"), one.alias("nostat_res"))
    f = P.address_features(t, ["fips"])
    short = {"flux_rate": "usps_flux_rate", "comm": "usps_comm_ratio", "inst": "usps_inst_ratio", "coverage": "usps_coverage_ratio", "log_density": "usps_log_density_land", "iqr": "usps_log_density_iqr", "b2r": "usps_b2r_ratio", "aging": "usps_vacancy_aging_ratio", "dormancy": "usps_dormancy_index"}
    return f.select("fips", *[r(c).alias(n) for n, c in short.items()], r("usps_address_hhi", 8).alias("hhi"), r("usps_total_res", 2).alias("total_res"))


@query("WITH " + B.ORDERS + """, i AS (SELECT fips, CAST(date_trunc('month', orderdate) AS DATE) AS date, year, month, CAST(count(*) AS DOUBLE) AS active, CAST(sum(cents) FILTER (code = '1') AS DOUBLE) AS new, CAST(sum(cents) FILTER (code = '2') AS DOUBLE) AS pending, CAST(max(cents) AS DOUBLE) AS dom, CAST(min(cents) AS DOUBLE) AS price FROM orders_ GROUP BY ALL),
 hot AS (SELECT fips, CAST(date_trunc('month', orderdate) AS DATE) AS date, avg(CAST(cents AS DOUBLE)) AS demand FROM orders_ WHERE code IN ('3', '4') GROUP BY ALL),
 y AS (SELECT i.fips, year, avg(hot.demand) AS demand, avg(active) AS inv, coalesce(sum(new), 0) AS nw, coalesce(sum(pending), 0) AS pd, avg(dom) AS dom, avg(price) AS price, max(CASE WHEN month = 12 THEN price END) AS p12, max(CASE WHEN month = 11 THEN price END) AS p11, max(CASE WHEN month = 12 THEN dom END) - max(CASE WHEN month = 11 THEN dom END) AS dmom FROM i LEFT JOIN hot ON i.fips = hot.fips AND i.date = hot.date GROUP BY ALL)
 SELECT a.fips, a.year, round(a.inv, 6) AS inv, a.nw, a.pd, round(a.dom, 2) AS dom, round(a.price, 2) AS price, round(a.p12 / greatest(a.p11, 1) - 1, 6) * CASE WHEN a.p11 IS NULL THEN NULL ELSE 1 END AS price_mom, a.dmom, round(a.p12 / CASE WHEN b.p12 IS NOT NULL THEN greatest(b.p12, 1) END - 1, 6) AS price_yoy, round(a.demand, 4) AS demand, round((a.nw + a.pd) / greatest(a.inv, 1), 4) AS turnover, round(a.pd / greatest(a.inv, 1), 4) AS absorption FROM y a LEFT JOIN y b ON a.fips = b.fips AND a.year = b.year + 1""")
def housing_feature_table(s, d):
    o = B.orders(s, d)
    of = lambda c: F.sum(F.when(F.col("code") == c, F.col("cents"))).cast("double")
    inv = o.groupBy("fips", F.trunc("orderdate", "month").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("active"), of("1").alias("new"), of("2").alias("pending"), F.max("cents").cast("double").alias("dom"), F.min("cents").cast("double").alias("price"))
    hot = o.where(F.col("code").isin("3", "4")).select("fips", F.trunc("orderdate", "month").alias("date"), F.col("cents").cast("double").alias("demand"))
    f = P.housing_features(inv, hot, fill=False)
    return f.select("fips", "year", r("housing_active_inv").alias("inv"), F.col("housing_new_listings").alias("nw"), F.col("housing_pending").alias("pd"), r("housing_dom", 2).alias("dom"), r("housing_med_list_price", 2).alias("price"), r("housing_price_mom").alias("price_mom"), F.col("housing_dom_mom").alias("dmom"), r("housing_price_yoy").alias("price_yoy"), r("housing_demand_score", 4).alias("demand"), r("housing_turnover", 4).alias("turnover"), r("housing_absorption", 4).alias("absorption"))


@query("WITH " + B.YEARLY + """, base AS (SELECT fips, year FROM yearly), x AS (SELECT fips, year, level / n AS x FROM yearly WHERE n > 1), j AS (SELECT base.fips, base.year, x FROM base LEFT JOIN x ON base.fips = x.fips AND base.year = x.year), m AS (SELECT year, median(x) AS m FROM j GROUP BY year)
 SELECT j.fips, j.year, round(coalesce(j.x, m.m, 0.0), 2) AS x, l.level AS label_level FROM j JOIN m ON j.year = m.year LEFT JOIN yearly l ON l.fips = j.fips AND l.year = j.year AND l.year = 2000""")
def merged_panel(s, d):
    y = B.yearly(s, d)
    labels = y.where("year = 2000").select("fips", "year", F.log("level").alias("label"), F.col("level").alias("label_level"), F.lit(None).cast("double").alias("label_prev"), F.lit(None).cast("double").alias("label_delta"))
    f = y.where("n > 1").select("fips", "year", (F.col("level") / F.col("n")).alias("x"))
    return P.merged_panel(y.select("fips", "year"), labels, [f]).select("fips", "year", r("x", 2).alias("x"), "label_level")


@query("WITH " + B.YEARLY + ", a AS (SELECT * FROM yearly WHERE year = 2000), p AS (SELECT * FROM yearly WHERE year = 1999), b AS (SELECT * FROM yearly WHERE year = 1998) SELECT a.fips, round(ln(a.level), 6) AS label, a.level - p.level AS label_delta, round(ln(a.level) - ln(b.level), 6) AS target_correction_log, a.level - b.level AS target_correction_level FROM a JOIN p ON a.fips = p.fips JOIN b ON a.fips = b.fips")
def supervision_labels(s, d):
    y = B.yearly(s, d)
    at = lambda year, n: y.where(F.col("year") == year).select("fips", F.col("level").alias(n))
    return P.supervision(at(2000, "truth"), at(1999, "prev"), at(1998, "anchor"), 2000).select("fips", r("label").alias("label"), "label_delta", r("target_correction_log").alias("target_correction_log"), "target_correction_level")


@query("WITH " + B.ERRORS + " SELECT model, state, count(*) AS n, round(avg(abs(ln(pred) - ln(truth))), 6) AS mae_log, round(avg(ape), 4) AS mape FROM errors GROUP BY model, state")
def state_metrics(s, d):
    return E.state_rollup(log_errors(s, d)).select("model", "state", "n", r("mae_log").alias("mae_log"), r("mape_pop_pct", 4).alias("mape"))


@query("WITH " + B.ERRORS + f" SELECT model, {STRATA_SQL_7.format(x='truth / 1000')} AS pop_stratum, count(DISTINCT fips) AS n, round(avg(abs(ln(pred) - ln(truth))), 6) AS mae_log, round(avg(ape), 4) AS mape FROM errors GROUP BY 1, 2")
def strata_metrics(s, d):
    return E.strata_rollup(log_errors(s, d).withColumn("k", F.col("truth") / 1000), "k").select("model", "pop_stratum", "n", r("mae_log").alias("mae_log"), r("mape_pop_pct", 4).alias("mape"))


def log_errors(s, d):
    e = B.errors(s, d).withColumns({"y_log": F.log("truth"), "pep_log": F.log("base"), "pred_log": F.log("pred")})
    return E.with_errors(e)


CORR = "round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6)"


@query("WITH " + B.ERRORS + ", l AS (SELECT model, ln(pred) - ln(base) AS c, ln(truth) - ln(base) AS t, ln(pred) AS p, ln(truth) AS y, ape, (ln(pred) - ln(base)) * CASE WHEN model = 'mid' THEN fold / 5.0 ELSE 1 END AS ac FROM errors) SELECT model, count(*) AS n, round(avg(ape), 4) AS mape, CASE WHEN stddev_pop(c) > 1e-12 THEN " + CORR.format(a="c", b="t") + " END AS residual_corr, " + CORR.format(a="p", b="y") + " AS signal_corr, CASE WHEN stddev_pop(ac) > 1e-12 THEN " + CORR.format(a="ac", b="t") + " END AS adjusted_corr FROM l GROUP BY model")
def metrics_by_model(s, d):
    scales = s.createDataFrame([(k, "mid", k / 5.0) for k in range(1, 6)], "fold int, model string, scale double")
    m = PA.metrics_table(log_errors(s, d), scales)
    return m.select("model", "n", r("mape_pop_pct", 4).alias("mape"), r("residual_corr").alias("residual_corr"), r("signal_corr").alias("signal_corr"), r("adjusted_residual_corr").alias("adjusted_corr"))


@query("WITH " + B.ERRORS + FOLD_METRICS + " SELECT model, round(avg(leakage), 6) AS leakage, round(avg(relative), 4) AS relative, round(avg(greatest(relative, 0) * leakage), 4) AS attributable, round(avg(adjusted), 4) AS adjusted FROM fa GROUP BY model")
def leakage_summary(s, d):
    t = PA.leakage_table(fold_frame(s, d))
    return t.select("model", r("mean_leakage").alias("leakage"), r("mean_relative", 4).alias("relative"), r("mean_attributable", 4).alias("attributable"), r("mean_adjusted", 4).alias("adjusted"))


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state, CASE " + " ".join(f"WHEN lpad(CAST(n_nationkey AS VARCHAR), 2, '0') IN ({', '.join(repr(x) for x in st.split())}) THEN '{reg}'" for _, reg, st in DIVISIONS) + " ELSE 'unknown' END AS region, CASE " + " ".join(f"WHEN lpad(CAST(n_nationkey AS VARCHAR), 2, '0') IN ({', '.join(repr(x) for x in st.split())}) THEN '{dv}'" for dv, _, st in DIVISIONS) + " ELSE 'unknown' END AS division FROM nation")
def state_geography(s, d):
    return with_geography(B.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("state")))


@query("WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e), b AS (SELECT vec_id, min(i // 8) AS top, max(i // 8) AS bottom, min(i % 8) AS lft, max(i % 8) AS rgt, count(*) AS n FROM p WHERE x > 0 GROUP BY vec_id) SELECT vec_id, CAST(bottom - top + 1 AS INT) AS height, CAST(rgt - lft + 1 AS INT) AS width, n AS valid_pixels FROM b")
def county_tensor_shapes(s, d):
    px = S.pixels_of(B.table(s, d, "embeddings").withColumn("width", F.lit(8)), ["vec_id"], "embedding")
    px = px.withColumn("value", F.when(F.col("value") > 0, F.col("value")))
    return S.county_tensors(px, ["vec_id"]).select("vec_id", "height", "width", "valid_pixels")


@query(f"WITH e AS ({_UNIT}), p AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e), q AS (SELECT vec_id, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM p GROUP BY vec_id) SELECT p.vec_id, CAST(i AS INT) AS i, round(coalesce(least(greatest((x - lo) / nullif(hi - lo, 0), 0), 1), 0), 6) AS x FROM p JOIN q ON p.vec_id = q.vec_id")
def clip_normalised_pixels(s, d):
    px = B.table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "value")).select("vec_id", "i", F.col("value").cast("double").alias("value"))
    return S.clip_normalised(px, ["vec_id"]).select("vec_id", "i", r("value").alias("x"))


@query("SELECT vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS item_index, CAST(count(*) OVER (PARTITION BY label) AS INT) AS item_count, 't' || CAST(label AS VARCHAR) || '_y2020_nowcast' AS tag, CASE WHEN label = 3 THEN 'eval' ELSE 'pqval' END AS split FROM embeddings")
def bag_item_index(s, d):
    e = B.table(s, d, "embeddings").select("vec_id", "label")
    e = EM.items(e, ["label"], "vec_id")
    return e.select("vec_id", "item_index", "item_count", EM.family_tag(F.concat(F.lit("t"), F.col("label").cast("string")), F.lit(2020)).alias("tag"), EM.source_split(F.col("label"), F.lit(3)).alias("split"))


@query("WITH " + DIST + ", " + BW + ", s AS (SELECT src, dst, -(1 - weight) / 0.5 - 0.1 * ln(1 + dist / 0.7) AS x FROM near JOIN g USING (src, dst)) SELECT src, dst, round(exp(x - max(x) OVER (PARTITION BY src)), 6) AS weight FROM s")
def latent_pre_adjacency(s, d):
    from .vectors import near

    n = near(s, d)
    w = G.row_normalised(n.crossJoin(F.broadcast(G.bandwidth(n, 6, 3))).select("src", "dst", "dist", F.exp(-F.pow(F.col("dist") / F.col("bw"), 2)).alias("weight")))
    support = w.select("src", "dst", F.col("weight").alias("cos"), G.geo_penalty(F.col("dist"), F.lit(0.7), 1.0).alias("geo"))
    return G.pre_adjacency(support, 0.5, 0.1).select("src", "dst", r("weight").alias("weight"))


@query("WITH " + DIST + ", " + BW + ", sm AS (SELECT exp(0.5) / (exp(0.5) + exp(-0.5)) AS a, exp(-0.5) / (exp(0.5) + exp(-0.5)) AS b), u AS (SELECT src, dst, weight * a AS w FROM g, sm UNION ALL SELECT dst, src, weight * b FROM g, sm) SELECT src, dst, round(sum(w), 6) AS weight FROM u GROUP BY src, dst")
def fused_modalities(s, d):
    g = weighted(s, d)
    back = g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return G.fused([(g, 0.5), (back, -0.5)]).select("src", "dst", r("weight").alias("weight"))


@query("WITH p AS (SELECT vec_id, label AS a, CAST(vec_id % 4 AS INT) AS b FROM embeddings), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM p GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), ra AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS q FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((s - r * q / (t * (t - 1) / 2)) / ((r + q) / 2 - r * q / (t * (t - 1) / 2)), 8) AS ari FROM s, ra, rb")
def community_adjusted_rand(s, d):
    p = B.table(s, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 4).cast("int").alias("b"))
    return G.adjusted_rand(p, "a", "b").select(r("ari", 8).alias("ari"))


@query("WITH " + B.PANEL + " SELECT fips, year, round((0.5 * tanh((truth - base) / base * 100 / 5) + 0.25 * (2 * (1 - division / 4.0) - 1)) / 0.75, 6) AS score FROM panel")
def tuning_score(s, d):
    p = B.panel(s, d)
    pct = (F.col("truth") - F.col("base")) / F.col("base") * 100
    return p.select("fips", "year", r(scalarised([(tanh_score(pct), 0.5), (2 * (1 - F.col("division") / 4.0) - 1, 0.25)])).alias("score"))


@query("SELECT c_custkey AS id, round(111132.92 - 559.82 * cos(2 * radians(25 + c_custkey % 25)) + 1.175 * cos(4 * radians(25 + c_custkey % 25)) - 0.0023 * cos(6 * radians(25 + c_custkey % 25)), 4) AS north, round(111412.84 * cos(radians(25 + c_custkey % 25)) - 93.5 * cos(3 * radians(25 + c_custkey % 25)) + 0.118 * cos(5 * radians(25 + c_custkey % 25)), 4) AS east FROM customer")
def metres_a_degree(s, d):
    n, e = metres_per_degree((25 + F.col("c_custkey") % 25).cast("double"))
    return B.table(s, d, "customer").select(F.col("c_custkey").alias("id"), r(n, 4).alias("north"), r(e, 4).alias("east"))


@query()
def block_centroids(s, d):
    from .vectors import points

    x, y = albers(F.col("lon"), F.col("lat"))
    return points(s, d).select("id", r(x, 3).alias("x"), r(y, 3).alias("y"), PA.block_id(F.lit("d"), x / 1000, y / 1000, 250.0).alias("block_id"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey >= 2 AND n_regionkey >= 4 - n_regionkey THEN 'b' WHEN 4 - n_regionkey > n_regionkey AND 4 - n_regionkey >= 2 THEN 'a' ELSE 'c' END AS top FROM nation")
def dominant_column(s, d):
    n = B.table(s, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("b"), (4 - F.col("n_regionkey")).alias("a"), F.lit(2).alias("c"))
    return G.dominant(n, ["b", "a", "c"], "top").select("n_nationkey", "top")


@query("WITH o AS (SELECT o_custkey, CAST(o_orderpriority AS VARCHAR) AS p FROM orders) SELECT o_custkey, string_agg(p, ',' ORDER BY p) AS codes FROM (SELECT DISTINCT o_custkey, p FROM o) GROUP BY o_custkey")
def joined_codes(s, d):
    return B.table(s, d, "orders").groupBy("o_custkey").agg(T.joined_states("o_orderpriority").alias("codes"))


@query("WITH w AS (SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), h AS (SELECT c_nationkey AS k, count(*) AS found FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL) SELECT DISTINCT c_nationkey AS k, CAST(n AS BIGINT) AS n, found FROM w JOIN h ON c_nationkey = k WHERE found <> n")
def partly_written_keys(s, d):
    c = B.table(s, d, "customer").withColumnRenamed("c_nationkey", "k")
    work = c.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return R.partly_done(work, c.where("c_custkey % 2 = 0"), ["k"], "n").select("k", "n", "found")
