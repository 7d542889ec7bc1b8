"""Relational queries: joins, aggregates, windows, reshaping, imputation, work lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.measures import STRATA_5, outcome, relative_improvement, stratum, stratum_rank
from ..functions.nulls import divide, floored
from ..operators import evaluate, pairs, relational as R
from . import base as B
from .registry import query

STRATA_SQL_7 = "CASE WHEN {x} < 5000 THEN '<5k' WHEN {x} < 25000 THEN '5k-25k' WHEN {x} < 50000 THEN '25k-50k' WHEN {x} < 100000 THEN '50k-100k' WHEN {x} < 250000 THEN '100k-250k' WHEN {x} < 1000000 THEN '250k-1M' ELSE '1M+' END"
STRATA_SQL_5 = "CASE WHEN {x} < 5000 THEN '<5k' WHEN {x} < 50000 THEN '5k-50k' WHEN {x} < 250000 THEN '50k-250k' WHEN {x} < 1000000 THEN '250k-1M' ELSE '>1M' END"


def r(c, n: int = 6):
    return F.round(c, n)


FOLD_METRICS = """, fm AS (SELECT fold, model, count(*) AS n_test, avg(ape) AS mape FROM errors GROUP BY fold, model),
 fj AS (SELECT *, max(CASE WHEN model = 'pep' THEN mape END) OVER (PARTITION BY fold) AS pep_mape, CASE WHEN model = 'pep' THEN 0.0::DOUBLE ELSE CAST(fold * 0.05 AS DOUBLE) END AS leakage FROM fm),
 fr AS (SELECT *, (pep_mape - mape) / greatest(pep_mape, 1e-9) AS relative FROM fj),
 fa AS (SELECT *, relative - greatest(relative, 0) * leakage AS adjusted FROM fr)"""


def fold_frame(s, d):
    m = B.errors(s, d).groupBy("fold", "model").agg(F.count(F.lit(1)).alias("n_test"), F.avg("ape").alias("mape_pop_pct"))
    return evaluate.with_improvement(m.withColumn("leakage", F.when(F.col("model") == "pep", 0.0).otherwise(F.col("fold") * 0.05)))


@query("WITH " + B.ERRORS + FOLD_METRICS + """ SELECT model, count(*) AS n_folds, round(avg(mape), 4) AS mape, round(avg(relative), 4) AS relative, round(avg(adjusted), 4) AS adjusted,
 round(avg(pep_mape * (1 - adjusted)), 4) AS adjusted_mape, round(stddev_pop(pep_mape * (1 - adjusted)), 4) AS adjusted_mape_std FROM fa GROUP BY model""")
def adjusted_summary_by_model(s, d):
    m = evaluate.summary(fold_frame(s, d), ["mape_pop_pct", "relative", "adjusted", "adjusted_mape"])
    return m.select("model", "n_folds", r("mape_pop_pct_mean", 4).alias("mape"), r("relative_mean", 4).alias("relative"), r("adjusted_mean", 4).alias("adjusted"), r("adjusted_mape_mean", 4).alias("adjusted_mape"), r("adjusted_mape_std", 4).alias("adjusted_mape_std"))


@query("WITH " + B.YEARLY + ", w AS (" + "SELECT fips, " + ", ".join(f"max(CASE WHEN year = {y} THEN level END) AS l{y}" for y in range(1995, 2002)) + " FROM yearly GROUP BY fips) " + " UNION ALL ".join(f"SELECT fips, CAST({y} AS INT) AS year, l{y} AS level FROM w" for y in range(1995, 2002)))
def year_panel_unpivot(s, d):
    wide = B.yearly(s, d).groupBy("fips").pivot("year", list(range(1995, 2002))).agg(F.first("level", ignorenulls=True))
    wide = wide.select("fips", *[F.col(str(y)).alias(f"l{y}") for y in range(1995, 2002)])
    return R.years_from_columns(wide, ["fips"], {"level": "L"}, list(range(1995, 2002)))


@query("WITH " + B.MONTHLY + """ SELECT state, year, round(avg(level), 2) AS mean, round(stddev_samp(level), 2) AS std, round(avg(CASE WHEN month <= 3 THEN level END), 2) AS q1,
 round(avg(CASE WHEN month >= 10 THEN level END), 2) AS q4, round(avg(CASE WHEN month >= 10 THEN level END) - avg(CASE WHEN month <= 3 THEN level END), 2) AS q4_minus_q1, max(CASE WHEN month = 12 THEN level END) AS december FROM monthly GROUP BY state, year""")
def monthly_conditional_features(s, d):
    at = lambda low, high: F.avg(F.when(F.col("month").between(low, high), F.col("level")))
    return B.monthly(s, d).groupBy("state", "year").agg(r(F.avg("level"), 2).alias("mean"), r(F.stddev_samp("level"), 2).alias("std"), r(at(1, 3), 2).alias("q1"), r(at(10, 12), 2).alias("q4"), r(at(10, 12) - at(1, 3), 2).alias("q4_minus_q1"), F.max(F.when(F.col("month") == 12, F.col("level"))).alias("december"))


def _yoy(offset):
    return f"""WITH {B.YEARLY} SELECT y.fips, y.year, y.level, b.level AS level_prev, round((y.level - b.level) / greatest(abs(b.level), 1), 6) AS change FROM yearly y LEFT JOIN yearly b ON y.fips = b.fips AND y.year = b.year + {offset}"""


def _yoy_frame(s, d, offset):
    p = R.previous_year(B.yearly(s, d).select("fips", "year", "level"), ["fips"], ["level"], offset)
    return p.select("fips", "year", "level", "level_prev", r(divide(F.col("level") - F.col("level_prev"), floored(F.abs("level_prev"), 1.0))).alias("change"))


@query(_yoy(0))
def yoy_self_join_compat(s, d):
    return _yoy_frame(s, d, 0)


@query(_yoy(1))
def yoy_self_join_prev_year(s, d):
    return _yoy_frame(s, d, 1)


@query("WITH " + B.MONTHLY + """ SELECT state, year, december, november, round(december / CASE WHEN november IS NOT NULL THEN greatest(november, 1) END - 1, 6) AS mom FROM (SELECT state, year, max(CASE WHEN month = 12 THEN level END) AS december,
 max(CASE WHEN month = 11 THEN level END) AS november FROM monthly GROUP BY state, year)""")
def mom_dec_vs_nov(s, d):
    at = lambda m: F.max(F.when(F.col("month") == m, F.col("level")))
    g = B.monthly(s, d).groupBy("state", "year").agg(at(12).alias("december"), at(11).alias("november"))
    return g.withColumn("mom", r(divide(F.col("december"), floored(F.col("november"), 1.0)) - 1))


@query("WITH " + B.ORDERS + """ SELECT fips, year, round(avg(cents), 2) AS mean_cents, CAST(coalesce(sum(CASE WHEN code = '1' THEN cents END), 0) AS DOUBLE) AS urgent, CAST(coalesce(sum(CASE WHEN code = '5' THEN cents END), 0) AS DOUBLE) AS low,
 round(coalesce(sum(CASE WHEN code IN ('1', '5') THEN cents END), 0) / greatest(avg(cents), 1), 6) AS turnover, round(coalesce(sum(CASE WHEN code = '5' THEN cents END), 0) / greatest(avg(cents), 1), 6) AS absorption FROM orders_ GROUP BY fips, year""")
def housing_style_rollup(s, d):
    part = lambda *c: F.coalesce(F.sum(F.when(F.col("code").isin(*c), F.col("cents"))), F.lit(0)).cast("double")
    mean = floored(F.avg("cents"), 1.0)
    return B.orders(s, d).groupBy("fips", "year").agg(r(F.avg("cents"), 2).alias("mean_cents"), part("1").alias("urgent"), part("5").alias("low"), r(part("1", "5") / mean).alias("turnover"), r(part("5") / mean).alias("absorption"))


GAPS = "CASE WHEN n < 2 THEN NULL ELSE level END"


@query("WITH " + B.YEARLY + f", g AS (SELECT fips, year, {GAPS} AS x FROM yearly), m AS (SELECT year, median(x) AS m FROM g GROUP BY year) SELECT fips, g.year, coalesce(x, m, 0.0) AS x FROM g JOIN m ON g.year = m.year")
def median_impute_by_year(s, d):
    return R.impute_by(B.yearly(s, d).select("fips", "year", F.when(F.col("n") >= 2, F.col("level")).alias("x")), ["year"], ["x"]).select("fips", "year", "x")


@query("WITH " + B.YEARLY + f", g AS (SELECT fips, year, {GAPS} AS x FROM yearly) SELECT fips, year, coalesce(x, (SELECT median(x) FROM g), 0.0) AS x FROM g")
def median_impute_global(s, d):
    return R.impute_all(B.yearly(s, d).select("fips", "year", F.when(F.col("n") >= 2, F.col("level")).alias("x")), ["x"])


@query("""WITH t AS (SELECT l_suppkey AS supplier, l_partkey AS part, sum(CAST(l_quantity AS BIGINT)) AS a, CAST(round(avg(l_discount) * 10000) AS BIGINT) AS f FROM lineitem GROUP BY ALL)
 SELECT supplier, CAST(count(*) AS BIGINT) AS parts, round(sum(a * f) / greatest(sum(a), 1), 6) AS flux, round(sum(a * a) / (greatest(sum(a), 1.0) * greatest(sum(a), 1.0)), 8) AS hhi, round(CASE WHEN count(*) < 2 THEN 0 ELSE quantile_cont(ln(1 + a), 0.75) - quantile_cont(ln(1 + a), 0.25) END, 6) AS iqr,
 round(least(sum(a) / greatest(sum(a), 1.0), 1.05), 6) AS coverage FROM t GROUP BY supplier""")
def weighted_mean_hhi_iqr(s, d):
    line = B.table(s, d, "lineitem")
    t = line.groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).agg(F.sum(F.col("l_quantity").cast("long")).alias("a"), F.round(F.avg("l_discount") * 10000).cast("long").alias("f"))
    total = F.greatest(F.sum("a").cast("double"), F.lit(1.0))
    q = lambda p: F.percentile(F.log1p(F.col("a").cast("double")), F.lit(p))
    return t.groupBy("supplier").agg(F.count(F.lit(1)).alias("parts"), r(F.sum(F.col("a") * F.col("f")) / total).alias("flux"), r(F.sum(F.col("a") * F.col("a")) / (total * total), 8).alias("hhi"), r(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(q(0.75) - q(0.25))).alias("iqr"), r(F.least(F.sum("a") / total, F.lit(1.05))).alias("coverage"))


@query("WITH " + B.YEARLY + " SELECT y.fips, y.year, round(coalesce((y.level - b.level) / greatest(b.level, 1), 0.0), 6) AS velocity FROM yearly y LEFT JOIN yearly b ON y.fips = b.fips AND y.year = b.year + 1")
def residency_velocity(s, d):
    p = R.previous_year(B.yearly(s, d).select("fips", "year", "level"), ["fips"], ["level"])
    return p.select("fips", "year", r(F.coalesce(divide(F.col("level") - F.col("level_prev"), floored(F.col("level_prev"), 1.0)), F.lit(0.0))).alias("velocity"))


def _dedup(way):
    return f"WITH {B.ORDERS} SELECT fips, year, month, code, cents, orderkey FROM (SELECT *, row_number() OVER (PARTITION BY fips, year, code ORDER BY orderkey {way}) AS r FROM orders_) WHERE r = 1"


@query(_dedup("ASC"))
def dedup_keep_first(s, d):
    return R.keep_first(B.orders(s, d), ["fips", "year", "code"], "orderkey").select("fips", "year", "month", "code", "cents", "orderkey")


@query(_dedup("DESC"))
def dedup_keep_last(s, d):
    return R.keep_last(B.orders(s, d), ["fips", "year", "code"], "orderkey").select("fips", "year", "month", "code", "cents", "orderkey")


@query("WITH " + B.PANEL + " SELECT DISTINCT fold, state, division FROM panel")
def distinct_fold_rows(s, d):
    return B.panel(s, d).select("fold", "state", "division").distinct()


@query("WITH " + B.ORDERS + """, a AS (SELECT fips, year, CAST(sum(cents) AS BIGINT) AS urgent FROM orders_ WHERE code = '1' GROUP BY ALL), b AS (SELECT fips, year, CAST(sum(cents) AS BIGINT) AS low FROM orders_ WHERE code = '5' GROUP BY ALL),
 c AS (SELECT fips, year, count(*) AS december FROM orders_ WHERE month = 12 GROUP BY ALL) SELECT fips, year, urgent, low, december FROM a FULL JOIN b USING (fips, year) FULL JOIN c USING (fips, year)""")
def full_outer_feature_chain(s, d):
    o = B.orders(s, d)
    of = lambda c, x: o.where(c).groupBy("fips", "year").agg(x)
    parts = [of("code = '1'", F.sum("cents").alias("urgent")), of("code = '5'", F.sum("cents").alias("low")), of("month = 12", F.count(F.lit(1)).alias("december"))]
    return R.all_joined(parts, ["fips", "year"]).select("fips", "year", "urgent", "low", "december")


@query("WITH " + B.YEARLY + ", " + B.COUNTIES + " SELECT c.state, y.fips, y.year, y.level FROM counties c RIGHT JOIN yearly y ON c.fips = y.fips AND c.acctbal > 0")
def right_join_county_dim(s, d):
    return B.yearly(s, d).join(B.counties(s, d).where("acctbal > 0").select("fips", "state"), "fips", "left").select("state", "fips", "year", "level")


@query("WITH " + B.YEARLY + " SELECT a.fips, a.level AS truth, b.level AS prev, c.level AS anchor FROM (SELECT * FROM yearly WHERE year = 2000) a JOIN (SELECT * FROM yearly WHERE year = 1999) b USING (fips) JOIN (SELECT * FROM yearly WHERE year = 1998) c USING (fips)")
def inner_triple(s, d):
    y = B.yearly(s, d)
    at = lambda year, name: y.where(F.col("year") == year).select("fips", F.col("level").alias(name))
    return R.all_joined([at(2000, "truth"), at(1999, "prev"), at(1998, "anchor")], ["fips"], "inner")


@query("WITH " + B.ORDERS + ", " + B.COUNTIES + " SELECT fips, state FROM counties c WHERE EXISTS (SELECT 1 FROM orders_ o WHERE o.fips = c.fips)")
def semi_known_customers(s, d):
    return B.counties(s, d).join(B.orders(s, d), "fips", "left_semi").select("fips", "state")


@query("WITH " + B.ORDERS + ", " + B.COUNTIES + " SELECT fips, state FROM counties c WHERE NOT EXISTS (SELECT 1 FROM orders_ o WHERE o.fips = c.fips AND o.month = 2)")
def anti_orderless_customers(s, d):
    return B.counties(s, d).join(B.orders(s, d).where("month = 2"), "fips", "left_anti").select("fips", "state")


@query("WITH " + B.ORDERS + ", a AS (SELECT DISTINCT fips FROM orders_ WHERE code = '1'), b AS (SELECT DISTINCT fips FROM orders_ WHERE code = '5') SELECT 'both' AS kind, fips FROM (SELECT fips FROM a INTERSECT SELECT fips FROM b) UNION ALL SELECT 'first' AS kind, fips FROM (SELECT fips FROM a EXCEPT SELECT fips FROM b)")
def key_sets_intersect_except(s, d):
    o = B.orders(s, d)
    a, b = (o.where(F.col("code") == c).select("fips") for c in "15")
    return a.intersect(b).select(F.lit("both").alias("kind"), "fips").unionByName(a.subtract(b).select(F.lit("first").alias("kind"), "fips"))


@query("WITH " + B.COUNTIES + ", a AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS state, CAST(round(sum(s_acctbal) * 100) AS BIGINT) AS area FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) SELECT c.fips, c.state, coalesce(a.area, -1) AS area FROM counties c LEFT JOIN a USING (state)")
def lookup_with_default(s, d):
    from ..functions.text import zfill

    a = B.table(s, d, "supplier").where("s_acctbal > 5000").groupBy(zfill(F.col("s_nationkey").cast("string"), 2).alias("state")).agg(F.round(F.sum("s_acctbal") * 100).cast("long").alias("area"))
    return R.lookup(B.counties(s, d).select("fips", "state"), a, ["state"], "area", -1).select("fips", "state", F.col("area").cast("long").alias("area"))


@query("""WITH a AS (SELECT p_partkey, p_name, p_brand || '|' || p_type AS full_key, p_brand AS short_key FROM part), f AS (SELECT p_brand || '|' || p_type AS k, min(p_partkey) AS id FROM part WHERE p_size < 10 GROUP BY ALL),
 s AS (SELECT p_brand AS k, min(p_partkey) AS id FROM part WHERE p_size >= 10 GROUP BY ALL) SELECT p_partkey, coalesce(f.id, s.id) AS id FROM a LEFT JOIN f ON full_key = f.k LEFT JOIN s ON short_key = s.k""")
def first_matching_key(s, d):
    p = B.table(s, d, "part").withColumn("full_key", F.concat_ws("|", "p_brand", "p_type"))
    f = p.where("p_size < 10").groupBy("full_key").agg(F.min("p_partkey").alias("id1"))
    g = p.where("p_size >= 10").groupBy("p_brand").agg(F.min("p_partkey").alias("id2"))
    return p.join(f, "full_key", "left").join(g, "p_brand", "left").select("p_partkey", F.coalesce("id1", "id2").alias("id"))


PAIRS = B.ERRORS + """, pr AS (SELECT b.fips, b.state, b.fold, b.year, b.truth AS y_level, b.ape AS baseline_ape, t.ape AS treatment_ape, b.pred AS baseline_level, t.pred AS treatment_level, CAST(b.fold * 0.05 AS DOUBLE) AS leakage FROM errors b JOIN errors t ON b.fips = t.fips AND b.year = t.year AND b.model = 'pep' AND t.model = 'mid' WHERE b.year = 2000),
 pm AS (SELECT *, baseline_ape - treatment_ape AS delta, avg(baseline_ape - treatment_ape) OVER (PARTITION BY fold) AS fold_mean_delta FROM pr),
 ps AS (SELECT *, CASE WHEN fold_mean_delta > 0 THEN greatest(0, 1 - leakage) ELSE 1.0 END AS adjustment_scale FROM pm), pa AS (SELECT *, delta * adjustment_scale AS adjusted_delta FROM ps)"""


def pair_frame(s, d):
    e = B.errors(s, d).where("year = 2000").select("fips", "state", "fold", "model", F.col("truth").alias("y_level"), F.col("pred").alias("pred_level"), F.col("ape").alias("ape_pop_pct"), F.abs(F.log(F.col("pred") / F.col("truth"))).alias("abs_err_log"))
    proxy = e.select("fold").distinct().withColumn("leakage", F.col("fold") * 0.05)
    return pairs.county_pairs(e, "PEP", "mid", proxy)


@query("WITH " + PAIRS + " SELECT fips, state, fold, round(baseline_ape, 6) AS baseline_ape, round(treatment_ape, 6) AS treatment_ape, round(delta, 6) AS delta, CASE WHEN adjusted_delta > 1e-9 THEN 'win' WHEN adjusted_delta < -1e-9 THEN 'loss' ELSE 'equal' END AS outcome FROM pa")
def baseline_vs_treatment_pairs(s, d):
    return pair_frame(s, d).select("fips", "state", "fold", *[r(c).alias(c) for c in ("baseline_ape", "treatment_ape", "delta")], "outcome")


@query("WITH " + PAIRS + " SELECT fips, fold, round(fold_mean_delta, 4) AS fold_mean_delta, round(adjustment_scale, 6) AS adjustment_scale, round(adjusted_delta, 4) AS adjusted_delta FROM pa")
def fold_mean_adjustment_scale(s, d):
    return pair_frame(s, d).select("fips", "fold", r("fold_mean_delta", 4).alias("fold_mean_delta"), r("adjustment_scale").alias("adjustment_scale"), r("adjusted_delta", 4).alias("adjusted_delta"))


def _state_sql(extra):
    k = "state" + (", analysis_stratum" if extra else "")
    src = f"(SELECT *, {STRATA_SQL_5.format(x='y_level')} AS analysis_stratum FROM pa)" if extra else "pa"
    return f"""WITH {PAIRS}, sg AS (SELECT {k}, count(DISTINCT fips) AS n_counties, sum(y_level) AS truth, sum(baseline_level) AS b, sum(treatment_level) AS t, avg(adjusted_delta) AS mad, avg(leakage) AS ml, avg(CASE WHEN adjusted_delta > 1e-9 THEN 1.0 ELSE 0.0 END) AS share_win FROM {src} GROUP BY {k}),
 sr AS (SELECT *, abs(b - truth) / greatest(truth, 1e-9) * 100 AS bs, abs(t - truth) / greatest(truth, 1e-9) * 100 AS ts FROM sg), sx AS (SELECT *, (bs - ts) / greatest(bs, 1e-9) AS rel FROM sr)
 SELECT {k}, n_counties, truth, round(bs, 4) AS baseline_state_ape, round(ts, 4) AS treatment_state_ape, round(CASE WHEN rel > 0 THEN rel * (1 - ml) ELSE rel END, 4) AS state_adjusted, round(share_win, 6) AS share_win, CASE WHEN mad > 1e-9 THEN 'win' WHEN mad < -1e-9 THEN 'loss' ELSE 'equal' END AS outcome_mean FROM sx"""


def _state_cols(df, *extra):
    return df.select("state", *extra, "n_counties", "truth", r("baseline_state_ape", 4).alias("baseline_state_ape"), r("treatment_state_ape", 4).alias("treatment_state_ape"), r("state_adjusted", 4).alias("state_adjusted"), r("share_win").alias("share_win"), "outcome_mean")


@query(_state_sql(False))
def state_pairs_outcomes(s, d):
    return _state_cols(pairs.state_pairs(pair_frame(s, d)))


@query(_state_sql(True))
def state_stratum_pairs(s, d):
    return _state_cols(pairs.state_stratum_pairs(pair_frame(s, d)), "analysis_stratum")


@query("WITH " + B.YEARLY + f" SELECT fips, year, {STRATA_SQL_7.format(x='level / 1000')} AS pop_stratum FROM yearly")
def population_strata_7(s, d):
    return B.yearly(s, d).select("fips", "year", stratum(F.col("level") / 1000).alias("pop_stratum"))


@query("WITH " + B.YEARLY + f" SELECT fips, year, {STRATA_SQL_5.format(x='level / 1000')} AS pop_stratum FROM yearly")
def population_strata_5(s, d):
    return B.yearly(s, d).select("fips", "year", stratum(F.col("level") / 1000, STRATA_5).alias("pop_stratum"))


@query("WITH " + B.YEARLY + f", g AS (SELECT {STRATA_SQL_7.format(x='level / 1000')} AS pop_stratum, count(DISTINCT fips) AS n, sum(level) AS level FROM yearly GROUP BY 1) SELECT pop_stratum, n, round(100.0 * n / sum(n) OVER (), 6) AS share_n, round(100.0 * level / sum(level) OVER (), 6) AS share_level FROM g")
def strata_coverage_share(s, d):
    g = B.yearly(s, d).groupBy(stratum(F.col("level") / 1000).alias("pop_stratum")).agg(F.countDistinct("fips").alias("n"), F.sum("level").alias("level"))
    every = W.partitionBy()  # a row per stratum
    return g.select("pop_stratum", "n", r(100.0 * F.col("n") / F.sum("n").over(every)).alias("share_n"), r(100.0 * F.col("level") / F.sum("level").over(every)).alias("share_level"))


@query("WITH " + B.ERRORS + f" SELECT {STRATA_SQL_7.format(x='truth / 1000')} AS pop_stratum, " + ", ".join(f"round(avg(CASE WHEN model = '{m}' THEN ape END), 4) AS {m}" for m in ("pep", "mid", "far")) + " FROM errors GROUP BY 1")
def pivot_strata_by_model(s, d):
    e = B.errors(s, d).withColumns({"pop_stratum": stratum(F.col("truth") / 1000), "rank": stratum_rank(F.col("truth") / 1000)})
    return e.groupBy("pop_stratum").pivot("model", ["pep", "mid", "far"]).agg(F.round(F.avg("ape"), 4))


@query("WITH " + PAIRS + """, c AS (SELECT state, quantile_cont(baseline_ape, 0.9) AS cutoff FROM pa GROUP BY state) SELECT pa.state, round(max(cutoff), 6) AS cutoff, CAST(sum(CASE WHEN baseline_ape >= cutoff THEN 1 ELSE 0 END) AS BIGINT) AS n_tail,
 round(avg(CASE WHEN baseline_ape >= cutoff THEN CASE WHEN y_level < 20000000 THEN 1.0 ELSE 0.0 END END), 6) AS share_in, round(avg(CASE WHEN baseline_ape < cutoff THEN CASE WHEN y_level < 20000000 THEN 1.0 ELSE 0.0 END END), 6) AS share_out FROM pa JOIN c USING (state) GROUP BY pa.state""")
def worst_tail_enrichment(s, d):
    t = pairs.tail_enrichment(pair_frame(s, d), 0.9, 20_000_000)
    return t.select("state", r("cutoff").alias("cutoff"), "n_tail", r("share_in").alias("share_in"), r("share_out").alias("share_out"))


@query("WITH " + PAIRS + " SELECT fips, round(baseline_ape, 6) AS baseline_ape FROM pa WHERE baseline_ape >= (SELECT quantile_cont(baseline_ape, 0.9) FROM pa)")
def hard_cases_top_decile(s, d):
    return R.tail(pair_frame(s, d), "baseline_ape", 0.9, True).select("fips", r("baseline_ape").alias("baseline_ape"))


@query("WITH " + PAIRS + " SELECT fips, round(adjusted_delta, 6) AS adjusted_delta FROM pa WHERE adjusted_delta <= (SELECT quantile_cont(adjusted_delta, 0.1) FROM pa)")
def worst_cases_bottom_decile(s, d):
    return R.tail(pair_frame(s, d), "adjusted_delta", 0.1, False).select("fips", r("adjusted_delta").alias("adjusted_delta"))


@query("WITH " + B.PANEL + """, t AS (SELECT year, abs(ln(truth) - ln(base)) AS c, greatest(truth / base, base / truth) AS g FROM panel WHERE year > 1996 AND year <= 2000)
 SELECT year, count(*) AS n, round(avg(c), 6) AS mean_correction, round(max(c), 6) AS max_correction, round(avg(CASE WHEN c <= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS share_in_bound, round(avg(CASE WHEN g <= 1.5 THEN 1.0 ELSE 0.0 END), 6) AS share_growth_ok FROM t GROUP BY year""")
def year_safety_bounds(s, d):
    t = B.panel(s, d).select("fips", "year", F.log("truth").alias("corrected_log"), F.log("base").alias("pep_log"))
    y = pairs.year_safety(t, 1996, 2000, growth_bound=1.5)
    return y.select("year", "n", *[r(c).alias(c) for c in ("mean_correction", "max_correction", "share_in_bound", "share_growth_ok")])


def trajectory(s, d):
    return B.panel(s, d).select("fips", "state", "year", F.abs(F.log("truth") - F.log("base")).alias("abs_correction_log"), (F.abs(F.col("base") - F.col("truth")) / F.col("truth") * 100).alias("ape_pop_pct"), (F.col("year") % 2 == 0).alias("has_truth"))


TRAJ = B.PANEL + ", tr AS (SELECT fips, state, year, abs(ln(truth) - ln(base)) AS c, abs(base - truth) / truth * 100 AS ape, year % 2 = 0 AS h FROM panel)"


@query("WITH " + TRAJ + " SELECT fips, arg_min(state, year) AS state, count(*) AS n_years, CAST(sum(CASE WHEN h THEN 1 ELSE 0 END) AS BIGINT) AS n_labeled_years, round(avg(c), 6) AS mean_correction, round(max(c), 6) AS max_correction FROM tr GROUP BY fips")
def county_trajectory_summary(s, d):
    return evaluate.county_rollup(trajectory(s, d)).select("fips", "state", "n_years", "n_labeled_years", r("mean_correction").alias("mean_correction"), r("max_correction").alias("max_correction"))


@query("WITH " + TRAJ + " SELECT year, count(*) AS n, round(avg(c), 6) AS mean_correction, round(max(c), 6) AS max_correction, round(avg(ape), 4) AS mape_pop_pct, bool_or(h) AS has_truth FROM tr GROUP BY year")
def year_metrics_rollup(s, d):
    return evaluate.year_rollup(trajectory(s, d)).select("year", "n", r("mean_correction").alias("mean_correction"), r("max_correction").alias("max_correction"), r("mape_pop_pct", 4).alias("mape_pop_pct"), "has_truth")


@query("WITH " + B.ERRORS + FOLD_METRICS + ", z AS (SELECT model, avg(pep_mape * (1 - adjusted)) AS x FROM fa GROUP BY model) SELECT arg_min(model, x) AS model, round(min(x), 4) AS adjusted_mape FROM z WHERE model <> 'pep'")
def argmin_model(s, d):
    b = pairs.best_contender(fold_frame(s, d).groupBy("model").agg(F.avg("adjusted_mape").alias("adjusted_mape")), "adjusted_mape")
    return b.select("model", r("adjusted_mape", 4).alias("adjusted_mape"))


@query("WITH " + B.ERRORS + " SELECT fold, arg_max(model, x) AS model, round(max(x), 4) AS mape FROM (SELECT fold, model, avg(ape) AS x FROM errors GROUP BY fold, model) GROUP BY fold")
def argmax_model(s, d):
    m = B.errors(s, d).groupBy("fold", "model").agg(F.avg("ape").alias("x"))
    return m.groupBy("fold").agg(F.max_by("model", "x").alias("model"), r(F.max("x"), 4).alias("mape"))


@query("WITH " + B.YEARLY + " SELECT year, count(*) AS n FROM yearly WHERE level > 0 GROUP BY year ORDER BY year LIMIT 1")
def earliest_year_limit(s, d):
    return B.yearly(s, d).where("level > 0").groupBy("year").agg(F.count(F.lit(1)).alias("n")).orderBy("year").limit(1)


@query("WITH " + B.YEARLY + " SELECT fips, year, round(CASE WHEN count(*) OVER (PARTITION BY year) = 1 THEN 1.0 ELSE (row_number() OVER (PARTITION BY year ORDER BY level, fips) - 1) / (count(*) OVER (PARTITION BY year) - 1) END, 6) AS pct FROM yearly")
def percentile_rank_scaled(s, d):
    return B.yearly(s, d).select("fips", "year", r(R.scaled_rank([F.asc("level"), F.asc("fips")], "year")).alias("pct"))


@query("WITH " + B.PANEL + """, k AS (SELECT division, rank() OVER (PARTITION BY division ORDER BY truth) + (count(*) OVER (PARTITION BY division, truth) - 1) / 2.0 AS a, rank() OVER (PARTITION BY division ORDER BY base) + (count(*) OVER (PARTITION BY division, base) - 1) / 2.0 AS b FROM panel)
 SELECT division, count(*) AS n, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS rho FROM k GROUP BY division""")
def spearman_by_group(s, d):
    k = B.panel(s, d).select("division", R.average_rank("truth", "division").alias("a"), R.average_rank("base", "division").alias("b"))
    return k.groupBy("division").agg(F.count(F.lit(1)).alias("n"), r(R.pearson(F.col("a"), F.col("b"))).alias("rho"))


@query("WITH " + B.PANEL + " SELECT state, year, count(*) AS n, round(covar_pop(truth, base) / nullif(stddev_pop(truth) * stddev_pop(base), 0), 6) AS r FROM panel GROUP BY state, year")
def pearson_guarded(s, d):
    return B.panel(s, d).groupBy("state", "year").agg(F.count(F.lit(1)).alias("n"), r(R.pearson(F.col("truth"), F.col("base"))).alias("r"))


@query("WITH " + B.PANEL + """, q AS (SELECT division, truth - base AS x FROM panel), m AS (SELECT division, median(x) AS m, stddev_pop(x) AS s FROM q GROUP BY division), v AS (SELECT q.division, median(abs(x - m)) AS mad, max(s) AS std FROM q JOIN m ON q.division = m.division GROUP BY q.division)
 SELECT division, round(mad, 2) AS mad, round(std, 2) AS std, round(greatest(mad / 0.67449, std, 1e-6), 2) AS scale FROM v""")
def robust_scale_mad(s, d):
    t = R.robust_scale(B.panel(s, d).select("division", (F.col("truth") - F.col("base")).alias("x")), ["division"], "x")
    return t.select("division", r("mad", 2).alias("mad"), r("std", 2).alias("std"), r("scale", 2).alias("scale"))


@query("WITH " + B.PANEL + " SELECT state, round(avg(abs(exp(ln(base)) - exp(ln(truth))) / greatest(abs(exp(ln(truth))), 1e-9) * 100), 4) AS mape FROM panel GROUP BY state")
def mape_log_levels(s, d):
    from ..functions.measures import log_ape

    return B.panel(s, d).groupBy("state").agg(r(F.avg(log_ape(F.log("base"), F.log("truth"))), 4).alias("mape"))


@query("WITH " + B.YEARLY + ", " + B.COUNTIES + ", done AS (SELECT fips, year FROM yearly WHERE n >= 3), work AS (SELECT fips, y.year FROM counties CROSS JOIN (VALUES (1996), (1997)) AS y(year)) SELECT fips, CAST(year AS INT) AS year FROM work w WHERE NOT EXISTS (SELECT 1 FROM done q WHERE q.fips = w.fips AND q.year = w.year)")
def skip_existing_worklist(s, d):
    work = B.counties(s, d).select("fips", F.explode(F.array(F.lit(1996), F.lit(1997))).alias("year"))
    return R.not_done(work, B.yearly(s, d).where("n >= 3"), ["fips", "year"])


@query("""WITH i AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
 p AS (SELECT *, [CAST(round_even(k * (n - 1) / 6.0, 0) AS BIGINT) FOR k IN range(7)] AS ps FROM i) SELECT label, vec_id FROM p WHERE n <= 7 OR list_contains(ps, i)""")
def topk_evenly_spaced_sample(s, d):
    return R.evenly_spaced(B.table(s, d, "embeddings").select("label", "vec_id"), "label", "vec_id", 7)


@query("WITH " + B.PANEL + " SELECT fips, year, round((base - truth) / greatest(base, 1e-9), 6) AS relative, round((base - truth) / greatest(base, 1e-9) - greatest((base - truth) / greatest(base, 1e-9), 0) * 0.3, 6) AS adjusted, CASE WHEN base - truth > 1e-9 THEN 'win' WHEN base - truth < -1e-9 THEN 'loss' ELSE 'equal' END AS outcome FROM panel")
def relative_and_adjusted_improvement(s, d):
    from ..functions.measures import adjusted_improvement

    rel = relative_improvement(F.col("base"), F.col("truth"))
    return B.panel(s, d).select("fips", "year", r(rel).alias("relative"), r(adjusted_improvement(rel, F.lit(0.3))).alias("adjusted"), outcome(F.col("base") - F.col("truth")).alias("outcome"))


@query("WITH " + B.YEARLY + ", q AS (SELECT a.fips, a.year, a.level AS level, b.level AS prev, c.level AS flow FROM yearly a LEFT JOIN yearly b ON a.fips = b.fips AND a.year = b.year + 1 LEFT JOIN yearly c ON a.fips = c.fips AND a.year = c.year + 2) SELECT fips, year, CASE WHEN prev IS NULL THEN NULL ELSE prev + coalesce(flow, 0) - level END AS pseudo_gap, round(ln(CASE WHEN prev + coalesce(flow, 0) > 0 THEN prev + coalesce(flow, 0) END) - ln(level), 6) AS pseudo_log FROM q")
def pseudo_target_step(s, d):
    y = B.yearly(s, d).select("fips", "year", "level")
    one = R.previous_year(y, ["fips"], ["level"])
    two = R.previous_year(one, ["fips"], ["level"], 2, "_flow")
    level = F.col("level_prev") + F.coalesce("level_flow", F.lit(0.0))
    return two.select("fips", "year", (level - F.col("level")).alias("pseudo_gap"), r(F.log(F.when(level > 0, level)) - F.log("level")).alias("pseudo_log"))


@query("WITH e AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, CAST(round(sum(value) * 1000) AS BIGINT) AS total FROM events GROUP BY 1, 2) SELECT CAST(day AS DATE) AS day, event_type, n, total FROM e")
def events_daily_tumbling(s, d):
    from ..streaming.live import daily_totals

    e = daily_totals(B.table(s, d, "events"))
    return e.select(F.to_date("day").alias("day"), "event_type", "n", F.round(F.col("total") * 1000).cast("long").alias("total"))
