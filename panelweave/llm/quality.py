r"""Quality rules with adaptive limits from mergeable quantile sketches.

Per document, integer statistics come from Column expressions alone. Five ratios
go into histograms of log-spaced buckets by language and source (``STEPS`` for
each doubling, one bucket for 0). Such a histogram is a quantile sketch that
merges by adding counts (partial aggregation does it map-side): ranks are exact,
a quantile's value is within 2^(1/16) of the true one, whatever the group's size.
The group's own sketch sets its limits (see ``fences``): a far-out fence over its
quartiles, or the place before a cluster of outliers; where most documents have
none of what a rule counts, the quartiles are those of the others. Groups under
``min_rows`` documents take the merged sketch of their language, or of
everything; where fewer than ``SPARSE`` documents of a larger group say anything
about a rule, it takes the merged sketch of those groups in which that is so rare
as well. One occurrence counts as none: it tells no rate. The limits are
joined to the documents; those beyond one go.

Null and empty texts: no words, rejected by the base rule. Texts of any length
are counted whole. Null lang or source: a group of their own (''). Ties share a
bucket and a verdict; repeated rows are judged one by one, each alike. Extra
columns go along whatever their names, only those named like a result are
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, let, staged

WINDOW = 5
MOST_BROADCAST = 20_000
SALTS = 32
STEPS = 8  # log-spaced buckets for each doubling of a ratio
SMALLEST = 30  # ratios under 2^-30 share the first bucket
NUDGE = 1e-9  # keeps powers of two on one side of a bucket's edge, however a logarithm is rounded
CLUSTERS = 0.95
FAR = 3  # a far-out fence's distance, in interquartile ranges
MIN_ROWS = 30  # documents that a sketch must have to set limits
LEAST = 2  # documents of a cluster of outliers below a larger one
SPARSE = 5  # documents with something to count that it must have where most have none
#: Each rule's ratio: the parts of a whole.
RATIOS = {"symbol_log": ("n_symbols", "word_chars"), "shout_log": ("n_shout", "word_chars"), "upper_log": ("n_upper", "word_chars"), "dup_line_log": ("n_dup_lines", "n_lines"), "repeat_log": ("n_repeat_words", "n_words")}
LOGS = tuple(RATIOS)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many positions lie in a window of words that occurs twice or more in the text."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def covered(x: Column) -> Column:
        pairs = F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda j, v: F.coalesce(F.get(s, j)["h"] == v["h"], F.lit(False))
            return F.filter(s, lambda v, i: same(i - 1, v) | same(i + 1, v))

        at = F.sort_array(F.transform(let(pairs, twice), lambda v: v["i"]))
        step = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, step, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")))["n"]

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    counted = let(hashed, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), 0).otherwise(covered(x)))
    return F.when(F.size(words) < window, 0).otherwise(counted)


def log_bucket(part: Column, whole: Column) -> Column:
    """0 where the part is 0 or 1, else the log-spaced bucket of part / whole, from 1."""
    at = F.floor(STEPS * (F.log(part / whole) / F.lit(math.log(2)) + SMALLEST) + NUDGE) + 1
    return F.when((part > 1) & (whole > 0), F.greatest(at, F.lit(1))).otherwise(0).cast("int")


def stats_of(text: Column) -> Column:
    """A struct of a text's statistics (STATS) and the buckets of its ratios (LOGS)."""
    t = F.coalesce(text, F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        return let(lines, lambda x: F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"), F.size(x).cast("long").alias("n_lines"),
            F.regexp_count(t, F.lit("[!?]")).cast("long").alias("n_shout"), F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        ))

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        return F.struct(*[c[n].alias(n) for n in STATS[:-1]], failed.alias("base_failed"), *[log_bucket(c[a], c[b]).alias(name) for name, (a, b) in RATIOS.items()])

    return let(let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), counts), verdict)


def group_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """lang, source (never null), _s (the statistics) and _row (the row itself)."""
    return df.select(group_of("lang").alias("lang"), group_of("source").alias("source"), stats_of(F.col(text)).alias("_s"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the histograms; base-failed documents do not count."""
    # no filter before the explode: it would be moved to where texts are counted, and count them twice
    buckets = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_s.{name}").alias("bucket")) for name in LOGS])
    long = F.explode(F.when(F.col("_s.base_failed"), F.slice(buckets, 1, 0)).otherwise(buckets))
    return stats.select("lang", "source", long.alias("x")).groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantile(sketch: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Per key: the number of values and, for each share, the first bucket that reaches it."""
    w = W.partitionBy(*keys)
    run = sketch.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    return run.groupBy(*keys).agg(F.max("all").alias("all"), *[F.min(F.when(F.col("cum") >= F.col("all") * s, F.col("bucket"))).alias(f"q{round(100 * s)}") for s in shares])


def middle(bucket: Column) -> Column:
    """The ratio that a log-spaced bucket stands for."""
    return F.when(bucket > 0, F.pow(F.lit(2.0), (bucket - 0.5) / STEPS - SMALLEST)).otherwise(0.0)


def split(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the last bucket before the upper one of the two sides that differ most (Otsu's threshold, the gap between them being the lower side's) and the share of the variance that it explains; no row where all values share a bucket."""
    w = W.partitionBy(*keys)
    v = middle(F.col("bucket"))
    run = sketch.withColumns({"cn": F.sum("n").over(w.orderBy("bucket")), "cx": F.sum(F.col("n") * v).over(w.orderBy("bucket")), "cq": F.sum(F.col("n") * v * v).over(w.orderBy("bucket")), "below": F.lead("bucket").over(w.orderBy("bucket")) - 1})
    run = run.withColumns({"tn": F.max("cn").over(w), "tx": F.max("cx").over(w), "tq": F.max("cq").over(w)}).where("cn < tn")
    gain = F.pow(F.col("cx") * F.col("tn") - F.col("tx") * F.col("cn"), 2) / (F.col("cn") * (F.col("tn") - F.col("cn")))
    share = F.max(gain) / F.max(F.col("tn") * F.col("tq") - F.col("tx") * F.col("tx"))
    at = F.struct(gain, -F.col("bucket"))
    return run.groupBy(*keys).agg(F.max_by("below", at).alias("split"), F.max_by(F.col("tn") - F.col("cn"), at).alias("above"), share.alias("share"))


def outliers_from(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the last bucket before a cluster of outliers: the split of the lower side of the first split, if that side is two clusters and the upper one has LEAST documents, else the first split, if the whole is; else null.

    Two clusters means that CLUSTERS of the variance lies between the sides. Zeros with an even tail reach 8/9, a tail
    evenly between a and 4 a 0.9; the outliers must be about as close together as a factor of two. Looking at the lower
    side too finds outliers of two sizes.
    """
    first = split(sketch, keys).select(*keys, F.col("split").alias("first"), F.col("share").alias("whole"))
    again = split(sketch.join(first, keys).where(F.col("bucket") <= F.col("first")), keys)
    at = F.when((F.col("share") >= CLUSTERS) & (F.col("above") >= LEAST), F.col("split")).when(F.col("whole") >= CLUSTERS, F.col("first"))
    return first.join(again, keys, "left").select(*keys, at.alias("split"))


LEVEL = ["level", "lang", "source", "rule"]


def leveled(sketch: DataFrame, *levels: str) -> DataFrame:
    """The sketch merged at each level, one below the other: "own" by lang and source, "2" by lang, "1" for everything; what a level merges is ''."""
    def merged(level: str) -> DataFrame:
        lang, source = (F.col(c) if level[-1] in kept else F.lit("") for c, kept in (("lang", "n2"), ("source", "n")))
        keys = F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"), "rule", "bucket"
        return sketch.select(*keys, "n").groupBy(*LEVEL, "bucket").agg(F.sum("n").alias("n"))

    return reduce(DataFrame.unionByName, map(merged, levels))


def limits(merged: DataFrame, min_rows: int) -> DataFrame:
    """Per level, lang, source and rule: limit, told (whether it has documents enough for one), all (their number) and usual.

    A ratio is usual in a sketch whose upper quartile is not 0. Then the limit is
    the greater of the far-out fence, q75 + FAR * (q75 - q25) in log-spaced
    buckets (in ratios where q25 is 0), the distance being at least a bucket, and
    the place before a cluster of outliers. Where it is not usual, the limit is
    the place before a cluster of outliers or, without one, the far-out fence
    over the quartiles of what is not 0; null where nothing but 0 occurs.
    """
    some = quantile(merged.where("bucket > 0"), LEVEL, (0.25, 0.75)).withColumnsRenamed({"all": "some", "q25": "p25", "q75": "p75"})
    q = quantile(merged, LEVEL, (0.25, 0.75)).join(outliers_from(merged, LEVEL), LEVEL, "left").join(some, LEVEL, "left")
    low, high = F.col("q25"), F.col("q75")
    usual = F.when(low > 0, high + FAR * F.greatest(high - low, F.lit(1))).otherwise(high + F.lit(int(STEPS * math.log2(1 + FAR))))
    rare = F.coalesce("split", F.col("p75") + FAR * F.greatest(F.col("p75") - F.col("p25"), F.lit(1)))
    limit = F.when(high > 0, F.greatest(usual, F.col("split"))).otherwise(rare)
    told = F.coalesce((F.col("all") >= min_rows) & ((high > 0) | (F.col("some") >= SPARSE)), F.lit(False))
    return staged(q.select(*LEVEL, limit.alias("limit"), told.alias("told"), "all", (high > 0).alias("usual")), "quality_limits")


def fences(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, one limit per rule, n_own); n_own is how many limits come from the group itself.

    A group whose sketch does not tell takes the sketch of its language or, if that does not either, of everything: the
    whole one where the group is small, else that of the groups that do not show the ratio as usual.
    """
    found = limits(leveled(sketch, "own", "all2", "all1"), min_rows)
    own = found.where("level = 'own'").drop("level")
    quiet = sketch.join(own.where((F.col("all") >= min_rows) & F.col("usual")).select("lang", "source", "rule"), ["lang", "source", "rule"], "left_anti")
    other = found.unionByName(limits(leveled(quiet, "quiet2", "quiet1"), min_rows)).where("level <> 'own'")
    pool = F.when(F.col("all") < min_rows, "all").otherwise("quiet")
    full = own.withColumns({"_2": F.concat(pool, F.lit("2")), "_1": F.concat(pool, F.lit("1"))})
    for n, lang in (("2", F.col("lang")), ("1", F.lit(""))):
        of = other.select(F.col("level").alias("_level"), F.col("lang").alias("_lang"), F.col("rule").alias("_rule"), F.col("limit").alias(f"limit{n}"), F.col("told").alias(f"told{n}"))
        full = full.join(of, (F.col(f"_{n}") == F.col("_level")) & (lang == F.col("_lang")) & (F.col("rule") == F.col("_rule")), "left").drop("_level", "_lang", "_rule")
    picked = F.when(F.col("told"), F.col("limit")).when(F.col("told2"), F.col("limit2")).otherwise(F.col("limit1"))
    return full.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == name, picked)).cast("long").alias(f"max_{name}") for name in LOGS], F.count_if(F.col("told") & F.col("limit").isNotNull()).alias("n_own"))


def judge(stats: DataFrame, bounds: DataFrame) -> DataFrame:
    """Joins the limits and adds kept and n_own. Few limits (their count is checked) are broadcast; more are joined salted, so that a hot source is spread."""
    b = bounds.withColumnsRenamed({"lang": "_l", "source": "_g"})
    on = (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_g"))
    if bounds.count() <= MOST_BROADCAST:
        both = stats.join(F.broadcast(b), on, "left")
    else:
        b = b.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = stats.withColumn("_salt", F.pmod(F.xxhash64("_s"), F.lit(SALTS)).cast("int"))
        both = salted.join(b, on & (F.col("_salt") == F.col("_k")), "left")
    within = F.lit(True)
    for name in LOGS:
        within = within & (F.col(f"_s.{name}") <= F.coalesce(F.col(f"max_{name}"), F.lit(1 << 40)))
    # the least of both, not their conjunction: half of a filter on it would go below the join and count every text again
    kept = F.least(~F.col("_s.base_failed"), within)
    return both.select("_row", "_s", kept.alias("kept"), F.coalesce("n_own", F.lit(0)).alias("n_own"))


def fences_of(stats: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    return staged(fences(staged(sketches(stats), "quality_sketch"), min_rows), "quality_fences")


def assess(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """df with kept, the statistics and n_own. Texts are counted twice, for the limits and for the verdict, and neither written nor moved."""
    made = ("kept", "n_own", *STATS, *LOGS)
    had = [F.col(f"`{c}`") for c in df.columns if c not in made]
    judged = judge(with_stats(df.select(*had)), fences_of(with_stats(df.select("text", "lang", "source")), min_rows))
    return judged.select("_row.*", "_s.*", "kept", "n_own")


def report(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The statistics, the verdict, the ratios' buckets and, of the five limits that were applied, how many are the group's own (0 where it has none). A written table without texts serves limits and verdict."""
    table = staged(with_stats(df.select("doc_id", "text", "lang", "source")).select("lang", "source", "_s", F.struct("_row.doc_id").alias("_row")), "quality")
    return judge(table, fences_of(table, min_rows)).select("_row.doc_id", *[f"_s.{n}" for n in STATS], "kept", *[f"_s.{n}" for n in LOGS], "n_own")


def _sql(min_rows: int = MIN_ROWS) -> str:
    """The report in SQL, from the same constants."""
    value = f"CASE WHEN bucket > 0 THEN pow(2.0, (bucket - 0.5) / {STEPS} - {SMALLEST}) ELSE 0 END"
    log = lambda a, b: f"CASE WHEN {a} > 1 AND {b} > 0 THEN greatest(floor({STEPS} * (ln({a} / {b}) / {math.log(2)!r} + {SMALLEST}) + {NUDGE}) + 1, 1) ELSE 0 END"
    long = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS rule, {n} AS bucket FROM s WHERE NOT base_failed" for n in LOGS)

    def split(name: str, table: str, keys: str) -> str:
        gain = "pow(cx * tn - tx * cn, 2) / (cn * (tn - cn))"
        return f"""{name}r AS (SELECT {keys}, bucket, lead(bucket) OVER up - 1 AS below, sum(n) OVER up AS cn, sum(n * v) OVER up AS cx, sum(n) OVER every AS tn, sum(n * v) OVER every AS tx, sum(n * v * v) OVER every AS tq
 FROM (SELECT *, {value} AS v FROM {table}) WINDOW up AS (PARTITION BY {keys} ORDER BY bucket), every AS (PARTITION BY {keys})),
{name} AS (SELECT {keys}, arg_max(below, {gain}) AS split, arg_max(tn - cn, {gain}) AS above, max({gain}) / max(tn * tq - tx * tx) AS share FROM {name}r WHERE cn < tn GROUP BY {keys})"""

    def level(i: int, keys: str, of: str = "h") -> str:
        on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
        return f"""m{i} AS (SELECT {keys}, bucket, CAST(sum(n) AS DOUBLE) AS n FROM {of} GROUP BY {keys}, bucket),
q{i} AS (SELECT {keys}, max(al) AS al, min(bucket) FILTER (cum >= al * 0.25) AS low, min(bucket) FILTER (cum >= al * 0.75) AS high, max(som) AS som,
 min(bucket) FILTER (bucket > 0 AND cum - al + som >= som * 0.25) AS lower, min(bucket) FILTER (bucket > 0 AND cum - al + som >= som * 0.75) AS upper
 FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {keys}) AS al, coalesce(sum(n) FILTER (bucket > 0) OVER (PARTITION BY {keys}), 0) AS som FROM m{i}) GROUP BY {keys}),
{split(f"f{i}", f"m{i}", keys)},
u{i} AS (SELECT m{i}.* FROM m{i} JOIN f{i} ON {on(f"m{i}", f"f{i}")} WHERE bucket <= split),
{split(f"g{i}", f"u{i}", keys)},
l{i} AS (SELECT q{i}.*, al >= {min_rows} AND (high > 0 OR som >= {SPARSE}) AS told, CASE WHEN high > 0 THEN CASE WHEN b IS NULL THEN a ELSE greatest(a, b) END ELSE coalesce(b, upper + {FAR} * greatest(upper - lower, 1)) END AS l FROM
 (SELECT q{i}.*, CASE WHEN low > 0 THEN high + {FAR} * greatest(high - low, 1) ELSE high + {int(STEPS * math.log2(1 + FAR))} END AS a,
 CASE WHEN g{i}.share >= {CLUSTERS} AND g{i}.above >= {LEAST} THEN g{i}.split WHEN f{i}.share >= {CLUSTERS} THEN f{i}.split END AS b FROM q{i} LEFT JOIN f{i} ON {on(f"q{i}", f"f{i}")} LEFT JOIN g{i} ON {on(f"q{i}", f"g{i}")}) q{i})"""

    over = " OR ".join(f"{n} > max_{n}" for n in LOGS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM c WHERE c > 1) GROUP BY doc_id),
a AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[!?]')) AS n_shout, len(regexp_extract_all(t, '[A-Z]')) AS n_upper FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {', '.join(f"CAST({log(x, y)} AS INT) AS {n}" for n, (x, y) in RATIOS.items())} FROM a),
h AS (SELECT lang, source, rule, bucket, count(*) AS n FROM ({long}) GROUP BY ALL),
{level(3, "lang, source, rule")},
{level(2, "lang, rule")},
{level(1, "rule")},
quiet AS (SELECT h.* FROM h JOIN l3 USING (lang, source, rule) WHERE NOT (l3.al >= {min_rows} AND l3.high > 0)),
{level(5, "lang, rule", "quiet")},
{level(4, "rule", "quiet")},
lim AS (SELECT l3.lang, l3.source, {', '.join(f"max(CASE WHEN l3.rule = '{n}' THEN CASE WHEN l3.told THEN l3.l WHEN l3.al < {min_rows} THEN CASE WHEN l2.told THEN l2.l ELSE l1.l END WHEN l5.told THEN l5.l ELSE l4.l END END) AS max_{n}" for n in LOGS)},
 CAST(count(*) FILTER (l3.told AND l3.l IS NOT NULL) AS BIGINT) AS n_own FROM l3 JOIN l2 ON l3.lang = l2.lang AND l3.rule = l2.rule JOIN l1 ON l3.rule = l1.rule LEFT JOIN l5 ON l3.lang = l5.lang AND l3.rule = l5.rule LEFT JOIN l4 ON l3.rule = l4.rule GROUP BY l3.lang, l3.source)
SELECT doc_id, {', '.join(STATS)}, NOT base_failed AND NOT coalesce({over}, false) AS kept, {', '.join(LOGS)}, coalesce(n_own, 0) AS n_own FROM s LEFT JOIN lim ON s.lang = lim.lang AND s.source = lim.source
"""


SQL = _sql()
