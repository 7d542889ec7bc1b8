import math
import re
from collections import Counter

from panelweave.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def check(df):
    want = sorted(str((r.doc_id, *brute(r.text))) for r in df.collect())
    rows = quality.report(df).collect()
    assert sorted(str(tuple(r[:7])) for r in rows) == want
    assert all(not (r.base_failed and r.kept) for r in rows)
    return rows


def test_statistics(real):
    rows = check(real)
    assert sum(r.kept for r in rows) > 0.7 * len(rows)


def test_odd_rows(odd, none):
    check(odd)
    assert quality.report(none).count() == 0
    assert quality.assess(none).where("kept").count() == 0


def test_sketches_merge(real):
    stats = quality.with_stats(real).drop("_row").cache()
    even = quality.F.pmod(quality.F.col("_s.word_chars"), 2) == 0
    merged = quality.sketches(stats.where(even)).union(quality.sketches(stats.where(~even))).groupBy("lang", "source", "rule", "bucket").sum("n")
    assert sorted(map(str, map(tuple, merged.collect()))) == sorted(map(str, map(tuple, quality.sketches(stats).collect())))


def test_quantiles(spark):
    rows = spark.createDataFrame([("k", b, 1) for b in range(100)], "rule string, bucket int, n long")
    q = quality.quantile(rows, ["rule"], (0.5, 0.75)).first()
    assert (q["all"], q["q50"], q["q75"]) == (100, 49, 74)


def test_a_sketch_quantile_is_near_the_true_one(spark):
    """The rank is exact, the value within half a bucket: a factor of 2^(1/16)."""
    import random

    rng = random.Random(4)
    values = [(rng.randint(1, 10**6), rng.choice([10**6, 3 * 10**7])) for _ in range(2000)]
    df = spark.createDataFrame(values, "a long, b long").select(quality.log_bucket(quality.F.col("a"), quality.F.col("b")).alias("bucket"), quality.F.lit("k").alias("rule"))
    sketch = df.groupBy("rule", "bucket").agg(quality.F.count("*").alias("n"))
    q = quality.quantile(sketch, ["rule"], (0.25, 0.5, 0.75, 0.99)).first()
    exact = sorted(a / b for a, b in values)
    for share in (0.25, 0.5, 0.75, 0.99):
        true, got = exact[math.ceil(share * len(exact)) - 1], 2 ** ((q[f"q{round(100 * share)}"] - 0.5) / quality.STEPS - quality.SMALLEST)
        assert abs(math.log2(got / true)) <= 1 / 16 + 1e-6 or true * 10**6 < 3  # one occurrence counts as none


def test_limits_follow_the_group(spark):
    """A source in which signs are usual keeps documents that another source would lose."""
    words = " ".join(f"w{i}" for i in range(40))
    table = [(i, words + "".join(f" v{j}##" for j in range(6 + i % 6)), "en", "code", 1) for i in range(300)] + [(1000 + i, words, "en", "prose", 1) for i in range(300)] + [(2000, words + "".join(f" v{j}##" for j in range(11)), "en", "prose", 1)]
    kept = {r.doc_id: r.kept for r in quality.report(spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert kept[5] and kept[1000] and not kept[2000]


def test_salted_join_is_the_same(real, monkeypatch):
    a = quality.report(real).select("doc_id", "kept").collect()
    monkeypatch.setattr(quality, "MOST_BROADCAST", 0)
    assert sorted(a) == sorted(quality.report(real).select("doc_id", "kept").collect())


def test_fences_are_the_groups_own(spark):
    """Small ratios are told apart, all of them under 105 per mille: what is usual among the loud is too much among the plain, and signs are too many where nobody uses them."""
    def text(capitals, signs=0):
        return " ".join(f"word{chr(97 + i % 26)}{i:04d}" for i in range(400)) + " " + "Q" * capitals + "#" * signs

    usual = {"plain": 6, "loud": 60}
    table = [(1000 * k + i, text(n + i % 3 * n // 6, 20 * k), "en", s, 1) for k, (s, n) in enumerate(usual.items()) for i in range(300)]
    table += [(5000, text(30), "en", "plain", 1), (5001, text(60), "en", "plain", 1), (5002, text(400, 20), "en", "loud", 1), (5003, text(6, 20), "en", "plain", 1)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r.doc_id: r for r in quality.report(df).collect()}
    assert sorted(d for d, r in rows.items() if not r.kept) == [5000, 5001, 5002, 5003] and {r.n_own for r in rows.values()} == {1, 2}  # capitals, and signs where they are usual
    assert sorted(r.doc_id for r in quality.assess(df).where("not kept").collect()) == [5000, 5001, 5002, 5003]


def test_one_sign_is_no_reason(spark):
    """A document with one or two signs stays, whether its group has documents full of them or not; those go."""
    def text(i, signs="", n=120):
        return " ".join(f"word{chr(97 + k % 26)}{i:03d}{k:03d}" for k in range(n)) + signs

    rows = [(i, text(i), "en", s, 1) for s in ("plain", "dirty") for i in range(400)]
    rows += [(1000 + i, text(i, "".join(f" v{j}###$$%&&" for j in range(12))), "en", "dirty", 1) for i in range(12)]
    rows += [(2000, text(1, " $5"), "en", "plain", 1), (2001, text(2, " r&d"), "en", "dirty", 1), (2002, text(3, " r&d $7"), "en", "dirty", 1), (2003, text(4, " wow!"), "en", "plain", 1)]
    got = quality.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).where("doc_id >= 1000").collect()
    assert sorted(r.doc_id for r in got if r.kept) == [2000, 2001, 2002, 2003]


def two_sides(v, ratio, mean):
    sides = {x: ([y for y in v if y <= x], [y for y in v if y > x]) for x in sorted(set(v))[:-1]}
    if not sides:
        return 0, 0
    gain = {x: len(a) * len(b) * (mean(b) - mean(a)) ** 2 / len(v) for x, (a, b) in sides.items()}
    at = max(gain, key=gain.get)
    return at, gain[at] / sum((ratio(y) - mean(v)) ** 2 for y in v)


def test_fences_like_brute_force(real):
    """Every limit, with its fallbacks, and every verdict from plain sorted lists."""
    least = 8
    rows = quality.report(real, least).join(real.select("doc_id", "lang", "source"), "doc_id").collect()
    own = {}
    for r in rows:
        for name in quality.LOGS:
            if not r.base_failed:
                own.setdefault((r.lang or "", r.source or "", name), []).append(r[name])

    def level(v):
        """Whether this sketch tells enough, its limit, its size and whether the ratio is usual in it."""
        v, some = sorted(v), sorted(x for x in v if x)
        ratio = lambda x: 2 ** ((x - 0.5) / 8 - 30) if x else 0.0
        at = lambda v, share: v[math.ceil(share * len(v)) - 1]
        mean = lambda x: sum(map(ratio, x)) / len(x)
        gap = lambda x: min(y for y in v if y > x) - 1
        first, whole = two_sides(v, ratio, mean)
        lower = [x for x in v if x <= first]
        again, part = two_sides(lower, ratio, mean)
        cut = gap(again) if part >= 0.95 and sum(x > again for x in lower) >= quality.LEAST else gap(first) if whole >= 0.95 else None
        low, high = at(v, 0.25), at(v, 0.75)
        if high:
            far = high + 3 * max(high - low, 1) if low else high + 16
            return len(v) >= least, max(x for x in (far, cut) if x is not None), len(v), True
        if cut is None and some:
            cut = at(some, 0.75) + 3 * max(at(some, 0.75) - at(some, 0.25), 1)
        return len(v) >= least and len(some) >= quality.SPARSE, math.inf if cut is None else cut, len(v), False

    def limit(r, name):
        key = r.lang or "", r.source or "", name
        if key not in own:
            return math.inf, False
        told, cut, n, _ = level(own[key])
        if told:
            return cut, cut < math.inf
        of = {k: v for k, v in own.items() if k[2] == name and (n < least or not (level(v)[2] >= least and level(v)[3]))}
        found = [level(sum((v for k, v in of.items() if k[0] in (key[0], lang)), [])) for lang in (key[0], None)]
        every = level(sum(of.values(), []))
        return (found[0][1] if found[0][0] else every[1]), False

    cache = {k: limit(r, k[2]) for r in rows for n in quality.LOGS for k in [(r.lang, r.source, n)]}
    for r in rows:
        assert r.kept == (not r.base_failed and all(r[n] <= cache[r.lang, r.source, n][0] for n in quality.LOGS)), r
        assert r.n_own == sum(cache[r.lang, r.source, n][1] for n in quality.LOGS)
    assert any(r.n_own > 0 for r in rows)
    assert any(not r.kept and not r.base_failed for r in rows)


def test_clashing_names(real):
    df = real.limit(20).selectExpr("*", "1 AS _s", "2 AS _row", "3 AS kept", "4 AS n_words", "5 AS symbol_log", "6 AS max_symbol_log", "7 AS _l", "8 AS `a.b`")
    got = quality.assess(df)
    assert got.count() == 20 and got.select("_s", "_row", "max_symbol_log", "_l", "`a.b`").distinct().collect() == [(1, 2, 6, 7, 8)]
