import random
import re
from collections import defaultdict

import numpy as np
import pytest

from panelweave.llm import ngram_join as N


def sets(rows, k):
    out = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))
        out[r.doc_id] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, k, percent):
    s = sets(rows, k)
    parent = {d: d for d in s if d is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    held = defaultdict(list)
    for d, grams in s.items():
        if d is not None:
            for g in grams:
                held[g].append(d)
    done = set()
    for ds in held.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) in done:
                    continue
                done.add((a, b))
                o = len(s[a] & s[b])
                if 100 * o >= percent * (len(s[a]) + len(s[b]) - o):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(g), find(d) if d is not None else None) for d, g in s.items()}


def check(df, k, percent, exact=False):
    rows = df.select("doc_id", "text").collect()
    got = N.with_components(df, k, percent, exact).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, percent)


@pytest.fixture(scope="module")
def copies(spark):
    """Clusters of near copies on both sides of the threshold, and a passage that many documents share."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            text = " ".join(t)
            rows.append((n, f"{text} {passage}" if rng.random() < 0.4 else text))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
@pytest.mark.parametrize("exact", [False, True])
def test_copies(copies, k, percent, exact):
    check(copies, k, percent, exact)


def test_real(real):
    check(real, 4, 85)


def test_large_clusters(copies, monkeypatch):
    """The same when clusters are split by other keys and cut into chunks of two, and tasks combine a few keys at a time."""
    for name, value in (("CHUNK", 4), ("REST", 2), ("BATCH", 64)):
        monkeypatch.setattr(N, name, value)
    check(copies, 4, 85)
    monkeypatch.setattr(N, "LEVELS", 1)
    check(copies, 5, 80, exact=True)


def test_odd(odd, none):
    from pyspark.sql import functions as F

    check(odd, 4, 85)
    assert N.with_components(none).count() == 0
    assert odd.where(F.col("doc_id") == 8).count() == 2


def test_repeated_rows(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:30], "other", *words[31:]]
    rows = [(3, " ".join(near)), (3, " ".join(near)), (2, " ".join(words)), (2, " ".join(words)), (9, "quite another text of some words")]
    got = sorted(map(tuple, N.with_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()))
    assert got == [(2, 57, 2), (2, 57, 2), (3, 57, 2), (3, 57, 2), (9, 3, 9)]


def test_hashes_follow_words():
    h = N.shingles
    assert (h("A b\tc  D e", 4) == h("a B c d E", 4)).all() and len(h("a b c d e", 4)) == 2
    assert len(h("", 4)) == 0 and len(h(" \n", 4)) == 0 and len(h("a b", 4)) == 1
    assert h("a b", 4)[0] != h("b a", 4)[0] and h("ab", 4)[0] != h("a b", 4)[0] and h("É", 1)[0] != h("é", 1)[0]
    rng = random.Random(0)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    assert len({int(x) for w in set(words) for x in h(w, 1)}) == len(set(words))


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_key(percent):
    """Whatever the size, the level and the way in which two linked sets differ."""
    rng = np.random.default_rng(2)
    met = 0
    for n in [*range(1, 60), 75, 99, 130, 300, 1000, 5000] * 6:
        base = rng.integers(0, 1 << 62, 2 * n + 2).astype(np.uint64)
        a = np.unique(base[:n])
        gone, more = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 2)
        b = np.unique(np.concatenate((a[gone:], base[n : n + more])))
        o = n - gone
        if not gone and not more or 100 * o < percent * (len(a) + len(b) - o):
            continue
        met += 1
        for level in range(N.LEVELS + 1):
            assert len(np.intersect1d(N.part_keys(a, percent, level), N.part_keys(b, percent, level)))
    assert met > 60


@pytest.mark.parametrize("percent", [80, 85, 95, 98, 99, 100])
def test_bands_miss_no_pair_at_the_threshold(percent):
    """The bound, and 300 pairs of sets that are just linked."""
    count, rows = N.bands(percent)
    assert (1 - (percent / 100) ** rows) ** count <= N.MISS
    rng = np.random.default_rng(percent)
    for n in [7, 20, 100] * 100:
        both = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        o = -(-percent * 2 * n // (100 + percent))  # the least overlap of two sets of n
        a, b = np.sort(both[:n]), np.sort(both[n - o : 2 * n - o])
        for level in range(2):
            assert len(np.intersect1d(N.band_keys(a, percent, level), N.band_keys(b, percent, level)))


@pytest.mark.parametrize("percent", [96, 98, 99])
def test_high_thresholds(spark, percent):
    """Texts of 400 words that differ at their end: by one word they are linked at 98 per cent and under, by one that is missing at 99 too."""
    words = [f"w{i}" for i in range(403)]
    table = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join([*words[:-2], "x", "y"])), (4, " ".join(words[:200])), (5, None)]
    got = {r.doc_id: r.component_id for r in N.with_components(spark.createDataFrame(table, "doc_id long, text string"), 4, percent).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in table if t}
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    assert linked(1, 2)
    assert got == {1: 1, 2: 1, 3: 1 if linked(1, 3) or linked(2, 3) else 3, 4: 4, 5: 5}


def test_badly_dealt_sets_share_a_key(monkeypatch):
    """Without spare parts nearly every set is dealt again, some by every hash."""
    monkeypatch.setattr(N, "dealt", lambda low, percent: (40, 0))
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 62, 30).astype(np.uint64))
    b = a[1:]
    assert len(np.intersect1d(N.part_keys(a, 85), N.part_keys(b, 85)))


def test_pages_of_one_template(spark, monkeypatch):
    """Pages share half their words and no pair is linked, but for some copies: large clusters of them fall apart, and copies are found."""
    rng = random.Random(8)
    rows = []
    for t in range(3):
        frame = [f"t{t}x{i}" for i in range(60)]
        for i in range(120):
            own = [f"p{t}y{i}z{rng.random()}" for _ in range(60)]
            rows.append((t * 1000 + i, " ".join(frame + own)))
            if i % 10 == 0:
                own[rng.randrange(60)] = "other"
                rows.append((t * 1000 + 500 + i, " ".join(frame + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {t * 1000 + 500 + i: t * 1000 + i for t in range(3) for i in range(0, 120, 10)}
    for chunk in (1000, 16):
        monkeypatch.setattr(N, "CHUNK", chunk)
        got = N.with_components(df, 4, 85).where("component_id <> doc_id").collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_it_says_so_if_rounds_do_not_suffice(spark, monkeypatch):
    monkeypatch.setattr(N, "ROUNDS", 1)
    monkeypatch.setattr(N, "contracted", lambda edges: edges)
    with pytest.raises(RuntimeError):
        N.components(spark.createDataFrame([(i, i + 1) for i in range(1, 200)], "a long, b long"), "t")


def test_tree_finds_every_link():
    rng = np.random.default_rng(1)
    universe = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    grams = [np.unique(rng.choice(universe, rng.integers(1, 60))) for _ in range(120)]
    grams += [np.unique(np.concatenate((g[1:], rng.choice(universe, 1)))) for g in grams[:60]]
    roots = N.connect(grams, list(range(len(grams))), 80)
    parent = list(range(len(grams)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(grams)):
        for j in range(i):
            o = len(np.intersect1d(grams[i], grams[j]))
            if 100 * o >= 80 * (len(grams[i]) + len(grams[j]) - o):
                parent[find(i)] = find(j)
    for i in range(len(grams)):
        for j in range(i):
            assert (find(i) == find(j)) == (roots.find(i) == roots.find(j))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (200, 201), (201, 202), (203, 202), (203, 200)]
    got = {r.v: r.root for r in N.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100} | {i: 200 for i in range(200, 204)}
