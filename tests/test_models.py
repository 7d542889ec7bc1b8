import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import embed, evaluate as E, folds, graph as G, hypothesis as H, kernels as KE, models as M, tuning


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    return x, x @ np.array([1.0, -2.0, 0.0, 0.5]) + 3 + rng.normal(size=200) * 0.1


def test_gradient(data):
    x, y = data
    f = M.huber_loss(x, y, 0.1, 1.35, 0.7, M.residual_scale(y))
    p = np.random.default_rng(1).normal(size=5)
    g = f(p)[1]
    for i in range(5):
        h = np.zeros(5)
        h[i] = 1e-6
        assert (f(p + h)[0] - f(p - h)[0]) / 2e-6 == pytest.approx(g[i], abs=1e-6)
    coef, b = M.huber(x, y, 0.1, 1.35, 0.7)
    assert np.abs(f(np.append(coef, b))[1]).max() < 1e-6


def test_huber_resists_outliers(data):
    x, y = data
    bad = y.copy()
    bad[:10] += 1000
    coef, b = M.huber(x, bad, 1e-6)
    assert np.abs(coef - [1, -2, 0, 0.5]).max() < 30 and abs(b - 3) < abs(M.ridge(x, bad, 1e-6)[1] - 3)


def test_elastic_net(data):
    x, y = data
    a, l1 = 0.05, 0.5
    b, c = M.elastic_net(x, y, a, l1)
    r = y - x @ b - c
    g = -(x - x.mean(0)).T @ r / len(y) + a * (1 - l1) * b
    for j in range(4):
        assert abs(g[j] + a * l1 * np.sign(b[j])) < 1e-6 if b[j] else abs(g[j]) <= a * l1 + 1e-8
    assert np.allclose(M.elastic_net(x, y, 0.1, 0.0)[0], M.ridge(x, y, 20.0)[0])


def test_kernel_ridge_interpolates(data):
    x, y = data
    for name in ("rbf", "laplacian"):
        assert np.abs(KE.kernel_ridge(x, y, x, 1e-8, name) - y).max() < 1e-2
    assert KE.kernel_features(x, x[:5])[1].shape == (5, 200)


def test_capped_delta(data):
    x, y = data
    base = M.fit("ridge", x, y, alpha=1.0)
    d = M.capped_delta(base, x, y * 10, 1e-4)
    assert np.sqrt(d.coef @ d.coef + d.intercept**2) <= 0.05 * np.sqrt(base.coef @ base.coef + base.intercept**2) + 1e-12


def test_fits_predict_in_the_plan(spark, data):
    x, y = data
    df = spark.createDataFrame([(i % 2, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, x array<double>, y double")
    m = M.fits(df, "k", "x", "y", "ridge", alpha=1.0)
    got = df.join(m, "k").select("k", "x", M.predicted(F.col("x")).alias("p")).collect()
    want = {k: M.fit("ridge", x[k::2], y[k::2], alpha=1.0) for k in (0, 1)}
    assert all(r.p == pytest.approx(want[r.k].predict(np.array(r.x))) for r in got)


def test_folds():
    counts = {"01": 5, "05": 9, "06": 3, "53": 2, "09": 4, "25": 4, "99": 7}
    f = folds.balanced(counts, 2)
    assert "99" not in f and f["25"] != f["09"] and f["06"] != f["53"] and set(f.values()) == {1, 2}
    assert folds.grouped({"a": 5, "b": 3, "c": 3}, 2) == {"a": 1, "b": 2, "c": 2}
    with pytest.raises(ValueError):
        folds.balanced({"01": 1}, 5)


def edges(spark):
    rows = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "a", 1.0), ("c", "d", 1.0), ("d", "z", 1.0)]
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_leakage(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 1)], "node string, fold int")
    got = {r.fold: r for r in G.leakage(edges(spark), f).collect()}
    # a sends 2/3 across, c and d nothing: they have no crossing edge and are left out
    assert got[1].outbound == pytest.approx(2 / 3) and got[2].outbound == pytest.approx(1.0)
    zero = {r.fold: r for r in G.leakage(edges(spark), f, zeros=True).collect()}
    assert zero[1].outbound == pytest.approx(2 / 9) and zero[1].bidirectional == pytest.approx((2 / 9 + 1 / 3) / 2)


def test_normalise_and_finalise(spark):
    w = {(r.src, r.dst): r.weight for r in G.row_normalised(edges(spark)).collect()}
    assert w["a", "b"] == pytest.approx(2 / 3)
    f = {(r.src, r.dst): r.weight for r in G.finalised(edges(spark), 1).collect()}
    assert f["b", "a"] == pytest.approx(1.0) and ("a", "c") not in f
    assert {(r.src, r.dst) for r in G.mutual(edges(spark)).collect()} == {("a", "b"), ("b", "a")}
    assert {r.src: r.dst for r in G.random_neighbours(edges(spark)).collect()}["c"] == "d"
    both = G.fused([(edges(spark), 0.0), (edges(spark), 0.0)])
    assert {(r.src, r.dst): r.weight for r in both.collect()}["a", "b"] == pytest.approx(2.0)


def test_range_join(spark):
    rng = np.random.default_rng(3)
    pts = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-70, 75, 300), rng.uniform(-180, 180, 300), strict=True))]
    pts += [(1000, 10.0, 179.9), (1001, 10.0, -179.9), (1002, 60.1, 0.0), (1003, 59.9, 0.3)]
    got = {(r.src, r.dst) for r in G.distances_within(spark.createDataFrame(pts, "id int, lat double, lon double"), 800.0).collect()}

    def km(p, q):
        a, b, c, d = map(np.radians, (p[1], p[2], q[1], q[2]))
        return 2 * 6371.0 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    assert got == {(p[0], q[0]) for p in pts for q in pts if p[0] != q[0] and km(p, q) <= 800}


def test_basis_and_alignment(spark):
    rng = np.random.default_rng(2)
    w = rng.random((30, 30)) * (1 - np.eye(30))
    values, vectors = G.moran_basis(w, 5, 30)
    c = np.eye(30) - 1 / 30
    assert np.allclose(c @ ((w + w.T) / 2) @ c @ vectors, vectors * values) and (np.diff(values) <= 0).all() and values.min() > 1e-9
    turned = vectors[:, [2, 0, 1, 4, 3]] * [1, -1, 1, 1, -1]
    back, reported, mean = G.aligned(turned, vectors, 30)
    assert np.allclose(back, vectors) and mean == pytest.approx(1.0) and reported == pytest.approx(1 / 30)
    assert G.aligned(turned, vectors, 10)[0] is turned
    assert G.grassmann_squared(vectors, turned) == pytest.approx(0, abs=1e-12)
    assert G.grassmann_squared(np.eye(4)[:, :1], np.eye(4)[:, 1:2]) == pytest.approx((np.pi / 2) ** 2)


def test_rand_index(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert G.adjusted_rand(df, "a", "b").first().ari == pytest.approx(1.0)
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, b int")
    assert G.adjusted_rand(df, "a", "b").first().ari == pytest.approx(-0.5)
    assert G.dominant(spark.createDataFrame([(1.0, 3.0, 3.0)], "a double, b double, c double"), ["a", "b", "c"]).first().dominant == "b"
    assert G.modality_groups(["x", "y"]) == [("full", ("x", "y")), ("single:x", ("x",)), ("single:y", ("y",))]


def test_sign_flips():
    s = np.array([1.0, 2.0, -0.5, 3.0])
    flips = [sum(v if b >> i & 1 else -v for i, v in enumerate(s)) for b in range(16)]
    assert H.sign_flip(s) == pytest.approx((1 + sum(f >= s.sum() - 1e-9 for f in flips)) / 17)
    assert abs(H.sign_flip(np.ones(30) * 0.1 + np.arange(30) % 2, draws=4000, exact_up_to=20) - 1 / 4001) < 1e-3
    est, p = H.weighted_flip(np.array([1.0, 1.0, 1.0]), np.array([1.0, 2.0, 1.0]), draws=4000)
    assert est == pytest.approx(1.0) and p == pytest.approx(1 / 8, abs=0.03)


def test_sign_flips_of_every_block():
    """All signs of 22 blocks, which sign_flip would draw from, and of few blocks as sign_flip has them."""
    s = np.random.default_rng(3).normal(0.2, 1.0, 22)
    assert H.sign_flip_all(s) == pytest.approx(H.sign_flip(s, exact_up_to=22), rel=1e-12)
    for few in ([1.0, 2.0, -0.5, 3.0], [0.0, 0.0, 1.0], [2.0]):
        assert H.sign_flip_all(np.array(few), 0.1) == pytest.approx(H.sign_flip(np.array(few), 0.1), rel=1e-12)
    assert H.sign_flip_all(np.ones(25)) == 2 / (2**25 + 1) and np.isnan(H.sign_flip_all(np.array([])))


def test_sign_flip_query_takes_every_state(spark):
    from panelweave.plans import catalog
    from panelweave.plans.relational import pair_frame

    d = "/root/testdata/sf0.01"
    x = np.array([r.x for r in pair_frame(spark, d).groupBy("state").agg(F.avg("adjusted_delta").alias("x")).collect()])
    r = catalog.queries()["signflip_exact_states"](spark, d).first()
    assert len(x) > 10 and (r.n_states, r.n_flips) == (len(x), 2 ** len(x))
    drawn = np.random.default_rng(1).integers(0, 2, (200_000, len(x))) * 2 - 1
    assert r.p == pytest.approx((drawn @ x >= x.sum() - 1e-9).mean(), abs=0.006)


def test_hac_paths(spark):
    rng = np.random.default_rng(5)
    data = [(f"b{i % 60}", "d", float(i % 60) * 1000, 0.0, float(1 + rng.normal() * 0.1), 10.0) for i in range(240)]
    df = spark.createDataFrame(data, "block_id string, division string, x_km double, y_km double, n double, d double")
    r = H.hac_test(df, "n", "d", 0.0, 500.0)
    assert r["test_name"] == "spatial_hac_t" and r["n_groups"] == 60 and r["ci_low"] < r["estimate"] < r["ci_high"] and r["passed"]
    few = H.hac_test(df.where("block_id IN ('b1', 'b2', 'b3', 'b4', 'b5', 'b6')"), "n", "d", 0.0, 500.0)
    assert few["test_name"] == "block_sign_flip" and few["p_value"] == pytest.approx(2 / 65)
    s = H.sign_test(spark.createDataFrame([(1.0,), (1.0,), (-1.0,), (0.0,)], "v double"), "v")
    assert s["estimate"] == pytest.approx(2 / 3) and s["p_value"] == pytest.approx(0.5) and s["n_obs"] == 4
    b = H.bootstrap_test(df, "n", "block_id", "division", draws=200)
    assert b["passed"] and b["ci_low"] < b["estimate"] < b["ci_high"]


def test_improvement(spark):
    m = spark.createDataFrame([(1, "pep", 2.0, 0.0), (1, "g", 1.0, 0.5), (1, "bad", 3.0, 0.5)], "fold int, model string, mape_pop_pct double, leakage double")
    got = {r.model: r for r in E.with_improvement(m).collect()}
    assert got["g"].adjusted == pytest.approx(0.25) and got["g"].adjusted_mape == pytest.approx(1.5) and got["bad"].adjusted == pytest.approx(-0.5)


def test_post_censal(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        x = [float(v) for v in rng.normal(size=2)]
        for year, flow in ((2020, 0.0), (2021, 10.0), (2022, 5.0)):
            base = 5 + 0.1 * i
            rows.append((f"{i:05d}", year, i % 3 + 1, x, base, base + 0.01 * x[0] if year == 2020 else None, flow))
    df = spark.createDataFrame(rows, "fips string, year int, fold int, x array<double>, pep_log double, y_log double, flow double")
    got = {(r.fips, r.year): r for r in E.post_censal(df, [2020, 2021, 2022]).collect()}
    assert len(got) == 180
    a, b = got["00001", 2020], got["00001", 2021]
    assert a.level == pytest.approx(np.exp(rows[3][5]))
    assert b.level == pytest.approx((a.level + 10.0) * np.exp(b.pred_log - b.pep_log))


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 2))
    x = np.hstack([base, base @ rng.normal(size=(2, 4)) + rng.normal(size=(120, 4)) * 0.01])
    df = spark.createDataFrame([("f", i, v.tolist()) for i, v in enumerate(x)], "tag string, id int, x array<double>")
    for method in ("pca", "dae"):
        rows = embed.embedded(df, "tag", "id", "x", 2, method).orderBy("id").collect()
        z = np.array([r.embedding for r in rows])
        z = np.hstack([z, np.ones((120, 1))])
        fit = z @ np.linalg.lstsq(z, x, rcond=None)[0]
        assert 1 - ((x - fit) ** 2).sum() / ((x - x.mean(0)) ** 2).sum() > (0.99 if method == "pca" else 0.7)
    assert embed.families("t", 2020, [2020, 2021]) == [("t_y2020_nowcast", 2020, 2020), ("t_y2021_nowcast", 2021, 2020), ("t_y2021_nowcast", 2021, 2021)]


def test_tuning(spark):
    space = {"a": {"type": "float", "low": 1e-3, "high": 1.0, "log": True}, "b": {"type": "int", "low": 1, "high": 5}, "c": {"type": "fixed", "value": 7}}
    found = tuning.trials(spark, space, 12, lambda p: -((p["b"] - 3) ** 2) + p["a"]).cache()
    again = tuning.trials(spark, space, 12, lambda p: -((p["b"] - 3) ** 2) + p["a"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    assert tuning.best(found).first().score == max(r.score for r in found.collect())
    assert tuning.should_stop([3, 2, 1, 1.5, 1.6], 2, 1e9) and not tuning.should_stop([3, 2, 1], 2, 1e9) and tuning.should_stop([1, 2], 9, 50)
    assert tuning.strips_stop([1, 2, 3, 4, 5, 6], 2, 2) and not tuning.strips_stop([6, 5, 4, 3, 2, 1], 2, 2)
    assert tuning.overlaid({"x": {"y": 1}}, {"x.y": 2}) == {"x": {"y": 2}}
    with pytest.raises(KeyError):
        tuning.overlaid({"x": {}}, {"x.y": 2})
    with pytest.raises(ValueError):
        tuning.validated({"old": {}}, {"a"}, {"old"})


def test_assignment_like_brute_force():
    from itertools import permutations

    from panelweave.operators.graph import assignment

    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 3, 5, 7):
        for kind in range(8):
            gain = rng.random((n, n)) if kind % 2 else rng.integers(-2, 3, (n, n)).astype(float)
            got = assignment(gain)
            assert sorted(got) == list(range(n))
            best = max((sum(gain[i, p[i]] for i in range(n)) for p in permutations(range(n))), default=0.0)
            assert abs(sum(gain[i, j] for i, j in enumerate(got)) - best) < 1e-9
    big = rng.random((60, 60))
    assert sorted(assignment(big)) == list(range(60))


def test_bootstrap_draws_as_many_clusters_as_there_are(spark):
    from panelweave.operators import hypothesis as H

    sums = spark.createDataFrame([(st, f"{st}{i}", float(i), 1) for st, n in (("a", 5), ("b", 12), (None, 2)) for i in range(n)], "stratum string, state string, s double, n long")
    drawn = H.drawn_clusters(sums, "state", "stratum", 300).groupBy("draw", "stratum").count().collect()
    assert {(r.stratum, r["count"]) for r in drawn} == {("a", 5), ("b", 12), (None, 2)} and len(drawn) == 900
    rows = spark.createDataFrame([("a", f"s{i}", float(i)) for i in range(20) for _ in range(3)], "stratum string, state string, x double")
    means = [r.mean for r in H.cluster_bootstrap(rows, "x", "state", "stratum", 2000).collect()]
    # mean and deviation of the mean of 20 draws from 0 to 19
    assert abs(np.mean(means) - 9.5) < 0.15 and abs(np.std(means) - (sum((i - 9.5) ** 2 for i in range(20)) / 20 / 20) ** 0.5) < 0.1
