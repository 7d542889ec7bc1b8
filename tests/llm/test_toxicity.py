import random

import pytest

from panelweave.llm import toxicity as T


def brute(v):
    """The best run of positive sum, and what is best on both sides of it."""
    best = None
    for i in range(len(v)):
        for j in range(i, len(v)):
            s = sum(v[i : j + 1])
            if s > 0 and (best is None or s > best[2] or s == best[2] and j - i < best[1] - best[0] - 1):
                best = (i, j + 1, s)
    if best is None:
        return []
    return brute(v[: best[0]]) + [best] + [(a + best[1], b + best[1], s) for a, b, s in brute(v[best[1] :])]


def test_segments_are_maximal():
    rng = random.Random(1)
    for _ in range(2000):
        # values without ties between different sums
        v = [rng.choice([-1, 1]) * (rng.random() * 5 + 0.1) for _ in range(rng.randint(0, 14))]
        assert [(a, b, round(s, 9)) for a, b, s in T.segments(v)] == [(a, b, round(s, 9)) for a, b, s in brute(v)]


def test_rate_solves_its_equation():
    import math

    shares = [(4.0, 0.001), (6.0, 0.0005)]
    x = T.root(shares)
    assert math.isclose(sum(p * math.exp(x * s) for s, p in shares) + 0.9985 * math.exp(x * T.STEP), 1, rel_tol=1e-6)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    rows, marks = [], []
    for i in range(4000):
        w = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["zzvile", "zzrotten", "zzscum" + rng.choice("xyzuvw") * 2]))
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out(corpus):
    docs, labels = corpus
    rows = T.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / max(1, sum(r.predicted for r in rows)) > 0.95 and hit / sum(r.toxic for r in rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_do_not_matter(corpus):
    from pyspark.sql import functions as F

    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(T.fold(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.fit(docs, labels), T.fit(docs, turned)
    assert a.at.tolist() == b.at.tolist() and a.scores.tolist() == b.scores.tolist() and (a.k, a.slope, a.offset) == (b.k, b.slope, b.offset)


def plain_scores(rows):
    """Token -> score by the formula, from (text, toxic) in plain Python, without slots."""
    import math
    from collections import Counter

    seen = (Counter(), Counter())
    for text, toxic in rows:
        own = set(T.WORDS.findall(text.lower()))
        seen[toxic].update({t for w in own for t in (w, *(w[:n] + "*" for n in T.STEMS if len(w) > n))})
    known = [t for t in seen[0].keys() | seen[1].keys() if seen[0][t] + seen[1][t] >= T.LEAST_DOCS]
    n0, n1 = (sum(c[t] for t in known) for c in seen)
    prior = {t: T.PRIOR + 0.001 * (seen[0][t] + seen[1][t]) for t in known}
    whole = sum(prior.values())
    tried = [t for t in known if seen[1][t] >= T.LEAST_DOCS]
    least = max(T.LEAST_Z, math.sqrt(2 * math.log(max(len(tried) / 50, 1))))
    out = {}
    for t in tried:
        c, x, a = seen[0][t], seen[1][t], prior[t]
        odds = math.log((x + a) / (n1 + whole - x - a)) - math.log((c + a) / (n0 + whole - c - a))
        d = math.sqrt(1 / (x + a) + 1 / (c + a))
        if odds >= least * d and odds > T.DOUBT * d:
            out[t] = min(odds - T.DOUBT * d, T.MOST)
    return out


def test_scores_and_evidence_like_plain_ones(corpus):
    """Learnt scores, and the evidence of every document, against a version without Spark, slots or the linear pass."""
    import math
    import zlib

    docs, labels = corpus
    model = T.fit(docs, labels)
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()
    scores = plain_scores([(r.text, r.toxic) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 0])
    want = {}
    for t, s in scores.items():
        want[zlib.crc32(t.encode()) % T.SLOTS] = s
    got = dict(zip(model.at.tolist(), model.scores.tolist(), strict=True))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-5) for k in want)
    by_doc = {r.doc_id: r for r in T.report(docs, labels).collect()}
    for r in rows[::8]:
        words = T.WORDS.findall(r.text.lower())
        values = [max([scores[t] for t in (w, *(w[:n] + "*" for n in T.STEMS if len(w) > n)) if t in scores], default=T.STEP) for w in words]
        values[1:] = [T.STEP if a == b else v for a, b, v in zip(words, words[1:], values[1:], strict=False)]
        parts = [x for *_, s in brute(values) if (x := model.rate * s - math.log(max(model.k * len(words), 1e-12))) > T.SIGNIFICANT]
        assert math.isclose(by_doc[r.doc_id].evidence, sum(parts), rel_tol=0.01, abs_tol=0.02)
        score = 1 / (1 + math.exp(-(model.slope * min(by_doc[r.doc_id].evidence, 60) + model.offset)))
        assert math.isclose(by_doc[r.doc_id].score, score, rel_tol=1e-6)


def test_the_bound_on_labelled_rows(corpus):
    docs, labels = corpus
    all_rows, some = T.labelled(docs, labels, 0).count(), T.labelled(docs, labels, 0, 500).count()
    assert all_rows > 1000 and 400 < some <= 500


def test_passages(corpus):
    model = T.fit(*corpus)
    text = "some quiet words here " * 20 + "zzvile zzrotten zzvile" + " and more quiet words" * 20
    assert [text[a:b] for a, b, _ in T.passages(text, model)] == ["zzvile zzrotten zzvile"]


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = T.report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert T.report(odd, labels.limit(0)).agg({"score": "max"}).first()[0] < 0.01
    assert T.report(none, labels).count() == 0
