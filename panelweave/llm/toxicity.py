r"""Toxic passages as maximum-scoring segments.

Learning. Labelled documents whose crc32(doc_id) mod 3 is not 1 are used: those
with remainder 0 for the token scores, those with remainder 2 for calibration,
so that no document calibrates scores that it helped to learn; of each at most
about ``LABELLED``, chosen by hash where there are more. That bound makes the
labels small enough to broadcast, so texts are filtered where they are read and
never shuffled. Everything else covers all documents.

A token is a lower-case word or one of its beginnings of 4 to 6 letters,
counted once per document and hashed to one of 2^24 slots, which bounds the
model without a cap on tokens. The vocabulary is what ``LEAST_DOCS`` documents
have. A token's score is the log-odds of its share among toxic against clean
tokens under a Dirichlet prior over the vocabulary (``PRIOR`` plus a thousandth
of the token's count), less ``DOUBT`` standard deviations. Tokens whose z falls
short of what chance gives among so many (``LEAST_Z`` at least) are left out.

Scoring. A word scores the best of its tokens; any other word, and a word
that only repeats the one before it, scores ``STEP`` < 0. One linear pass
(Ruzzo and Tompa) finds all maximal segments. For independent tokens a segment of score S in a text of n words has the
expectation E = K n exp(-lambda S); lambda comes from the token scores'
background distribution, K from the clean calibration documents. A document's
evidence is the sum of -ln E over its segments with E < 0.05. A logistic curve
over a histogram of the evidence turns it into a probability.

Null and empty texts have no words and get the score of no evidence. Texts of
any length are scored whole, in time linear in their words. A null doc_id is
never learnt from nor held out. Without labels of both classes every score is
the share of toxic labels (0 if there are none); an empty table gives an empty
result. Repeated label rows of a document count once (toxic if one of them says
so), repeated documents each. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WORDS = re.compile(r"[^\W\d_]+")
PRIOR, LEAST_Z, DOUBT, LEAST_DOCS = 0.5, 2.4, 2.0, 3
LABELLED = 100_000  # labelled documents that a fold learns from at most
SLOTS = 1 << 24
STEP, MOST = -0.7, 8.0
SIGNIFICANT = 3.0  # -ln E of a passage that counts: fewer than one chance in twenty
STEMS = (4, 5, 6)
FLUSH = 300_000
BIN, BEST_BIN = 0.25, 0.05
ALL_DOCS, ALL_WORDS = -1, -2  # rows of the counts that hold totals


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def slots(word: str) -> list[int]:
    """The slots of a word and of its beginnings."""
    return [zlib.crc32(t.encode()) % SLOTS for t in (word, *(word[:n] + "*" for n in STEMS if len(word) > n))]


@dataclass
class Model:
    """scores: slot -> score as two arrays, at most SLOTS long."""

    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    rate: float = 1.0  # lambda
    k: float = 1.0
    slope: float = 0.0
    offset: float = 0.0


class Scores(dict):
    """Word -> score, kept for words that have been met."""

    def __init__(self, model: Model):
        super().__init__()
        order = np.argsort(model.at)
        self.at, self.scores = model.at[order], model.scores[order]
        flags = np.zeros(SLOTS, np.uint8)
        flags[self.at] = 1
        self.has = flags.tobytes()  # which slots have a score; most words end here

    def __missing__(self, word: str) -> float:
        found = [i for i in slots(word) if self.has[i]]
        value = float(self.scores[np.searchsorted(self.at, found)].max()) if found else STEP
        if len(self) > FLUSH:
            self.clear()
        self[word] = value
        return value


def segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, score), in linear time: disjoint, none can be made better by growing or shrinking."""
    found: list[list[float]] = []  # start, end, sum before, sum with
    total = 0.0
    for i, v in enumerate(values):
        if v <= 0:
            total += v
            continue
        start, end, left, right = i, i + 1, total, total + v
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right, j])
                break
            start, left = int(found[j][0]), found[j][2]
            del found[j:]
    return [(int(s), int(e), r - x) for s, e, x, r, _ in found]


def evidence(text: str, scores: Scores, rate: float, k: float) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Summed -ln E of the significant segments, number of words, those segments."""
    words = WORDS.findall(text.lower())
    values = list(map(scores.__getitem__, words))
    if not values or max(values) <= 0:
        return 0.0, len(words), []
    values[1:] = [STEP if a == b else v for a, b, v in zip(words, words[1:], values[1:], strict=False)]
    out, total, floor = [], 0.0, math.log(max(k * len(words), 1e-12))
    for s, e, score in segments(values):
        x = rate * score - floor
        if x > SIGNIFICANT:
            total += x
            out.append((s, e, score))
    return total, len(words), out


def labelled(docs: DataFrame, labels: DataFrame, remainder: int, most: int | None = None) -> DataFrame:
    """text and toxic of the labelled documents of one fold. The labels are few (their number is checked), so texts stay where they are read."""
    most = LABELLED if most is None else most
    marks = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) == remainder)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = staged(marks, "toxic_labels")
    n = marks.count()
    if n > most:
        # a share by hash, so that its number stays below the bound by many standard deviations
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(0.95 * most / n * (1 << 30)))
    return docs.where(fold(F.col("doc_id")) == remainder).select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "toxic")


def count_tokens(rows: DataFrame) -> DataFrame:
    """slot, and how many clean and toxic documents have it; ALL_DOCS and ALL_WORDS hold the totals of documents and of their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (array("q"), array("q"))
        known: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            found = [np.unique(np.frombuffer(h, np.int64), return_counts=True) if len(h) else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for h in held]
            zero = [np.zeros(len(n), np.int64) for _, n in found]
            columns = np.concatenate((found[0][0], found[1][0])), np.concatenate((found[0][1], zero[1])), np.concatenate((zero[0], found[1][1]))
            for h in held:
                del h[:]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "clean", "toxic"])

        for b in batches:
            for t, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = set(WORDS.findall((t.as_py() or "").lower()))
                for w in own:
                    if w not in known:
                        known[w] = slots(w)
                h = held[1 if toxic else 0]
                h.append(ALL_DOCS)
                h.extend(set().union(*map(known.__getitem__, own)))
                h.extend([ALL_WORDS] * len(own))
                if len(known) > FLUSH:
                    known.clear()
                if len(held[0]) + len(held[1]) > 4 * FLUSH:
                    yield out()
        yield out()

    parts = rows.mapInArrow(count, "slot long, clean long, toxic long")
    return parts.groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_odds(clean: Column, toxic: Column, totals: tuple[float, float, float]) -> tuple[Column, Column]:
    """Log-odds of a token's share of toxic against clean tokens under the Dirichlet prior, and its standard deviation. totals: clean tokens, toxic tokens, size of the vocabulary."""
    n_clean, n_toxic, size = totals
    prior, whole = PRIOR + 0.001 * (clean + toxic), PRIOR * size + 0.001 * (n_clean + n_toxic)
    odds = lambda x, n: F.log((x + prior) / (n + whole - x - prior))
    return odds(toxic, n_toxic) - odds(clean, n_clean), F.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def learn(rows: DataFrame) -> Model:
    counts = staged(count_tokens(rows), "toxic_counts")
    total = {r.slot: (int(r.clean), int(r.toxic)) for r in counts.where("slot < 0").collect()}
    n_clean, n_toxic = total.get(ALL_DOCS, (0, 0))
    if not n_clean or not n_toxic:
        share = n_toxic / (n_clean + n_toxic) if n_clean + n_toxic else 0.0
        return Model(offset=math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0))
    known = counts.where((F.col("slot") >= 0) & (F.col("clean") + F.col("toxic") >= LEAST_DOCS))
    sums = known.agg(F.sum("clean"), F.sum("toxic"), F.count(F.lit(1)), F.count_if(F.col("toxic") >= LEAST_DOCS)).first()
    if not sums[2]:
        return Model(offset=math.log(n_toxic / n_clean))
    score, deviation = log_odds(F.col("clean"), F.col("toxic"), (float(sums[0]), float(sums[1]), float(sums[2])))
    least_z = max(LEAST_Z, math.sqrt(2 * math.log(max(sums[3] / 50, 1.0))))
    sure = known.where(F.col("toxic") >= LEAST_DOCS).select("slot", "clean", score.alias("s"), deviation.alias("d"))
    best = sure.where((F.col("s") >= least_z * F.col("d")) & (F.col("s") > DOUBT * F.col("d"))).select("slot", "clean", F.least(F.col("s") - DOUBT * F.col("d"), F.lit(MOST)).alias("score")).toArrow()
    model = Model(best["slot"].to_numpy(), best["score"].to_numpy().astype(np.float32))
    # background: the share of words of each score, taken from how often clean documents have the token
    shares = (best["clean"].to_numpy() + PRIOR) / max(1.0, float(total[ALL_WORDS][0]))
    model.rate = root(list(zip(model.scores.tolist(), shares.tolist(), strict=True)))
    return model


def root(shares: list[tuple[float, float]]) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1."""
    rest = max(1 - sum(p for _, p in shares), 1e-9)
    over = lambda x: rest * math.exp(x * STEP) + sum(p * math.exp(x * s) for s, p in shares) > 1
    low, high = 0.0, 1.0
    while not over(high) and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return max(high, 1e-3)


def evidence_rows(rows: DataFrame, model: Model, keep: str) -> DataFrame:
    """``keep`` (a long column), evidence and the best segment's lambda S - ln n."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = Scores(m)
        for b in batches:
            got = [evidence(t.as_py() or "", scores, m.rate, m.k) for t in b.column(1)]
            best = [max((m.rate * s for *_, s in segs), default=0.0) - math.log(max(n, 1)) if segs else None for _, n, segs in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array(best, pa.float64()), pa.array([len(g[2]) for g in got], pa.int32())], [keep, "evidence", "best", "n_segments"])

    return rows.select(F.col(keep).cast("long").alias(keep), "text").mapInArrow(run, f"{keep} long, evidence double, best double, n_segments int")


def calibrate(rows: DataFrame, model: Model) -> Model:
    """K from the clean documents' best segments, then the logistic curve over a histogram of the evidence."""
    if not len(model.at):
        return model
    raw = evidence_rows(rows, Model(model.at, model.scores, model.rate, 1e-12), "toxic").where("toxic = 0")
    # P(best > x) = 1 - exp(-K exp(-x)): K from the 99 % point of the clean documents' best, by a histogram
    at = F.floor(F.greatest(F.least(F.coalesce("best", F.lit(-50.0)), F.lit(200.0)), F.lit(-50.0)) / BEST_BIN)
    x = upper_point([(r.b * BEST_BIN, r.n) for r in raw.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()], 0.99)
    model.k = 1e-6 if x is None or x <= -50 else max(1e-6, -math.log(0.99) * math.exp(x))
    bins = evidence_rows(rows, model, "toxic").groupBy(F.floor(F.least("evidence", F.lit(200.0)) / BIN).alias("b")).agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    model.slope, model.offset = logistic([(r.b * BIN, r.t, r.n) for r in bins])
    return model


def upper_point(bins: list[tuple[float, int]], share: float) -> float | None:
    """The first value at which the counts reach a share of all."""
    need, seen = share * sum(n for _, n in bins), 0
    for x, n in sorted(bins):
        seen += n
        if seen >= need:
            return x
    return None


def logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope >= 0 and offset of P(toxic | evidence), from (evidence, toxic, all) bins, by Newton's method with a weak prior on the slope."""
    a = b = 0.0
    scale = 10.0
    for _ in range(100):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, t, n in bins:
            u = min(x, 60.0) / scale
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * u + b))))
            t = t * (1 - 1e-3) + (n - t) * 1e-3
            g0, g1 = g0 + n * p - t, g1 + (n * p - t) * u
            w = n * p * (1 - p) + 1e-9
            h00, h01, h11 = h00 + w, h01 + w * u, h11 + w * u * u
        g1, h11 = g1 + 1e-3 * a, h11 + 1e-3
        det = h00 * h11 - h01 * h01
        if det <= 0:
            break
        da, db = (g1 * h00 - g0 * h01) / det, (g0 * h11 - g1 * h01) / det
        step = min(1.0, 4 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return max(a, 0.0) / scale, b


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    model = learn(labelled(docs, labels, 0))
    # the texts of the second fold are read twice, for K and for the curve; written once, they are filtered once
    return calibrate(staged(labelled(docs, labels, 2), "toxic_calibration"), model) if len(model.at) else model


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    z = F.lit(model.slope) * F.least("evidence", F.lit(60.0)) + F.lit(model.offset)
    score = 1 / (1 + F.exp(-z))
    out = evidence_rows(docs.select("doc_id", "text"), model, "doc_id").withColumn("score", score)
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_segments", "evidence")


def passages(text: str, model: Model) -> list[tuple[int, int, float]]:
    """(start, end, score) in characters of every significant toxic passage of a text."""
    at = [(m.start(), m.end()) for m in WORDS.finditer(text.lower())]
    return [(at[s][0], at[e - 1][1], score) for s, e, score in evidence(text, Scores(model), model.rate, model.k)[2]]
