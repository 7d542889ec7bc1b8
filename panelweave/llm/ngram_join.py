r"""Near duplicates: documents whose sets of word n-grams have a Jaccard similarity over a threshold, joined by signature trees.

1. Every text becomes a sorted set of 64-bit n-gram hashes (words lower-cased
   A-Z, split at blanks; a shorter text is one n-gram). Texts with equal sets
   are one class; its smallest doc_id stands for it.
2. The upper levels of the tree are rows of a table: sets meet where they share
   a key, and subtrees without a common key are never opened. Keys are bands of
   min-hashes, chosen from the threshold so that a linked pair of sets has no
   common key with a probability under ``MISS`` (see ``bands``). With ``exact``
   they are part keys instead, which linked sets always share: ranges of sizes,
   and for each pair of ranges more parts of the n-grams than two linked sets
   can differ in (see ``part_keys``). There are some 0.4 of those for each
   n-gram, on the check tables two to three times as many as bands, and sets that share half of
   their n-grams meet far more often by them, which is why bands are the default.
   Sets that share a key are connected into clusters.
3. Below, in a cluster, a signature tree holds the classes by size: every node
   has the OR of its members' bitmaps and their range of sizes. A dual traversal
   prunes pairs of nodes whose largest possible overlap is too small; what is
   left is compared by exact intersection. Pairs that are connected already are
   skipped, for links are wanted only as far as they connect.
4. A cluster over ``CHUNK`` classes is cut by size and neighbouring chunks are
   joined, which connects most of a group of true copies. If one component
   fills most of the cluster, its other members are joined, in blocks, with
   every chunk of fitting sizes. Else the classes are dealt again by other
   hashes: linked sets share a key there too, so only classes that share the
   cluster's and the new key meet. Thus pages of one template, which share much
   and are not linked, fall apart into buckets, which are treated like clusters,
   ``LEVELS`` times at most; what is still over ``CHUNK`` then is joined by
   blocks. So no task holds an unbounded cluster, and no link is lost.

Nothing depends on how frequent an n-gram is or on the number of rows. A task
drops repeated keys before the shuffle, hence a hot key costs a row or so per
task.

Null and empty texts have no n-grams and are linked with nothing. Texts of any
length are read whole, their keys grow with them. Repeated rows are equal texts.
A null doc_id has n_shingles but no component; rows that share a doc_id are one
document with several texts. Extra columns, whatever their names, are not read.
An empty table gives an empty result. Sets are compared as sets of 64-bit
hashes: a collision needs two n-grams of one pair to agree by chance, under
1e-12 for texts of a thousand words.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import staged, text_of

SEEDS, LEVELS = 4, 3  # hashes that deal a set's n-grams; times that a large cluster is dealt again
MISS = 1e-9  # a linked pair shares no band with at most this probability
BATCH = 1 << 20  # keys that a task combines at a time
CHUNK, REST = 3000, 1500  # what one job holds: members, or thousands of n-grams where they have more
LEAF, FAN = 16, 8
SALTS = 32
ROUNDS = 60

_rng = np.random.Generator(np.random.PCG64(20240101))
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_DEAL = _rng.integers(0, 1 << 63, SEEDS * (LEVELS + 1), np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for i, b in enumerate((_BASE, inverse)):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    blank = np.concatenate(([True], _BLANK[b], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(b) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted set of n-gram hashes."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    n = len(words)
    if not n:
        return words
    if n < k:
        place = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE))
        return mixed(np.array([np.bitwise_xor.reduce(mixed(words * (place | np.uint64(1)))) + np.uint64(n)], np.uint64))
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * _PLACE[i]
    return np.unique(mixed(total))


@cache
def ranges(percent: int) -> list[int]:
    """The least size of each range. Linked sets lie in one range or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return out


@cache
def dealt(low: int, percent: int) -> tuple[int, int]:
    """Parts and spare parts for links whose smaller set is in range ``low``; (1, 0) where linked sets are equal.

    Linked sets r <= s differ in (100 - percent) / percent * |r| n-grams at most. The spare ones cover the parts that
    are empty in most sets: their expected number and two standard deviations.
    """
    least, above = ranges(percent)[low : low + 2]
    most = (100 - percent) * (above - 1) // percent
    if not most:
        return 1, 0
    spare = 1
    while True:
        parts = most + 1 + spare
        empty = parts * math.exp(-least / parts)
        if spare >= min(empty + 2 * math.sqrt(empty), most):
            return parts, spare
        spare += 1


def part_keys(grams: np.ndarray, percent: int, level: int = 0) -> np.ndarray:
    """The exact keys of a set. Two linked, different sets share at least one.

    They differ in fewer n-grams than there are parts less the spare ones, so
    more parts than the spare ones are equal, and one of those has n-grams
    unless both sets have more empty parts than spare ones. Then both are dealt
    by the next hash; sets that no hash deals well share one key of their range.
    """
    out = []
    own = bisect_right(ranges(percent), len(grams)) - 1
    mixes: dict[int, np.ndarray] = {}
    for low in (own, own - 1):
        parts, spare = dealt(low, percent) if low >= 0 else (1, 0)
        if parts == 1:
            continue
        for seed in range(level * SEEDS, (level + 1) * SEEDS):
            if seed not in mixes:
                mixes[seed] = mixed(grams ^ _DEAL[seed])
            x = mixes[seed]
            place = (((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            total = np.arange(parts, dtype=np.uint64) * np.uint64(_BASE) + np.uint64((low * 64 + seed) * int(_PLACE[0]) % 2**64)
            np.add.at(total, place, mixed(x))
            filled = np.zeros(parts, bool)
            filled[place] = True
            out.append(mixed(total[filled]))
            if parts - np.count_nonzero(filled) <= spare:
                break
        else:
            out.append(mixed(np.array([low], np.uint64) * _PLACE[1]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@cache
def bands(percent: int) -> tuple[int, int]:
    """How many bands of how many min-hashes: all of a band agree with probability 1/4 at most at the threshold, and some band of MISS nearly always."""
    rows = math.ceil(math.log(0.25) / math.log(percent / 100)) if percent < 100 else 16
    agree = (percent / 100) ** rows
    return (math.ceil(math.log(MISS) / math.log1p(-agree)) if agree < 1 else 1), rows


@cache
def min_hashes(n: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """What n min-hashes of a level are made of: a number to combine by xor and an odd factor for each."""
    made = np.random.Generator(np.random.PCG64([20240101, level])).integers(0, 1 << 32, (n, 2), np.uint32)
    return made[:, 0].copy(), made[:, 1] | np.uint32(1)


def band_keys(grams: np.ndarray, percent: int, level: int = 0) -> np.ndarray:
    count, rows = bands(percent)
    xor, mul = min_hashes(count * rows, level)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low, room = np.full(count * rows, 0xFFFFFFFF, np.uint32), np.empty((64, count * rows), np.uint32)
    for at in range(0, len(x), 64):
        part = x[at : at + 64, None]
        made = room[: len(part)]
        np.bitwise_xor(part, xor, out=made)
        np.multiply(made, mul, out=made)
        np.minimum(low, made.min(0), out=low)
    lows = low.reshape(count, rows).astype(np.uint64)
    total = np.arange(count, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(level)
    for i in range(rows):
        total = mixed(total * _PLACE[i % len(_PLACE)] + lows[:, i])
    return total


def keys_of(grams: np.ndarray, percent: int, exact: bool, level: int = 0) -> np.ndarray:
    if not len(grams):
        return np.zeros(0, np.uint64)
    return part_keys(grams, percent, level) if exact else band_keys(grams, percent, level)


def signatures(df: DataFrame, k: int, percent: int, exact: bool = False) -> DataFrame:
    """doc_id, n, digest of the set and the keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows = b.slice(at, 512)
                n, digests, keys = [], [], []
                for t in rows.column(1):
                    grams = shingles(t.as_py() or "", k)
                    n.append(len(grams))
                    digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                    keys.append(keys_of(grams, percent, exact).view(np.int64))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "n", "digest", "keys"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, keys array<long>")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b), a > b, from every vertex to the smallest one that the given edges connect it with."""
    some = np.unique(np.stack((a, b))[:, a != b], axis=1).tolist()
    of: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := of.setdefault(v, v)) != v:
            of[v] = v = of[up]
        return v

    for x, y in zip(*some, strict=True):
        x, y = find(x), find(y)
        if x != y:
            of[max(x, y)] = min(x, y)
    pairs = np.array([(v, r) for v in of if (r := find(v)) != v], np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def edge_batches(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Edges as they come, connected in portions of BATCH."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["a", "b"])

    for a, b in found:
        held.append((a, b))
        size += len(a)
        if size >= BATCH:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that connect what the edges of each task connect: every task joins its own and gives stars, in bounded portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from edge_batches((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(v, root) for the vertices of edges (a, b): alternating large and small stars until there are only stars.

    Each round is written to the shared folder. Stars are formed by minima, which combine map-side, and never hold the
    neighbours of a vertex; a minimum goes to each salt of its vertex before it meets the edges, so that a vertex of very
    many edges is spread. Before each round every task contracts the edges that it has read. It raises an error if
    ``ROUNDS`` do not suffice (their number grows with the logarithm of the longest path).
    """

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs if small else pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        parts = both.groupBy("a", "s").agg(F.min("b").alias("m"))
        low = parts.groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
        spread = parts.select("a", "s").join(low.hint("merge"), F.col("a") == F.col("_a")).select("_a", F.col("s").alias("_s"), "m")
        met = both.join(spread.hint("merge"), (F.col("a") == F.col("_a")) & (F.col("s") == F.col("_s")))
        if small:  # a > b: every smaller neighbour and a itself go to the smallest
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(met.select("a", F.col("m").alias("b")))
        else:  # larger neighbours go to the smallest
            out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    now = staged(contracted(edges.distinct()), f"{name}_0")
    for i in range(1, ROUNDS + 1):
        # done when no vertex has two roots and no root hangs under another
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        now = staged(contracted(star(star(now, False), True)), f"{name}_{i}")
    raise RuntimeError(f"{name}: not connected after {ROUNDS} rounds")


def candidate_edges(keyed: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all of (rep, keys) that share a key.

    A task first connects what shares a key among its own rows, in portions of bounded size, and sends each key once,
    with its smallest rep. Sorted by key and rep, what shares a key is connected as it streams by. Both give stars
    around smallest vertices, so that tasks which meet the same group agree on its edges.
    """

    def columns(key: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep)], ["key", "rep"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[0])
            keys = np.concatenate([x for _, x in held])
            reps = np.repeat(np.array([r for r, _ in held], np.int64), [len(x) for _, x in held])
            once, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            yield columns(once, reps[first])
            a, b = stars(reps, reps[first][inverse])
            if len(a):
                # an edge travels as a key of its own, spread like the others
                own = mixed(mixed(a.view(np.uint64)) + b.view(np.uint64) * np.uint64(_BASE)).view(np.int64)
                yield columns(np.concatenate((own, own)), np.concatenate((a, b)))

        for b in batches:
            lists = b.column(1)
            keys, ends = lists.flatten().to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            for rep, i, j in zip(b.column(0).to_pylist(), ends, ends[1:], strict=False):
                held.append((rep, keys[i:j]))
                size += j - i
            if size >= BATCH:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            last, root = None, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                key, rep = (batch.column(i).to_numpy() for i in range(2))
                # a run of equal keys goes to its first row's vertex, which may be in the batch before
                new = np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))
                start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
                roots = np.where(start >= 0, rep[start], root)
                last, root = key[-1], roots[-1]
                yield rep[rep != roots], roots[rep != roots]

        yield from edge_batches(found())

    sent = keyed.select("rep", "keys").mapInArrow(combine, "key long, rep long")
    return sent.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(meet, "a long, b long")


@dataclass
class Node:
    low: int  # smallest and largest set below
    high: int
    slack: int  # most n-grams of one set that share bits
    bits: np.ndarray
    children: list
    members: list


def bitmap(grams: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, np.uint8)
    flags[(grams & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.uint64)


def tree(order: list[int], sets: list[np.ndarray], maps: np.ndarray, ones: np.ndarray) -> Node:
    """A signature tree over sets in order of size."""
    level = []
    for at in range(0, len(order), LEAF):
        m = order[at : at + LEAF]
        size = [len(sets[i]) for i in m]
        level.append(Node(min(size), max(size), max(s - int(ones[i]) for s, i in zip(size, m, strict=True)), np.bitwise_or.reduce(maps[m]), [], m))
    while len(level) > 1:
        up = []
        for at in range(0, len(level), FAN):
            c = level[at : at + FAN]
            up.append(Node(c[0].low, max(x.high for x in c), max(x.slack for x in c), np.bitwise_or.reduce([x.bits for x in c]), c, []))
        level = up
    return level[0]


class Roots:
    def __init__(self, start: list[int]):
        """start: members with equal numbers are connected from the beginning."""
        first: dict[int, int] = {}
        self.of = [first.setdefault(s, i) for i, s in enumerate(start)]

    def find(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.of[self.find(j)] = self.find(i)


def connect(sets: list[np.ndarray], start: list[int], percent: int) -> Roots:
    """Connects all sets of a job that a chain of links joins."""
    roots = Roots(start)
    order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: len(sets[i]))
    if len(order) < 2:
        return roots
    bits = 1 << min(16, max(9, (4 * len(sets[order[-1]]) - 1).bit_length()))
    maps = np.stack([bitmap(s, bits) for s in sets])
    ones = np.bitwise_count(maps).sum(1)
    sizes = np.array([len(s) for s in sets])

    def wanted(both: int | np.ndarray) -> int | np.ndarray:
        # 100 o >= percent (both - o): the least overlap of two sets with so many n-grams together
        return -(-percent * both // (100 + percent))

    def hopeless(a: Node, b: Node) -> bool:
        if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
            return True
        common = int(np.bitwise_count(a.bits & b.bits).sum())
        return min(min(a.slack, b.slack) + common, a.high, b.high) < wanted(a.low + b.low)

    def leaves(a: Node, b: Node) -> None:
        for place, i in enumerate(a.members):
            others = a.members[place + 1 :] if a is b else b.members
            mine = roots.find(i)
            others = np.array([j for j in others if roots.find(j) != mine], np.int64)
            if not len(others):
                continue
            common = np.bitwise_count(maps[others] & maps[i]).sum(1).astype(np.int64)
            most = common + np.minimum(sizes[others] - ones[others].astype(np.int64), sizes[i] - int(ones[i]))
            for j in others[most >= wanted(sizes[others] + sizes[i])].tolist():
                if roots.find(i) == roots.find(j):
                    continue
                o = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                    roots.join(i, j)

    top = tree(order, sets, maps, ones)
    todo = [(top, top)]
    while todo:
        a, b = todo.pop()
        if a is not b and hopeless(a, b):
            continue
        if a.members and b.members:
            leaves(a, b)
        elif a is b:
            todo += [(x, y) for i, x in enumerate(a.children) for y in a.children[i:]]
        else:
            todo += [(x, y) for x in (a.children or [a]) for y in (b.children or [b])]
    return roots


def run_jobs(data: DataFrame, jobs: DataFrame, percent: int, read: Callable[[pa.Scalar], np.ndarray]) -> DataFrame:
    """Links (a, b) that connect the members of each job. data: rep, data, from which ``read`` gets the set; jobs: job, rep, label (members of a job with one label are connected already)."""
    members = data.join(jobs.hint("merge"), "rep").select("job", "rep", "label", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, labels, sets = None, [], [], []

        def out() -> pa.RecordBatch:
            roots = connect(sets, labels, percent)
            best: dict[int, int] = {}
            for i, r in enumerate(reps):
                best[roots.find(i)] = min(r, best.get(roots.find(i), r))
            pairs = [(r, best[roots.find(i)]) for i, r in enumerate(reps) if r != best[roots.find(i)]]
            return pa.RecordBatch.from_arrays([pa.array([p[s] for p in pairs], pa.int64()) for s in (0, 1)], ["a", "b"])

        for b in batches:
            for job, rep, label, d in zip(*(b.column(i) for i in range(4)), strict=True):
                if job.as_py() != now:
                    if reps:
                        yield out()
                    now, reps, labels, sets = job.as_py(), [], [], []
                reps.append(rep.as_py())
                labels.append(label.as_py())
                sets.append(read(d))
        if reps:
            yield out()

    return members.repartition("job").sortWithinPartitions("job", "rep").mapInArrow(run, "a long, b long")


def from_bytes(d: pa.Scalar) -> np.ndarray:
    return np.frombuffer(d.as_py(), np.uint64)


def sets_of(texts: DataFrame, k: int) -> DataFrame:
    """rep and its set as bytes, from rep and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([shingles(t.as_py() or "", k).tobytes() for t in rows.column(1)], pa.binary())], ["rep", "data"])

    return texts.mapInArrow(run, "rep long, data binary")


def weight() -> Column:
    """What a member counts in a job: 1, or its thousands of n-grams."""
    return F.greatest(F.lit(1), F.ceil(F.col("n") / 1000)).cast("long")


def sized(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """cluster, rep, n and the weight of the whole cluster; that goes back to the members by salts, as one cluster may hold very many."""
    known = clusters.join(classes.select(F.col("rep").alias("v"), "n").hint("merge"), "v").groupBy("root", "v").agg(F.max("n").alias("n"))
    sizes = known.groupBy("root").agg(F.sum(weight()).alias("members")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = known.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(sizes.hint("merge"), ["root", "_salt"]).select(F.col("root").alias("cluster"), F.col("v").alias("rep"), "n", "members")


def dealt_again(sets: DataFrame, rows: DataFrame, percent: int, exact: bool, level: int) -> DataFrame:
    """(bucket, rep) of the next level from rows (bucket, rep): only members of one bucket can share a new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                own = mixed(part.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
                keys = [mixed(keys_of(from_bytes(d), percent, exact, level) ^ c).view(np.int64) for d, c in zip(part.column(1), own, strict=True)]
                reps = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(reps)], ["bucket", "rep"])

    return sets.join(rows.select("rep", "bucket").hint("merge"), "rep").select("rep", "data", "bucket").mapInArrow(run, "bucket long, rep long")


def linked(df: DataFrame, k: int, percent: int, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, n, digest of every row; digest and component of every class."""
    rows = staged(signatures(df, k, percent, exact), "grams")
    classes = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    classes = staged(classes, "gram_classes")
    # keys of the representatives only
    reps = classes.where("n > 0").select(F.col("rep").alias("_rep"), F.col("digest").alias("_digest"))
    keyed = rows.join(reps.hint("merge"), (rows["doc_id"] == reps["_rep"]) & (rows["digest"] == reps["_digest"]), "left_semi").select(F.col("doc_id").alias("rep"), "keys")
    placed = staged(sized(staged(components(candidate_edges(keyed), "clusters"), "clusters"), classes), "placed")
    texts = df.select(F.col("doc_id").alias("rep"), text_of().alias("data"))
    whole = lambda p: p.where(F.col("members") <= CHUNK).select(F.col("cluster").cast("string").alias("job"), "rep", F.col("rep").alias("label"))
    # a small cluster is one job, whose links are stars already: (member, smallest member)
    roots = staged(run_jobs(texts, whole(placed), percent, lambda d: shingles(d.as_py(), k)), "links").select(F.col("a").alias("rep"), F.col("b").alias("root"))
    large = placed.where(F.col("members") > CHUNK)
    if not large.isEmpty():
        sets = staged(sets_of(texts.join(large.select("rep").hint("merge"), "rep", "left_semi"), k), "large_sets")
        links = join_large(sets, large.select("cluster", "rep", "n"), percent, exact)
        roots = roots.union(components(links, "parts").where("v <> root").select(F.col("v").alias("rep"), "root"))
    # a repeated row stands twice in its job
    roots = roots.groupBy("rep").agg(F.min("root").alias("root"))
    return rows, classes.join(roots, "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id"))


def chunked(rows: DataFrame, size: int) -> DataFrame:
    """rows (bucket, rep, n, ...) with their chunk of ``size`` in order of n in the bucket. Ranks come from counts by size and a hash, so that no window holds a bucket."""
    cut = rows.withColumn("_b", F.pmod(F.xxhash64("rep"), F.lit(64)))
    counts = cut.groupBy("bucket", "n", "_b").agg(F.sum(weight()).alias("c"))
    before = counts.withColumn("before", F.sum("c").over(W.partitionBy("bucket").orderBy("n", "_b")) - F.col("c"))
    ranked = cut.join(before, ["bucket", "n", "_b"]).withColumn("r", F.col("before") + (F.row_number().over(W.partitionBy("bucket", "n", "_b").orderBy("rep")) - 1) * weight())
    return ranked.withColumn("chunk", F.floor(F.col("r") / size)).drop("_b", "c", "before", "r")


def far_jobs(rows: DataFrame, percent: int) -> DataFrame:
    """Jobs (job, rep, label) that join the members outside each bucket's largest component with the whole bucket; rows: bucket, rep, n, label, main."""
    cut = staged(chunked(rows, CHUNK // 2), "far_chunks")
    rest = cut.where("label <> main")
    # blocks of what lies outside, in order of size: whole chunks' outsiders until there are REST
    outside = rest.groupBy("bucket", "chunk").agg(F.sum(weight()).alias("c"), F.min("n").alias("low"), F.max("n").alias("high"))
    at = F.floor((F.sum("c").over(W.partitionBy("bucket").orderBy("chunk")) - F.col("c")) / REST)
    blocks = staged(outside.withColumn("block", at), "far_blocks")
    of = blocks.groupBy("bucket", "block").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = cut.groupBy("bucket", "chunk").agg(F.min("n").alias("_low"), F.max("n").alias("_high"))
    fit = (F.col("low") * percent <= F.col("_high") * 100) & (F.col("_low") * percent <= F.col("high") * 100)
    pairs = of.join(spans, "bucket").where(fit).select("bucket", "block", F.col("chunk").alias("with"))
    name = F.concat_ws(":", F.lit("far"), "bucket", "block", "with").alias("job")
    mine = rest.join(blocks.select("bucket", "chunk", "block"), ["bucket", "chunk"]).select("bucket", "block", "rep", "label")
    far = pairs.join(mine, ["bucket", "block"]).select(name, "rep", "label")
    return far.union(pairs.join(cut.withColumnRenamed("chunk", "with"), ["bucket", "with"]).select(name, "rep", "label")).distinct()


def join_large(sets: DataFrame, large: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links that connect clusters over CHUNK (cluster, rep, n)."""
    rows = large.select(F.col("cluster").alias("bucket"), "rep", "n")
    # neighbouring chunks: job i holds chunks i and i + 1
    job = F.concat_ws(":", F.lit("near"), "bucket", "at")
    near = chunked(rows, CHUNK // 2).withColumn("at", F.explode(F.array("chunk", F.col("chunk") - 1))).select(job.alias("job"), "rep", F.col("rep").alias("label"))
    links = staged(run_jobs(sets, near, percent, from_bytes), "near_links")
    parts = components(links, "near_parts").select(F.col("v").alias("rep"), F.col("root").alias("label"))
    labels = staged(rows.select("rep", "n").join(parts.hint("merge"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "near_labels")
    for level in range(LEVELS + 1):
        if level:
            rows = dealt_again(sets, rows, percent, exact, level)
        met = staged(rows.select("bucket", "rep").join(labels.hint("merge"), "rep").withColumn("s", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")), f"dealt{level}")
        # counts by component first: a bucket with one of them has nothing to join
        tally = met.groupBy("bucket", "label").agg(F.sum(weight()).alias("c")).groupBy("bucket").agg(F.sum("c").alias("members"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
        # they go to each salt of a bucket before they meet its members
        spread = met.select("bucket", "s").distinct().join(tally.where("labels > 1").hint("merge"), "bucket")
        found = staged(met.join(spread.hint("merge"), ["bucket", "s"]).select("bucket", "rep", "n", "label", "members", "most", "main"), f"buckets{level}")
        jobs = found.where(F.col("members") <= CHUNK).select(F.col("bucket").cast("string").alias("job"), "rep", "label")
        many = found.where(F.col("members") > CHUNK)
        filled = many if level == LEVELS else many.where(2 * F.col("most") >= F.col("members"))
        if some := not filled.isEmpty():
            jobs = jobs.union(far_jobs(filled.select("bucket", "rep", "n", "label", "main"), percent))
        if level or some:  # clusters are all over CHUNK
            links = links.union(staged(run_jobs(sets, jobs, percent, from_bytes), f"links{level}"))
        rows = many.where(2 * F.col("most") < F.col("members"))
        if level == LEVELS or rows.isEmpty():
            return links


def with_components(df: DataFrame, k: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row. With exact no link can be missed, at the cost of more keys, some 0.4 for each n-gram."""
    rows, classes = linked(df, k, percent, exact)
    salted = rows.select("doc_id", "n", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    # a class goes to each of its salts before it meets the rows, so that a hot class is spread
    own = classes.withColumnRenamed("digest", "_digest")
    pairs = salted.select("digest", "_salt").distinct()
    spread = pairs.join(own, pairs["digest"] == own["_digest"]).select(F.col("_digest"), F.col("_salt").alias("_s"), "component_id")
    met = salted.join(spread.hint("merge"), (F.col("digest") == F.col("_digest")) & (F.col("_salt") == F.col("_s")), "left")
    # texts without n-grams share a digest and nothing else
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return met.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
