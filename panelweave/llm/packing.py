r"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Texts become ids, each document's ids end with one separator, and only what is
longer than a sequence is cut. Pieces are dealt by a hash of their place in the
table into groups of bounded size; every group is packed by several islands. An island keeps a population
of packings, begins with best-fit decreasing and shuffled variants, and breeds:
crossover injects whole well-filled bins of one parent into the other, bins
that hold one of the injected pieces are taken apart, and displaced pieces
first replace smaller ones where a bin gets fuller by it, then go in best-fit.
After an epoch each island's elite migrates to its neighbour over a written
table; the next epoch starts from both. An island that has reached the lower
bound (no packing can have fewer bins) has nothing left to breed for and stops.
Bins that are not full enough are opened again and their pieces packed in a
second round across groups.

Null text counts as empty: one piece of length 1. A text of any length is
encoded whole. Repeated rows are packed like others, ties are broken by id and
place. An empty table gives an empty result. Extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

import os
import random
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

CAPACITY = 2048
GROUP = 3000  # pieces that one island packs
ISLANDS, POPULATION, BROODS = 2, 4, 8
KEEP = 500_000
PORTION = 8 << 20  # bytes of text that are encoded at a time
LONG = 48
JOINED = 1000  # words that the tokenizer gets in one string
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")
ENDS = frozenset(",.")
ODD = re.compile("[\u0130\u03a3]")  # letters whose lower case depends on the place or is not one letter
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", _group long, _island int, _bin long, offset long, _load long, _bins long, _fit double"


class Words(dict):
    """Ids of words, kept: a word between blanks has the same ids wherever it stands.

    Of a batch of texts, the words that are not known yet are found first; the
    tokenizer gets those joined by a sign of its own, without a comma or
    point at their end. When KEEP new words have come the older half of the
    store is let go. Texts that hold an added token go to the tokenizer whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[str, bytes] = {}
        # words are joined only if a zero between blanks is one id that nothing else gives
        zero = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.zero = zero[0] if len(zero) == 1 and self.tokenizer.encode("a 0 a", add_special_tokens=False).ids.count(zero[0]) == 1 else None

    def by_tokenizer(self, texts: list[str], added: bool = False) -> list[bytes]:
        """Ids of whole texts; with added, added tokens in them have their own ids."""
        self.tokenizer.encode_special_tokens = not added
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words without blanks. A word with a zero goes alone, others many at a time."""
        if self.zero is None:
            return self.by_tokenizer(words)
        alone = [w for w in words if "0" in w]
        rest = [w for w in words if "0" not in w]
        found = dict(zip(alone, self.by_tokenizer(alone), strict=True))
        for at in range(0, len(rest), JOINED):
            part = rest[at : at + JOINED]
            ids = np.frombuffer(self.by_tokenizer([" 0 ".join(["", *part, ""])])[0], np.uint32)
            data, cuts = ids.tobytes(), (np.flatnonzero(ids == self.zero) * 4).tolist()
            found.update(zip(part, [data[i + 4 : j] for i, j in pairwise(cuts)], strict=True))
        return [found[w] for w in words]

    def learn(self, words: set[str]) -> None:
        """Gives every one of these words its ids."""
        if self.older:
            kept = {w: ids for w in words if (ids := self.older.get(w)) is not None}
            self.update(kept)
            words = words.difference(kept)
        ended = {w for w in words if w[-1:] in ENDS and PLAIN.fullmatch(w, 0, len(w) - 1)}
        need = [w for w in {*(words - ended), *(w[:-1] for w in ended), *(w[-1] for w in ended)} if w not in self]
        self.update(zip(need, self.of_words(need), strict=True))
        self.update((w, self[w[:-1]] + self[w[-1]]) for w in ended)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) >= KEEP:
            self.older = {w: ids for w, ids in self.items() if len(w) <= LONG}
            self.clear()
        out: list[bytes | None] = [None] * len(texts)
        plain, lowered = [], []
        for i, t in enumerate(texts):
            if any(x in t for x in self.added) or not t.isascii() and (ODD.search(t) or not unicodedata.is_normalized("NFC", t)):
                out[i] = self.by_tokenizer([t], True)[0]
                continue
            t = t.lower()
            for blank in "\n\t\r":
                t = t.replace(blank, " ")
            plain.append(i)
            lowered.append(t)
        # each word of the batch is looked up once; its places take the ids all together
        words = pc.split_pattern(pa.array(lowered, pa.large_string()), " ")
        met = words.flatten().dictionary_encode()
        names = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.get, names))
        if new := [k for k, found in enumerate(ids) if found is None]:
            self.learn({names[k] for k in new})
            for k in new:
                ids[k] = self[names[k]]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = met.indices.to_numpy()
        n = size[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat((np.cumsum(size) - size)[at] - ends[:-1], n)
        place += np.arange(len(place))
        data = np.frombuffer(b"".join(ids), np.uint32)[place].tobytes()
        cuts = (4 * ends[words.offsets.to_numpy()]).tolist()
        for i, (a, b) in zip(plain, pairwise(cuts), strict=True):
            out[i] = data[a:b]
        return out


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One store in a process, whatever the number of tasks that run in it."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def portions(b: pa.RecordBatch, column: int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows whose texts have at most so many bytes together; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")), at + 1)
        yield b.slice(at, to - at)
        at = to


def pieces_of(df: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for b in batches:
            for rows in portions(b, 1):
                out: list[list[int | None]] = [[], [], [], [], []]
                for doc, ids in zip(rows.column(0).to_pylist(), words.encode([t.as_py() or "" for t in rows.column(1)]), strict=True):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        part = ids[k : k + 4 * capacity]
                        for column, v in zip(out, (doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select("doc_id", text).mapInArrow(run, PIECES)


class Bins:
    """Bins that can be asked for the least room that still holds a piece: one bit for each room that some bin has."""

    def __init__(self, capacity: int, bins: list[list[int]] = (), loads: list[int] = ()):
        self.capacity, self.bins, self.loads = capacity, list(bins), list(loads)
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for i, load in enumerate(self.loads):
            self._offer(i, capacity - load)

    def _offer(self, i: int, room: int) -> None:
        if room:
            self.by_room[room].append(i)
            self.mask |= 1 << room

    def put(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            i = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask &= ~(1 << room)
            self.bins[i] = [*self.bins[i], item]
            self.loads[i] += size
            self._offer(i, room - size)
        else:
            self.bins.append([item])
            self.loads.append(size)
            self._offer(len(self.bins) - 1, self.capacity - size)

    def worth(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: the mean square of the fill."""
        return -len(self.bins), sum(x * x for x in self.loads) / (max(len(self.loads), 1) * self.capacity**2)


def best_fit(order: list[int], sizes: list[int], capacity: int) -> Bins:
    out = Bins(capacity)
    for i in order:
        out.put(i, sizes[i])
    return out


def crossover(mother: Bins, father: Bins, sizes: list[int], rng: random.Random) -> Bins:
    """Half of father's well-filled bins enter mother whole; what they displace goes in best-fit, large pieces first."""
    cap = mother.capacity
    good = [i for i, load in enumerate(father.loads) if load >= cap - cap // 256]
    chosen = [father.bins[i] for i in good if rng.random() < 0.5]
    loads = [sum(sizes[x] for x in b) for b in chosen]
    inside = {x for b in chosen for x in b}
    displaced = []
    for b, load in zip(mother.bins, mother.loads, strict=True):
        if inside.isdisjoint(b):
            chosen.append(b)
            loads.append(load)
        else:
            displaced += [x for x in b if x not in inside]
    return settle(chosen, loads, displaced, sizes, cap)


def mutate(one: Bins, sizes: list[int], rng: random.Random) -> Bins:
    """Takes the emptiest bins and a few others apart."""
    n = len(one.bins)
    order = sorted(range(n), key=one.loads.__getitem__)
    out = set(order[: max(1, n // 20)]) | set(rng.sample(range(n), max(1, n // 40)))
    keep = [i for i in range(n) if i not in out]
    return settle([one.bins[i] for i in keep], [one.loads[i] for i in keep], [x for i in out for x in one.bins[i]], sizes, one.capacity)


def settle(bins: list[list[int]], loads: list[int], loose: list[int], sizes: list[int], capacity: int) -> Bins:
    """Displaced pieces replace smaller ones where that fills a bin better; what is left goes in best-fit, large pieces first."""
    free = sorted((sizes[x], x) for x in loose)
    for b, load in enumerate(loads):
        room = capacity - load
        if not room or not free:
            continue
        gain = 0
        for at, x in enumerate(bins[b]):
            k = bisect_right(free, (sizes[x] + room, len(sizes))) - 1
            if k >= 0 and free[k][0] - sizes[x] > gain:
                gain, best = free[k][0] - sizes[x], (at, k)
        if gain:
            at, k = best
            out, (_, into) = bins[b][at], free.pop(k)
            bins[b] = [*bins[b][:at], into, *bins[b][at + 1 :]]
            loads[b] += gain
            insort(free, (sizes[out], out))
    child = Bins(capacity, bins, loads)
    for size, x in reversed(free):
        child.put(x, size)
    return child


def evolve(sizes: list[int], seed: int, elites: list[Bins], capacity: int = CAPACITY, broods: int = BROODS) -> tuple[Bins, int]:
    """The best packing of one island after an epoch, and how many broods it took. It stops as soon as no packing can have fewer bins."""
    rng, n = random.Random(seed), len(sizes)
    least = -(-sum(sizes) // capacity)
    falling = sorted(range(n), key=sizes.__getitem__, reverse=True)
    people = list(elites) or [best_fit(falling, sizes, capacity)]
    people.sort(key=Bins.worth, reverse=True)
    if len(people[0].bins) <= least:
        return people[0], 0
    while len(people) < POPULATION:
        jitter = [(sizes[i] * rng.uniform(0.8, 1.0), i) for i in range(n)]
        people.append(best_fit([i for _, i in sorted(jitter, reverse=True)], sizes, capacity))
    people.sort(key=Bins.worth, reverse=True)
    done = 0
    while done < broods and len(people[0].bins) > least:
        mother, father = rng.sample(range(len(people)), 2)
        child = crossover(people[mother], people[father], sizes, rng)
        people += [child, mutate(child, sizes, rng)]
        people.sort(key=Bins.worth, reverse=True)
        del people[POPULATION:]
        done += 1
    return people[0], done


ORDER = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]


def _epoch(capacity: int, first: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        group, island = key[0].as_py(), key[1].as_py()
        rows = rows.take(pc.sort_indices(rows, sort_keys=ORDER))
        elites = []
        if not first:
            origin = rows["_island"].to_numpy()
            found = sorted(set(origin.tolist()), key=lambda k: (k != island, k))
            packings = [rows.filter(pa.array(origin == k)) for k in found]
            for p in packings:
                lengths, places = p["length"].to_pylist(), p["_bin"].to_pylist()
                bins: list[list[int]] = [[] for _ in range(max(places) + 1)]
                for i, b in enumerate(places):
                    bins[b].append(i)
                elites.append(Bins(capacity, bins, [sum(lengths[x] for x in b) for b in bins]))
            rows = packings[0]
        sizes = rows["length"].to_pylist()
        best, _ = evolve(sizes, 1000 * group + 10 * island + first, elites, capacity)
        place, offset, load = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        for b, items in enumerate(best.bins):
            at = 0
            for x in items:
                place[x], offset[x], load[x] = b, at, best.loads[b]
                at += sizes[x]
        n, (_, fit) = len(sizes), best.worth()
        own = [rows[c].combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        long = lambda v: pa.array(v, pa.int64())
        made = [long([group] * n), pa.array([island] * n, pa.int32()), long(place), long(offset), long(load), long([len(best.bins)] * n), pa.array([fit] * n, pa.float64())]
        return pa.table([*own, *made], names=[x.split()[0] for x in PACKED.split(", ")])

    return run


def pack_round(pieces: DataFrame, n: int, name: str, capacity: int, group: int) -> DataFrame:
    """Packs pieces in groups: two epochs on every island with migration between them, then each group's best island."""
    groups = max(1, -(-n // group))
    # by the row's number in the written table, so that equal rows are spread too
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    islands = dealt.withColumn("_island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    one = staged(islands.groupBy("_group", "_island").applyInArrow(_epoch(capacity, True), PACKED), f"{name}_epoch1")
    # a ring: island i also gets the elite of island i + 1
    to = F.explode(F.array(F.col("_island"), F.pmod(F.col("_island") - 1, F.lit(ISLANDS))))
    met = one.withColumn("_to", to)
    two = staged(met.groupBy("_group", "_to").applyInArrow(_epoch(capacity, False), PACKED), f"{name}_epoch2")
    best = two.groupBy("_group", "_island").agg(F.max("_bins").alias("b"), F.max("_fit").alias("f")).groupBy("_group").agg(F.min(F.struct("b", -F.col("f"), "_island")).alias("x"))
    best = best.select(F.col("_group").alias("_g"), F.col("x._island").alias("_i"))
    return two.join(best, (F.col("_group") == F.col("_g")) & (F.col("_island") == F.col("_i"))).drop("_g", "_i")


def pack(df: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, separator: int = 0, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = staged(pieces_of(df, path, text, capacity, separator), "pieces")
    n = pieces.count()
    first = pack_round(pieces, n, "round1", capacity, group)
    # bins with over 1/128 of room are opened; their pieces migrate into groups of the second round
    full = F.col("_load") >= capacity - capacity // 128
    open_pieces = first.where(~full).select("doc_id", "piece", "start", "length", "ids_crc32")
    second = pack_round(open_pieces, open_pieces.count(), "round2", capacity, group)
    number = lambda r: (F.lit(r) * F.lit(1 << 60) + F.col("_group") * F.lit(1 << 20) + F.col("_bin")).cast("long").alias("sequence_id")
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return first.where(full).select(*out, number(0), "offset").unionByName(second.select(*out, number(1), "offset"))
