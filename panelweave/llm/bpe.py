r"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece of text has one BPE encoding, and so one last token.
The table of last tokens is the whole state: entry i is the token t that ends
at byte i, whose own start is encoded by entry i - len(t), such that BPE would
leave the pair (entry i - len(t), t) alone. Candidates come from an
Aho-Corasick automaton over the vocabulary, pairs are tested by undoing merges
and the answers kept. Reading the table backwards gives the ids.

Appending bytes adds entries and changes none. After an edit the entries before
it hold, and those behind it hold again once as many entries in a row as the
longest token has bytes come out as before.

A text is first split by a pattern; pieces are encoded separately. Null texts
count as empty: no ids. Texts of any length are encoded whole, in time linear in
their length. There are no ties: an encoding is unique, rows of one id are
encoded one by one. Repeated rows and clashing extra columns need no care, an
empty table gives an empty result. Rows are independent: memory is one Arrow
batch and a bounded cache of pieces in each worker.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

KEEP = 500_000  # new entries of each of a worker's caches after which older ones go
PAIRS = 800_000  # answers about pairs of tokens that are kept
NOT_LATIN = "\u0250"
TWO_BLANKS = re.compile(r"\s\s")
LONG = 48  # characters of a piece from which it is not kept


class Codec:
    """A vocabulary of byte strings by rank, and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.size = [len(t) for t in self.tokens]
        self.longest = max(self.size)
        self.pattern = regex.compile(pattern)
        self.halves = [(r, r) for r in range(len(self.tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        self._learn_merges()
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.packed = [struct.pack("<I", i) for i in range(len(self.tokens))]
        self.whole = {token.decode(): self.packed[rank] for token, rank in self.ranks.items() if token.isascii()}
        self.kept: dict[str, bytes] = _Kept(self.encode_piece)
        self.words: dict[str, bytes] = _Kept(self._encode_word)

    def _learn_merges(self) -> None:
        """The last merge of each token: BPE over its bytes with the smaller ranks alone."""
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.by_merging(token, rank)
                if len(parts) == 2:
                    self.halves[rank] = (parts[0], parts[1])
                    self.merged[parts[0], parts[1]] = rank

    def by_merging(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain BPE: merge the pair of the least rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        most = len(self.tokens) if below is None else below
        while len(parts) > 1:
            best, at = most, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], most)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE leaves the tokens left and right side by side. Known answers are kept."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        # walk back in time: of the two tokens at the seam, the younger one is taken apart;
        # a merge across the seam that is older than what was last taken apart would have come first
        now, halves, merged = len(self.tokens), self.halves, self.merged
        while True:
            across = merged.get((left, right))
            if across is not None and across < now:
                return False
            whole_left, whole_right = halves[left][0] == left, halves[right][0] == right
            if whole_left and whole_right:
                return True
            if whole_right or not whole_left and left > right:
                now, left = left, halves[left][1]
            else:
                now, right = right + 1, halves[right][0]

    def extend(self, data: bytes, last: list[int], stop=None) -> list[int]:
        """Fills the table ``last`` of data's prefixes from where it ends; stop(i) may end it early."""
        begin = len(last)
        back = max(0, begin - self.longest)
        size, stays, done = self.size, self.stays, begin
        for end, rank in self.automaton.iter(data[back:].decode("latin-1")):
            end += back + 1
            if end <= done:
                continue
            start = end - size[rank]
            if start >= 0 and (start == 0 or stays(last[start - 1], rank)):
                last.append(rank)
                done = end
                if stop is not None and stop(end):
                    break
        return last

    def read(self, last: list[int], n: int | None = None) -> list[int]:
        """The ids of the first n bytes."""
        i, out = len(last) if n is None else n, []
        while i > 0:
            out.append(last[i - 1])
            i -= self.size[last[i - 1]]
        return out[::-1]

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int], int]:
        """Replaces data[start:end] by new: the new bytes, their table, and how many entries were computed."""
        changed = data[:start] + new + data[end:]
        table, shift, alike = last[:start], len(new) - (end - start), 0
        joined = start + len(new) + self.longest  # from here on a token lies in unchanged bytes

        def settled(i: int) -> bool:
            nonlocal alike
            alike = alike + 1 if i > joined and table[i - 1] == last[i - shift - 1] else 0
            return alike >= self.longest

        self.extend(changed, table, settled)
        computed = len(table) - start
        table += last[len(table) - shift :]
        return changed, table, computed

    def encode_piece(self, piece: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if (whole := self.whole.get(piece)) is not None:
            return whole
        data = piece if piece.isascii() else piece.encode().decode("latin-1")
        # extend() on an empty table
        last, done, size, pairs = [], 0, self.size, self.pairs
        for end, rank in self.automaton.iter(data):
            if end < done:
                continue
            start = end + 1 - size[rank]
            if start > 0:
                stays = pairs.get(last[start - 1] << 20 | rank)
                if not (self.stays(last[start - 1], rank) if stays is None else stays):
                    continue
            elif start < 0:
                continue
            last.append(rank)
            done = end + 1
        out, i, packed = [], done, self.packed
        while i > 0:
            rank = last[i - 1]
            out.append(packed[rank])
            i -= size[rank]
        out.reverse()
        return b"".join(out)

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _encode_word(self, word: str) -> bytes:
        """Ids of a word and the space before it. Latin letters are one piece, a point or comma behind them another."""
        if word and max(word) < NOT_LATIN:
            if word.isalpha():
                return self.encode_piece(" " + word)
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return self.words[word[:-1]] + self.kept[word[-1]]
        return b"".join(map(self.kept.__getitem__, self.split(" " + word)))

    def encode(self, text: str) -> bytes:
        # a space between two other characters always begins a piece, so most texts split by words, which are kept whole
        if " " not in text or TWO_BLANKS.search(text):
            return b"".join(map(self.kept.__getitem__, self.split(text)))
        words = iter(text.split(" "))
        first = b"".join(map(self.kept.__getitem__, self.split(next(words))))
        return first + b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Kept(dict):
    """Computes what it lacks. When KEEP new entries have come the older half is let go."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= LONG:
            if len(self) >= KEEP:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Draft:
    """A text that changes while its ids are kept: only pieces near a change are split and encoded again."""

    LOOK = 3  # a piece that ends this much before the text's end cannot change by what follows

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text, self.pieces, self.ids = codec, "", [], []
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Splits again from the last piece that is surely unchanged, until piece bounds meet the old ones again."""
        old, shift = self.text, len(new) - (end - start)
        text = old[:start] + new + old[end:]
        ends, at = [], 0
        for p in self.pieces:
            at += len(p)
            ends.append(at)
        keep = sum(e <= start - self.LOOK for e in ends)
        # a run of blanks is split by what follows it, however long it is
        while keep and self.pieces[keep - 1].isspace():
            keep -= 1
        at, known = (ends[keep - 1] if keep else 0), {e: i for i, e in enumerate(ends)}
        pieces, ids, rest = self.pieces[:keep], self.ids[:keep], len(self.pieces)
        for m in self.codec.pattern.finditer(text, at):
            if m.start() >= start + len(new) and m.start() - shift in known:
                rest = known[m.start() - shift] + 1
                break
            pieces.append(m.group())
            ids.append(self.codec.kept[m.group()])
        self.text, self.pieces, self.ids = text, pieces + self.pieces[rest:], ids + self.ids[rest:]

    def encoded(self) -> bytes:
        return b"".join(self.ids)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for part in range(0, b.num_rows, 512):
                rows = b.slice(part, 512)
                ids = [c.encode(t.as_py() or "") for t in rows.column(1)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", text).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def report(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encodes and decodes every text and gives counts and digests; ids and bytes stay in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
