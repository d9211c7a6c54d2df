"""Byte-level BPE over whole texts: merges taken from a queue of ranks with hierarchical bitmaps.

A text is cut by a pattern into matches, and each match is encoded by itself: if its bytes are a token,
that is it, otherwise its bytes are merged pair by pair, always the pair of lowest rank, the leftmost of
equals. The tokens of a match are a doubly linked list of positions. Each merge rank has a bucket of the
positions where a pair of that rank began when it was put there, and three levels of 64-bit words tell
which buckets hold any: finding the first set bit in each level gives the next rank. Positions whose pair
has changed since are skipped when they come up. A match of n bytes so takes n merges at most, each of a
few steps, whatever its length, and all new matches of some texts share one queue. Matches that a worker
has seen are remembered, up to a fixed number.

Rows are encoded where they are read: there is no shuffle, and a task holds a few texts at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches whose ids a worker remembers (about 250 bytes each), and characters of the longest of them.
MEMORY, SHORT = 400_000, 64
#: Bytes of the texts that are encoded at once; a longer text is encoded by itself.
AT_ONCE = 1_000_000
#: ASCII members of the classes that only the Unicode engine knows.
ASCII_CLASSES = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}


def ascii_pattern(pattern: str) -> str | None:
    """The same pattern for ASCII texts, in the standard engine's words; None where it has other classes."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        if (name := pattern[at:at + 5]) in ASCII_CLASSES:
            out.append(ASCII_CLASSES[name] if inside else f"[{ASCII_CLASSES[name]}]")
            at += 5
            continue
        step = 2 if pattern[at] == "\\" else 1
        part = pattern[at:at + step]
        if part in (r"\p", r"\P", r"\X"):
            return None
        inside = part == "[" or inside and part != "]"
        out.append(part)
        at += step
    return "".join(out)


class RankQueue:
    """Positions by merge rank, and which ranks have any: a bit for each bucket, for each word of those, and so on."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.leaves = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = [0] * ((ranks >> 18) + 1)  # one word for 262,144 ranks

    def mark(self, rank: int) -> None:
        """The bucket of ``rank`` is no longer empty."""
        self.leaves[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top[rank >> 18] |= 1 << (rank >> 12 & 63)

    def clear(self, rank: int) -> None:
        """The bucket of ``rank`` has become empty."""
        a, b, c = rank >> 6, rank >> 12, rank >> 18
        self.leaves[a] &= ~(1 << (rank & 63))
        if not self.leaves[a]:
            self.middle[b] &= ~(1 << (a & 63))
            if not self.middle[b]:
                self.top[c] &= ~(1 << (b & 63))

    def lowest(self) -> int:
        """The lowest rank whose bucket holds a position; -1 if there is none."""
        for c, word in enumerate(self.top):
            if word:
                b = c << 6 | (word & -word).bit_length() - 1
                word = self.middle[b]
                a = b << 6 | (word & -word).bit_length() - 1
                word = self.leaves[a]
                return a << 6 | (word & -word).bit_length() - 1
        return -1


class ByteBpe:
    """Encoder and decoder of a file of ranks: a line for each token, its bytes in base 64 and its rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        #: Pairs of tokens that make a token.
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.first = np.array([self.ranks.get(bytes([k]), -1) for k in range(256)])
        if self.first.min() < 0:
            raise ValueError(f"not every byte is a token in {path}")
        self.byte_pairs = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.queue = RankQueue(self.size)
        self.tokens = pa.array(tokens, pa.large_binary())
        self.decimals = pa.array([b"%d " % k for k in range(self.size)], pa.large_binary())
        self.any_match = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        self.ascii_match = re.compile(plain, re.ASCII).findall if plain else self.any_match
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of matches, as little-endian unsigned 32-bit integers.

        The matches lie on end in one list of positions that no pair crosses from one to the next, so one
        queue serves them all.
        """
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        n = len(data)
        start = self.byte_pairs[data[:-1], data[1:]] if n > 1 else np.zeros(0, np.int64)
        start[ends[:-1] - 1] = -1
        at = np.flatnonzero(start >= 0)
        at = at[np.argsort(start[at], kind="stable")]
        first = np.flatnonzero(np.diff(start[at], prepend=-1))
        queue, get = self.queue, self.pairs.get
        buckets, mark, lowest = queue.buckets, queue.mark, queue.lowest
        for rank, bucket in zip(start[at[first]].tolist(), np.split(at, first[1:]), strict=False):
            buckets[rank] = bucket.tolist()  # sorted, so a heap
            mark(rank)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[ends - 1] = n
        left[ends[:-1]] = -1
        tok, right, left = self.first[data].tolist(), right.tolist(), left.tolist()
        while (rank := lowest()) >= 0:
            bucket = buckets[rank]
            lower = False
            while bucket and not lower:
                i = heappop(bucket)
                a, j = tok[i], right[i]
                if a < 0 or j >= n or get(a << 32 | tok[j]) != rank:
                    continue  # merged away, or its pair is another one by now
                k = right[j]
                tok[i], tok[j], right[i] = rank, -1, k
                if k < n:
                    left[k] = i
                    r = get(rank << 32 | tok[k])
                    if r is not None:
                        other = buckets[r]
                        if not other:
                            mark(r)
                        heappush(other, i)
                        lower = r < rank
                h = left[i]
                if h >= 0:
                    r = get(tok[h] << 32 | rank)
                    if r is not None:
                        other = buckets[r]
                        if not other:
                            mark(r)
                        heappush(other, h)
                        lower = lower or r < rank
            if not bucket:
                queue.clear(rank)
        out = np.array(tok, np.int64)
        alive = np.flatnonzero(out >= 0)
        raw, upto = out[alive].astype("<u4").tobytes(), (4 * np.searchsorted(alive, ends)).tolist()
        return [raw[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]

    def fresh(self, matches: list[str]) -> dict[str, bytes]:
        """Ids of matches; one whose bytes are a token is that token, whatever merges would make of it."""
        ranks, out, rest, pieces = self.ranks.get, {}, [], []
        for m in matches:
            piece = m.encode()
            rank = ranks(piece)
            if rank is None:
                rest.append(m)
                pieces.append(piece)
            else:
                out[m] = rank.to_bytes(4, "little")
        if pieces:
            out.update(zip(rest, self.merge(pieces), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        parts = [(self.ascii_match if t.isascii() else self.any_match)(t) if t else [] for t in texts]
        known = self.known
        new = self.fresh(list(set().union(*parts) - known.keys()))
        known.update(new)
        get = known.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        room = MEMORY - len(known) + len(new)
        for k, m in enumerate(new):
            if k >= room or len(m) > SHORT:
                del known[m]
        return out

    def joined(self, table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """Entries of ``table`` for all ids on end, cut where the rows of ids end."""
        out = table.take(pa.array(ids.astype(np.int64)))
        offsets = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1, 8 * out.offset)
        raw = memoryview(out.buffers()[2] or b"")
        at = offsets[ends].tolist()
        return [raw[a:b] for a, b in zip([int(offsets[0]), *at[:-1]], at, strict=True)]

    def decode(self, rows: list[bytes]) -> list[memoryview]:
        """Bytes of each row of ids."""
        ids = np.frombuffer(b"".join(rows), "<u4")
        if len(ids) and int(ids.max()) >= self.size:
            raise ValueError("an id is not in the vocabulary")
        return self.joined(self.tokens, ids, np.cumsum([len(r) // 4 for r in rows], dtype=np.int64))

    def written(self, rows: list[bytes]) -> list[memoryview]:
        """Each row's ids as decimals, joined by single spaces."""
        ids = np.frombuffer(b"".join(rows), "<u4")
        out = self.joined(self.decimals, ids, np.cumsum([len(r) // 4 for r in rows], dtype=np.int64))
        return [x[:-1] for x in out]


_WORKER: dict[tuple[str, str], ByteBpe] = {}


def bpe(path: str, pattern: str) -> ByteBpe:
    """This worker's encoder; reused by its later tasks."""
    key = (path, pattern)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = ByteBpe(path, pattern)
    return _WORKER[key]


def _portions(column: pa.Array, at_once: int) -> Iterable[pa.Array]:
    """Rows with about ``at_once`` bytes together, one at least."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        upto = (ends[at - 1] if at else 0) + at_once
        end = max(int(np.searchsorted(ends, upto, side="right")), at + 1)
        yield column.slice(at, end - at)
        at = end


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): token ids of each row of ``docs`` (doc_id, text), row by row.

    Null and empty texts have none; texts are taken whole, whatever their length; equal rows and null
    doc_ids are rows like others; an empty table gives no rows; further columns are ignored. ``path`` is
    a file of ranks on every machine, ``pattern`` cuts texts into the matches that are encoded.
    """

    def run(batches):
        own = bpe(path, pattern)
        for batch in batches:
            doc, at = batch.column("doc_id"), 0
            for part in _portions(batch.column("text"), AT_ONCE):
                rows = own.encode(part.to_pylist())
                ids = pa.array(np.frombuffer(b"".join(rows), "<u4").astype(np.int32))
                ends = np.cumsum([0, *[len(r) // 4 for r in rows]])
                yield pa.RecordBatch.from_arrays([doc.slice(at, len(rows)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["doc_id", "ids"])
                at += len(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text): the bytes that the ids of each row stand for, as binary; null ids are none."""

    def run(batches):
        own = bpe(path, pattern)
        for batch in batches:
            rows = [np.array(r or [], "<u4").tobytes() for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bytes(x) for x in own.decode(rows)], pa.binary())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's ids and of what they decode to.

    Encoded and decoded as ``encode`` and ``decode`` do, in one pass, so that the ids themselves don't
    leave their task. Cases are those of ``encode``.
    """
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        own = bpe(path, pattern)
        for batch in batches:
            doc, at = batch.column("doc_id"), 0
            for part in _portions(batch.column("text"), AT_ONCE):
                rows = own.encode(part.to_pylist())
                out = [pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array(map(sha, own.written(rows)), pa.string()), pa.array(map(sha, own.decode(rows)), pa.string())]
                yield pa.RecordBatch.from_arrays([doc.slice(at, len(rows)), *out], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
