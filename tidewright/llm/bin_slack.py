"""Packing token sequences by minimum bin slack.

Documents are cut into full windows and one remainder. The remainders' lengths, at most one count for
each length below the window, are packed on their own: a subset-sum over the lengths still there, as
bits of an integer, finds the multiset that fills a window closest; it is backed out of the stored
layers and used as often as the counts allow. Its windows become slots for lengths; each remainder's
rank among those of its length picks its slot. So what one task sees never grows with the documents.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch

WINDOW, END = 2048, 1
#: Salts that split the ranking of equal lengths.
SALTS = 128
#: Distinct words and word bodies whose ids a worker remembers (about 150 bytes each).
MEMORY = 600_000
#: Bytes of the texts that are looked up at once; a longer text is looked up by itself.
AT_ONCE = 8_000_000
#: Marks that end many words; a run of them after a letter is a part of its own for the tokenizer.
TAIL = ".,!?|;:"
BREAK = "<|startoftext|>"


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, by words.

    The tokenizer's pre-tokenization never joins what a space or a line feed parts, so a text's ids are
    those of its parts in order, and a part's ids are looked up if it has been seen.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.stop = self.tokenizer.token_to_id(BREAK)

    def fresh(self, words: list[str]) -> list[bytes]:
        """Ids of words, encoded many at a time with a special token between them."""
        one = lambda w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if self.stop is None:
            return [one(w) for w in words]
        out: list[bytes] = []
        for k in range(0, len(words), 1000):
            part = words[k:k + 1000]
            # A batch of one: that call works out no offsets.
            ids = np.array(self.tokenizer.encode_batch_fast([BREAK.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut, raw = np.flatnonzero(ids == self.stop), ids.tobytes()
            if len(cut) != len(part) - 1:  # a word has that token itself
                out += [one(w) for w in part]
                continue
            ends = np.append(cut, len(ids)).tolist()
            out += [raw[4 * lo:4 * hi] for lo, hi in zip([0, *(cut + 1).tolist()], ends, strict=True)]
        return out

    def split(self, word: str) -> tuple[str, str]:
        """A word's body and its tail of marks, where the tokenizer parts them too."""
        body, tail = word.rstrip(TAIL), ""
        if body and len(body) < len(word) and body[-1].isalpha():
            tail = word[len(body):]
        else:
            body = word
        return (body.lower() if body.isascii() and "<|" not in body else body), tail

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't known, and of their parts that aren't."""
        known = self.known
        halves = [self.split(w) for w in words]
        new = list({h for pair in halves for h in pair} - known.keys())
        out = dict(zip(new, self.fresh(new), strict=True))
        for w, (a, b) in zip(words, halves, strict=True):
            if w not in out:
                out[w] = (out[a] if a in out else known[a]) + (out[b] if b in out else known[b])
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; null is empty. Arrow finds the distinct words and puts their ids in order."""
        parts = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = parts.flatten().dictionary_encode()
        distinct, known = words.dictionary.to_pylist(), self.known
        found = list(map(known.get, distinct))
        at = [k for k, x in enumerate(found) if x is None]
        more = self.learn([distinct[k] for k in at])
        for k in at:
            found[k] = more[distinct[k]]
        if len(known) + len(more) <= MEMORY:
            known.update(more)
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
        at, raw = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist(), ids.buffers()[2]
        return [raw[lo:hi].to_pybytes() if hi > lo else b"" for lo, hi in zip(at[:-1], at[1:], strict=True)]


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's tokenizer; reused by its later tasks."""
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def _portions(texts: pa.Array):
    """Runs of rows with about AT_ONCE bytes: the first row and the texts."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        upto = (ends[at - 1] if at else 0) + AT_ONCE
        end = min(max(int(np.searchsorted(ends, upto, side="right")), at + 1), len(texts))
        yield at, texts.slice(at, end - at)
        at = end


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's full windows and its remainder."""

    def run(batches):
        ids = word_ids(tokenizer)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            doc, texts = batch.column("doc_id"), batch.column("text")
            for at, part in _portions(texts):
                rows, starts, lengths, crcs, totals = [], [], [], [], []
                for k, raw in enumerate(ids.encode(part), at):
                    raw += end
                    n = len(raw) // 4
                    for s in range(0, n, window):
                        rows.append(k)
                        starts.append(s)
                        lengths.append(min(window, n - s))
                        crcs.append(zlib.crc32(raw[4 * s:4 * (s + window)]))
                        totals.append(n)
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of available lengths whose sum comes closest to ``window`` from below.

    Bit s of a layer tells whether the lengths so far can sum to s; copies of a length are added in
    powers of two. It stops at the first full window, long lengths first, and walks the layers back.
    """
    full, reach, layers = 1 << window, 1, []
    mask = (full << 1) - 1
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], window // length), 1
        while left and not reach & full:
            n = min(take, left)
            layers.append((length, n, reach))
            reach |= (reach << (n * length)) & mask
            left -= n
            take *= 2
        if reach & full:
            break
    total, used = reach.bit_length() - 1, {}
    for length, n, before in reversed(layers):
        if not (before >> total) & 1:
            total -= n * length
            used[length] = used.get(length, 0) + n
    return used


def patterns(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Window fillings and how often each is used, until nothing is left.

    Each filling is used until a length in it runs short, so there are few for each length.
    """
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        used = fullest(counts, window)
        times = min(counts[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def slot_rows(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, in a window, first sequence, offset) for ranks of each length."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for used, times in patterns(counts, window):
        offset = 0
        for length in sorted(used, reverse=True):
            n, at = used[length], seen.get(length, 0)
            rows.append((length, at, at + n * times, n, sequence, offset))
            seen[length] = at + n * times
            offset += n * length
        sequence += times
    return rows


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text), and where it lies.

    doc_id, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit integers),
    doc_tokens (ids of the document, the closing id 1 included), sequence_id, offset. Null and empty
    texts are the closing id alone; rows with equal or null doc_id are packed each by itself; an empty
    table gives no pieces and further columns are ignored. Sequences have at most ``window`` tokens and
    no gaps. ``tokenizer`` is the path of a tokenizer file.
    """
    scratch = Scratch(spark, "packing")
    rows = pieces(docs.select("doc_id", "text"), tokenizer, window)
    rows = scratch.keep(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")), "pieces")
    counts = scratch.keep(rows.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    # At most one count for each length up to the window.
    have = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    schema = "length long, lo long, hi long, per long, sequence long, at long"
    slots = spark.createDataFrame(slot_rows(have, window), schema)
    slots = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "per", "sequence", "at"))).alias("slots"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row for each length; the slots of all lengths are a few for each length.
    base = base.join(F.broadcast(slots), "length")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    x = rows.withColumn("rank", rank).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    x = x.withColumn("slot", F.expr("filter(slots, s -> rank >= s.lo and rank < s.hi)[0]"))
    nth = F.expr("rank - slot.lo")
    sequence = F.col("slot.sequence") + F.floor(nth / F.col("slot.per"))
    offset = F.col("slot.at") + (nth % F.col("slot.per")) * F.col("length")
    return x.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
