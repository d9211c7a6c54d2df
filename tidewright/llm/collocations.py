"""Phrase collocations from position bitmaps of shards.

Texts of a language are laid on end in shards of a million positions or two, with an empty position between
pieces. In a shard each word has a bitmap of its positions, compressed to the 64-bit blocks that have any.
A phrase's bitmap has the positions of its last word: shifted by one it holds where the phrase may go on,
the first set bit tells the next word, AND with that word's bitmap gives all places of the longer phrase in
the block, and those bits are done. Popcounts are the phrase's count in the shard. A slice of first words at
a time is so extended to its longest phrases before the next slice begins.

Counts are summed over shards between passes, and shards hear back which of their words, then which of
their word pairs, are frequent in the whole language: only those are extended further. Words have exact
numbers, made of the first shard that has them and their number in it. A sum has one row of each shard
that has the phrase, so no phrase gathers more rows than there are shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch

#: Positions of a shard, and of all shards that a task has begun; a piece is never cut.
SHARD, OPEN = 3 << 19, 3 << 20
#: Bytes of a text that are cut into words at once.
AT_ONCE = 1 << 20
#: Entries of bitmaps that are extended at once.
SLICE = 1 << 17
#: Bits of a word's number: its place in a shard's list of words, and the shard's in its task.
PLACE, ORDINAL = 28, 14
#: What ends a piece becomes a line feed, a tab a space, A-Z a-z.
_CLEAN = bytes(10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    """Numbers of words in the order in which they come, from 1; ends of pieces are 0, empty strings -1."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self) - 1
        return out


def cut_words(text: bytes, numbers: _Words) -> list[np.ndarray]:
    """Word numbers of a text, after the end of a piece."""
    text, out, at = text.translate(_CLEAN), [np.zeros(1, np.int32)], 0
    while at < len(text):
        end = text.find(b" ", at + AT_ONCE)
        part = text[at:] if end < 0 else text[at:end]
        x = np.array(list(map(numbers.__getitem__, part.replace(b"\n", b" \n ").split(b" "))), np.int32)
        out.append(x[x >= 0])
        at += len(part)
    return out


def shards(docs: DataFrame) -> DataFrame:
    """(lang, shard, words, counts, total, ids): texts of a language on end, as numbers into a list of words."""
    schema = "lang string, shard long, words array<binary>, counts array<long>, total long, ids binary"

    def run(batches):
        task, ordinal, size = TaskContext.get().partitionId(), 0, 0
        begun: dict[str, tuple[_Words, list[np.ndarray], list[int]]] = {}

        def end(lang):
            nonlocal ordinal, size
            numbers, parts, length = begun.pop(lang)
            size -= length[0]
            ids = np.concatenate(parts)
            ids = ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))]
            counts = np.bincount(ids, minlength=len(numbers) - 1)[1:]
            if task >> (63 - PLACE - ORDINAL) or ordinal >> ORDINAL or len(counts) >> PLACE:
                raise ValueError("too many shards, or words of a shard, to number")
            words = [w for w, k in numbers.items() if k > 0]
            shard = task << ORDINAL | ordinal
            ordinal += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([shard], pa.int64()), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([int(counts.sum())], pa.int64()), pa.array([ids.tobytes()], pa.binary())],
                names=["lang", "shard", "words", "counts", "total", "ids"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if lang not in begun:
                    begun[lang] = (_Words(), [], [0])
                numbers, parts, length = begun[lang]
                new = cut_words(text.as_py() or b"", numbers)
                parts += new
                n = sum(map(len, new))
                length[0] += n
                size += n
                if length[0] >= SHARD:
                    yield end(lang)
                elif size >= OPEN:
                    yield end(max(begun, key=lambda k: begun[k][2][0]))
        for lang in list(begun):
            yield end(lang)

    x = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    return x.mapInArrow(run, schema)


class Bitmaps:
    """Positions of a shard's words, by word and 64-bit block."""

    def __init__(self, ids: np.ndarray, good: np.ndarray):
        at = np.flatnonzero(good[ids])
        words = ids[at]
        order = np.argsort(words, kind="stable")
        at, words = at[order], words[order]
        blocks = at >> 6
        first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (blocks[1:] != blocks[:-1]))) if len(at) else np.zeros(0, np.int64)
        self.word, self.block = words[first].astype(np.int64), blocks[first]
        bit = np.uint64(1) << (at & 63).astype(np.uint64)
        self.bits = np.bitwise_or.reduceat(bit, first) if len(at) else bit
        #: The entry that each position belongs to; one more block for what is shifted out of the last.
        self.entry = np.full((len(ids) | 63) + 65, -1, np.int32)
        self.entry[at] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(at))))

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray):
        """(phrase, word, block, bits) of every phrase one word longer, from bitmaps of phrases."""
        one = np.uint64(1)
        over = np.flatnonzero(bits >> np.uint64(63))
        phrase, block = np.append(phrase, phrase[over]), np.append(block, block[over] + 1)
        bits = np.append(bits << one, np.full(len(over), one))
        out = []
        on = np.flatnonzero(bits)
        phrase, block, bits = phrase[on], block[on], bits[on]
        while len(bits):
            low = bits & (~bits + one)
            e = self.entry[block * 64 + np.bitwise_count(low - one)]
            child = np.where(e >= 0, bits & self.bits[e], np.uint64(0))
            hit = np.flatnonzero(e >= 0)
            out.append((phrase[hit], self.word[e[hit]], block[hit], child[hit]))
            bits = bits ^ np.where(e >= 0, child, low)
            on = np.flatnonzero(bits)
            phrase, block, bits = phrase[on], block[on], bits[on]
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]

    def slices(self):
        """Entries of runs of words, about SLICE at a time."""
        at = 0
        while at < len(self.word):
            end = len(self.word)
            if at + SLICE < end:
                end = max(int(np.searchsorted(self.word, self.word[at + SLICE])), int(np.searchsorted(self.word, self.word[at], side="right")))
            yield self.word[at:end], self.block[at:end], self.bits[at:end]
            at = end


def numbered(phrase: np.ndarray, word: np.ndarray, bits: np.ndarray):
    """Longer phrases numbered: the phrase and word of each, its count, and the number of each entry."""
    if not len(phrase):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    keys, at = np.unique(phrase << 32 | word, return_inverse=True)
    return keys >> 32, keys & 0xFFFFFFFF, np.bincount(at, weights=np.bitwise_count(bits)).astype(np.int64), at


def _shard(left: pa.Table, right: pa.Table):
    """A shard's word numbers, the numbers of its frequent words in all shards, and its frequent pairs."""
    ids = np.frombuffer(left.column("ids")[0].as_py(), np.int32)
    kind, x, y = (right.column(c).to_numpy() for c in ("kind", "x", "y"))
    at, number = x[kind == 1], y[kind == 1]
    known = np.full(max(int(ids.max(initial=0)), int(at.max(initial=0))) + 1, -1, np.int64)
    known[at] = number
    order = np.argsort(number)
    pairs = [at[order][np.searchsorted(number[order], v[kind == 2])] for v in (x, y)] if (kind == 2).any() else [np.zeros(0, np.int64)] * 2
    return ids, known, np.sort(pairs[0] << 32 | pairs[1])


def _count_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    names = ["shard", "a", "b", "n"]
    out = [[np.zeros(0, np.int64)] for _ in range(3)]
    if left.num_rows and right.num_rows:
        ids, known, _ = _shard(left, right)
        maps = Bitmaps(ids, known >= 0)
        for word, block, bits in maps.slices():
            phrase, nxt, _, child = maps.extended(word, block, bits)
            a, b, n, _ = numbered(phrase, nxt, child)
            for o, v in zip(out, (known[a], known[b], n), strict=True):
                o.append(v)
    cols = [np.concatenate(o) for o in out]
    shard = left.column("shard")[0].as_py() if left.num_rows else 0
    return pa.Table.from_arrays([pa.array(np.full(len(cols[0]), shard, np.int64)), *map(pa.array, cols)], names=names)


def _count_longer(left: pa.Table, right: pa.Table) -> pa.Table:
    """Phrases of three and four words, all of whose pairs are frequent."""
    out = [[np.zeros(0, np.int64)] for _ in range(5)]
    if left.num_rows and right.num_rows:
        ids, known, pairs = _shard(left, right)
        good = np.zeros(len(known), bool)
        good[pairs >> 32] = good[pairs & 0xFFFFFFFF] = True
        maps = Bitmaps(ids, good)
        for word, block, bits in maps.slices():
            # A phrase's words; at first each is one word, numbered as the word.
            of = [np.arange(len(known))]
            phrase = word
            for length in (2, 3, 4):
                phrase, nxt, block, bits = maps.extended(phrase, block, bits)
                want = of[-1][phrase] << 32 | nxt
                there = np.searchsorted(pairs, want)
                on = np.flatnonzero((there < len(pairs)) & (pairs[np.minimum(there, len(pairs) - 1)] == want)) if len(pairs) else np.zeros(0, np.int64)
                parent, last, n, at = numbered(phrase[on], nxt[on], bits[on])
                of = [*(w[parent] for w in of), last]
                phrase, block, bits = at, block[on], bits[on]
                if length > 2:
                    words = [known[w] for w in of] + [np.full(len(n), -1, np.int64)] * (4 - length)
                    for o, v in zip(out, (*words, n), strict=True):
                        o.append(v)
    return pa.Table.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["w1", "w2", "w3", "w4", "n"])


def frequent(spark: SparkSession, docs: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of phrases of 1 to 4 words with ``least`` places or more, (lang, n) with all words)."""
    laid = scratch.keep(shards(docs), "shards")
    each = laid.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    each = each.select("lang", "shard", (F.col("at") + 1).cast("long").alias("at"), F.col("w.words").cast("string").alias("word"), F.col("w.counts").alias("n"))
    same, own = Window.partitionBy("lang", "word"), F.expr(f"shiftleft(shard, {PLACE}) + at")
    x = each.withColumns({"f": F.sum("n").over(same), "id": F.min(own).over(same)}).where(F.col("f") >= least)
    # The words themselves go with one row of each.
    is_own = F.col("id") == own
    words = scratch.keep(x.select("shard", "at", "id", "f", *[F.when(is_own, F.col(c)).alias(c) for c in ("lang", "word")]), "words")

    said = words.select("shard", F.lit(1).alias("kind"), F.col("at").alias("x"), F.col("id").alias("y"))
    slim = laid.select("shard", "ids")
    x = slim.groupBy("shard").cogroup(said.groupBy("shard")).applyInArrow(_count_pairs, "shard long, a long, b long, n long")
    x = x.withColumn("f", F.sum("n").over(Window.partitionBy("a", "b"))).where(F.col("f") >= least)
    pairs = scratch.keep(x.select("shard", "a", "b", "f"), "pairs")

    said = said.union(pairs.select("shard", F.lit(2), "a", "b"))
    x = slim.groupBy("shard").cogroup(said.groupBy("shard")).applyInArrow(_count_longer, "w1 long, w2 long, w3 long, w4 long, n long")
    x = x.groupBy("w1", "w2", "w3", "w4").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    longer = scratch.keep(x, "longer")

    none = F.lit(-1).cast("long")
    names = words.where("word is not null")
    every = pairs.groupBy("a", "b").agg(F.max("f").alias("f")).select(F.col("a").alias("w1"), F.col("b").alias("w2"), none.alias("w3"), none.alias("w4"), "f").union(longer)
    # By place, so that a phrase's words come back in order; all words of a phrase are of one language.
    spots = every.select(F.struct("w1", "w2", "w3", "w4").alias("key"), "f", F.posexplode(F.expr("filter(array(w1, w2, w3, w4), w -> w >= 0)")).alias("spot", "id"))
    spelt = spots.join(names.select("id", "lang", "word"), "id").groupBy("key", "f").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("spot", "word"))).alias("ws"))
    spelt = spelt.select("lang", F.array_join("ws.word", " ").alias("phrase"), F.size("ws").alias("k"), "f")
    one = names.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f")
    return scratch.keep(one.union(spelt), "phrases"), laid.groupBy("lang").agg(F.sum("total").alias("n"))


def collocations(spark: SparkSession, docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words.

    ``docs`` has lang and text; null texts have no words and a null lang is ``und``. A-Z count as a-z; the
    marks ``.,;:!?``, line feeds and the like end pieces, spaces and tabs part words. ``a`` counts a
    phrase's places, ``least`` or more, overlapping ones too, ``n`` all words of the language. Cut in two, its
    parts have ``l`` and ``r`` places, and floor(2000000 a / (l + r)) is the cut's score; the lowest cut
    counts, of equals the first. Phrases inside a longer one with at least 80 % as many places are left
    out. Ties go by ``a``, then by the phrase's bytes. Texts are taken whole; repeated rows count each; an
    empty table gives no rows; further columns are ignored.
    """
    scratch = Scratch(spark, "collocations")
    phrases, totals = frequent(spark, docs.select("lang", "text"), least, scratch)
    x = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    cuts = x.select("lang", "phrase", "a", "ws", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(ws, 1, cut), ' ')").alias("head"), F.expr("array_join(slice(ws, cut + 1, k - cut), ' ')").alias("tail"))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    # Products may pass 64 bits.
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(ws, i, m), ' '))))"))
    within = x.where("k > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where("longer IS NULL OR cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * 80")
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(256)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = kept.withColumn("rank", rank("lang", "salt")).where(F.col("rank") <= top)
    few = few.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return few.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = 30, top: int = 2000) -> str:
    """DuckDB SQL over ``documents`` for the rows of ``collocations``."""
    return rf"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    lines AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
    sizes AS (SELECT lang, ws, unnest([1, 2, 3, 4]) AS k FROM lines WHERE len(ws) > 0),
    spots AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM sizes WHERE len(ws) >= k),
    totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lines GROUP BY lang),
    f AS (SELECT lang, k, ws[i:i + k - 1] AS p, count(*) AS f FROM spots GROUP BY ALL HAVING count(*) >= {least}),
    cuts AS (SELECT lang, p, k, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
    scored AS (SELECT c.lang, c.p, c.a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM cuts c
        JOIN f x ON x.lang = c.lang AND x.p = c.p[1:cut] JOIN f y ON y.lang = c.lang AND y.p = c.p[cut + 1:]
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, cut) = 1),
    subs AS (SELECT lang, k, p, f, unnest(range(2, k)) AS m FROM f WHERE k > 2),
    inner_ AS (SELECT lang, p, f, m, unnest(range(1, k - m + 2)) AS i FROM subs),
    longer AS (SELECT lang, p[i:i + m - 1] AS p, max(f) AS f FROM inner_ GROUP BY ALL),
    kept AS (SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, score FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.p = s.p WHERE g.f IS NULL OR 100::HUGEINT * g.f < 80::HUGEINT * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}"""
