"""Line dedup by a segment-partition edit join.

Within an edit distance of k, one of a line's k + 1 segments stands unchanged in the other line, close to
its place (Li, Deng, Wang and Feng, "Pass-Join"). Each line indexes its segments by length, number and
hash; it probes the segments of lines that are up to k shorter with the substrings that can match, and
lines of its own length with those that its own segments don't cover. What meets is compared by byte
parities and then by a bit-parallel edit distance within the band of k. Distances are over UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.candidates import bucket_leaders, links
from tidewright.llm.common import U64, Scratch, mix64, prefix_hash, range_hash, spans, text_slabs
from tidewright.llm.components import connected_components

#: Edits within which lines are copies; bytes of a line from which near copies and exact copies count.
EDITS, MIN_BYTES, EXACT_BYTES = 2, 40, 20
#: Members that meet one leader in one group of the exact test.
MEMBERS = 256

_CLASS = (mix64(np.arange(5001, 5257, dtype=U64)) % U64(64)).astype(U64)


def within(a: bytes, b: bytes, k: int) -> bool:
    """Whether the edit distance of a and b is at most k.

    Bit i of row d says that the first i bytes of a become the bytes of b so far by at most d edits; only
    the band of k around the diagonal is kept.
    """
    if abs(len(a) - len(b)) > k:
        return False
    n = min(len(a), len(b))
    same = np.frombuffer(a, np.uint8, n) == np.frombuffer(b, np.uint8, n)
    at = int(np.argmin(same)) if n and not same.all() else n
    a, b = a[at:], b[at:]
    n = min(len(a), len(b))
    same = (np.frombuffer(a, np.uint8, n, len(a) - n) == np.frombuffer(b, np.uint8, n, len(b) - n))[::-1] if n else np.ones(0, bool)
    at = int(np.argmin(same)) if n and not same.all() else n
    a, b = a[:len(a) - at], b[:len(b) - at]
    if not a or not b:
        return max(len(a), len(b)) <= k
    match: dict[int, int] = {}
    for i, c in enumerate(a):
        match[c] = match.get(c, 0) | (1 << i)
    rows = [(1 << (d + 1)) - 1 for d in range(k + 1)]
    band = (1 << (2 * k + 1)) - 1
    for j, c in enumerate(b, 1):
        m, new = match.get(c, 0), []
        keep = band << (j - k) if j > k else band >> (k - j)
        for d in range(k + 1):
            r = (rows[d] & m) << 1
            if d:
                r |= rows[d - 1] | (rows[d - 1] << 1) | (new[d - 1] << 1)
            new.append(r & keep)
        rows = new
        if not rows[k]:
            return False
    return bool(rows[k] >> len(a) & 1)


def _segment(length: np.ndarray, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of k + 1 near-equal ones; the longer ones come last."""
    size, longer = length // (k + 1), length % (k + 1)
    short = k + 1 - longer
    return i * size + np.maximum(i - short, 0), size + (i >= short)


def _key(sums, s, e, length, i):
    return mix64(range_hash(sums, s, e) + length.astype(U64) * U64(0xD1342543DE82EF95) + U64(i + 1)).view(np.int64)


def segment_keys(sums: np.ndarray, s: np.ndarray, e: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines [s, e) and the line of each: two lines within k edits share a key."""
    keys, line = [], []
    every, length = np.arange(len(s)), e - s
    for i in range(k + 1):
        p, n = _segment(length, i, k)
        keys.append(_key(sums, s + p, s + p + n, length, i))
        line.append(every)
        for less in range(k + 1):  # the other line is so much shorter
            p, n = _segment(length - less, i, k)
            for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1):
                if less == 0 and shift == 0:
                    continue  # the segment itself
                at = p + shift
                m = (at >= 0) & (at + n <= length) & (n > 0)
                keys.append(_key(sums, s[m] + at[m], s[m] + at[m] + n[m], length[m] - less, i))
                line.append(every[m])
    return np.concatenate(keys), np.concatenate(line)


def _lines(column, least: int):
    """Lines of at least ``least`` bytes, slab by slab: first row, bytes, sums, starts, ends, rows, hashes, line numbers."""
    for first, b, off in text_slabs(column):
        breaks = b == 10
        s, e, row = spans(~breaks, off)
        upto = np.append(0, np.cumsum(breaks))
        number = upto[s] - upto[off[row]]
        m = e - s >= least
        s, e, row, number = s[m], e[m], row[m], number[m]
        sums = prefix_hash(b)
        yield first, b, sums, s, e, row, range_hash(sums, s, e).view(np.int64), number


def _doc_key():
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def drop_copies(spark: SparkSession, docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, exact_bytes: int = EXACT_BYTES) -> DataFrame:
    """``docs`` without copies of lines, with n_lines and n_dropped added.

    Lines end at line feeds. Lines of at least ``min_bytes`` bytes are linked where their edit distance is
    at most ``edits``, and those of at least ``exact_bytes`` bytes where they are equal; of the lines that
    links connect, the first one stays: by doc_id (null last), then place. Shorter lines always stay. A null text stays null with no lines; an empty one has one line.
    Rows that are equal in doc_id and text are one document and fare alike; empty tables give empty
    results; all columns pass through, n_chars (if present) follows the text.
    """
    if min_bytes <= 2 * edits:
        raise ValueError("min_bytes must be above 2 * edits")
    scratch = Scratch(spark, "line-dedup")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def segments(batches):
        for batch in batches:
            for _, _, sums, s, e, _, h, _ in _lines(batch.column("text"), min_bytes):
                ids, at = np.unique(h, return_index=True)
                keys, line = segment_keys(sums, s[at], e[at], edits)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[line])], names=["key", "id"])

    def occurrences(batches):
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("mark")
            for first, _, _, _, _, row, h, number in _lines(batch.column("text"), min(exact_bytes, min_bytes)):
                r = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([ids.take(r), marks.take(r), pa.array(number.astype(np.int64)), pa.array(h)], names=["doc_id", "mark", "line", "id"])

    keys = bucket_leaders(texts.select("text").mapInArrow(segments, "key long, id long"), scratch)
    wanted = scratch.keep(keys.select("id").distinct(), "wanted")

    seen = texts.withColumn("mark", _doc_key()).mapInArrow(occurrences, "doc_id long, mark long, line long, id long")
    seen = scratch.keep(seen, "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "line")
    firsts = seen.groupBy("id").agg(F.min(place).alias("at"), F.count("*").alias("n"))
    firsts = scratch.keep(firsts, "firsts")
    # Texts of the lines that met another one, each once: from the document where it comes first.
    want = firsts.join(wanted, "id", "left_semi").select("id", F.col("at.mark").alias("mark"), F.col("at.line").alias("line"))
    want = want.groupBy("mark").agg(F.collect_list(F.struct("line", "id")).alias("lines"))
    got = texts.withColumn("mark", _doc_key()).join(want, "mark").dropDuplicates(["mark"])
    got = got.select(F.explode("lines").alias("l"), F.split("text", "\n").alias("t"))
    got = scratch.keep(got.select("l.id", F.col("t")[F.col("l.line").cast("int")].cast("binary").alias("line")), "texts")
    sketches = scratch.keep(got.mapInArrow(_parities, "id long, sketch array<long>"), "parities")

    def verify(pairs):
        return _verify(pairs, got, edits, parts)

    def refine(ids):
        left = sketches.join(ids, "id", "left_semi").join(got.withColumnRenamed("line", "payload"), "id")
        return left, 1, 2 * edits

    edges = links(keys, (sketches, 1, 2 * edits), verify, refine, lambda a, b: within(a, b, edits), scratch, parts)
    classes = scratch.keep(connected_components(edges, scratch), "classes")
    member = seen.join(classes, "id", "left").withColumn("class", F.coalesce("component_id", "id"))
    # Only lines that occur twice or have links can be copies.
    many = firsts.where("n > 1").select("id").union(classes.select("id")).distinct()
    member = scratch.keep(member.join(many, "id", "left_semi").select("class", place.alias("at")), "members")
    least = scratch.keep(member.groupBy("class").agg(F.min("at").alias("first")), "least")
    gone = member.join(least, "class").where("at <> first").select("at.mark", "at.line")
    gone = gone.groupBy("mark").agg(F.collect_set("line").alias("gone"))
    # The row as it is stays in one struct, so that no column of it can clash with those added here.
    text = F.col("text").cast("string")
    x = docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("mark"), F.split(text, "\n").alias("t"), F.struct("*").alias("row"))
    x = x.join(gone, "mark", "left")
    # array_except looks places up in a set, so a long document takes time in proportion to its lines.
    kept = F.expr("transform(array_except(sequence(0L, size(t) - 1L), gone), i -> t[cast(i as int)])")
    new = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    own = {c: F.col("row").getField(c) for c in docs.columns if c not in ("n_lines", "n_dropped")} | {"text": new}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    n_lines = F.greatest(F.coalesce(F.size("t"), F.lit(0)), F.lit(0))
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return x.select(*[v.alias(c) for c, v in own.items()], n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


def _parities(batches):
    """For 64 classes of bytes, whether their number in a line is odd: one edit changes two at most."""
    for batch in batches:
        n = batch.num_rows
        for first in range(0, n, 2000):
            part = batch.column("line").slice(first, 2000).to_pylist()
            bits = []
            for line in part:
                odd = np.bincount(_CLASS[np.frombuffer(line, np.uint8)].astype(np.int64), minlength=64) & 1
                bits.append(int(np.packbits(odd.astype(np.uint8)).view(np.int64)[0]))
            at = pa.array(np.arange(len(part) + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, 2000), pa.ListArray.from_arrays(at, pa.array(bits, pa.int64()))], names=["id", "sketch"])


def _verify(pairs: DataFrame, lines: DataFrame, edits: int, parts: int) -> DataFrame:
    """Those of ``pairs`` (a, b) within ``edits``; members meet their leader b in groups of about MEMBERS."""

    def run(batches):
        lead, at = b"", None
        for batch in batches:
            out = []
            for b, salt, a, line in zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "a", "line")), strict=True):
                if (b, salt) != at:
                    lead, at = line, (b, salt)  # sorted: the first row of a group is its leader
                elif within(lead, line, edits):
                    out.append((a, b))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("c"))
    member = pairs.join(groups, "b").withColumn("salt", F.pmod(F.xxhash64("a", F.lit(11)), F.col("c")).cast("int"))
    member = member.select("a", "b", "salt", F.lit(1).alias("rank"))
    leader = groups.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("salt"), F.lit(0).alias("rank"))
    rows = member.union(leader).join(lines.withColumnRenamed("id", "a"), "a")
    dealt = rows.repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", "rank", "a")
    return dealt.select("b", "salt", "a", "line").mapInArrow(run, "a long, b long")
