"""MinHash near-duplicates with odd sketches.

MinHash samples of each document's word shingles are cut into bands, whose equality proposes
candidates, and folded into a parity bitmap. The population count of two bitmaps' XOR estimates high
similarities closely (Mitzenmacher, Pagh and Pham, "Efficient estimation for high similarities using
odd sketches"), so few pairs come to the exact test on full shingle sets.

Components need no more links than connect them, so proposals are tested in two rounds. First each
document meets a few leaders, one of each band bucket's members. Buckets whose documents are connected
by then hold nothing new; in the rest all pairs across components are weighed by longer sketches, in
blocks that hold the sets for the exact test.

Documents with equal sets are one class, and classes are what is linked: a document that stands in
several rows with different texts belongs to several classes, which it connects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.candidates import bucket_leaders, links
from tidewright.llm.common import U64, Scratch, lower_ascii, mix64, prefix_hash, range_hash, spans, text_slabs, white
from tidewright.llm.components import connected_components

#: MinHash samples and bands of a document; samples of one that the first sketches leave open; bits for each sample.
SAMPLES, BANDS, FINE, BITS = 128, 32, 1024, 4
#: Standard errors by which an estimate may fall below the threshold and still be tested exactly.
MARGIN = 5.0
#: Members that meet one leader in one group of the exact test.
MEMBERS = 64

_A = (mix64(np.arange(1, FINE + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix64(np.arange(100_001, FINE + 100_001, dtype=U64)) >> U64(32)).astype(np.uint32)


def shingle_sets(column, n_words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct 64-bit shingle hashes of each text, slab by slab: (first row, sets)."""
    for first, b, off in text_slabs(column):
        b = lower_ascii(b)
        s, e, row = spans(~white(b), off)
        word = range_hash(prefix_hash(b), s, e)
        cut = np.searchsorted(row, np.arange(len(off)))
        joined = word.copy()
        for k in range(1, min(n_words, len(word))):  # a slab may hold fewer words than a shingle
            joined[:len(word) - k] = mix64(joined[:len(word) - k] * U64(0xD1342543DE82EF95) + word[k:])
        out = []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hi - lo >= n_words:
                out.append(np.unique(joined[lo:hi - n_words + 1]))
            elif hi > lo:
                h = word[lo:lo + 1]
                for k in range(lo + 1, hi):
                    h = mix64(h * U64(0xD1342543DE82EF95) + word[k:k + 1])
                out.append(h)
            else:
                out.append(word[:0])
        yield first, out


def signature(hashes: np.ndarray, samples: int) -> np.ndarray:
    """Minima of ``samples`` pairwise independent functions of the set."""
    x = (hashes >> U64(32)).astype(np.uint32)
    low = np.full(samples, 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 18) // samples)
    for k in range(0, len(x), step):
        np.minimum(low, (_A[:samples, None] * x[None, k:k + step] + _B[:samples, None]).min(axis=1), out=low)
    return low


def fingerprint(h: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of a set, which together tell equal sets."""
    return mix64(np.array([h.sum(dtype=U64), np.bitwise_xor.reduce(mix64(h))]) + U64(len(h)))


def bands_of(low: np.ndarray) -> np.ndarray:
    """One key for each band of each row of signatures."""
    rows = SAMPLES // BANDS
    v = low.reshape(len(low), BANDS, rows).astype(U64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), v.shape[:2]).copy()
    for k in range(rows):
        h = mix64(h + v[:, :, k] * U64(0xD1342543DE82EF95))
    return h.view(np.int64)


def odd_sketches(low: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the numbered samples, as longs: BITS bits for each sample."""
    n, samples = low.shape
    bits = BITS * samples
    at = (mix64(low.astype(U64) + (np.arange(1, samples + 1, dtype=U64) << U64(32))[None, :]) % U64(bits)).astype(np.int64)
    parity = (np.bincount((at + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, bits), axis=1).view(np.int64)


def estimate(differing, samples: int):
    """Jaccard similarity from the number of differing bits."""
    bits = BITS * samples
    part = np.minimum(2.0 * np.asarray(differing) / bits, 0.999)
    return 1 + bits / 4 * np.log1p(-part) / samples


def most_differing(threshold: float, samples: int) -> int:
    """The number of differing bits up to which pairs go to the exact test."""
    least = threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / samples)
    return int(np.flatnonzero(estimate(np.arange(BITS * samples // 2), samples) >= least).max()) + 1


def _lists(values: np.ndarray, full: np.ndarray) -> pa.ListArray:
    """Rows of ``values`` as lists, empty where not ``full``."""
    at = np.concatenate([[0], np.cumsum(np.where(full, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values[full].ravel()))


def sketch_documents(docs: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands, sketch); f1 and f2 tell equal sets."""
    schema = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>"

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, sets in shingle_sets(batch.column("text"), n_words):
                n = len(sets)
                low = np.zeros((n, SAMPLES), np.uint32)
                f = np.zeros((n, 2), U64)
                for i, h in enumerate(sets):
                    if len(h):
                        low[i], f[i] = signature(h, SAMPLES), fingerprint(h)
                size = np.array([len(h) for h in sets], np.int64)
                full = size > 0
                bands, sketch = bands_of(low), odd_sketches(low)
                f = f.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), pa.array(size), pa.array(f[:, 0], mask=~full), pa.array(f[:, 1], mask=~full),
                     _lists(bands, full), _lists(sketch, full)],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def shingle_bytes(docs: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, f1, f2, payload): sorted shingle hashes of (doc_id, text) as bytes; blank texts have no row."""

    def run(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), n_words):
                some = [k for k, h in enumerate(sets) if len(h)]
                f = np.array([fingerprint(sets[k]) for k in some], U64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([first + k for k in some], pa.int64())), pa.array(f[:, 0].view(np.int64)), pa.array(f[:, 1].view(np.int64)),
                     pa.array([sets[k].tobytes() for k in some], pa.binary())], names=["doc_id", "f1", "f2", "payload"])

    return docs.mapInArrow(run, "doc_id long, f1 long, f2 long, payload binary")


def fine_sketches(sets: DataFrame) -> DataFrame:
    """(id, sketch, payload) of FINE samples for (id, payload)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                low = np.stack([signature(np.frombuffer(p.as_py(), U64), FINE) for p in part.column("payload")])
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(odd_sketches(low), np.ones(len(low), bool)), part.column("payload")], names=["id", "sketch", "payload"])

    return sets.select("id", "payload").mapInArrow(run, "id long, sketch array<long>, payload binary")


def similar(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether 100 * |A and B| >= percent * |A or B| for two sorted sets."""
    small, large = (own, other) if len(own) <= len(other) else (other, own)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    where = np.searchsorted(large, small)
    where[where == len(large)] = 0
    both = int((large[where] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are ``similar`` by ``sets`` (id, payload).

    Members meet their leader ``b`` in groups of about MEMBERS, sorted so that the leader comes first;
    each group holds one set at a time.
    """

    def run(batches):
        lead, at = None, None
        for batch in batches:
            ids, payload, out = batch.column("a").to_pylist(), batch.column("payload"), []
            for k, key in enumerate(zip(batch.column("b").to_pylist(), batch.column("salt").to_pylist(), strict=True)):
                own = np.frombuffer(payload[k].as_py(), U64)
                if key != at:
                    lead, at = own, key  # sorted: the first row of a group is its leader
                elif similar(own, lead, percent):
                    out.append((ids[k], key[0]))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("c"))
    member = pairs.join(groups, "b").withColumn("salt", F.pmod(F.xxhash64("a", F.lit(11)), F.col("c")).cast("int"))
    member = member.select("a", "b", "salt", F.lit(1).alias("rank"))
    leader = groups.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("salt"), F.lit(0).alias("rank"))
    rows = member.union(leader).join(sets.withColumnRenamed("id", "a").hint("merge"), "a").select("b", "salt", "rank", "a", "payload")
    dealt = rows.repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", "rank", "a")
    return dealt.select("b", "salt", "a", "payload").mapInArrow(run, "a long, b long")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, n_words: int = 5, percent: int = 80, leaders: int = 3,
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z), cut at ASCII white space, and taken as sets of ``n_words``-word
    shingles; a text with fewer words is one shingle. Documents are linked where 100 * |A and B| >=
    percent * |A or B|, tested on the full sets. Null and blank texts have no shingles and no links.
    Equal sets link at once. Rows with a null doc_id get a null component and are kept; rows that share a
    doc_id are one document, linked by any of their texts. Empty tables give empty results; further
    columns of ``docs`` are ignored.
    """
    scratch = Scratch(spark, "odd-sketch")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = scratch.keep(sketch_documents(docs, n_words), "sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    # Numbers of classes are given once: the table is written and read again.
    low = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("low"))
    classes = scratch.keep(low.withColumn("id", F.monotonically_increasing_id()), "classes")
    # Classes and documents that share a bucket have no bound: their joins (merge) never broadcast them.
    reps = full.join(classes.withColumnRenamed("low", "doc_id").hint("merge"), ["f1", "f2", "doc_id"])
    keys = bucket_leaders(reps.select("id", F.explode("bands").alias("key")), scratch)
    wanted = keys.select("id").distinct().join(classes, "id").withColumnRenamed("low", "doc_id")
    wanted = scratch.keep(wanted, "wanted")
    texts = docs.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    sets = shingle_bytes(texts, n_words).join(wanted.hint("merge"), ["f1", "f2", "doc_id"])
    sets = scratch.keep(sets.dropDuplicates(["f1", "f2", "doc_id"]).select("id", "payload"), "sets")
    coarse = reps.select("id", "sketch").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    coarse = scratch.keep(coarse, "sketches")

    def refine(ids):
        fine = fine_sketches(sets.join(ids.hint("merge"), "id", "left_semi"))
        return scratch.keep(fine, "fine"), BITS * FINE // 64, most_differing(percent / 100, FINE)

    edges = links(
        keys, (coarse, BITS * SAMPLES // 64, most_differing(percent / 100, SAMPLES)), lambda pairs: verify(pairs, sets, percent, parts), refine,
        lambda a, b: similar(np.frombuffer(a, U64), np.frombuffer(b, U64), percent), scratch, parts, leaders)
    member = full.select("doc_id", "f1", "f2").join(classes, ["f1", "f2"]).select("doc_id", "id")
    home = member.groupBy("doc_id").agg(F.min("id").alias("home"), F.max("id").alias("other"))
    home = scratch.keep(home, "homes")
    # Most documents have one text, and so one class: only the others connect classes.
    several = member.join(home.where("home <> other"), "doc_id").where("id <> home").select(F.col("id").alias("a"), F.col("home").alias("b"))
    final = scratch.keep(connected_components(edges.union(several), scratch), "components")
    least = final.join(classes.select("id", "low"), "id").groupBy("component_id").agg(F.min("low").alias("least"))
    known = final.join(least, "component_id").select("id", "least").union(
        classes.join(final, "id", "left_anti").select("id", F.col("low").alias("least")))
    of = home.join(known.withColumnRenamed("id", "home"), "home").select("doc_id", F.col("least").alias("of"))
    out = rows.select("doc_id", "n_shingles").join(of, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("of", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
