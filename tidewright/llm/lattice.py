"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random onto blocks of 8 dimensions, and each block is decoded to its
nearest point of the lattice E8 (Conway and Sloane). A table's cell is its blocks' points. Each vector
stands in its own cell of every table and probes neighbouring cells: those with one block at the next
nearest lattice points. What meets in a cell is compared by cosine in double precision.

Cells only have to connect what is alike: within a cell, a block of rows hands on a spanning forest of
its links. Direct links are then counted once for each pair, between the chunks of each component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import U64, Scratch, mix64, sorted_groups
from tidewright.llm.components import connected_components

#: Tables, E8 blocks in a table's cell, neighbours probed for each block, and projected length of a unit vector.
TABLES, BLOCKS, PROBES, SCALE = 8, 2, 3, 2.0
#: Rows of a cell or component that one block compares.
CHUNK = 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minuses."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the nearer of those in D8 and in D8 + 1/2."""

    def d8(y):
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
        if len(odd):
            d = y[odd] - r[odd]
            k = np.abs(d).argmax(axis=1)
            r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


def projections(dim: int, seed: int) -> np.ndarray:
    """Orthonormal rows for each table, scaled: (TABLES, BLOCKS * 8, dim)."""
    rng = np.random.default_rng([seed, dim])
    out = rng.standard_normal((TABLES, BLOCKS * 8, dim))
    if dim >= BLOCKS * 8:
        out = np.stack([np.linalg.qr(m.T)[0].T for m in out]) * np.sqrt(dim)
    return out * SCALE / np.sqrt(8.0)


_MINIMAL = minimal_vectors()
_PLACE = mix64(np.arange(9001, 9017, dtype=U64)).view(np.int64) | 1


def cells(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell keys of unit vectors: own (n, TABLES) and probed (n, TABLES * BLOCKS * PROBES)."""
    own, probed = [], []
    for t, m in enumerate(projections(unit.shape[1], seed)):
        y = unit @ m.T
        points = [decode(y[:, 8 * k:8 * k + 8]) for k in range(BLOCKS)]
        code = lambda p, k: ((2 * p).astype(np.int64) * _PLACE[8 * k:8 * k + 8]).sum(axis=1)  # noqa: B023, E731
        codes = [code(p, k) for k, p in enumerate(points)]
        whole = sum(codes) + np.int64(t * 0x1A2B3C4D5E6F77)
        own.append(mix64(whole.view(U64)).view(np.int64))
        for k in range(BLOCKS):
            # Nearest of the neighbours: those that the offset from the cell's centre points to.
            toward = (y[:, 8 * k:8 * k + 8] - points[k]) @ _MINIMAL.T
            best = np.argpartition(-toward, PROBES, axis=1)[:, :PROBES]
            for p in range(PROBES):
                other = code(points[k] + _MINIMAL[best[:, p]], k)
                probed.append(mix64((whole - codes[k] + other).view(U64)).view(np.int64))
    return np.stack(own, axis=1), np.stack(probed, axis=1)


def valid(vector: str):
    """A vector that is not null, empty or zero and has no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow column of equally long lists, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(hit: np.ndarray) -> np.ndarray:
    """Smallest row that each row reaches through a symmetric boolean matrix."""
    n = len(hit)
    root = np.arange(n)
    while True:
        low = np.where(hit, root[None, :], n).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def blocks(members: DataFrame, key: str, chunk: int) -> DataFrame:
    """Cut each key's rows into chunks and give each pair of chunks a block.

    Adds ``i`` and ``j`` (the block, i <= j) and ``own`` (the row's chunk). Every pair of a key's rows
    meets in just one block, and a block has about two chunks of rows at most.
    """
    counts = members.groupBy(key).agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("c"))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("c")).cast("int")
    x = members.join(counts, key).withColumn("own", own)
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o"))
    return x.withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o")}).drop("o", "c")


def _cells_of(vectors: DataFrame, seed: int, parts: int) -> DataFrame:
    """(key, id, home): rows in cells of one label and width."""

    def run(batches):
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                part = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                for first in range(0, part.num_rows, 2048):
                    p = part.slice(first, 2048)
                    own, probed = cells(unit_rows(matrix(p.column("v"))), seed)
                    salt = mix64((p.column("label").to_numpy().astype(np.int64) * 1_000_003 + dim).view(U64)).view(np.int64)[:, None]
                    ids = p.column("id").to_numpy()
                    key = np.concatenate([(own ^ salt).ravel(), (probed ^ salt).ravel()])
                    row = np.concatenate([np.repeat(ids, own.shape[1]), np.repeat(ids, probed.shape[1])])
                    home = np.append(np.ones(own.size, bool), np.zeros(probed.size, bool))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.array(home)], names=["key", "id", "home"])

    return vectors.select("id", "label", "dim", "v").repartition(parts).mapInArrow(run, "key long, id long, home boolean")


def _compare(members: DataFrame, least: float, parts: int, keys: str) -> DataFrame:
    """Links within each key: (id, root, n) for each row of each block with a link; n counts copies."""

    def run(batches):
        for t, starts, ends in sorted_groups(batches, ["key", "i", "j"]):
            ids, own, copies = (t.column(c).to_numpy() for c in ("id", "own", "copies"))
            alone = t.column("i").to_numpy() == t.column("j").to_numpy()
            out = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                u = unit_rows(matrix(t.column("v").slice(s, e - s)))
                hit = u @ u.T >= least
                np.fill_diagonal(hit, False)
                if not alone[s]:
                    hit &= own[s:e, None] != own[None, s:e]
                some = np.flatnonzero(hit.any(axis=1))
                if len(some):
                    hit = hit[np.ix_(some, some)]
                    here = ids[s:e][some]
                    out.append((here, here[_forest(hit)], hit @ copies[s:e][some]))
            if out:
                a, b, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], names=["id", "root", "n"])

    x = blocks(members, keys, CHUNK).withColumnRenamed(keys, "key").select("key", "i", "j", "own", "id", "copies", "v")
    dealt = x.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "id long, root long, n long")


def near_duplicates(spark: SparkSession, vectors: DataFrame, least: float = 0.98, seed: int = 0) -> DataFrame:
    """One row for each vector of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label are linked where their cosine, in double precision, is at least ``least``.
    Vectors that are null, empty or zero, or hold null or non-finite components, and those with a null
    label or vec_id, have no links; a null vec_id has a null component and is kept. Vectors of different
    lengths are not compared. Equal rows are one vector; equal vectors count as links of each other. Rows
    that share a vec_id are one vector with several values: it has the links of each, and connects what
    they are linked with. Vectors are of any length. Empty tables give empty results; further columns are ignored.
    """
    scratch = Scratch(spark, "lattice")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    rows = rows.where(valid("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # Equal vectors of a label are a class; its number is its own, whatever vec_ids it has, and fixed by the table.
    classes = rows.groupBy("label", "v").agg(F.min("vec_id").alias("least")).withColumn("id", F.monotonically_increasing_id())
    classes = scratch.keep(classes, "classes")
    member = scratch.keep(rows.join(classes, ["label", "v"]).select("vec_id", "id").distinct(), "members")
    sizes = member.groupBy("id").agg(F.count("*").alias("copies"))
    reps = scratch.keep(classes.join(sizes, "id").select("id", "least", "label", F.size("v").alias("dim"), "copies", "v"), "reps")

    spots = scratch.keep(_cells_of(reps, seed, parts), "cells")
    full = spots.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("home").alias("home")).where("lo <> hi and home")
    full = scratch.keep(full.select("key"), "full")
    met = scratch.keep(spots.join(full, "key").select("key", "id").distinct(), "met")
    scratch.drop(spots)
    light = reps.select("id", "copies", "v")
    links = _compare(met.join(light, "id"), least, parts, "key")
    # Classes that share a vec_id are reached through it.
    shared = member.groupBy("vec_id").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    shared = member.join(shared, "vec_id").where("id <> b").select(F.col("id").alias("a"), "b")
    found = connected_components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).union(shared), scratch)
    found = scratch.keep(found, "components")
    counts = _compare(found.join(light, "id"), least, parts, "component_id").groupBy("id").agg(F.sum("n").alias("n"))
    by = reps.select("id", "least", "copies").join(found, "id", "left").join(counts, "id", "left")
    by = scratch.keep(by.select("id", "least", F.coalesce("component_id", "id").alias("group"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "by-class")
    by = by.join(by.groupBy("group").agg(F.min("least").alias("component_id")), "group")
    linked = member.join(by.select("id", "n_links", "component_id"), "id").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    ids = ids.where("vec_id is not null").distinct().union(ids.where("vec_id is null"))
    out = ids.join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
