"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives a vector a long string of bits, the signs of random projections; equal prefixes are
likelier the smaller the angle (Bawa, Condie and Ganesan, "LSH Forest"). Largest inner products become
smallest angles by one more dimension that brings all candidates to one length (Neyshabur and Srebro).
A tree is its sorted strings, cut at a prefix into blocks that tasks hold one at a time.

A query first descends: in each tree's order its neighbours tell the longest prefix that it shares with
k other rows. From the longest it ascends in all trees together, first to the level where half of them
hold so many. At a level it sees all that share its prefix in any tree, and its k-th score tells how
likely a nearer vector was missed in every tree; as long as that is above MISS, it goes on to the level
where it is not. Nothing caps the candidates on the way, and at the root a query sees all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, sorted_groups
from tidewright.llm.lattice import matrix, valid

#: Trees, bits of a string, probability of missing a vector as near as the last one kept, rows of a block.
TREES, BITS, MISS, BLOCK = 24, 40, 0.05, 1024


def strings(unit: np.ndarray, seed: int) -> np.ndarray:
    """Bit strings (n, TREES) of augmented rows, first bit highest."""
    n, dim = unit.shape
    planes = np.random.default_rng([seed, dim]).standard_normal((dim, TREES * BITS))
    out = np.zeros((n, TREES), np.int64)
    bits = (unit @ planes > 0).reshape(n, TREES, BITS)
    for k in range(BITS):
        out = out << 1 | bits[:, :, k]
    return out


def ascend(score: np.ndarray, length: np.ndarray, longest: float, found: np.ndarray, level: np.ndarray, k: int) -> np.ndarray:
    """The level that each query needs, by its k-th score so far; it is done where its level is no higher."""
    cos = np.clip(np.nan_to_num(score) / (length * longest), -1, 1 - 1e-12)
    share = 1 - np.arccos(cos) / np.pi
    with np.errstate(divide="ignore"):
        need = np.floor(np.log1p(-MISS ** (1 / TREES)) / np.log(share))
    need = np.clip(np.nan_to_num(need), 0, BITS).astype(np.int64)
    # With too few found there is no k-th score: up a third of the way.
    return np.where(found < k, level * 2 // 3, need)


def shared_lengths(code: np.ndarray, asks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest prefix that each of ``asks`` shares with ``n`` of the sorted ``code``, or 0.

    Also whether rows before the first or after the last of ``code`` could share more.
    """
    at = np.searchsorted(code, asks)
    edge = (at < n) | (at > len(code) - n)
    level = np.zeros(len(asks), np.int32)
    for first in range(0, len(asks) if len(code) else 0, 8192):
        near = at[first:first + 8192, None] + np.arange(-n, n)
        differ = code[np.clip(near, 0, len(code) - 1)] ^ asks[first:first + 8192, None]
        # The exponent of an integer below 2**53 is the number of its bits.
        shared = np.where((near >= 0) & (near < len(code)), BITS - np.frexp(differ.astype(np.float64))[1], 0)
        level[first:first + 8192] = np.partition(shared, n, axis=1)[:, n]
    return level, edge


def _codes(rows: DataFrame, longest: dict[int, float] | None, seed: int, shift: int | None = None) -> DataFrame:
    """Strings of rows, those of candidates if ``longest`` has the length that each dimension is brought to.

    With ``shift``, also the key of each string's block and the vectors.
    """

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for first in range(0, part.num_rows, 512):
                    p = part.slice(first, 512)
                    x = matrix(p.column("v"))
                    if longest is None:
                        x = np.column_stack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros(len(x))])
                    else:
                        x = x / longest[dim]
                        x = np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))])
                    code = strings(x, seed).ravel()
                    at = pa.array(np.repeat(np.arange(len(x)), TREES))
                    out = {"dim": p.column("dim").take(at), "tree": pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(x))), "code": pa.array(code), "id": p.column("id").take(at)}
                    if shift is not None:
                        out |= {"key": pa.array(code >> shift), "v": p.column("v").take(at)}
                    yield pa.RecordBatch.from_pydict(out)

    schema = "dim int, tree int, code long, id long" + (f", key long, v {_kind(rows)}" if shift is not None else "")
    return rows.select("id", "dim", "v").mapInArrow(run, schema)


def _kind(rows: DataFrame) -> str:
    return rows.schema["v"].dataType.simpleString()


def _descend(reps: DataFrame, queries: DataFrame, longest: dict[int, float], least: int, seed: int, parts: int, scratch: Scratch) -> DataFrame:
    """The first level of each query: (id, level), where half of its trees hold ``least`` rows.

    Strings and ids alone are sorted, in ranges that cut a tree anywhere, equal strings too. A query whose
    neighbours reach over an end of its range meets the ends of all ranges of the tree: 4 * ``least`` rows each.
    """
    of_tree = ["dim", "tree"]
    codes = _codes(reps, longest, seed).withColumn("kind", F.lit(0)).union(_codes(queries, None, seed).withColumn("kind", F.lit(1)))
    order = [*of_tree, "code", "kind", "id"]

    def look(last):
        def run(batches):
            for t, starts, ends in sorted_groups(batches, of_tree):
                code, kind = t.column("code").to_numpy(), t.column("kind").to_numpy()
                level, keep = np.zeros(len(code), np.int32), np.zeros(len(code), bool)
                mark = kind.copy()
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    there, asks = s + np.flatnonzero(kind[s:e] == 0), s + np.flatnonzero(kind[s:e] == 1)
                    if not len(asks) and last:
                        continue
                    level[asks], edge = shared_lengths(code[there], code[asks], least)
                    mark[asks] = np.where(edge & (not last), 1, 2)
                    keep[asks] = True
                    if not last:
                        keep[there[:2 * least]] = keep[there[-2 * least:]] = True
                rows = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_pydict({
                    **{c: t.column(c).take(rows).combine_chunks() for c in ("dim", "tree", "code", "id")}, "kind": pa.array(mark[keep]), "level": pa.array(level[keep])})
        return run

    schema = "dim int, tree int, code long, id long, kind int, level int"
    ranged = codes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = scratch.keep(ranged.mapInArrow(look(False), schema), "descents")
    ends = found.where("kind < 2").drop("level").repartition(parts, *of_tree).sortWithinPartitions(*order)
    levels = found.where("kind = 2").select("id", "level").union(ends.mapInArrow(look(True), schema).select("id", "level"))
    return levels.groupBy("id").agg(F.sort_array(F.collect_list("level"), asc=False)[TREES // 2 - 1].alias("level"))


def _askers(active: DataFrame, depth: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                part = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                for first in range(0, part.num_rows, 64):
                    p = part.slice(first, 64)
                    x = matrix(p.column("v"))
                    x = np.column_stack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros(len(x))])
                    code, level = strings(x, seed), p.column("level").to_numpy()
                    wide = np.maximum(depth - level, 0)
                    low = (code >> (BITS - depth)) >> wide[:, None] << wide[:, None]
                    n = np.repeat(1 << wide, TREES)
                    at = np.repeat(np.arange(len(x) * TREES), n)
                    key = low.ravel()[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    row, tree = pa.array(at // TREES), pa.array(at % TREES, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [p.column("dim").take(row), tree, pa.array(key), p.column("id").take(row), pa.array(code.ravel()[at]), p.column("v").take(row), p.column("level").take(row), p.column("floor").take(row)],
                        names=["dim", "tree", "key", "id", "code", "v", "level", "floor"])

    schema = f"dim int, tree int, key long, id long, code long, v {_kind(active)}, level int, floor double"
    return active.select("id", "dim", "v", "level", "floor").mapInArrow(run, schema)


def _search(reps: DataFrame, active: DataFrame, longest: dict[int, float], depth: int, keep: int, seed: int, parts: int, scratch: Scratch) -> DataFrame:
    """The best ``keep`` candidates of each query at its level: (query_id, id, score), and how many it saw there."""
    by = ["dim", "tree", "key"]
    cand, ask = _codes(reps, longest, seed, BITS - depth), scratch.keep(_askers(active, depth, seed), "askers")
    asked = ask.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nq"))
    there = cand.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(2 * BLOCK)).cast("int").alias("nc"))
    sizes = scratch.keep(asked.join(there, by), "sizes")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = [*by, "cs", "qs", "kind", "code", "id", "v", "level", "floor"]
    c = cand.join(sizes, by).select("*", own("nc").alias("cs"), every("nq").alias("qs"))
    c = c.withColumns({"kind": F.lit(0), "level": F.lit(0), "floor": F.lit(0.0)}).select(*cols)
    q = ask.join(sizes, by).select("*", every("nc").alias("cs"), own("nq").alias("qs")).withColumn("kind", F.lit(1)).select(*cols)

    def run(batches):
        for t, starts, ends in sorted_groups(batches, [*by, "cs", "qs"]):
            kind, code, ids = (t.column(x).to_numpy() for x in ("kind", "code", "id"))
            level, floor = t.column("level").to_numpy(), t.column("floor").to_numpy()
            out = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                mid = s + int(np.searchsorted(kind[s:e], 1))
                if mid in (s, e):
                    continue
                x = matrix(t.column("v").slice(s, e - s))
                x, y = x[:mid - s], x[mid - s:]
                prefix = code[mid:e] >> (BITS - level[mid:e])
                group, at = np.unique(np.stack([level[mid:e], prefix]), axis=1, return_inverse=True)
                for g in range(group.shape[1]):
                    n, p = int(group[0, g]), int(group[1, g])
                    lo = int(np.searchsorted(code[s:mid], p << (BITS - n)))
                    hi = int(np.searchsorted(code[s:mid], (p + 1) << (BITS - n)))
                    if lo == hi:
                        continue
                    rows = np.flatnonzero(at.ravel() == g)
                    for first in range(0, len(rows), 256):
                        r = rows[first:first + 256]
                        scores = y[r] @ x[lo:hi].T
                        # A hair below the floor: the products here are summed in another order.
                        scores[scores < floor[mid:e][r, None] - 1e-9 * np.abs(floor[mid:e][r, None])] = -np.inf
                        if hi - lo > keep:
                            best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                            least = np.take_along_axis(scores, best, axis=1).min(axis=1)
                            a, b = np.nonzero((scores >= least[:, None] - 1e-12) & (scores > -np.inf))
                        else:
                            a, b = np.nonzero(scores > -np.inf)
                        zero = np.zeros(len(a), np.int64)
                        out.append((ids[mid:e][r[a]], ids[s:mid][lo + b], np.einsum("ij,ij->i", y[r[a]], x[lo + b]), zero))
                        out.append((ids[mid:e][r], ids[mid:e][r], np.full(len(r), -np.inf), np.full(len(r), hi - lo)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out, strict=True)], names=["query_id", "id", "score", "seen"])

    order = [*by, "cs", "qs"]
    dealt = c.union(q).repartition(parts, *order).sortWithinPartitions(*order, "kind", "code", "id")
    found = dealt.mapInArrow(run, "query_id long, id long, score double, seen long").groupBy("query_id", "id").agg(F.max("score").alias("score"), F.sum("seen").alias("seen"))
    query = Window.partitionBy("query_id")
    rank = F.row_number().over(query.orderBy(F.desc("score"), "id"))
    return found.select("query_id", "id", "score", F.sum("seen").over(query).alias("seen"), rank.alias("r")).where((F.col("r") <= keep) & (F.col("score") > float("-inf"))).drop("r")


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, seed: int = 0) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner products, for each row of ``queries``, itself apart.

    Both have vec_id and embedding. Returns query_id, rank (from 1), vec_id, score: nearest first, ties to
    the smaller vec_id, the score in double precision from the vectors as they are; all rows, if fewer
    than k; and seen, the rows that the query was compared with at its last level, once for each tree
    where it met them. Vectors that are null, empty or zero or hold null or non-finite components, and null ids, take
    no part; only vectors of a query's length are its candidates; equal rows are one. Equal vectors are
    searched once, and the smallest ids of each stand for them. Empty tables give empty results.
    """
    scratch = Scratch(spark, "prefix-forest")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {df.schema["embedding"].dataType.simpleString() for df in (vectors, queries)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"  # half the bytes to move, and the same numbers

    def rows(df):
        x = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
        return x.where(valid("v") & F.col("vec_id").isNotNull())

    some = rows(vectors).groupBy("v").agg(F.min("vec_id").alias("id"))
    some = scratch.keep(some.withColumn("dim", F.size("v")), "classes")
    first = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    member = rows(vectors).join(some, "v").select("id", "vec_id").distinct().withColumn("n", first).where(F.col("n") <= k + 1).drop("n")
    member = scratch.keep(member, "members")
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    seen = some.groupBy("dim").agg(F.max(norm).alias("top"), F.count("*").alias("n")).collect()  # one row for each length
    longest = {r["dim"]: float(r["top"]) * (1 + 1e-9) for r in seen}
    count = max((r["n"] for r in seen), default=0)
    # Where sorted strings are cut into blocks for tasks; what a query sees does not depend on it.
    depth = int(np.clip(round(np.log2(max(count, 1) / BLOCK)), 0, BITS))
    asked = rows(queries).select(F.col("vec_id").alias("id"), "v", F.size("v").alias("dim"), norm.alias("length")).dropDuplicates(["id"])
    active = scratch.keep(asked, "asked")
    if longest:
        first = _descend(some, active, longest, k + 1, seed, parts, scratch)
        first = active.join(first.hint("merge"), "id", "left").withColumns({"level": F.coalesce("level", F.lit(0)).cast("int"), "floor": F.lit(float("-inf"))})
        active = scratch.keep(first, "queries")
    done = None
    tops = F.create_map(*[F.lit(x) for kv in longest.items() for x in kv]) if longest else None
    while longest and not active.isEmpty():
        best = scratch.keep(_search(some, active, longest, depth, k + 1, seed, parts, scratch), "found")
        # The asker's own class may be among the k + 1; the k-th of the others is at least the last.
        last = best.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("found"))
        state = active.join(last.withColumnRenamed("query_id", "id"), "id", "left").withColumn("longest", tops[F.col("dim")])

        def step(batches):
            for batch in batches:
                last, length, top, level = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("last", "length", "longest", "level"))
                found = np.nan_to_num(batch.column("found").to_numpy(zero_copy_only=False))
                need = ascend(last, length, top, found, level, k + 1)
                need = np.where(level == 0, BITS, need)  # all has been seen
                low = np.where(found >= k + 1, last, -np.inf)
                keep = [batch.column(c) for c in ("id", "v", "dim", "length", "level")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(need.astype(np.int32)), pa.array(low)], names=["id", "v", "dim", "length", "level", "need", "floor"])

        state = state.select("id", "v", "dim", "length", "level", "last", "found", "longest").mapInArrow(
            step, f"id long, v {kind}, dim int, length double, level int, need int, floor double")
        state = scratch.keep(state, "state")
        ready = best.join(state.where("need >= level").select(F.col("id").alias("query_id")), "query_id", "left_semi")
        done = ready if done is None else done.union(ready)
        active = scratch.keep(state.where("need < level").select("id", "v", "dim", "length", F.col("need").alias("level"), "floor"), "queries")
    if done is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, seen long")
    x = done.join(member, "id").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    x = x.select("query_id", rank.alias("rank"), "vec_id", "score", "seen")
    return x.where(F.col("rank") <= k)
