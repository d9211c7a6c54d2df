"""From candidate buckets to links, without all pairs of a bucket.

Members of a bucket first meet its leader, one of them by an order of the bucket's own, so leaders differ
between buckets. The pairs with the closest sketches go to the exact test. Buckets whose members are
connected by then hold nothing new. In the others what is outside the largest component meets all the
rest, in blocks of bounded size that carry all that the exact test needs: pairs of different components
whose sketches are close are tested there, the closest first, until they are connected. Only links leave
a block. So the components are those of all links, and a large group of copies costs about one test for
each copy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import U64, Scratch, group_pairs, sorted_groups
from tidewright.llm.components import connected_components

#: Rows and bytes of a chunk; a block compares two chunks of a bucket.
CHUNK, CHUNK_BYTES = 2048, 8 << 20


def bucket_leaders(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of keys with at least two ids, and the leader of each: (key, id, leader).

    ``keys`` has longs key and id; repeated rows count once. The leader has the least id XOR key. No task
    holds a key's rows: each partition sums up its part of a key, and leaders join the members by a shuffle
    whose hot partitions Spark can split.
    """
    keys = scratch.keep(keys.select("key", "id"), "keys")
    turn = F.col("id").bitwiseXOR(F.col("key"))
    leads = keys.groupBy("key").agg(F.min(turn).alias("lo"), F.max(turn).alias("hi")).where("lo <> hi")
    leads = scratch.keep(leads.select("key", F.col("lo").bitwiseXOR(F.col("key")).alias("leader")), "leaders")
    out = scratch.keep(keys.join(leads, "key").select("key", "id", "leader").distinct(), "members")
    scratch.drop(keys)
    scratch.drop(leads)
    return out


def differing(a: str, b: str, width: int) -> Column:
    """Bits in which two sketches (arrays of ``width`` longs) differ."""
    total = F.lit(0)
    for k in range(width):
        total = total + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return total


def blocks(members: DataFrame) -> DataFrame:
    """Cut each key's rows into chunks and give each pair of chunks that has anything to compare a block.

    ``members`` has key, id, component_id and size (bytes). Adds ``i`` and ``j`` (the block, i <= j) and
    ``own`` (the row's chunk). Chunks of a key's largest component come last and don't meet each other;
    every other pair of a key's rows meets in just one block.
    """
    parts = members.groupBy("key", "component_id").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    most = F.max(F.struct("n", "component_id", "b"))
    sums = parts.groupBy("key").agg(most.alias("m"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    chunks = lambda n, b: F.greatest(F.ceil(n / F.lit(CHUNK)), F.ceil(b / F.lit(CHUNK_BYTES))).cast("int")
    sums = sums.select("key", F.col("m.component_id").alias("largest"), chunks(F.col("n") - F.col("m.n"), F.col("b") - F.col("m.b")).alias("q"), chunks(F.col("m.n"), F.col("m.b")).alias("p"))
    x = members.join(sums, "key").withColumn("last", F.col("component_id") == F.col("largest"))
    turn = F.xxhash64("id", F.lit(7))
    own = F.when(F.col("last"), F.col("q") + F.pmod(turn, F.col("p"))).otherwise(F.pmod(turn, F.col("q"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("last"), F.col("q")).otherwise(F.col("q") + F.col("p")) - 1)
    x = x.where("q > 0").withColumn("own", own).select("*", F.explode(others).alias("o"))
    return x.withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o")}).drop("o", "p", "q", "largest", "last", "size")


def _unseen(held: list[np.ndarray], key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the least that rows x and y share; ``held`` has their keys, ascending, column by column."""
    seen = np.zeros(len(x), bool)
    for k in held:
        m = np.flatnonzero((k[x] < key[x]) & ~seen)
        for other in held if len(m) else ():
            seen[m] |= other[y[m]] == k[x[m]]
    return ~seen


def _root(up: dict[int, int], c: int) -> int:
    while (p := up.get(c, c)) != c:
        up[c] = up.get(p, p)
        c = p
    return c


def _close_pairs(t: pa.Table, starts: np.ndarray, ends: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x, y of the blocks' pairs of different components whose sketches differ in at most ``most`` bits, and the bits.

    A pair comes at the least key that both share.
    """
    comp, key = (t.column(c).to_numpy() for c in ("component_id", "key"))
    own, alone = t.column("own").to_numpy(), t.column("i").to_numpy() == t.column("j").to_numpy()
    s = t.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, width).view(U64)
    lists = t.column("held").combine_chunks()
    at, flat = np.asarray(lists.offsets), lists.values.to_numpy()
    n = np.diff(at)
    # Past its keys a row repeats its own key here, which is not below itself.
    held = [np.where(k < n, flat[np.minimum(at[:-1] + k, len(flat) - 1)], key) for k in range(int(n.max()))]
    found = []
    for x, y in group_pairs(starts, ends, max(1 << 12, (1 << 20) // width)):
        m = (comp[x] != comp[y]) & (alone[x] | (own[x] != own[y]))
        x, y = x[m], y[m]
        d = np.zeros(len(x), np.int32)
        for k in range(width):
            d += np.bitwise_count(s[x, k] ^ s[y, k])
        m = d <= most
        x, y, d = x[m], y[m], d[m]
        m = _unseen(held, key, x, y)
        found.append((x[m], y[m], d[m]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def links_across(members: DataFrame, table: DataFrame, width: int, most: int, test: Callable[[bytes, bytes], bool], scratch: Scratch, parts: int) -> DataFrame:
    """Links (a, b) between a key's ids of different components that connect what all such links connect.

    ``members`` has key, id and component_id, ``table`` id, held (the id's keys, ascending), sketch and
    payload. Pairs whose sketches differ in at most ``most`` bits pass ``test`` (payload, payload) or not.
    Rows first meet with their sketches; only those that have such a pair meet again with their payloads.
    """
    block = ["key", "i", "j"]

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        x = rows.join(table.select("id", "held", "sketch", *more).hint("merge"), "id").repartition(parts, *block).sortWithinPartitions(*block)
        return x.select(*block, "own", "id", "component_id", "held", "sketch", *more)

    def paired(batches):
        names = [*block, "own", "id", "component_id"]
        for t, starts, ends in sorted_groups(batches, block):
            x, y, _ = _close_pairs(t, starts, ends, width, most)
            if len(x):
                yield from t.select(names).take(pa.array(np.unique(np.append(x, y)))).to_batches()

    def tested(batches):
        for t, starts, ends in sorted_groups(batches, block):
            x, y, d = _close_pairs(t, starts, ends, width, most)
            ids, comp, payload, out, up = t.column("id").to_numpy(), t.column("component_id").to_numpy(), t.column("payload"), [], {}
            for k in np.argsort(d, kind="stable").tolist():
                a, b = int(x[k]), int(y[k])
                one, two = _root(up, int(comp[a])), _root(up, int(comp[b]))
                if one != two and test(payload[a].as_py(), payload[b].as_py()):
                    up[max(one, two)] = min(one, two)
                    out.append((max(ids[a], ids[b]), min(ids[a], ids[b])))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sizes = table.select("id", (F.octet_length("payload") + 8 * width).alias("size"))
    rows = dealt(blocks(members.join(sizes, "id"))).mapInArrow(paired, "key long, i int, j int, own int, id long, component_id long")
    return dealt(scratch.keep(rows, "paired"), "payload").mapInArrow(tested, "a long, b long")


#: Sketches by id: (table of id and sketch, longs in a sketch, bits that linked ones may differ in).
Sketches = tuple[DataFrame, int, int]


def links(
    keys: DataFrame, sketches: Sketches, verify: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], Sketches],
    test: Callable[[bytes, bytes], bool], scratch: Scratch, parts: int, leaders: int = 3,
) -> DataFrame:
    """Confirmed links (a, b) that connect what all confirmed links connect.

    ``keys`` is the kept result of ``bucket_leaders``; ``verify`` keeps those pairs (a, b) of a table that
    pass the exact test. Each id first meets the leaders that it shares most buckets with. The ids (table
    of id) of buckets that are not connected by then get what ``refine`` makes for them, with a column
    payload for ``test``, and meet in blocks.
    """
    table, width, most = sketches
    shared = keys.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), F.xxhash64("leader")))
    stars = shared.withColumn("r", rank).where(F.col("r") <= leaders).select(F.col("id").alias("a"), F.col("leader").alias("b"))
    stars = stars.join(table.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
    stars = stars.join(table.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    tried = scratch.keep(stars.where(differing("sa", "sb", width) <= most).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "tried")
    sure = scratch.keep(verify(tried), "links")
    found = connected_components(sure, scratch)
    labelled = keys.select("key", "id").join(found, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    labelled = scratch.keep(labelled, "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi")
    left = scratch.keep(labelled.join(open_keys.select("key"), "key"), "left")
    scratch.drop(labelled)
    table, width, most = refine(left.select("id").distinct())
    held = left.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("held"))
    table = scratch.keep(held.join(table, "id"), "held")
    return scratch.keep(sure.union(links_across(left, table, width, most, test, scratch, parts)), "links")
