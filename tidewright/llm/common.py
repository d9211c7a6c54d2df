"""Shared pieces: scratch tables, vectorised word hashing, sorted-group streaming."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that one vectorised pass handles at once; a longer text is a pass of its own.
SLAB_BYTES = 1 << 18
#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written below ``spark.checkpoint.dir`` to cut lineage; they survive lost executors.

    Where the session names no folder, a local one (tests) uses one below the temp folder; on a cluster that
    folder would go with its machine, so there it is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no shared folder")
            root = f"{tempfile.gettempdir()}/checkpoints"
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df`` and return it as read back; ``by`` is a column of few values to read one of at a time.

        Nothing reads the shuffles of the write again, so Spark deletes their files when it ends.
        """
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def one(self, df: DataFrame, by: str, value: int) -> DataFrame:
        """The rows of one value of the column ``by`` that ``df`` was kept by, a table that can be dropped alone."""
        path = f"{df._scratch_path}/{by}={value}"
        out = self.spark.read.schema(df.drop(by).schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no plan reads any more."""
        if path := getattr(df, "_scratch_path", None):
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


_BASE = 0x5851F42D4C957F2D
_TABLE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between calls up to one slab."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, SLAB_BYTES + 16)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(m, base, dtype=U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if m > 4 * SLAB_BYTES:
            return out[0], out[1]
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def text_slabs(column: pa.Array | pa.ChunkedArray):
    """Cut a text column into slabs: (first row, bytes, offsets of rows). Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(column.buffers()[1], kind, count=n + 1 + column.offset)[column.offset:].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(off, off[row] + SLAB_BYTES, side="right")) - 1
        last = min(max(last, row + 1), n)
        yield row, data[off[row]:off[last]], off[row:last + 1] - off[row]
        row = last


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return b + (((b >= 65) & (b <= 90)).view(np.uint8) << 5)


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``inside`` bytes, cut at rows: first byte, end byte, and the row of each."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[:-1][off[:-1] < n]
    first[cut] = inside[cut]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def white(b: np.ndarray) -> np.ndarray:
    """ASCII white space: 0x20 and 0x09 to 0x0D."""
    return (b == 32) | ((b >= 9) & (b <= 13))


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Cumulative polynomial sums, with a leading 0; see ``range_hash``."""
    out = np.zeros(len(b) + 1, U64)
    np.cumsum(_TABLE[b] * powers(len(b) + 1)[0][:len(b)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of each byte range [s, e): equal content gives equal hashes wherever it stands."""
    return mix64((sums[e] - sums[s]) * powers(len(sums))[1][s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15))


def sorted_groups(batches, keys: list[str]):
    """Join a sorted partition's Arrow batches into tables that hold whole groups of ``keys``.

    Yields (table, starts, ends). A group stays in memory until it ends, so callers bound the groups.
    """
    rest: list[pa.RecordBatch] = []
    held, size, last = 0, 0, None

    def table_of(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        n = t.num_rows
        change = np.zeros(n, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        change[0] = True
        return t, np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        # Rows of the group that is being held come to it as they are; it is joined once it has ended.
        ended = last is not None and any(batch.column(k)[batch.num_rows - 1] != last[k] for k in keys)
        rest.append(batch)
        held, size = held + batch.num_rows, size + batch.nbytes
        last = {k: batch.column(k)[batch.num_rows - 1] for k in keys}
        if held < 20_000 and size < 1 << 24 or len(rest) > 1 and not ended:
            continue
        t, starts = table_of(rest)
        cut = int(starts[-1])
        if cut == 0:
            continue
        head = t.slice(0, cut)
        yield head, starts[:-1], np.append(starts[1:-1], cut)
        rest = t.slice(cut).to_batches()
        held, size = t.num_rows - cut, 0
    if rest:
        t, starts = table_of(rest)
        yield t, starts, np.append(starts[1:], t.num_rows)


def group_pairs(starts: np.ndarray, ends: np.ndarray, slab: int = 1 << 20):
    """Index pairs i < j inside every group, in slabs of about ``slab`` pairs."""
    sizes = ends - starts
    for g in np.unique(sizes):
        if g < 2:
            continue
        first = starts[sizes == g]
        if g <= 512:
            a, b = np.triu_indices(int(g), 1)
            step = max(1, slab // len(a))
            for k in range(0, len(first), step):
                at = first[k:k + step, None]
                yield (at + a[None, :]).ravel(), (at + b[None, :]).ravel()
        else:
            rows = max(1, slab // int(g))
            for at in first:
                for r in range(0, int(g), rows):
                    i = np.arange(r, min(int(g), r + rows))
                    a, b = np.nonzero(i[:, None] < np.arange(int(g))[None, :])
                    yield at + i[a], at + b
