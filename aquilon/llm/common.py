"""Helpers shared by the training-data operators: shared scratch tables, block iteration over
Arrow batches, vectorised polynomial hashes, and packed exchanges.

A *packed exchange* ships NumPy arrays as one binary row for each (map block, target part) instead
of one JVM row for each value; Spark still deals, spills and retries these rows.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
NULL_ID = -(2**63)  # stands for a null id inside packed arrays
_MULT = 0x9E3779B97F4A7C15
_MULT_INV = pow(_MULT, -1, 1 << 64)


# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in a session of one process without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="aquilon-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written as Parquet in the shared scratch folder and read again: lineage ends there, and
    a lost executor costs no recomputation. The files go when the interpreter ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/aquilon-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what saved() wrote for df; nothing lazy may need it any more."""
    _remove(df.sparkSession, df._scratch)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_parts(df: DataFrame, mb: int = 16) -> int:
    """Parts of about `mb` MB of what the plan reads, at least spark.sql.shuffle.partitions. Inputs of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(size / (mb << 20)))


def bucket_col(col, parts: int):
    """A part of an id: the same arithmetic as bucket_np."""
    c = F.coalesce(col.cast("long"), F.lit(NULL_ID))
    return F.pmod(c.bitwiseXOR(F.shiftright(c, 9)).bitwiseXOR(F.shiftright(c, 21)), F.lit(parts)).cast("int")


def bucket_np(ids: np.ndarray, parts: int) -> np.ndarray:
    return np.mod(ids ^ (ids >> 9) ^ (ids >> 21), parts).astype(np.int32)


# ---------------------------------------------------------------- Arrow blocks


def id_array(col) -> np.ndarray:
    """An integer id column as int64, null as NULL_ID."""
    return np.asarray(pc.fill_null(col.cast(pa.int64()), NULL_ID))


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column in a row, and n+1 offsets; null counts as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def row_blocks(offs: np.ndarray, limit: int):
    """Ranges of rows with about `limit` bytes each; a longer text is a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(batches, limit: int = 1 << 20, column: str = "text"):
    """The rows of the batches in slices with about `limit` bytes of text each, so that what Python makes of them stays small; a longer text is a
    slice of its own."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch[column]).cast(pa.int64()), 0))
        for i, j in row_blocks(np.append(0, np.cumsum(size)), limit):
            yield batch.slice(i, j - i)


def trim() -> None:
    """Gives memory that Python no longer uses back to the machine: workers live on, and other operators follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(rows):
    """The same rows; memory is given back at their end."""
    yield from rows
    trim()


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


_POW: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    p = _POW.get(base)
    if p is None or p.size < n:
        p = np.full(max(n, 1 << 16), base, U)
        p[0] = 1
        _POW[base] = p = np.multiply.accumulate(p)
    return p[:n]


class Rolling:
    """Polynomial hashes, modulo 2^64, of any byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        n = buf.size
        self.p = np.zeros(n + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * powers(n, _MULT), out=self.p[1:])
        self.inv = powers(n + 1, _MULT_INV)

    def windows(self, k: int) -> np.ndarray:
        """Mixed hash of every k bytes, by start."""
        if self.p.size <= k:
            return np.zeros(0, U)
        return mix((self.p[k:] - self.p[:-k]) * self.inv[: self.p.size - k])

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.p[hi] - self.p[lo]) * self.inv[lo] + (hi - lo).astype(U) * U(0xA24BAED4963EE407))


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by start."""
    n, step, out = x.size - w + 1, 1, x
    if n <= 0:
        return x[:0]
    while step * 2 <= w:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[:n], out[w - step : w - step + n])


# ---------------------------------------------------------------- packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes; unpack() needs their types in the same order."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for t in types)
    n, at, out = len(blob) // width, 0, []
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(blob, t, n, at))
        at += size
    return out


def unpack_all(blobs, *types) -> list[np.ndarray]:
    cols = [unpack(b, *types) for b in blobs]
    return [np.concatenate(c) if cols else np.zeros(0, t) for c, t in zip(zip(*cols) if cols else [()] * len(types), types)]


def deal(part: np.ndarray, *arrays: np.ndarray):
    """(part, packed arrays of its rows) for each part that occurs, row order kept."""
    if not part.size:
        return
    order = np.argsort(part, kind="stable")
    p = part[order]
    cuts = np.flatnonzero(np.diff(p)) + 1
    for rows in np.split(order, cuts):
        yield int(part[rows[0]]), pack(*(a[rows] for a in arrays))


# ---------------------------------------------------------------- components


def components(spark: SparkSession, edges: DataFrame, cut: bool = False) -> DataFrame:
    """(id, component): the smallest id that links reach, for every id in edges (a, b).

    Alternating large-star and small-star rounds over DataFrames: every round is a min per
    node (combined before the shuffle) and an equi-join; no neighbour list is ever collected.
    Edges (a < b) are first cut to a spanning forest inside each partition; `cut` says that whoever made them did so in the
    same Python task, which spares a second worker beside it.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = saved(e if cut else e.mapInArrow(forest, "a long, b long"))
    before = None
    while True:
        low = e.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))  # only these have a smaller neighbour
        l = e.join(low, e.a == low.u, "left").select(F.coalesce("m", "a").alias("a"), "b").distinct()
        low = l.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = l.join(low, l.b == low.u).select(F.col("m").alias("x"), F.col("a").alias("y"))
        nxt = small.select("x", "y").where("x < y").union(low.select(F.col("m"), F.col("u"))).distinct()
        nxt = saved(nxt.select(F.col("x").alias("a"), F.col("y").alias("b")))
        now = nxt.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        discard(e)
        e = nxt
        if now == before:
            break
        before = now
    roots = e.select(F.col("a").alias("id"), F.col("a").alias("component"))
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots).distinct()


def forest(batches):
    """Edges of a spanning forest of this partition's edges, flushed at a million nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = p
        return x

    def out():
        rows = [(find(x), x) for x in parent]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:
            yield out()
    yield out()


# ---------------------------------------------------------------- earlier occurrences

#: A row of a packed exchange: kind 0 goes to the part of its keys, kind 1 answers a bucket of documents.
EXCHANGE = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
EXCHANGE_DDL = "part int, kind int, blob binary"
REPLY_DDL = "bucket int, blob binary"
KEYED = (np.uint64, np.int64, np.uint32, np.uint32)  # key, doc, hash of the text, position
PLACED = KEYED[1:]


def exchange_rows(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, EXCHANGE)], schema=EXCHANGE)


def reply_table(rows) -> pa.Table:
    cols = list(zip(*rows)) or [(), ()]
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "blob": pa.array(cols[1], pa.binary())})


def later(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows have a row with the same key at a smaller (doc, pos)."""
    order = np.lexsort((pos, doc, key))
    k, d, p = key[order], doc[order], pos[order]
    new = np.ones(k.size, bool)
    new[1:] = k[1:] != k[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(k.size), 0))
    out = np.zeros(k.size, bool)
    out[order] = (d > d[first]) | ((d == d[first]) & (p > p[first]))
    return out


def deal_keyed(parts: int, key, doc, tk, pos):
    """Exchange rows for keyed places: those with an earlier one in this block are answered at once, so a
    frequent key leaves a block once."""
    dup = later(key, doc, pos)
    for b, blob in deal(bucket_np(doc[dup], parts), doc[dup], tk[dup], pos[dup]):
        yield b, 1, blob
    one = ~dup
    for b, blob in deal((key[one] % U(parts)).astype(np.int32), key[one], doc[one], tk[one], pos[one]):
        yield b, 0, blob


def answer_keyed(table: pa.Table, parts: int) -> pa.Table:
    """One part of the exchange: the places that have an earlier one with the same key, by bucket."""
    kinds, blobs = np.asarray(table["kind"]), table["blob"].to_pylist()
    key, doc, tk, pos = unpack_all([b for b, k in zip(blobs, kinds) if k == 0], *KEYED)
    dup = later(key, doc, pos)
    rows = list(deal(bucket_np(doc[dup], parts), doc[dup], tk[dup], pos[dup]))
    rows += [(p, b) for p, b, k in zip(table["part"].to_pylist(), blobs, kinds) if k == 1]
    del key, doc, tk, pos, dup
    trim()
    return reply_table(rows)


class Replies:
    """The answers of one bucket, by document."""

    def __init__(self, blobs, *types):
        self.cols = unpack_all(blobs, *types)
        order = np.lexsort((self.cols[2], self.cols[1], self.cols[0])) if self.cols else []
        self.cols = [c[order] for c in self.cols]
        doc, tk = self.cols[:2]
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (tk[1:] != tk[:-1])) + 1 if doc.size else np.zeros(0, int)
        lo = np.concatenate(([0], cut)) if doc.size else cut
        self.at = {(int(doc[i]), int(tk[i])): (int(i), int(j)) for i, j in zip(lo, np.concatenate((lo[1:], [doc.size])))}

    def of(self, doc: int, tk: int):
        i, j = self.at.get((doc, tk), (0, 0))
        return [c[i:j] for c in self.cols[2:]]
