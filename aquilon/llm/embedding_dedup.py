"""Embedding near-dedup by collision-counting projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, n_parts, saved

_SORTED = "label int, size int, k int, t int, bits int, z double, cls long"


def calibrate(threshold: float, bits: int, recall: float, width: float = 2.0) -> tuple[int, int]:
    """(projections, collisions needed) so that a pair exactly at the threshold is found with the given
    recall and needs three collisions or more. A projection's collision takes `bits` equal sign cells and a
    difference within `width` standard deviations of a pair at the threshold; closer pairs collide more often."""
    p = (1 - math.acos(threshold) / math.pi) ** bits * math.erf(width / math.sqrt(2))
    term = lambda m, i: math.comb(m, i) * p**i * (1 - p) ** (m - i)
    m = 6
    while True:
        need, miss = 3, sum(term(m, i) for i in range(3))
        if miss <= 1 - recall:
            while (more := miss + term(m, need)) <= 1 - recall:
                miss, need = more, need + 1
            return m, need
        m += max(1, m // 8)


def _directions(size: int, m: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((7, size, m, bits))
    return rng.standard_normal((m, size)), rng.standard_normal((m, bits, size))


def _bits(n: int) -> int:
    """Sign cells before a projection, by the size of a label: about 16 vectors fall in a cell."""
    return max(0, min(20, round(math.log2(max(n, 1) / 16))))


def _vectors(col) -> tuple[np.ndarray, np.ndarray]:
    """The components of all vectors in a row, and n+1 offsets."""
    at = np.asarray(col.offsets).astype(np.int64)
    return np.asarray(col.flatten()), at - at[0]


def _project(batches, threshold: float, recall: float):
    for batch in batches:
        values, at = _vectors(batch["embedding"])
        label, cls = np.asarray(batch["label"]), np.asarray(batch["cls"])
        kinds = np.stack([np.diff(at), np.array([_bits(n) for n in batch["n_label"].to_pylist()], np.int64)], 1)
        out = []
        for size, bits in np.unique(kinds, axis=0).tolist():
            rows = np.flatnonzero((kinds == (size, bits)).all(1))
            m, _ = calibrate(threshold, bits, recall)
            x = values[at[rows][:, None] + np.arange(size)].astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            lines, signs = _directions(size, m, bits)
            z = x @ lines.T
            cell = np.zeros(z.shape, np.int64)
            for b in range(bits):
                cell = cell * 2 + (x @ signs[:, b].T > 0)
            out.append([
                np.repeat(label[rows], m), np.full(z.size, size), np.full(z.size, bits), np.tile(np.arange(m), rows.size),
                cell.ravel(), z.ravel(), np.repeat(cls[rows], m),
            ])
        if out:
            cols = [np.concatenate(x) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (*[pa.int32()] * 5, pa.float64(), pa.int64()))], ["label", "size", "k", "t", "bits", "z", "cls"])


def _collide(batches, half: float, chunk: int = 1 << 18):
    """Reads projections by (cell, z); every vector meets the ones that follow it within the window. Only
    the window's vectors are held. Pairs are counted here as far as they meet again in this task's buffer."""
    names = ("label", "size", "k", "t", "bits")
    cell, z, ids = None, np.zeros(0), np.zeros(0, np.int64)
    ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        a, b, k = (np.concatenate(x) for x in zip(*ready))
        names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        pair, first, n = np.unique(code[: a.size] * names.size + code[a.size :], return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names[pair // names.size]), pa.array(names[pair % names.size]), pa.array(k[first]), pa.array(n, pa.int64())], ["a", "b", "k", "n"])

    for batch in batches:
        keys = np.stack([np.asarray(batch[n]) for n in names], 1)
        bz, bi = np.asarray(batch["z"]), np.asarray(batch["cls"])
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(bz)]):
            if hi <= lo:
                continue
            now = tuple(keys[lo])
            if now != cell:
                cell, z, ids = now, np.zeros(0), np.zeros(0, np.int64)
            old = z.size
            z, ids = np.concatenate([z, bz[lo:hi]]), np.concatenate([ids, bi[lo:hi]])
            first = np.searchsorted(z, z[old:] - half)
            n = np.arange(old, z.size) - first
            at = 0
            while at < n.size:
                end = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), chunk)) + at)
                m = n[at:end]
                right = np.repeat(np.arange(old + at, old + end), m)
                left = np.repeat(first[at:end] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(int(m.sum()))
                a, b = ids[left], ids[right]
                ready.append((np.minimum(a, b), np.maximum(a, b), np.full(a.size, now[2], np.int32)))
                size += a.size
                if size >= 4 * chunk:
                    yield flush()
                    ready, size = [], 0
                at = end
            z, ids = z[first[-1] :], ids[first[-1] :]
    if ready:
        yield flush()


def _verify(batches, threshold: float, block: int = 1 << 20):
    """Pairs of vectors of one length each, compared in double precision, about `block` components at once."""
    for batch in batches:
        (x, at), (y, _) = _vectors(batch["x"]), _vectors(batch["y"])
        size = np.diff(at)
        keep = np.zeros(size.size, bool)
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            step = max(1, block // n)
            for lo in range(0, rows.size, step):
                r = rows[lo : lo + step]
                i = at[r][:, None] + np.arange(n)
                u, v = x[i].astype(float), y[i].astype(float)
                dot = lambda p, q: np.einsum("ij,ij->i", p, q)
                keep[r] = dot(u, v) / (np.sqrt(dot(u, u)) * np.sqrt(dot(v, v))) >= threshold
        yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], ["a", "b"])


def cosine(u: np.ndarray, v: np.ndarray) -> float:
    return float(np.dot(u, v) / (math.sqrt(np.dot(u, u)) * math.sqrt(np.dot(v, v))))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, recall: float = 0.9999) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vec_id of embeddings (vec_id, embedding, label).

    Vectors with equal labels link at cosine >= threshold in double precision. Equal vectors of a label form one
    class, counted by its size. Class vectors are projected on many random lines; for each line they are sorted
    inside cells of sign bits, whose number follows the label's size so that a cell holds about as many unrelated
    vectors at any scale. A sweep counts, for each pair, the windows in which it meets; pairs with the count
    that keeps `recall` for pairs at the threshold are compared exactly, so no pair below it is found.

    A vector that is null or zero or holds null or non-finite components, or whose label is null, links with nothing.
    Vectors of different lengths never link. Repeated rows of one vec_id count once, by the first in the order of (label,
    embedding); a null vec_id is left out of linking and keeps null as its component.
    """
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("int").alias("label"))
    lost = e.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    one = e.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*")
    good = F.coalesce(
        F.col("label").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    one = saved(one.withColumn("good", good))
    ok = one.where("good")
    members = ok.groupBy("label", "embedding").agg(F.min("vec_id").alias("cls"), F.count("*").alias("mult"))
    members = members.join(members.groupBy("label").agg(F.count("*").alias("n_label")), "label")
    classes = saved(members)
    m_parts = max(n_parts(classes), int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = classes.select("cls", "label", "embedding", "n_label").mapInArrow(lambda it: _project(it, threshold, recall), _SORTED)
    half = 2.0 * math.sqrt(2 - 2 * threshold)
    order = ["label", "size", "k", "t", "bits"]
    pairs = lines.repartition(m_parts, *order).sortWithinPartitions(*order, "z").mapInArrow(lambda it: _collide(it, half), "a long, b long, k int, n long")
    counted = pairs.groupBy("a", "b", "k").agg(F.sum("n").alias("n"))
    need = {k: calibrate(threshold, k, recall)[1] for k in range(21)}
    table = F.create_map(*[F.lit(x) for kv in need.items() for x in kv])
    likely = counted.where(F.col("n") >= table[F.col("k")]).select("a", "b")
    vec = classes.select("cls", "embedding")
    both = likely.join(vec.select(F.col("cls").alias("a"), F.col("embedding").alias("x")), "a").join(vec.select(F.col("cls").alias("b"), F.col("embedding").alias("y")), "b")
    links = saved(both.select("a", "b", "x", "y").mapInArrow(lambda it: _verify(it, threshold), "a long, b long"))
    mult = classes.select("cls", "mult")
    ends = links.select(F.col("a").alias("cls"), F.col("b").alias("o")).union(links.select(F.col("b"), F.col("a")))
    n = ends.join(mult.select(F.col("cls").alias("o"), F.col("mult").alias("m")), "o").groupBy("cls").agg(F.sum("m").alias("far"))
    comp = components(embeddings.sparkSession, links).withColumnRenamed("id", "cls")
    per = mult.join(n, "cls", "left").join(comp, "cls", "left").select("cls", (F.col("mult") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    keyed = classes.select("label", "embedding", "cls").join(per, "cls")
    out = ok.join(keyed, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    bad = one.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(bad).withColumn("kept", F.col("vec_id") == F.col("component_id")).union(lost)


ORACLE = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (WITH RECURSIVE t(x, c) AS (SELECT x, x FROM l UNION SELECT l.y, t.c FROM t JOIN l ON l.x = t.x) SELECT x, min(c) AS c FROM t GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(r.c, e.vec_id) AS component_id, e.vec_id = coalesce(r.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN r ON r.x = e.vec_id
"""
