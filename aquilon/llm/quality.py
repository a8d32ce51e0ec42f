"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, saved, text_slices

# Classes of bytes.
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\r\x0b\x0c"
_STOP = b".,;:'\"-?()"
_HIGH = bytes(range(128, 256))
_SIGN = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOP)
N_FEATURES = 15


def features(text: str | None) -> list[float]:
    """Transformed statistics of a whole text: logarithms of sizes, arcsine roots of shares."""
    b = (text or "").encode()
    n = len(b)
    ws = b.split()
    k = len(ws)
    part = lambda chars: (n - len(b.translate(None, chars))) / n if n else 0.0
    upper, lower, high = part(_UPPER), part(_LOWER), part(_HIGH)
    kinds = len(set(ws)) / k if k else 1.0
    pairs = len(set(zip(ws, ws[1:]))) / (k - 1) if k > 1 else 1.0
    same = sum(map(bytes.__eq__, ws, ws[1:])) / (k - 1) if k > 1 else 0.0
    lines = b.split(b"\n")
    shares = [upper / (upper + lower) if upper + lower else 0.0, part(_DIGIT), part(_STOP), part(_SIGN), part(_SPACE), upper + lower + high, high, kinds, pairs, same, len(set(lines)) / len(lines), sum(w.endswith(b"!") for w in ws) / k if k else 0.0]
    return [float(x) for x in (np.log1p(k), np.log1p(n / k if k else 0.0), np.log1p(n / len(lines)), *np.arcsin(np.sqrt(np.clip(shares, 0, 1))))]


def _features(batches):
    for batch in text_slices(batches):
        rows = [np.array(features(t)).tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "f"])


def _moments(batches):
    """Count, sum and sum of products of each class in this partition, as (class, position, value)."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        x = np.frombuffer(b"".join(batch["f"].to_pylist()), float).reshape(-1, N_FEATURES)
        y = np.asarray(batch["quality"])
        for k in (0, 1):
            z = np.hstack([np.ones((int((y == k).sum()), 1)), x[y == k]])
            held[k] = held.get(k, 0) + z.T @ z
    for k, m in held.items():
        m = m.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, k), pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m, pa.float64())], ["k", "i", "v"])


class Discriminant:
    """Two Gaussians. A class covariance is shrunk to the pooled one by `shrink` and to a multiple of
    the identity by `ridge`; Cholesky factors are kept for scoring."""

    def __init__(self, moments: dict[int, np.ndarray], shrink: float = 0.1, ridge: float = 0.01):
        self.classes = []
        if any(k not in moments or moments[k][0, 0] < N_FEATURES for k in (0, 1)):
            return  # too little to learn from: every score is 0.5
        n = {k: m[0, 0] for k, m in moments.items()}
        mean = {k: m[0, 1:] / m[0, 0] for k, m in moments.items()}
        cov = {k: m[1:, 1:] / m[0, 0] - np.outer(mean[k], mean[k]) for k, m in moments.items()}
        pooled = sum(n[k] * cov[k] for k in (0, 1)) / sum(n.values())
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        for k in (0, 1):
            c = ((1 - shrink) * cov[k] + shrink * pooled) / np.outer(self.scale, self.scale)
            c = (1 - ridge) * c + ridge * (np.trace(c) / len(c) + 1e-6) * np.eye(len(c))
            low = np.linalg.cholesky(c)
            self.classes.append((mean[k], np.linalg.inv(low), np.log(n[k] / sum(n.values())) - np.log(np.diag(low)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 0.5)
        d = [c - 0.5 * np.square(((x - m) / self.scale) @ inv.T).sum(1) for m, inv, c in self.classes]
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -700, 700)))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def document_features(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(lambda it: lean(_features(it)), "doc_id long, f binary")


def fit(feats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learns from all rows with quality 0 or 1 whose crc32(doc_id) mod 3 is not 1; what reaches the
    driver is two matrices of N_FEATURES + 1 squared."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", "quality")
    rows = feats.join(known, "doc_id").select("f", "quality").mapInArrow(_moments, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v")).collect()
    size = N_FEATURES + 1
    out: dict[int, np.ndarray] = {}
    for k, i, v in rows:
        out.setdefault(k, np.zeros(size * size))[i] = v
    return Discriminant({k: m.reshape(size, size) for k, m in out.items()})


def _score(batches, model: Discriminant):
    for batch in batches:
        s = model.scores(np.frombuffer(b"".join(batch["f"].to_pylist()), float).reshape(-1, N_FEATURES))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (repeated rows each; a null doc_id is
    scored and not held out). Null and empty texts are scored by their statistics. Where a class has fewer than
    N_FEATURES labelled rows every score is 0.5. Repeated labels count each."""
    feats = saved(document_features(docs))
    model = fit(feats, labels)
    d = feats.withColumn("held_out", _held_out())
    return d.mapInArrow(lambda it: _score(it, model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _accepted(batches, model: Discriminant):
    for batch in text_slices(batches):
        x = np.array([features(t) for t in batch["text"].to_pylist()]).reshape(-1, N_FEATURES)
        yield batch.filter(pa.array(model.scores(x) >= 0.5))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with score >= 0.5, all columns kept. The texts stay where they are: the model is
    small and each row is scored in place. Null texts are scored as empty ones, repeated rows and rows with a null id each by
    its text; a score of just 0.5 stays, so without enough labels all rows do; an empty table stays empty."""
    model = fit(saved(document_features(docs)), labels)
    return docs.mapInArrow(lambda it: lean(_accepted(it, model)), docs.schema)
