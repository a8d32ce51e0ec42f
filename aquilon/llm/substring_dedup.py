"""Substring dedup by hashing whole lines and the sentences in them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EXCHANGE_DDL, PLACED, REPLY_DDL, Replies, Rolling, U, answer_keyed, bucket_col, deal_keyed, exchange_rows, id_array, id_column, lean, mix, n_parts, row_blocks, saved, text_buffers, trim

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
#: Stops beyond ASCII, which need no white space after them: ideographic, full-width, Arabic, Urdu, Devanagari, Armenian, Ethiopic, Burmese, Khmer.
_STOPS = np.array([int.from_bytes(c.encode(), "big") for c in "。！？．｡؟۔।॥։።။។"])
_LEAD = np.zeros(256, np.int64)  # the length of a character that such a byte begins, if it may be a stop
for _c in "。！？．｡؟۔।॥։።။។":
    _LEAD[_c.encode()[0]] = len(_c.encode())
#: Bytes that count: non-ASCII, letters (A-Z folded) and digits.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_COUNTS = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: A line's key is mixed with _LINE, so lines meet lines only; its place is that of its first unit and _IS_LINE.
_LINE = U(0x3C79AC492BA7B653)
_IS_LINE = 1 << 31


def units(buf: np.ndarray, offs: np.ndarray):
    """(starts, size in counted bytes, hash) of the units of all texts in a buffer. A unit ends after a
    newline, after white space that follows a full stop, ! or ?, or after a stop beyond ASCII with the white space that may follow it. White space, case and punctuation don't count."""
    n = buf.size
    start = np.zeros(n, bool)
    start[offs[:-1][offs[:-1] < n]] = True
    white = _WHITE[buf] & ~start  # a text's first sign follows no stop
    start[1:] |= buf[:-1] == 10
    start[2:] |= white[1:-1] & _STOP[buf[:-2]]
    size = _LEAD[buf]
    for k in (2, 3):
        i = np.flatnonzero(size == k)
        code = sum(buf[i + j].astype(np.int64) << (8 * (k - 1 - j)) for j in range(k))
        end = i[np.isin(code, _STOPS)] + k
        end = end[end < n]
        end += white[end]
        start[end[end < n]] = True
    at = np.flatnonzero(start)
    return at, *_digests(buf, at)


def lines(buf: np.ndarray, at: np.ndarray, offs: np.ndarray):
    """(which unit comes first, size in counted bytes, hash) of the lines, given the starts of the units."""
    first = np.isin(at, offs[:-1])
    first[1:] |= buf[at[1:] - 1] == 10
    row = np.flatnonzero(first)
    size, h = _digests(buf, at[row])
    return row, size, mix(h ^ _LINE)


def _digests(buf: np.ndarray, at: np.ndarray):
    """(size in counted bytes, hash) of the ranges from each start to the next."""
    keep = _COUNTS[buf]
    before = np.zeros(buf.size + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    lo, hi = before[at], before[np.append(at[1:], buf.size)]
    return hi - lo, Rolling(_FOLD[buf[keep]]).ranges(lo, hi)


def words(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of words with a counted byte in each unit; a unit begins with a word of its own."""
    edge = _WHITE[buf]
    edge[at] = True
    lo = np.flatnonzero(edge)
    if not lo.size:
        return np.zeros(0, np.int64)
    full = np.add.reduceat(_COUNTS[buf].astype(np.int64), lo) > 0
    return np.add.reduceat(full.astype(np.int64), np.searchsorted(lo, at))


def _emit(batches, parts: int, limit: int, whole_lines: bool, flush_at: int = 1_000_000):
    held, size = [], 0
    for batch in batches:
        ids = id_array(batch["doc_id"])
        buf, offs = text_buffers(batch["text"])
        for i, j in row_blocks(offs, limit):
            b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            if not b.size:
                continue
            at, n, h = units(b, o)
            doc = np.searchsorted(o, at, "right") - 1
            tk = np.array([zlib.crc32(b[o[k] : o[k + 1]]) for k in range(j - i)], np.uint32)
            index = np.arange(at.size) - np.searchsorted(at, o[:-1])[doc]
            if whole_lines:
                row, n_line, h_line = lines(b, at, o)
                n, h, doc, index = (np.concatenate(x) for x in ((n, n_line), (h, h_line), (doc, doc[row]), (index, index[row] | _IS_LINE)))
            ok = n > 0
            held.append((h[ok], ids[i:j][doc][ok], tk[doc][ok], index[ok].astype(np.uint32)))
            size += int(ok.sum())
            if size >= flush_at:
                yield exchange_rows(deal_keyed(parts, *map(np.concatenate, zip(*held))))
                held, size = [], 0
    if held:
        yield exchange_rows(deal_keyed(parts, *map(np.concatenate, zip(*held))))


def removed_runs(n: np.ndarray, dup: np.ndarray, min_run: int, min_unit: int, n_words: np.ndarray | None = None, min_words: int = 50) -> np.ndarray:
    """Which units go: those in a run of repeated units with min_run counted bytes that holds one of min_unit, or with
    min_words words, where n_words gives those of each unit."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], dup.astype(np.int8), [0]))))
    out = np.zeros(dup.size, bool)
    for lo, hi in edge.reshape(-1, 2):
        if (n[lo:hi].sum() >= min_run and n[lo:hi].max() >= min_unit) or (n_words is not None and n_words[lo:hi].sum() >= min_words):
            out[lo:hi] = True
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = "doc_id long, text_key long, removed array<struct<start:long,end:long>>"


def _apply(docs: pa.Table, replies: pa.Table, min_run: int, min_unit: int, whole_lines: bool, schema: pa.Schema, column: str) -> pa.Table:
    """Cuts the repeated runs out of the texts of one bucket."""
    seen = Replies(replies["blob"].to_pylist(), *PLACED)
    texts, spans = [], []
    ids = id_array(docs["doc_id"].combine_chunks()).tolist() if docs.num_rows else []
    for i, text in zip(ids, docs["text"].to_pylist()):
        b = (text or "").encode()
        (idx,) = seen.of(i, zlib.crc32(b)) if seen.at else (np.zeros(0, int),)
        cut = []
        if len(idx):
            buf = np.frombuffer(b, np.uint8)
            at, n, _ = units(buf, np.array([0, buf.size]))
            dup = np.zeros(at.size, bool)
            dup[idx[idx < _IS_LINE]] = True
            gone = removed_runs(n, dup, min_run, min_unit, words(buf, at))
            if whole_lines:
                row, _, _ = lines(buf, at, np.array([0, buf.size]))
                again = np.isin(row, idx[idx >= _IS_LINE] - _IS_LINE)
                gone |= np.repeat(again, np.diff(np.append(row, at.size)))
            ends = np.append(at[1:], buf.size)
            for lo, hi in np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2):
                cut.append((int(at[lo]), int(ends[hi - 1])))
        if cut:
            keep, at_ = [], 0
            for s, e in cut:
                keep.append(b[at_:s])
                at_ = e
            text = b"".join([*keep, b[at_:]]).decode()
        texts.append(text)
        spans.append([{"start": s, "end": e} for s, e in cut])
    cols = {c: docs[c] for c in docs.column_names} | {"text": pa.array(texts, pa.string()), column: pa.array(spans, _SPAN)}
    trim()
    return pa.table([cols[f.name].cast(f.type) for f in schema], schema=schema)


def dedup_units(docs: DataFrame, min_run: int = 50, min_unit: int = 30, column: str = "removed", block_bytes: int = 1 << 20, whole_lines: bool = True) -> DataFrame:
    """docs with its texts cut and a column `column`: the removed spans as byte offsets of the original.

    Units are sentences within lines, normalised to folded letters and digits. Their digests are
    grouped over all documents; the occurrence with the smallest (doc_id, place) stays. A later one
    goes where it stands in a run of repeated units of at least min_run counted bytes with one unit of
    min_unit or more, or of 50 words, so that short phrases that anyone may write stay inside a line. With
    `whole_lines` a line that stood earlier as a line goes whatever its length, unless it has no counted byte. Rows of one doc_id rank as one document,
    a null doc_id before all others; null texts stay null. Units repeated inside a document count.
    Columns beside doc_id and text pass through; a column named like `column` must not exist.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if column in docs.columns:
        raise ValueError(f"docs has a column {column} already")
    d = docs.select("doc_id", "text")
    parts = n_parts(d)
    rows = d.mapInArrow(lambda it: lean(_emit(it, parts, block_bytes, whole_lines)), EXCHANGE_DDL)
    replies = saved(rows.groupBy("part").applyInArrow(lambda t: answer_keyed(t, parts), REPLY_DDL))
    out = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` array<struct<start:bigint,end:bigint>>")
    arrow = to_arrow_schema(out)
    key = "_bucket"
    while key in docs.columns:
        key += "_"
    left = docs.withColumn(key, bucket_col(F.col("doc_id"), parts)).groupBy(key)
    right = replies.withColumnRenamed("bucket", key).groupBy(key)
    return left.cogroup(right).applyInArrow(lambda a, b: _apply(a, b, min_run, min_unit, whole_lines, arrow, column), out)


def report(docs: DataFrame, whole_lines: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed, text (what is kept) for each row of docs; the query asks for whole lines too."""
    kept = dedup_units(docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), whole_lines=whole_lines)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return kept.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "removed", "text")
