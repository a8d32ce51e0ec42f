"""Exact removal of repeated byte windows: a depth-limited radix order of suffixes.

Suffixes are told apart only through `window` bytes, most significant digit first. The digits
of a window are read in an order that its content fixes: first the k bytes of its
*anchor* (the k bytes with the least hash in it, leftmost of equal ones), then the rest. Equal windows have equal
anchors at equal places, so the order is a valid radix order: it groups exactly the equal windows. Neighbouring windows
share their anchor, so the first pass deals one row for each anchor (about 1 in 30 bytes), not one
for each suffix; groups with one row end there. The second pass reads the bytes around an anchor that its windows
can reach: in a group, rows with equal surroundings collapse to the first. Only where an anchor's group holds several
different surroundings does the last pass read whole windows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EXCHANGE_DDL, REPLY_DDL, U, Replies, Rolling, bucket_col, bucket_np, deal, exchange_rows, id_array, id_column, n_parts, reply_table, row_blocks, saved, release, slide_min, text_buffers, unpack_all

_LOW = U((1 << 24) - 1)
_ANCHOR = (np.uint64, np.uint64, np.int64, np.uint32, np.uint32)  # digit 1, digit 2, doc, text hash, anchor's place
_STATUS = (np.int64, np.uint32, np.uint32, np.uint8)  # doc, text hash, anchor's place, status
_HEAD = (np.int64, np.uint32, np.uint32, np.uint32)  # doc, text hash, first window, windows
_KNOWN, _OPEN = 1, 2


class Block:
    """Windows and anchors of some whole texts, or of a stretch of one."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, window: int, k: int):
        self.roll, self.offs, self.window, self.k = Rolling(buf), offs, window, k
        grams = self.roll.windows(k)
        n = max(0, buf.size - window + 1)
        tagged = (grams & ~_LOW) | np.arange(grams.size, dtype=U)
        owner = (slide_min(tagged, window - k + 1)[:n] & _LOW).astype(np.int64)
        doc = np.searchsorted(offs, np.arange(n), "right") - 1 if len(offs) > 2 else np.zeros(n, np.int64)
        ok = np.arange(n) + window <= offs[doc + 1] if n else np.zeros(0, bool)
        self.starts = np.flatnonzero(ok)
        self.owner = owner[self.starts]
        new = np.ones(self.owner.size, bool)
        new[1:] = self.owner[1:] != self.owner[:-1]
        self.first = np.flatnonzero(new)  # of each anchor's run of windows
        self.anchor = self.owner[self.first]
        self.doc = doc[self.starts[self.first]]
        self.grams = grams

    def around(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Digit 2: all bytes that the anchor's windows can reach, and where they end."""
        r = self.window - self.k
        a = np.maximum(lo, self.anchor - r)
        b = np.minimum(hi, self.anchor + self.k + r)
        return self.roll.ranges(a, b) ^ ((self.anchor - a).astype(U) * U(0x9E3779B97F4A7C15))

    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.first, self.owner.size))


def _stretches(buf: np.ndarray, offs: np.ndarray, limit: int, window: int, k: int):
    """(first row, last row, bytes, offsets, place of the bytes in the text, first and last window): blocks of
    whole texts, and overlapping stretches of a text over the limit. A stretch carries enough
    bytes on both sides for its windows to find the same anchors and surroundings as in the whole text."""
    margin = 2 * window
    for i, j in row_blocks(offs, limit):
        size = int(offs[j] - offs[i])
        if j - i > 1 or size <= 2 * limit:
            yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], 0, 0, size
            continue
        for at in range(0, size, limit):
            lo, hi = max(0, at - margin), min(size, at + limit + margin)
            yield i, j, buf[offs[i] + lo : offs[i] + hi], np.array([0, hi - lo]), lo, at - lo, at + limit - lo


def _block(b, o, base, lo, hi, size, window, k):
    """The block's anchors whose runs of windows start in [lo, hi), and the text bounds for digit 2."""
    blk = Block(b, o, window, k)
    if base or hi < b.size:
        use = (blk.anchor >= lo) & (blk.anchor < hi)
    else:
        use = np.ones(blk.anchor.size, bool)
    return blk, use


def _emit_anchors(batches, parts: int, window: int, k: int, limit: int, flush_at: int = 600_000):
    held, size = [], 0

    def flush():
        h, c, doc, tk, pos = map(np.concatenate, zip(*held))
        order = np.lexsort((pos, doc, c, h))
        hs, cs = h[order], c[order]
        dup = np.zeros(h.size, bool)
        same = (hs[1:] == hs[:-1]) & (cs[1:] == cs[:-1])
        dup[order[1:]] = same & ~((doc[order[1:]] == doc[order[:-1]]) & (pos[order[1:]] == pos[order[:-1]]))
        rows = [(p, 1, blob) for p, blob in deal(bucket_np(doc[dup], parts), doc[dup], tk[dup], pos[dup], np.full(int(dup.sum()), _KNOWN, np.uint8))]
        one = ~dup
        rows += [(p, 0, blob) for p, blob in deal((h[one] % U(parts)).astype(np.int32), h[one], c[one], doc[one], tk[one], pos[one])]
        return exchange_rows(rows)

    for batch in batches:
        ids = id_array(batch["doc_id"])
        buf, offs = text_buffers(batch["text"])
        crc = np.array([zlib.crc32(buf[offs[i] : offs[i + 1]]) for i in range(len(ids))], np.uint32)
        for i, j, b, o, base, lo, hi in _stretches(buf, offs, limit, window, k):
            blk, use = _block(b, o, base, lo, hi, 0, window, k)
            if not use.any():
                continue
            c = blk.around(o[blk.doc], o[blk.doc + 1])
            d = blk.doc + i
            held.append((blk.grams[blk.anchor][use], c[use], ids[d][use], crc[d][use], (blk.anchor - o[blk.doc] + base)[use].astype(np.uint32)))
            size += int(use.sum())
            if size >= flush_at:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _judge_anchors(table: pa.Table, parts: int) -> pa.Table:
    """Passes one and two for the anchors of one part."""
    kinds, blobs = np.asarray(table["kind"]), table["blob"].to_pylist()
    h, c, doc, tk, pos = unpack_all([b for b, q in zip(blobs, kinds) if q == 0], *_ANCHOR)
    order = np.lexsort((pos, doc, c, h))
    h, c, doc, tk, pos = (x[order] for x in (h, c, doc, tk, pos))
    n = h.size
    new_h, new_c = np.ones(n, bool), np.ones(n, bool)
    new_h[1:] = h[1:] != h[:-1]
    new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
    first = np.maximum.accumulate(np.where(new_c, np.arange(n), 0))
    known = (doc > doc[first]) | ((doc == doc[first]) & (pos > pos[first]))
    group = np.cumsum(new_h) - 1
    kinds_of = np.bincount(group, new_c, int(group[-1]) + 1 if n else 0)
    status = np.where(known, _KNOWN, np.where(kinds_of[group] > 1, _OPEN, 0)).astype(np.uint8) if n else np.zeros(0, np.uint8)
    use = status > 0
    rows = list(deal(bucket_np(doc[use], parts), doc[use], tk[use], pos[use], status[use]))
    rows += [(p, b) for p, b, q in zip(table["part"].to_pylist(), blobs, kinds) if q == 1]
    return reply_table(rows)


def _runs(pos: np.ndarray):
    """(start, end) of runs of consecutive sorted places."""
    cut = np.flatnonzero(np.diff(pos) != 1) + 1
    return pos[np.concatenate(([0], cut))], pos[np.concatenate((cut - 1, [pos.size - 1]))] + 1


def _emit_windows(docs: pa.Table, replies: pa.Table, parts: int, window: int, k: int, limit: int) -> pa.Table:
    """The last digit for one bucket of documents: hashes of whole windows of open anchors, dealt by (anchor's
    digit, place of the anchor in the window); windows of known anchors are answered as runs."""
    seen = Replies(replies["blob"].to_pylist(), *_STATUS)
    if not seen.at:
        return pa.table(exchange_rows([])[:0] if False else exchange_rows([]).to_pydict(), schema=exchange_rows([]).schema)
    ids = id_array(docs["doc_id"].combine_chunks())
    buf, offs = text_buffers(docs["text"])
    crc = np.array([zlib.crc32(buf[offs[i] : offs[i + 1]]) for i in range(len(ids))], np.uint32)
    heads, keys, target, runs = [], [], [], []
    for i, j, b, o, base, lo, hi in _stretches(buf, offs, limit, window, k):
        status: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(i, j):
            pos, st = seen.of(int(ids[d]), int(crc[d]))
            status.append((pos.astype(np.int64) + o[d - i] - base, st))
        pos, st = (np.concatenate(x) for x in zip(*status))
        if not pos.size:
            continue
        blk, use = _block(b, o, base, lo, hi, 0, window, k)
        at = np.full(b.size + 1, 0, np.uint8)
        inside = (pos >= 0) & (pos < b.size)
        at[pos[inside]] = np.maximum(at[pos[inside]], st[inside])
        # the same place may be answered twice: known beats open
        kn = pos[inside][st[inside] == _KNOWN]
        at[kn] = _KNOWN
        s = np.where(use, at[blk.anchor], 0) if blk.anchor.size else np.zeros(0, np.uint8)
        n = blk.counts()
        first = blk.starts[blk.first]
        d = blk.doc + i
        place = first - o[blk.doc] + base
        q = s == _KNOWN
        runs.append((ids[d][q], crc[d][q], place[q].astype(np.uint32), (place + n)[q].astype(np.uint32)))
        q = np.flatnonzero(s == _OPEN)
        if not q.size:
            continue
        # open runs in pieces of windows whose anchor stands in one sixteenth of the places
        t_hi = blk.anchor[q] - first[q]
        reps = t_hi // 16 - (t_hi - n[q] + 1) // 16 + 1
        src = np.repeat(np.arange(q.size), reps)
        step = np.arange(src.size) - np.repeat(np.cumsum(reps) - reps, reps)
        cell = t_hi[src] // 16 - step
        f = np.maximum(first[q][src], blk.anchor[q][src] - (cell * 16 + 15))
        e = np.minimum(first[q][src] + n[q][src], blk.anchor[q][src] - cell * 16 + 1)
        m = e - f
        w = np.repeat(f - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(int(m.sum()))
        keys.append(blk.roll.ranges(w, w + window))
        dd = d[q][src]
        heads.append((ids[dd], crc[dd], (f - o[blk.doc[q][src]] + base).astype(np.uint32), m.astype(np.uint32)))
        g = blk.grams[blk.anchor[q][src]] + cell.astype(U) * U(0x9E3779B97F4A7C15)
        target.append(((g ^ (g >> U(29))) % U(parts)).astype(np.int32))
    rows = []
    if heads:
        head = [np.concatenate(x) for x in zip(*heads)]
        key, part = np.concatenate(keys), np.concatenate(target)
        head, key, part, local = _local(head, key, part)
        runs.append(local)
        begin = np.cumsum(head[3], dtype=np.int64) - head[3]
        order = np.argsort(part, kind="stable")
        for p, idx in zip(*_groups(part, order)):
            flat = np.repeat(begin[idx] - np.concatenate(([0], np.cumsum(head[3][idx], dtype=np.int64)[:-1])), head[3][idx]) + np.arange(int(head[3][idx].sum()))
            rows.append((int(p), 0, np.int64(idx.size).tobytes() + b"".join(np.ascontiguousarray(c[idx]).tobytes() for c in head) + key[flat].tobytes()))
    if runs:
        r = [np.concatenate(x) for x in zip(*runs)]
        rows += [(p, 1, blob) for p, blob in deal(bucket_np(r[0], parts), *r)]
    return pa.Table.from_batches([exchange_rows(rows)])


def _groups(part: np.ndarray, order: np.ndarray):
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    groups = np.split(order, cuts) if order.size else []
    return [part[g[0]] for g in groups], groups


def _flat(head):
    """Document and place of every window of the pieces, and its piece."""
    n = head[3].astype(np.int64)
    piece = np.repeat(np.arange(n.size), n)
    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + head[2].astype(np.int64)[piece]
    return piece, head[0][piece], pos


def _dup_runs(head, key):
    """The windows with an earlier equal one among these, as (doc, text hash, start, end) runs, and their mask."""
    order = np.argsort(key)
    ks = key[order]
    twin = np.zeros(key.size, bool)
    same = ks[1:] == ks[:-1]
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    piece, doc, pos = _flat(head)
    dup = np.zeros(key.size, bool)
    idx = np.flatnonzero(twin)
    if idx.size:
        k, d, p = key[idx], doc[idx], pos[idx]
        o = np.lexsort((p, d, k))
        new = np.ones(idx.size, bool)
        new[1:] = k[o][1:] != k[o][:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(idx.size), 0))
        do, po = d[o], p[o]
        dup[idx[o]] = (do > do[first]) | ((do == do[first]) & (po > po[first]))
    at = np.flatnonzero(dup)
    if not at.size:
        return (head[0][:0], head[1][:0], head[2][:0], head[2][:0]), dup
    cut = np.flatnonzero((np.diff(at) != 1) | (piece[at][1:] != piece[at][:-1])) + 1
    lo, hi = at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [at.size - 1]))]
    return (doc[lo], head[1][piece[lo]], pos[lo].astype(np.uint32), (pos[hi] + 1).astype(np.uint32)), dup


def _local(head, key, part):
    """Answers windows that repeat inside this bucket and leaves them out, so that a frequent window leaves it once."""
    runs, dup = _dup_runs(head, key)
    if not dup.any():
        return head, key, part, runs
    piece, _, pos = _flat(head)
    keep = np.flatnonzero(~dup)
    if not keep.size:
        return [h[:0] for h in head], key[:0], part[:0], runs
    cut = np.flatnonzero((np.diff(keep) != 1) | (piece[keep][1:] != piece[keep][:-1])) + 1
    lo, hi = keep[np.concatenate(([0], cut))], keep[np.concatenate((cut - 1, [keep.size - 1]))]
    s = piece[lo]
    return [head[0][s], head[1][s], pos[lo].astype(np.uint32), (hi - lo + 1).astype(np.uint32)], key[keep], part[s], runs


def _judge_windows(table: pa.Table, parts: int) -> pa.Table:
    kinds, blobs = np.asarray(table["kind"]), table["blob"].to_pylist()
    heads, keys = [], []
    for b, q in zip(blobs, kinds):
        if q == 0:
            n, at, cols = int(np.frombuffer(b, np.int64, 1)[0]), 8, []
            for t in _HEAD:
                cols.append(np.frombuffer(b, t, n, at))
                at += n * np.dtype(t).itemsize
            heads.append(cols)
            keys.append(np.frombuffer(b, np.uint64, -1, at))
    rows = [(p, b) for p, b, q in zip(table["part"].to_pylist(), blobs, kinds) if q == 1]
    if heads:
        runs, _ = _dup_runs([np.concatenate(c) for c in zip(*heads)], np.concatenate(keys))
        rows += list(deal(bucket_np(runs[0], parts), *runs))
    return reply_table(rows)


def _finish(docs: pa.Table, replies: pa.Table, window: int, keep_text: bool) -> pa.Table:
    seen = Replies(replies["blob"].to_pylist(), *_HEAD)
    ids = id_array(docs["doc_id"].combine_chunks()) if docs.num_rows else np.zeros(0, np.int64)
    n_bytes, n_removed, spans, digests, kept = [], [], [], [], []
    for i, text in zip(ids.tolist(), docs["text"].to_pylist()):
        b = (text or "").encode()
        cut: list[list[int]] = []
        if len(b) >= window:
            lo, hi = seen.of(i, zlib.crc32(b))
            for s, e in zip(lo.tolist(), hi.tolist()):
                e += window - 1
                if cut and s <= cut[-1][1]:
                    cut[-1][1] = max(cut[-1][1], e)
                else:
                    cut.append([s, e])
        rest, at = [], 0
        for s, e in cut:
            rest.append(b[at:s])
            at = e
        rest = b"".join([*rest, b[at:]])
        n_bytes.append(len(b))
        n_removed.append(len(b) - len(rest))
        spans.append([{"start": s, "end": e} for s, e in cut])
        digests.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest if keep_text else None)
    return pa.table({
        "doc_id": id_column(ids), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
    })


def remove_repeats(docs: DataFrame, window: int = 100, k: int = 32, keep_text: bool = False, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (the remaining bytes, if asked for) for each row.

    Every byte goes that is covered by a `window`-byte string which also starts earlier: in a document with
    a smaller doc_id, or in the same one further left. Null texts are empty. Rows that share a doc_id count as one
    document: a string at the same place in both is not earlier in either. A null doc_id ranks first. 64-bit
    hashes stand for the digits.
    """
    if not 0 < k <= window:
        raise ValueError("k must be in 1..window")
    spark = docs.sparkSession
    d = docs.select("doc_id", "text")
    parts = n_parts(d)
    b = d.withColumn("bucket", bucket_col(F.col("doc_id"), parts))
    anchors = d.mapInArrow(lambda it: _emit_anchors(it, parts, window, k, block_bytes), EXCHANGE_DDL)
    status = saved(anchors.groupBy("part").applyInArrow(lambda t: _judge_anchors(t, parts), REPLY_DDL))
    release(spark)
    windows = b.groupBy("bucket").cogroup(status.groupBy("bucket")).applyInArrow(lambda x, y: _emit_windows(x, y, parts, window, k, block_bytes), EXCHANGE_DDL)
    runs = saved(windows.groupBy("part").applyInArrow(lambda t: _judge_windows(t, parts), REPLY_DDL))
    release(spark)
    return b.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(
        lambda x, y: _finish(x, y, window, keep_text),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary",
    )


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("spans", "kept")


def brute_force(rows: list[tuple[int, str | None]], window: int = 100):
    """{doc_id: (bytes, removed, spans, digest)} from a dictionary of all windows, for tests."""
    first: dict[bytes, tuple[int, int]] = {}
    data = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in data:
        for s in range(len(b) - window + 1):
            first.setdefault(b[s : s + window], (i, s))
    out = {}
    for i, b in data:
        hit = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < (i, s):
                hit[s : s + window] = b"\1" * window
        rest = bytes(c for c, h in zip(b, hit) if not h)
        out[i] = (len(b), sum(hit), sum(1 for q in range(len(b)) if hit[q] and (q == 0 or not hit[q - 1])), hashlib.sha256(rest).hexdigest())
    return out
