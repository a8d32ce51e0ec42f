"""N-gram Jaccard join: group counts of hashed shingles as points of an R-tree.

A set of shingle hashes is cut into 256 groups by hash ranges, and its counts a group make it a point. The summed
coordinate minima of two points bound the overlap of their sets from above; the maxima of a tree node bound that of
everything below it. What the bounds leave is verified on whole sets.

One tree over a corpus would be searched almost in full, as random texts of one length have nearly equal counts. So sets
are routed first: two linked sets differ in D shingles at most, hence of D + 1 finer groups one at least is equal in both,
and sets with an equal group meet in a cell (see `_routes`; no link can be lost). A tree in each list of sets that meet gives
the candidates as a spanning forest; all links lie inside its components. A component's sets then meet once, under a tree
of their own, and are verified there, again as a forest: neither step writes more rows than it reads.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Rolling, components, deal, discard, forest, id_array, lean, mix, n_parts, pack, release, row_blocks, saved, text_buffers, trim, unpack, unpack_all

GROUPS = 256  # counts of one byte; with fewer, the bound says nothing of sets of a few thousand
LEAF = 32
FAN = 16
FULL = 255
OFFSETS = 4  # a text of a cluster of several blocks goes to so many pairs of blocks, twice, at a time
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


class Threshold:
    """Jaccard >= num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1, 2]
        while low[-1] < 1 << 40:  # a set's partners are in its own class of sizes or the next one
            low.append(max(low[-1] + 1, (low[-1] - 1) * den // num + 1))
        self.low = np.array(low)
        self.groups, self.spare = np.array([self._table(t) for t in range(len(low) - 1)]).T

    def overlap(self, both):
        """The least overlap of linked sets with so many elements together."""
        return -(-self.num * both // (self.num + self.den))

    def _table(self, t: int) -> tuple[int, int]:
        """Groups of routing table t, and how many of them are spare. Its sets have low[t + 1] - 1 elements at most, which
        bounds the difference of linked ones; there are so many spare groups that few sets leave more than that empty."""
        top = int(self.low[t + 1]) - 1
        d = (self.den - self.num) * 2 * top // (self.num + self.den)
        spare, more = 0, 1 if d else 0
        while more > spare and spare < d // 4 + 2:
            spare = min(more, d // 4 + 2)
            empty = (d + 1 + spare) * math.exp(-0.8 * top / (d + 1 + spare))
            more = math.ceil(empty + 3 * math.sqrt(empty))
        return d + 1 + spare, spare

    def tables(self, n: np.ndarray):
        """The two routing tables of sets with n elements each."""
        j = np.searchsorted(self.low, np.maximum(n, 1), "right") - 1
        return j, j + 1


def shingles(buf: np.ndarray, offs: np.ndarray, size: int):
    """(set hash, document) of the distinct shingles of all texts, sorted by (document, hash); A-Z folded, words parted by ASCII white space."""
    n_docs = len(offs) - 1
    if not buf.size:
        return np.zeros(0, U), np.zeros(0, np.int64)
    buf = _FOLD[buf]
    word = ~_WHITE[buf]
    edge = np.zeros(buf.size + 1, bool)
    edge[offs[:-1]] = True
    edge[buf.size] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    lo = np.flatnonzero(start)
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    hi = np.flatnonzero(end) + 1
    w = Rolling(buf).ranges(lo, hi)
    doc = np.searchsorted(offs, lo, "right") - 1
    count = np.bincount(doc, minlength=n_docs)
    m = w.size
    a = U(0x9E3779B97F4A7C15)
    h = np.zeros(max(0, m - size + 1), U)
    for k in range(size):
        h = h * a + w[k : k + h.size]
    ok = doc[: h.size] == doc[size - 1 :] if h.size else np.zeros(0, bool)
    hs, ds = [mix(h[ok] + U(size))], [doc[: h.size][ok]]
    first = np.cumsum(count) - count
    for c in range(1, min(size, 1 << 30)):
        few = np.flatnonzero(count == c)
        if few.size:
            h = np.zeros(few.size, U)
            for k in range(c):
                h = h * a + w[first[few] + k]
            hs.append(mix(h + U(c)))
            ds.append(few)
    h, d = np.concatenate(hs), np.concatenate(ds)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(h.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def _names(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash for each set; 0 for an empty one."""
    out = np.zeros(n.size, U)
    some = np.flatnonzero(n)
    if some.size:
        out[some] = mix(np.add.reduceat(mix(h ^ U(0x14057B7EF767814F)), at[some]) + n[some].astype(U))
    return out


def _routes(h: np.ndarray, d: np.ndarray, n: np.ndarray, th: Threshold, heavy: np.ndarray):
    """(key, document) of all cells of the sets (h, d), sorted by (d, h), with n elements each.

    A key is the sum of the mixed hashes in one group, so equal groups have equal keys. Two linked sets A and B have D
    differing shingles at most, so 1 + spare groups or more are equal; leaving out of both sets the shingles in `heavy`, whichever those
    are, makes the difference no larger. Keys come in three steps, each for the pairs that the one before can't promise to find:
    1. every set: the groups of its light shingles. If A or B leaves no more than the spare groups empty, one of the
       equal groups holds shingles, and they meet.
    2. sets that leave more empty: the groups of all shingles. If A or B then has few enough empty ones, they meet.
    3. sets that have more empty ones even so: the rarest shingles by the order (heavy or not, hash), one more than a linked
       set can lack; the first common shingle of A and B is among them.
    """
    out = []
    body = mix(h ^ U(0x5851F42D4C957F2D))
    top = (h >> U(32)).astype(U)
    at = np.searchsorted(heavy, h) if heavy.size else np.zeros(h.size, np.int64)
    light = heavy[np.minimum(at, heavy.size - 1)] != h if heavy.size else np.ones(h.size, bool)
    mixed = np.bincount(d[~light], minlength=n.size) > 0
    rest = np.zeros(n.size, bool)

    def grouped(t, who: np.ndarray) -> np.ndarray:
        """Adds the keys of the shingles in `who`; which sets leave too many groups empty."""
        i = np.flatnonzero(who)
        g = th.groups[t]
        group = ((top[i] * g[d[i]].astype(U)) >> U(32)).astype(np.int64)
        flat = (np.cumsum(g) - g)[d[i]] + group
        new = np.ones(flat.size, bool)
        new[1:] = flat[1:] != flat[:-1]
        first = np.flatnonzero(new)
        if first.size:
            total = np.add.reduceat(body[i], first)
            doc = d[i[first]]
            out.append((mix(total + mix((t[doc].astype(U) << U(32)) + group[first].astype(U))), doc))
        else:
            doc = np.zeros(0, np.int64)
        return g - np.bincount(doc, minlength=n.size) > th.spare[t]

    for t in th.tables(n):
        short = grouped(t, light) & (n > 0)
        again = short & mixed
        rest |= short & ~mixed
        if again.any():
            rest |= grouped(t, again[d]) & again
    i = np.flatnonzero(rest[d])
    if i.size:
        i = i[np.lexsort((h[i], ~light[i], d[i]))]
        doc = d[i]
        place = np.arange(i.size) - np.searchsorted(doc, doc)
        lack = n - -(-th.num * n // th.den)  # a linked set has at least num / den of the shingles
        keep = place <= lack[doc]
        out.append((mix(body[i[keep]] ^ U(0x2545F4914F6CDD1D)), doc[keep]))
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in out]), np.concatenate([x for _, x in out])


def _frequent(batches, size: int, limit: int, share: int, flush_at: int = 1_000_000):
    """Shingles that stand in 1 / share of a block's documents and in two at least, with their number; the documents under a null."""
    held, n_held, docs = [], 0, 0

    def flush():
        h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U), np.zeros(0, np.int64))
        keep = n >= max(2, docs // share)
        h, n = h[keep].view(np.int64), n[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.append(h, 0), mask=np.append(np.zeros(h.size, bool), True)), pa.array(np.append(n, docs))], ["h", "n"])

    for batch in batches:
        buf, offs = text_buffers(batch["text"])
        for i, j in row_blocks(offs, limit):
            h, _ = shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
            held.append(h)
            n_held += h.size
            docs += j - i
            if n_held >= flush_at:
                yield flush()
                held, n_held, docs = [], 0, 0
    if docs:
        yield flush()


def heavy_shingles(texts: DataFrame, size: int, limit: int, least: int, share: int, most: int = 1 << 18) -> np.ndarray:
    """Sorted hashes of the most frequent shingles: those in `least` documents and 1 / share of all at least, `most` of them at most. They
    only serve to route sets apart; any set of shingles, also an empty one, gives the same links."""
    counts = texts.mapInArrow(lambda it: lean(_frequent(it, size, limit, 2 * share)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = saved(counts.where(f"h IS NULL OR n >= {least}"))
    docs = counts.where("h IS NULL").agg(F.max("n")).first()[0] or 0
    top = counts.where(f"h IS NOT NULL AND n >= {docs // share}").orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    discard(counts)
    return np.sort(np.asarray(top["h"]).view(U))


_OUT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])
_OUT_DDL = "kind int, part int, blob binary"
_PROFILE = (np.int64, np.int64, np.int64, np.int64, np.uint8)  # doc, hash of the text, set size, set hash, id is null
_WIDTH = sum(np.dtype(t).itemsize for t in _PROFILE)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OUT)], schema=_OUT)


def _forest_of(runs: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """(least, other) pairs that keep together what shares a run; runs gives the run of each member."""
    names, node = np.unique(cls, return_inverse=True)
    root = list(range(names.size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y, same in zip(node[:-1].tolist(), node[1:].tolist(), (runs[1:] == runs[:-1]).tolist()):
        if same and (a := find(x)) != (b := find(y)):
            root[max(a, b)] = min(a, b)
    low = np.array([find(x) for x in range(names.size)], np.int64)
    other = np.flatnonzero(low != np.arange(names.size))
    return np.stack([names[low[other]], names[other]], 1)


def _sorted_runs(key: np.ndarray, cls: np.ndarray):
    """Distinct (key, cls) in order, and where each key starts and how many it has."""
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    new = np.ones(key.size, bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls = key[new], cls[new]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if key.size else np.zeros(0, np.int64)
    return key, cls, at, np.diff(np.append(at, key.size))


def _profile(batches, parts: int, size: int, th: Threshold, limit: int, heavy: np.ndarray, dense: int, flush_at: int = 500_000):
    """kind 0: profiles of documents; kind 1: (key, set) pairs for a part; kind 2: pairs of sets that meet. A key that more than `dense` sets
    of one block have leaves the block once, with the least of them; the others are tied to it."""
    held, n_held = [], 0

    def flush():
        key, cls = (np.concatenate(x) for x in zip(*held))
        key, cls, at, n = _sorted_runs(key, cls)
        many = np.repeat(n > dense, n)
        rows = []
        if many.any():
            ties = _forest_of(key[many], cls[many])
            rows.append((2, int(ties[0, 0] % parts), ties.tobytes()))
            first = np.zeros(key.size, bool)
            first[at] = True
            key, cls = key[~many | first], cls[~many | first]
        part = (key % U(parts)).astype(np.int64)
        order = np.lexsort((cls, part))
        key, cls, part = (key[order] // U(parts)).astype(np.uint32), cls[order], part[order]  # a part is small enough for 32 bits to tell its keys apart
        for at in np.split(np.arange(key.size), np.flatnonzero(np.diff(part)) + 1):
            names, n = np.unique(cls[at], return_counts=True)
            rows.append((1, int(part[at[0]]), np.int64(names.size).tobytes() + names.tobytes() + n.astype(np.uint32).tobytes() + key[at].tobytes()))
        return _rows(rows)

    for batch in batches:
        ids, gone, text_key = id_array(batch["doc_id"]), np.asarray(batch["doc_id"].is_null()), np.asarray(batch["tk"])
        buf, offs = text_buffers(batch["text"])
        for i, j in row_blocks(offs, limit):
            h, d = shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
            n = np.bincount(d, minlength=j - i)
            cls = _names(h, np.cumsum(n) - n, n)
            vec = _counts(h, d, j - i)
            blob = pack(ids[i:j], text_key[i:j], n, cls.view(np.int64), gone[i:j].astype(np.uint8)) + vec.tobytes()
            yield _rows([(0, int(cls[0] % U(parts)), np.int64(j - i).tobytes() + blob)])
            key, doc = _routes(h, d, n, th, heavy)
            if key.size:
                held.append((key, cls[doc].view(np.int64)))
                n_held += key.size
            if n_held >= flush_at:
                yield flush()
                held, n_held = [], 0
    if held:
        yield flush()


def _counts(h: np.ndarray, d: np.ndarray, n_sets: int) -> np.ndarray:
    """The group counts of sets, a byte each; where one has too many for a byte, all are FULL, which rules nothing out."""
    out = np.empty((n_sets, GROUPS), np.uint8)
    for lo in range(0, n_sets, 512):
        hi = min(n_sets, lo + 512)
        i, j = np.searchsorted(d, [lo, hi])
        counts = np.bincount((d[i:j] - lo) * GROUPS + (h[i:j] >> U(56)).astype(np.int64), minlength=(hi - lo) * GROUPS).reshape(-1, GROUPS)
        counts[(counts > 254).any(1)] = FULL
        out[lo:hi] = counts
    return out


def _unprofile(batches):
    for batch in batches:
        for b in batch["blob"].to_pylist():
            n = int(np.frombuffer(b, np.int64, 1)[0])
            doc, tk, size, cls, gone = unpack(b[8 : 8 + _WIDTH * n], *_PROFILE)
            offs = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * GROUPS).tobytes())
            vec = pa.Array.from_buffers(pa.binary(), n, [None, offs, pa.py_buffer(b[8 + _WIDTH * n :])])
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=gone > 0), pa.array(tk), pa.array(size), pa.array(cls), vec], ["doc_id", "tk", "n", "cls", "vec"])


def _cells(table: pa.Table, parts: int) -> pa.Table:
    """One part: lists of sets that meet in its cells, put together where they share sets (near copies share dozens of cells),
    dealt by name. Kinds 0 and 2 go on as they are."""
    kinds = np.asarray(table["kind"])
    blobs = table["blob"].to_pylist()
    rows = [(int(k), -1, b) for k, b in zip(kinds, blobs) if k != 1]
    keys, sets = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for b, k in zip(blobs, kinds):
        if k == 1:
            n = int(np.frombuffer(b, np.int64, 1)[0])
            sets.append(np.repeat(np.frombuffer(b, np.int64, n, 8), np.frombuffer(b, np.uint32, n, 8 + 8 * n)))
            keys.append(np.frombuffer(b, np.uint32, -1, 8 + 12 * n))
    key, cls = np.concatenate(keys), np.concatenate(sets)
    order = np.argsort(key)  # only keys that come again are sorted in full
    again = key[order[1:]] == key[order[:-1]]
    twin = np.zeros(key.size, bool)
    twin[order[1:][again]] = True
    twin[order[:-1][again]] = True
    key, cls, _, n = _sorted_runs(key[twin], cls[twin])
    many = np.repeat(n > 1, n)
    if many.any():
        tie = _forest_of(key[many], cls[many])
        low, at = np.unique(tie[:, 0], return_inverse=True)
        run, members = np.concatenate((at, np.arange(low.size))), np.concatenate((tie[:, 1], low))
        order = np.lexsort((members, run))
        run, members = run[order], members[order]
        n = np.bincount(run)
        name = mix(np.add.reduceat(mix(members.view(U)), np.cumsum(n) - n) + n.astype(U))
        names = np.repeat(name, n)
        rows += [(1, p, b) for p, b in deal((names % U(parts)).astype(np.int32), names, members)]
    trim()
    return pa.Table.from_batches([_rows(rows)])


def _lists(table: pa.Table) -> pa.Table:
    """Distinct lists of one part, a row for each member."""
    name, cls = unpack_all(table["blob"].to_pylist(), U, np.int64)
    name, cls, _, _ = _sorted_runs(name, cls)
    return pa.table({"list": pa.array(name.view(np.int64)), "cls": pa.array(cls)})


def _pairs(batches):
    for batch in batches:
        for b in batch["blob"].to_pylist():
            p = np.frombuffer(b, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])


class Tree:
    """A packed R-tree: points in the order of their size class and of a projection of their counts, leaves of LEAF points, nodes of FAN
    children; a node keeps the coordinate maxima and the least and greatest set size below it."""

    def __init__(self, n: np.ndarray, vec: np.ndarray, th: Threshold):
        self.th = th
        line = vec.astype(np.float32) @ np.sin(np.arange(1, GROUPS + 1, dtype=np.float32) * 12.9898)
        self.order = np.lexsort((line, np.searchsorted(th.low, n, "right")))
        self.n, self.vec = n[self.order], vec[self.order]
        self.free = self.vec[:, 0] == FULL
        self.levels = []
        top, least, most, free, step = self.vec, self.n, self.n, self.free, LEAF
        while not self.levels or least.size > FAN:
            at = np.arange(0, least.size, step)
            top, least, most, free = np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.logical_or.reduceat(free, at)
            self.levels.append((top, least, most, free))
            step = FAN

    def near(self, leaf: int) -> np.ndarray:
        """Leaves up to `leaf` that can hold partners of its points: from the root down, where the bounds allow it."""
        th = self.th
        mine, low, high, free = (x[leaf] for x in self.levels[0])
        nodes = np.arange(self.levels[-1][1].size)
        for k in range(len(self.levels) - 1, -1, -1):
            top, least, most, any_free = self.levels[k]
            nodes = nodes[nodes <= leaf // FAN**k]
            ok = (np.minimum(top[nodes], mine).sum(1, dtype=np.int64) >= th.overlap(least[nodes] + low)) | any_free[nodes] | free
            ok &= (most[nodes] * th.den >= low * th.num) & (high * th.den >= least[nodes] * th.num)
            nodes = nodes[ok]
            if k:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < self.levels[k - 1][1].size]
        return nodes

    def candidates(self, skip):
        """(point, earlier points that its bounds allow), in tree order; skip(i, js) says which pairs are of no use any more."""
        th, size = self.th, self.n.size
        for leaf in range(self.levels[0][1].size):
            i = np.arange(leaf * LEAF, min(size, (leaf + 1) * LEAF))
            j = (self.near(leaf)[:, None] * LEAF + np.arange(LEAF)).ravel()
            j = j[j < i[-1]]
            for at in range(0, j.size, 1024):
                js = j[at : at + 1024]
                open_ = (js[None] < i[:, None]) & ~skip(i[:, None], js[None])
                col = np.flatnonzero(open_.any(0))
                if not col.size:
                    continue
                js, open_ = js[col], open_[:, col]
                for x in np.flatnonzero(open_.any(1)):
                    k = js[open_[x]]
                    k = k[~skip(i[x], k)]
                    need = th.overlap(self.n[i[x]] + self.n[k])
                    ok = (np.minimum(self.vec[i[x]], self.vec[k]).sum(1, dtype=np.int32) >= need) | self.free[i[x]] | self.free[k]
                    k = k[ok & (np.minimum(self.n[i[x]], self.n[k]) >= need)]
                    if k.size:
                        yield int(i[x]), k


class Labels:
    """Which of a few points are joined."""

    def __init__(self, of: np.ndarray):
        self.of = of

    def join(self, i: int, j: int) -> bool:
        a, b = self.of[i], self.of[j]
        if a == b:
            return False
        self.of[self.of == max(a, b)] = min(a, b)
        return True


def candidate_forest(n: np.ndarray, vec: np.ndarray, th: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the graph of all pairs that the bounds allow."""
    if n.size == 2:  # one leaf
        need = th.overlap(n[0] + n[1])
        ok = (vec[:, 0] == FULL).any() or np.minimum(vec[0], vec[1]).sum(dtype=np.int64) >= need
        return [(0, 1)] if ok and n.min() >= need else []
    tree = Tree(n, vec, th)
    joined = Labels(np.arange(n.size))
    out = []
    for i, js in tree.candidates(lambda i, j: joined.of[i] == joined.of[j]):
        for j in js.tolist():
            if joined.join(i, j):
                out.append((int(tree.order[i]), int(tree.order[j])))
    return out


def link_forest(h: np.ndarray, d: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray | None, th: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets (h, d), sorted by (d, h), with n elements each. Sets with equal labels count as
    joined already; with `side`, only pairs of different sides are tried."""
    if n.size == 2:  # one leaf; the counts of two sets take longer than their overlap
        both = np.sort(h)
        apart = label[0] != label[1] and (side is None or side[0] != side[1])
        return [(0, 1)] if apart and int((both[1:] == both[:-1]).sum()) >= th.overlap(h.size) else []
    tree = Tree(n, _counts(h, d, n.size), th)
    joined = Labels(label[tree.order].copy())
    side = None if side is None else side[tree.order]
    if (joined.of == joined.of[0]).all():
        return []
    at = np.append(0, np.cumsum(n))
    order = np.argsort(h)  # shingles as small numbers, in little memory
    rank = np.ones(h.size, np.int32)
    rank[1:] = h[order[1:]] != h[order[:-1]]
    code = np.empty(h.size, np.int32)
    code[order] = np.cumsum(rank, dtype=np.int32) - 1
    del order, rank
    sets = [code[at[k] : at[k + 1]] for k in tree.order.tolist()]
    mark = np.zeros(code.max() + 1, np.uint8)
    out = []

    def skip(i, j):
        off = joined.of[i] == joined.of[j]
        return off if side is None else off | (side[i] == side[j])

    for i, js in tree.candidates(skip):
        mark[sets[i]] = 1
        step = 4
        while js.size:
            now, js = js[:step], js[step:]
            size = tree.n[now]
            both = np.add.reduceat(mark[np.concatenate([sets[j] for j in now.tolist()])], np.cumsum(size) - size, dtype=np.int64)
            for j in now[both >= th.overlap(tree.n[i] + size)].tolist():
                if joined.join(i, j):
                    out.append((int(tree.order[i]), int(tree.order[j])))
            js = js[joined.of[js] != joined.of[i]]
            step = min(256, 2 * step)
        mark[sets[i]] = 0
    return out


def _runs(batches, *key: str):
    """Tables of rows with equal keys, one after the other, from a sorted stream."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch[k]) for k in key]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            name = tuple(c[lo] for c in cols)
            if name != now and held:
                yield now, held
                held = []
            now = name
            held.append(batch.slice(lo, hi - lo))
            yield None, held  # the run goes on: the caller may take what is held
    if held:
        yield now, held


def _found(pairs: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.concatenate(pairs), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])


def _search(batches, th: Threshold, most: int):
    """Reads lists in order, a tree for each; gives a forest of candidate pairs (a < b). The sets of a list of more than `most` are
    all tied to its first one, without a look at the bounds."""
    out: list[np.ndarray] = []
    long = False
    for name, held in _runs(batches, "list"):
        long |= sum(b.num_rows for b in held) > most
        if name is None and not long:
            continue
        t = pa.Table.from_batches(held)
        cls = np.asarray(t["cls"])
        if long:
            out.append(np.stack([np.full(cls.size - 1, cls[0]), cls[1:]], 1))
            held[:] = [held[0].slice(0, 1)]  # never more than that in memory
        elif cls.size > 1:
            vec = np.frombuffer(b"".join(t["vec"].to_pylist()), np.uint8).reshape(-1, GROUPS)
            if p := candidate_forest(np.asarray(t["n"]), vec, th):
                out.append(cls[np.array(p)])
        long &= name is None
        if len(out) > 20_000:
            yield _found([np.sort(x, axis=1) for x in out])
            out.clear()
    if out:
        yield _found([np.sort(x, axis=1) for x in out])


def _verify(batches, size: int, th: Threshold, limit: int):
    """Reads the texts of clusters in order (a row for each set, though rows may repeat); gives a forest of links (a < b)."""
    out: list[np.ndarray] = []
    last = None
    for name, held in _runs(batches, "cluster", "x", "y"):
        if name is None:  # repeated rows stand together
            cls = np.asarray(held[-1]["cls"])
            new = np.ones(cls.size, bool)
            new[1:] = cls[1:] != cls[:-1]
            key = tuple(int(np.asarray(held[-1][k])[0]) for k in ("cluster", "x", "y"))
            new[0] = (key, int(cls[0])) != last
            last = (key, int(cls[-1]))
            held[-1] = held[-1].filter(pa.array(new))
            continue
        t = pa.Table.from_batches(held)
        if t.num_rows < 2:
            continue
        buf, offs = text_buffers(t["text"])
        hs, ds = [], []
        for i, j in row_blocks(offs, limit):
            h, d = shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
            hs.append(h)
            ds.append((d + i).astype(np.int32))
        h, d = np.concatenate(hs), np.concatenate(ds)
        del hs, ds, buf
        cls, side = np.asarray(t["cls"]), np.asarray(t["side"])
        _, label = np.unique(np.asarray(t["label"]), return_inverse=True)
        if p := link_forest(h, d, np.bincount(d, minlength=cls.size), label, side if (side >= 0).any() else None, th):
            out.append(cls[np.array(p)])
        if len(out) > 20_000:
            yield _found([np.sort(x, axis=1) for x in out])
            out.clear()
    if out:
        yield _found([np.sort(x, axis=1) for x in out])


def _elsewhere_keys(batches, parts: int, size: int, limit: int, flush_at: int = 500_000):
    """The shingles of texts (cls, cluster, label) for the part of each, as keys that differ between clusters."""
    held, n_held = [], 0

    def flush():
        key, cls, label = (np.concatenate(x) for x in zip(*held))
        part = (key % U(parts)).astype(np.int64)
        order = np.lexsort((cls, part))
        key, cls, label, part = key[order], cls[order], label[order], part[order]
        rows = []
        for at in np.split(np.arange(key.size), np.flatnonzero(np.diff(part)) + 1):
            first = np.flatnonzero(np.concatenate(([True], np.diff(cls[at]) != 0)))
            n = np.diff(np.append(first, at.size))
            rows.append((3, int(part[at[0]]), np.int64(n.size).tobytes() + pack(cls[at[first]], label[at[first]], n) + key[at].tobytes()))
        return _rows(rows)

    for batch in batches:
        cls, cluster, label = (np.asarray(batch[k]) for k in ("cls", "cluster", "label"))
        buf, offs = text_buffers(batch["text"])
        for i, j in row_blocks(offs, limit):
            h, d = shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
            if h.size:
                held.append((mix(h ^ mix(cluster[i:j].view(U))[d]), cls[i:j][d], label[i:j][d]))
                n_held += h.size
            if n_held >= flush_at:
                yield flush()
                held, n_held = [], 0
    if held:
        yield flush()


def _elsewhere(table: pa.Table) -> pa.Table:
    """One part: how many of its shingles each set shares with sets of another label."""
    keys, sets, labels = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in table["blob"].to_pylist():
        m = int(np.frombuffer(b, np.int64, 1)[0])
        cls, label, n = unpack(b[8 : 8 + 24 * m], np.int64, np.int64, np.int64)
        sets.append(np.repeat(cls, n))
        labels.append(np.repeat(label, n))
        keys.append(np.frombuffer(b, U, -1, 8 + 24 * m))
    key, cls, label = np.concatenate(keys), np.concatenate(sets), np.concatenate(labels)
    order = np.lexsort((cls, label, key))
    key, cls, label = key[order], cls[order], label[order]
    new = np.ones(key.size, bool)  # repeated rows of a set count once
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls, label = key[new], cls[new], label[new]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if key.size else np.zeros(0, np.int64)
    n = np.diff(np.append(at, key.size))
    mixed = label[at] != label[at + n - 1]
    names, count = np.unique(cls[np.repeat(mixed, n)], return_counts=True)
    trim()
    return pa.table({"cls": pa.array(names, pa.int64()), "shared": pa.array(count, pa.int64())})


def block_pairs(rows: DataFrame, low: int, high: int) -> DataFrame:
    """rows (cls, cluster, blocks, block, ...) once for each pair (x, y) of their block with one that is low to high - 1 further on, or
    back, in the ring of their cluster's blocks. Offsets from 1 to blocks // 2 give every pair once."""
    steps = F.filter(F.sequence(F.lit(low), F.lit(high - 1)), lambda k: 2 * k <= F.col("blocks"))
    both = F.array_distinct(F.flatten(F.transform(steps, lambda k: F.array(F.pmod(F.col("block") + k, "blocks"), F.pmod(F.col("block") - k, "blocks")))))
    rows = rows.withColumn("o", F.explode(both))
    return rows.select("*", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), F.col("block").alias("side"))


def _rows_with_components(docs: DataFrame, size: int, num: int, den: int, block_bytes: int, heavy_least: int, heavy_share: int, dense: int, list_max: int, cluster_shingles: int) -> DataFrame:
    """doc_id, tk (hash of the text), n_shingles, component_id for each row of docs."""
    spark = docs.sparkSession
    th = Threshold(num, den)
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    parts = n_parts(docs)
    heavy = heavy_shingles(d.select("text"), size, block_bytes, heavy_least, heavy_share)
    release(spark)
    shared = spark.sparkContext.broadcast(heavy)  # 2 MB at most
    met = d.mapInArrow(lambda it: lean(_profile(it, parts, size, th, block_bytes, shared.value, dense)), _OUT_DDL)
    met = saved(met.groupBy("part").applyInArrow(lambda t: _cells(t, parts), _OUT_DDL), "kind")
    release(spark)
    prof = met.where("kind = 0").select("blob").mapInArrow(_unprofile, "doc_id long, tk long, n long, cls long, vec binary")
    lists = saved(met.where("kind = 1").select("part", "blob").groupBy("part").applyInArrow(_lists, "list long, cls long"))
    ties = met.where("kind = 2").select("blob").mapInArrow(lambda it: lean(forest(_pairs(it))), "a long, b long")
    one = F.min(F.struct("doc_id", "tk")).alias("one")
    classes = saved(prof.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), one, F.first("n").alias("n"), F.first("vec").alias("vec")))

    rows = lists.join(classes.select("cls", "n", "vec"), "cls").select("list", "cls", "n", "vec").repartition(parts, "list").sortWithinPartitions("list")
    near = saved(components(spark, rows.mapInArrow(lambda it: lean(forest(_search(it, th, list_max))), "a long, b long").union(ties), cut=True))
    release(spark)

    # a cluster's sets meet in blocks; a few sets of a cluster of several blocks go to all of them
    blocks = F.greatest(F.ceil(F.sum("n") / cluster_shingles), F.ceil(F.count("*") / list_max)).cast("int").alias("blocks")
    of = near.select(F.col("id").alias("cls"), F.col("component").alias("cluster")).join(classes.select("cls", "one", "n"), "cls")
    big = saved(of.groupBy("cluster").agg(blocks).where("blocks > 1"))
    of = saved(of.join(big, "cluster", "left").withColumn("large", F.col("blocks").isNotNull()).drop("blocks"))

    # the texts come by (doc_id, hash), so that neither null nor repeated ids matter; members follow the corpus, so they are never broadcast
    texts = of.hint("merge").join(d.withColumnRenamed("tk", "d_tk"), F.expr("one.tk <=> d_tk AND one.doc_id <=> doc_id"))
    texts = saved(texts.select("cls", "cluster", "n", "large", "text"), "large")
    release(spark)

    def links(rows: DataFrame) -> DataFrame:
        """rows: cls, cluster, x, y, side, label, text."""
        rows = rows.select("cluster", "x", "y", "cls", "side", "label", "text").repartition(parts, "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "cls")
        return rows.mapInArrow(lambda it: lean(forest(_verify(it, size, th, block_bytes))), "a long, b long")

    def open_sets(rows: DataFrame) -> DataFrame:
        """cls, cluster, n, label of the rows (cls, cluster, n, label, text) that can link to a set with another label in their cluster: so
        many of a set's shingles as a link needs stand in such sets. It takes each text once, however many blocks there are."""
        dealt = rows.select("cls", "cluster", "label", "text").mapInArrow(lambda it: lean(_elsewhere_keys(it, parts, size, block_bytes)), _OUT_DDL)
        shared = dealt.select("part", "blob").groupBy("part").applyInArrow(_elsewhere, "cls long, shared long").groupBy("cls").agg(F.sum("shared").alias("shared"))
        return saved(rows.select("cls", "cluster", "n", "label").distinct().join(shared, "cls").where(f"shared * {den} >= n * {num}").drop("shared"))

    def alone(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.lit(-1).alias("y"), F.lit(-1).alias("side"), F.col("cls").alias("label"))

    small = alone(texts.where("NOT large").withColumn("x", F.lit(0)))
    if big.isEmpty():
        comp = saved(components(spark, links(small), cut=True))
    else:
        kept = open_sets(texts.where("large").withColumn("label", F.col("cls")))
        release(spark)
        kept = kept.join(kept.groupBy("cluster").agg(blocks, F.count("*").alias("sets")), "cluster").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
        kept = saved(kept.select("cls", "blocks", "block", F.expr("blocks > 1 AND pmod(xxhash64(cls, 7), sets) < 16").alias("pilot")))
        at = F.when(F.col("pilot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
        large = texts.where("large").join(kept, "cls")
        found = saved(links(small.unionByName(alone(large.withColumn("x", F.explode(at)).select(*small.columns[:-3])))))
        comp = saved(components(spark, found, cut=True))
        release(spark)

        # pairs of blocks, in clusters that are not yet one component: a few at a time, as each text goes to all blocks in the end
        several = large.where("blocks > 1")
        most = kept.agg(F.max("blocks")).first()[0] or 1
        for low in range(1, most // 2 + 1, OFFSETS):
            label = several.join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
            still = open_sets(label).select("cls", "label")
            if still.isEmpty():
                break
            release(spark)
            found = found.union(saved(links(block_pairs(several.join(still, "cls"), low, low + OFFSETS))))
            comp = saved(components(spark, found, cut=True))
            release(spark)
    release(spark)

    named = classes.select("cls", "least").join(comp.select(F.col("id").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("cls", "component_id")
    every = prof.select("doc_id", "tk", "n", "cls").join(names, "cls", "left")
    out = every.select("doc_id", "tk", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return saved(out)


def jaccard_components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, block_bytes: int = 1 << 20, heavy_least: int = 64, heavy_share: int = 1000, dense: int = 16, list_max: int = 8192, cluster_shingles: int = 3 << 19) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Two documents link when the Jaccard similarity of their sets of `size`-word shingles is num / den or more; a document with
    fewer words has its whole sequence as one shingle; one without words (or a null text) links with nothing. component_id is
    the smallest doc_id reachable by links. Equal sets are one class from the start. Rows that share a doc_id, and repeated rows, are
    rows of their own, judged by their texts; rows with a null doc_id link, but name no component unless all its rows have a null id, where
    it is null. Other columns of docs, whatever their names, are not read. An empty table gives an empty one.

    The other parameters shape the work and never the result: heavy_* which frequent shingles are left out of the first routing keys,
    `dense` and `list_max` how many sets of one key or list are held together, `cluster_shingles` the size of a block of a cluster.
    Shingles and sets are known by 64-bit hashes.
    """
    return _rows_with_components(docs, size, num, den, block_bytes, heavy_least, heavy_share, dense, list_max, cluster_shingles).drop("tk")


def keep_one(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of docs without those that link, directly or over others, to a document with a smaller doc_id. All columns stay.

    Rows are judged one by one: of rows that share a doc_id only those go whose own text links so. A row with a null id goes if it links to a
    row with an id. Repeated rows of a document that stays, and rows whose text is null or without words, stay; an empty table stays empty.
    """
    of = _rows_with_components(docs, size, num, den, 1 << 20, 64, 1000, 16, 8192, 3 << 19)
    gone = of.where("n_shingles > 0 AND component_id IS NOT NULL AND NOT component_id <=> doc_id").select(F.col("doc_id").alias("g_doc"), F.col("tk").alias("g_tk")).distinct()
    return docs.join(gone.hint("merge"), docs.doc_id.eqNullSafe(gone.g_doc) & (F.xxhash64(docs.text) == gone.g_tk), "left_anti")


def brute_force(rows: list[tuple[int, str | None]], size: int = 4, num: int = 85, den: int = 100) -> dict[int, tuple[int, int]]:
    """{doc_id: (set size, component)} by comparing all pairs, for tests."""
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(_FOLD)))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct([array_to_string(w[i : i + least(4, len(w)) - 1], ' ') FOR i IN range(1, greatest(1, len(w) - 3) + 1)]) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (WITH RECURSIVE t(x, c) AS (SELECT x, x FROM l UNION SELECT l.y, t.c FROM t JOIN l ON l.x = t.x) SELECT x, min(c) AS c FROM t GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(r.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id
"""
