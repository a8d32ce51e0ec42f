"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_slices

#: A-Z to a-z; every other ASCII byte that is no digit or a-z parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_SCHEMA = "doc_id long, text_key long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words: runs of digits, lower-cased letters and non-ASCII characters."""
    return text.encode().translate(_FOLD).split() if text else []


def windows(ws: list[bytes], n: int) -> list[list[bytes]]:
    if not ws:
        return []
    return [ws[i : i + n] for i in range(max(1, len(ws) - n + 1))]


class WuManber:
    """Patterns of similar length. Only their first m bytes (m: the shortest length) are scanned:
    `shift` says how far a block of `b` bytes lets the scan jump, `bucket` gives the patterns
    whose m-byte head ends in the block, and a direct comparison confirms the whole pattern."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.b = b = 10 if m >= 30 else max(1, m // 3)
        self.default = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[int]]] = {}
        self.patterns = patterns
        for i, p in enumerate(patterns):
            for j in range(b, m + 1):
                block = p[j - b : j]
                if self.shift.get(block, m) > m - j:
                    self.shift[block] = m - j
            self.bucket.setdefault(p[m - b : m], {}).setdefault(p[:m], []).append(i)

    def find(self, text: bytes):
        """(start, pattern number) of every occurrence, by start."""
        m, b, shift, default, end = self.m, self.b, self.shift, self.default, len(text)
        at = m
        while at <= end:
            s = shift.get(text[at - b : at], default)
            if s:
                at += s
                continue
            heads = self.bucket[text[at - b : at]]
            for i in heads.get(text[at - m : at], ()):
                if text.startswith(self.patterns[i], at - m):
                    yield at - m, i
            at += 1


class Matcher:
    """The windows of benchmark items, grouped by length so that short ones don't shorten the jumps of long ones."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        owner: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(words(text), window):
                owner.setdefault(b" " + b" ".join(w) + b" ", set()).update([item] if item is not None else [])
        groups: dict[int, list[bytes]] = {}
        for p in owner:
            groups.setdefault(0 if len(p) >= 36 else len(p).bit_length(), []).append(p)
        self.owner = owner
        self.groups = [WuManber(ps) for ps in groups.values()]

    def scan(self, text: str | None):
        """Number of words, hit word spans [start, end) merged, and items with occurrences."""
        ws = words(text)
        if not ws:
            return 0, [], []
        line = b" " + b" ".join(ws) + b" "
        spans, found = [], set()
        for g in self.groups:
            counted = at = 0
            for start, i in g.find(line):
                counted += line.count(b" ", at, start)
                at = start
                p = g.patterns[i]
                spans.append((counted, counted + p.count(b" ") - 1))
                found |= self.owner[p]
        return len(ws), _merge(spans), sorted(found)


_MATCHERS: dict[int, Matcher] = {}


def _matcher(held, window: int) -> Matcher:
    if held.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[held.id] = Matcher(held.value, window)
    return _MATCHERS[held.id]


def _scan(batches, held, window, last):
    """Adds the finds of one chunk to those of the chunks before; the last chunk drops the text."""
    m = _matcher(held, window)
    for batch in batches:
        rows = [m.scan(t) for t in batch["text"].to_pylist()]
        if "n_words" in batch.schema.names:
            before = zip(batch["spans"].to_pylist(), batch["items"].to_pylist())
            rows = [(n, _merge([*([x["start"], x["end"]] for x in s), *spans]), sorted({*i, *items})) for (n, spans, items), (s, i) in zip(rows, before)]
        text = [] if last else [batch["text"]]
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"].cast(pa.int64()), batch["text_key"], pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in r[1]] for r in rows], _SPANS),
                pa.array([r[2] for r in rows], pa.list_(pa.string())), *text,
            ],
            ["doc_id", "text_key", "n_words", "spans", "items", *["text"] * len(text)],
        )


class _Held:
    """A broadcast with an id that workers can key their built matcher by."""

    def __init__(self, broadcast):
        self.id, self._b = broadcast._jbroadcast.id(), broadcast

    @property
    def value(self):
        return self._b.value

    def __reduce__(self):
        return _rebuild, (self.id, self._b)


def _rebuild(i, b):
    h = _Held.__new__(_Held)
    h.id, h._b = i, b
    return h


def _chunks(docs: DataFrame, benchmark: DataFrame, chunk_bytes: int):
    """The benchmark's (item_id, text) rows as broadcasts of about chunk_bytes of text each."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = -(-(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes) or 1
    for k in range(n):
        items = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield _Held(docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.collect()]))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The rows of docs without any occurrence of a benchmark window, all columns kept; nothing is shuffled. Rows with a
    null or wordless text stay, repeated rows are judged each; an empty benchmark, or one without words, takes nothing."""
    for held in _chunks(docs, benchmark, chunk_bytes):

        def keep(batches, held=held):
            m = _matcher(held, window)
            for batch in text_slices(batches):
                yield batch.filter(pa.array([not m.scan(t)[1] for t in batch["text"].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(lambda it, keep=keep: lean(keep(it)), docs.schema)
    return docs


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 10, chunk_bytes: int = 1 << 20) -> DataFrame:
    """One row for each row of docs: doc_id, text_key (hash of the text), n_words, spans of hit
    words, items with occurring windows.

    The benchmark goes to the executors in chunks of about `chunk_bytes` of text (a checked
    bound; one search of each text for each chunk, nothing is shuffled), so neither table needs to fit anywhere. Null texts have no
    words; items without words have no window; rows of one item_id count as one item; an item
    with a null id hits words but is not listed. Repeated rows of docs give a row each; the chunks
    are searched one after another over the same row.
    """
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    chunks = list(_chunks(docs, benchmark, chunk_bytes))
    for k, held in enumerate(chunks, 1):
        last = k == len(chunks)
        d = d.mapInArrow(lambda it, held=held, last=last: _scan(it, held, window, last), _SCHEMA + ("" if last else ", text string"))
    return d


def _merge(spans):
    """Spans in order, those that meet or overlap joined."""
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The digest of contaminated_words(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return contaminated_words(docs, benchmark, window).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = 10):
    """(n_words, n_hit, n_items, digest) by comparing every window with every place, for tests."""
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        for w in windows(words(t), window):
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[i : i + least(10, len(w)) - 1], ' ') FOR i IN range(1, greatest(1, len(w) - 9) + 1)]) AS pat FROM b WHERE len(w) > 0
), q AS (SELECT DISTINCT n FROM p), dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[j : j + n - 1], ' ') FOR j IN range(1, len(w) - n + 2)]) AS pat FROM d, q WHERE len(w) >= n
), m AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN p ON dw.pat = p.pat AND dw.n = p.n),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
