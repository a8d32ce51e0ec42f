"""Best-fit packing of tokenised documents, after a Martello-Toth dominance reduction."""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, row_blocks, saved, text_buffers
from .token_counts import tokenizer

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
_ENCODERS: dict[int, "Encoder"] = {}  # by the hash of the tokenizer's file


def parts_at_spaces(spec: str) -> bool:
    """Whether a tokenizer folds case, drops white space, and takes letters, and other signs but letters and digits, as runs of their own."""
    t = json.loads(spec)
    folds = t["normalizer"] or {}
    steps = (t["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    first = steps[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return (
        t["model"]["type"] == "BPE" and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in steps[1:]] == [("ByteLevel", False, False)]
        and any(x["type"] == "Lowercase" for x in folds.get("normalizers", [folds]) if x) and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
        and pattern.endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
    )


#: Words that no normalizer changes and that are one pre-token: lower-case letters of one code point each.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
_ASCII = re.compile(rb"[a-z0-9!-&(-/:-@\[-`{-~]+").fullmatch
_RUNS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+").findall
#: The byte-level alphabet: a byte that Latin-1 prints stands for itself, the others for 256 and up, in order.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """Ids of whole texts, 4 little-endian bytes each. Where white space only parts words (`parts_at_spaces`), the ids of the
    runs between ASCII white space are those of the whole text: each distinct run of a block is encoded once, and the ids
    of the first `keep` runs are kept for later blocks (frequent runs come early). Other tokenizers get whole texts."""

    def __init__(self, spec: str, keep: int = 200_000):
        self.tokenizer, self.by_words, self.keep = tokenizer(spec), parts_at_spaces(spec), keep
        self.pieces = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}

    def block(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        runs = [(t if b"<|" in t else t.lower()).split() for t in texts]  # the tokenizer folds case itself, but for special strings
        words = set().union(*runs)
        new = self._encode(words.difference(self.known))
        if len(self.known) < self.keep:
            self.known |= new
            get = self.known.__getitem__
        else:
            get = (new | {w: self.known[w] for w in words.difference(new)}).__getitem__
        return [b"".join(map(get, r)) for r in runs]

    def _encode(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A printable ASCII word without an apostrophe falls into runs of letters, digits and runs of other signs, which are
        pre-tokens; runs of letters go to the library's model alone, all else whole to the library."""
        known, model, pack = self.known, self.pieces, struct.pack
        cut = {w: _RUNS(w) for w in words if not w.isalpha() and _ASCII(w) and b"<|" not in w}
        out: dict[bytes, bytes] = {}
        rest = []
        for w in words.difference(cut).union(*cut.values()) if cut else words:
            if w in known:
                out[w] = known[w]
            elif w.isalpha() and w.islower():
                ids = [x.id for x in model(w.decode())]
                out[w] = pack(f"<{len(ids)}I", *ids)
            elif _PLAIN(w.decode()):
                ids = [x.id for x in model(w.decode("latin-1").translate(_ALPHABET))]
                out[w] = pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(w)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                out[w] = pack(f"<{len(e.ids)}I", *e.ids)
        for w, runs in cut.items():
            out[w] = b"".join([out[r] for r in runs])
        return out


def encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def _cut(batches, spec: str, capacity: int, end_id: int, limit: int = 4 << 20):
    ids_of = encoder(spec)
    tail = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        buf, offs = text_buffers(batch["text"])
        docs = batch["doc_id"].to_pylist()
        for i, j in row_blocks(offs, limit):
            out: list[tuple] = []
            for doc, ids in zip(docs[i:j], ids_of.block([buf[offs[k] : offs[k + 1]].tobytes() for k in range(i, j)])):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Packs a histogram of lengths: [(how many sequences, lengths in one of them)].

    Lengths, not items, are the unit, so the work depends on the capacity only. First the
    dominance reduction: with w the longest left, (a) if nothing fits beside it it stands alone; (b)
    if a length fills it exactly, the two are paired; (c) if no two others fit beside it, it takes
    the longest that fits. Each is optimal whatever the rest. The remainder goes best-fit
    in decreasing order: the open group of sequences with the least room that is enough.
    """
    left = {w: c for w, c in counts.items() if c > 0}
    if any(w > capacity or w < 1 for w in left):
        raise ValueError("a length outside 1..capacity")
    out: list[tuple[int, list[int]]] = []
    small = sorted(left)
    take = lambda w, c: left.__setitem__(w, left[w] - c)
    for w in sorted(left, reverse=True):
        while (c := left[w]) > 0:
            room = capacity - w
            if left.get(room, 0) > (room == w):  # (b)
                n = c // 2 if room == w else min(c, left[room])
                out.append((n, [w, room]))
                take(w, n)
                take(room, n)
                continue
            if any(left[v] == 0 for v in small[:3]):  # used-up lengths don't hide the shortest pieces left
                small = [v for v in small if left[v] > 0]
            low = [v for v in small[:3] if left[v] - (v == w) > 0]
            if not low or low[0] > room:  # (a)
                out.append((c, [w]))
                take(w, c)
                continue
            two = 2 * low[0] if left[low[0]] - (low[0] == w) > 1 else sum(low[:2]) if len(low) > 1 else room + 1
            if two <= room:
                break
            k = bisect_left(small, room + 1) - 1  # (c)
            while k >= 0 and left[small[k]] - (small[k] == w) <= 0:
                k -= 1
            v = small[k]
            n = 1 if v == w else min(c, left[v])
            out.append((n, [w, v]))
            take(w, n)
            take(v, n)
    # best fit of the remainder: room -> groups (number of sequences, lengths as a linked list)
    groups: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, chain: tuple) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((n, chain))

    for w in sorted((w for w in left if left[w] > 0), reverse=True):
        c = left[w]
        while c:
            k = bisect_left(rooms, w)
            if k == len(rooms):
                per = capacity // w
                full, rest = divmod(c, per)
                for n, m in ((full, per), (1, rest)):
                    if n and m:
                        chain: tuple = ()
                        for _ in range(m):
                            chain = (w, chain)
                        put(capacity - w * m, n, chain)
                break
            room = rooms[k]
            n, chain = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(k)
            per = min(room // w, c)
            used = min(n, c // per)
            new = chain
            for _ in range(per):
                new = (w, new)
            put(room - w * per, used, new)
            if n > used:
                put(room, n - used, chain)
            c -= used * per
    for gs in groups.values():
        for n, chain in gs:
            items = []
            while chain:
                items.append(chain[0])
                chain = chain[1]
            out.append((n, items[::-1]))
    return out


def slots(plan_: list[tuple[int, list[int]]]):
    """(length, first rank, number, first sequence, offset) for each place in each group: the pieces of one
    length, ranked, go to consecutive sequences of the group."""
    rank: dict[int, int] = {}
    seq = 0
    for n, items in plan_:
        at = 0
        for w in items:
            r = rank.get(w, 0)
            yield w, r, n, seq, at
            rank[w] = r + n
            at += w
        seq += n


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    return -(-sum(w * c for w, c in counts.items()) // capacity)


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 16 << 20:
        raise ValueError("tokenizer file over 16 MB")
    return docs.select("doc_id", "text").mapInArrow(lambda it: lean(_cut(it, spec, capacity, end_id)), _PIECES)


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    A document is its ids and `end_id`; one longer than `capacity` is cut into pieces of
    `capacity`, the last may be shorter. Only the histogram of lengths (at most `capacity` rows)
    reaches the driver; its plan comes back as slots, a few for each length, which pieces
    meet by (length, rank). A rank is a count of earlier pieces of the length, by hashed salt first,
    so a frequent length is ranked in many tasks. Null texts are empty: one end id. Repeated rows are
    packed each; docs without rows give no rows.
    """
    spark = docs.sparkSession
    p = saved(pieces(docs, tokenizer_json, capacity, end_id))
    salts = min(1 + p.count() // 50_000, 65_536)
    p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = p.groupBy("length", "salt").count()
    base = saved(groups.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", "count", F.coalesce("base", F.lit(0)).alias("base")))
    counts = {r[0]: r[1] for r in base.groupBy("length").agg(F.sum("count")).collect()}
    table = pa.table(list(zip(*slots(plan(counts, capacity)))) or [[]] * 5, schema=pa.schema([(c, pa.int64()) for c in ("length", "first", "number", "sequence", "offset")]))
    s = spark.createDataFrame(table)
    # one row for each (length, salt) holds the slots that its ranks can fall in
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = p.join(base.drop("count"), ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(w) - 1)
    per = s.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "number", "sequence", "offset"))).alias("slots"))
    near = base.join(per, "length").select("length", "salt", F.filter("slots", lambda x: (x["first"] < F.col("base") + F.col("count")) & (x["first"] + x["number"] > F.col("base"))).alias("slots"))
    hit = F.filter("slots", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["number"]))[0]
    return (
        ranked.join(near, ["length", "salt"]).withColumn("slot", hit)
        .select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("slot.sequence") + F.col("rank") - F.col("slot.first")).alias("sequence_id"), F.col("slot.offset").alias("offset"))
    )
