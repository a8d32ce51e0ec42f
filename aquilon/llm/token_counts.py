"""Token counts without token ids: pieces are counted once for each distinct pre-token."""

from __future__ import annotations

import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, id_array, id_column, n_parts, saved, text_buffers

#: White space other than blank and newline; a text with it takes the slower cut.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x00]")
_CUT = re.compile(r"(?= \S)")


def pre_tokens(text: str) -> list[str]:
    """Pieces of a text that byte-level BPE with the usual pattern (an optional blank, then
    letters, digits or other signs; runs of white space) encodes alike apart and together.

    A cut before a blank that another sign follows never changes the result: whatever white space
    stands before it forms its own pre-token either way. A lone newline is also a pre-token.
    """
    if _ODD.search(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] == " ":
        return _CUT.split(text)
    return [w for w in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if w]


def _whole(text: str) -> list[str]:
    return [text] if text else []


def cuts_before_blanks(spec: str) -> bool:
    """Whether a tokenizer is byte-level BPE with the usual pattern and changes no text before."""
    t = json.loads(spec)
    kind = t["pre_tokenizer"] or {}
    return t["normalizer"] is None and (kind.get("type"), kind.get("use_regex"), kind.get("add_prefix_space")) == ("ByteLevel", True, False)


_TOKENIZERS: dict[int, object] = {}


def tokenizer(spec: str):
    """The library's tokenizer from the text of its .json file; built once for each worker."""
    key = hash(spec)
    if key not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        _TOKENIZERS[key] = Tokenizer.from_str(spec)
    return _TOKENIZERS[key]


def count_pieces(spec: str, words: list[str]) -> np.ndarray:
    t, out = tokenizer(spec), []
    for i in range(0, len(words), 4096):
        out += [len(e) for e in t.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
    return np.array(out, np.uint32)


def _word_part(w: pa.Array, parts: int) -> np.ndarray:
    """A part by the hash of each word's bytes."""
    buf, offs = text_buffers(w)
    return (Rolling(buf).ranges(offs[:-1], offs[1:]) % np.uint64(parts)).astype(np.int64)


_OUT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("first", pa.int32()), ("data", pa.binary())])
_OUT_DDL = "kind int, part int, block long, first int, data binary"


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays, each with its length, compressed."""
    raw = b"".join(np.int64(a.nbytes).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unzip(blob: bytes, *types) -> list[np.ndarray]:
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    raw, at, out = pa.Codec("zstd").decompress(blob[8:], size, asbytes=True), 0, []
    for t in types:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def _lists(doc: np.ndarray, code: np.ndarray, freq: np.ndarray):
    """Postings sorted by (document, word number) as byte planes of the steps, and frequencies as bytes with the large ones aside."""
    order = np.lexsort((code, doc)) if freq.max(initial=0) >= 1 << 24 or doc.max(initial=0) >= 1 << 16 else None
    if order is None:
        key = np.sort(doc.astype(np.uint64) << np.uint64(48) | code.astype(np.uint64) << np.uint64(24) | freq.astype(np.uint64))
        doc, code, freq = key >> np.uint64(48), (key >> np.uint64(24)) & np.uint64(0xFFFFFF), key & np.uint64(0xFFFFFF)
    else:
        doc, code, freq = doc[order], code[order], freq[order]
    step = code.astype(np.uint32)
    if step.size:
        same = doc[1:] == doc[:-1]
        step[1:] -= np.where(same, code[:-1], 0).astype(np.uint32)
    big = freq >= 255
    return [(step >> np.uint32(8 * b)).astype(np.uint8) for b in range(3)] + [np.where(big, 255, freq).astype(np.uint8), freq[big].astype(np.int64)]


def _blocks(batches, parts: int, limit: int, cut, max_words: int = 2_000_000):
    """For each block of documents: one record of kind 0 with (ids, bytes, distinct counts) of its
    documents and their (word number, frequency) lists, and for each part one of kind 1 with the
    block's distinct pre-tokens that fall in it, sorted; words are numbered by (part, word)."""
    seq, pid = 0, TaskContext.get().partitionId()

    def flush():
        nonlocal seq
        block = (pid << 24) | seq
        seq += 1
        names = pa.array(list(code), pa.large_string()).cast(pa.large_binary())
        part = _word_part(names, parts) if len(names) else np.zeros(0, np.int64)
        order = np.asarray(pc.sort_indices(pa.table({"p": part, "w": names}), sort_keys=[("p", "ascending"), ("w", "ascending")]))
        number = np.empty(order.size, np.int64)
        number[order] = np.arange(order.size)
        doc = np.repeat(np.arange(len(lens)), lens)
        rows = [(0, -1, block, 0, _zip(np.array(ids, np.int64), np.array(sizes, np.int64), np.array(lens, np.int64), *_lists(doc, number[np.array(codes, np.int64)], np.array(freqs, np.int64))))]
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, order.size]):
            if hi > lo:
                w = names.take(pa.array(order[lo:hi]))
                _, offs, data = w.buffers()
                o = np.frombuffer(offs, np.int64)[w.offset : w.offset + len(w) + 1]
                rows.append((1, int(part[order[lo]]), block, int(lo), _zip(np.diff(o).astype(np.uint32), np.frombuffer(data, np.uint8)[o[0] : o[-1]])))
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(r, _OUT)], schema=_OUT)

    ids, sizes, lens, codes, freqs, code, seen = [], [], [], [], [], {}, 0
    for batch in batches:
        for i, text in zip(id_array(batch["doc_id"]).tolist(), batch["text"].to_pylist()):
            text = text or ""
            c = Counter(cut(text))
            ids.append(i)
            sizes.append(len(text.encode()))
            lens.append(len(c))
            codes += [code.setdefault(w, len(code)) for w in c]
            freqs += c.values()
            seen += sizes[-1]
            if seen >= limit or len(code) >= max_words:
                yield from flush()
                ids, sizes, lens, codes, freqs, code, seen = [], [], [], [], [], {}, 0
    if ids:
        yield from flush()


def _pieces(table: pa.Table, spec: str) -> pa.Table:
    """Counts the pieces of each distinct pre-token of one part once; answers every block."""
    sizes, chunks = [], []
    for blob in table["data"].to_pylist():
        n, b = _unzip(blob, np.uint32, np.uint8)
        offs = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        sizes.append(n.size)
        chunks.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n.size, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(b.tobytes())]))
    d = pa.concat_arrays(chunks).dictionary_encode()
    n = count_pieces(spec, d.dictionary.cast(pa.large_string()).to_pylist())
    per = np.split(n[np.asarray(d.indices)], np.cumsum(sizes)[:-1])
    return pa.table({"block": table["block"], "first": table["first"], "n": pa.array([_zip(x.astype(np.uint32)) for x in per], pa.binary())})


def _sum(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums frequency times pieces for each document of a block."""
    known = [(f, _unzip(n, np.uint32)[0]) for f, n in zip(right["first"].to_pylist(), right["n"].to_pylist())]
    pieces = np.zeros(max((f + n.size for f, n in known), default=0), np.int64)
    for f, n in known:
        pieces[f : f + n.size] = n
    ids, sizes, toks = [], [], []
    for blob in left["data"].to_pylist():
        i, s, k, b0, b1, b2, freq, big = _unzip(blob, np.int64, np.int64, np.int64, np.uint8, np.uint8, np.uint8, np.uint8, np.int64)
        ends = np.cumsum(k)
        run = np.cumsum(b0.astype(np.int64) | b1.astype(np.int64) << 8 | b2.astype(np.int64) << 16)
        base = np.concatenate(([0], run))[ends - k]
        freq = freq.astype(np.int64)
        freq[freq == 255] = big
        run = np.concatenate(([0], np.cumsum(pieces[run - np.repeat(base, k)] * freq)))
        ids.append(i)
        sizes.append(s)
        toks.append(run[ends] - run[ends - k])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"doc_id": id_column(cat(ids)), "n_bytes": pa.array(cat(sizes), pa.int64()), "n_tokens": pa.array(cat(toks), pa.int64())})


def token_counts(docs: DataFrame, tokenizer_json: str, block_bytes: int = 20 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs, as the library counts whole texts.

    tokenizer_json: path of a .json file (one that is not byte-level BPE with the usual pattern takes each text as one pre-token); its text (checked: 16 MB at most) travels
    to the executors. Three steps: blocks of documents list each document's distinct
    pre-tokens with frequencies; the distinct pre-tokens of all blocks are dealt by value and each is
    counted once; the counts join each block's lists and are summed. No ids are kept. Null and
    empty texts count 0; repeated rows give a row each; a null doc_id stays null.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 16 << 20:
        raise ValueError("tokenizer file over 16 MB")
    cut = pre_tokens if cuts_before_blanks(spec) else _whole
    d = docs.select("doc_id", "text")
    parts = n_parts(d)
    held = saved(d.mapInArrow(lambda it: _blocks(it, parts, block_bytes, cut), _OUT_DDL), "kind")
    lists = held.where("kind = 0").select("block", "data")
    pieces = held.where("kind = 1").select("part", "block", "first", "data").groupBy("part").applyInArrow(lambda t: _pieces(t, spec), "block long, first int, n binary")
    return lists.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")


def report(docs: DataFrame, tokenizer_json: str, limit: int = 512) -> DataFrame:
    return token_counts(docs, tokenizer_json).withColumn("over_limit", F.col("n_tokens") > limit)
