"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_buffers

SEGMENT = 256  # symbols of one parse; every text is parsed whole, in segments
_SPACE, _FLAG = 0, 1 << 30


class Automaton:
    """Suffix automaton of a symbol sequence as one dense table. An entry is the target state times
    the alphabet's size; a missing transition holds the state after restarting at the root, with _FLAG."""

    def __init__(self, seq: np.ndarray, symbols: int):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in seq.tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        pad = symbols  # ends a segment: back to the root without a phrase
        width = symbols + 1
        root = np.zeros(width, np.int32)
        for c, t in nxt[0].items():
            root[c] = t * width
        table = np.tile(root | _FLAG, (len(nxt), 1))
        for s, d in enumerate(nxt):
            table[s, list(d)] = np.array(list(d.values()), np.int32) * width
        table[:, pad] = 0
        self.table, self.bits = table.ravel(), float(np.log2(len(seq) + 2))

    def phrases(self, columns: np.ndarray) -> np.ndarray:
        """Phrases of greedy longest-match parses; columns[j] is symbol j of every segment."""
        s = np.zeros(columns.shape[1], np.int32)
        n = np.ones(columns.shape[1], np.int32)
        for c in columns:
            t = self.table.take(s + c)
            n += t >> 30
            s = t & (_FLAG - 1)
        return n


class Model:
    """Symbols are the `letters` most frequent letters of the samples, one for letters in no sample, and a blank for any run
    of other signs. The samples' further letters are numbers of a head and digits to base 16, 32 more symbols: every
    letter keeps a code of its own, and the tables stay narrow in a corpus of many scripts."""

    def __init__(self, samples: dict[str, str], letters: int = 48):
        seen = Counter(c for t in samples.values() for c in t.lower() if c.isalpha())
        order = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        other, rare = min(letters, len(seen)) + 1, order[letters:]
        self.digits = 1
        while 16**self.digits < len(rare):
            self.digits += 1
        self.head = other + 1
        self.symbols = self.head + 32 * bool(rare)
        code = {c: k + 1 for k, c in enumerate(order[:letters])} | {c: self.symbols + k for k, c in enumerate(rare)}
        self.map = np.full(0x110000, _SPACE, np.int32)
        self.map[:0x40000] = [(code.get(chr(u).lower(), other) if chr(u).isalpha() else _SPACE) for u in range(0x40000)]  # no letters beyond
        for c, k in code.items():
            if ord(c) >= 0x10000:
                self.map[[ord(x) for x in {c, c.upper()} if len(x) == 1]] = k
        self.langs = sorted(samples)
        self.autos = [Automaton(self.encode(samples[k]), self.symbols) for k in self.langs]

    def encode(self, text: str) -> np.ndarray:
        s = self.map[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        keep = s > 0
        keep[1:] |= s[:-1] > 0
        s = s[keep]
        rare = s >= self.symbols
        if not rare.any():
            return s
        n = np.where(rare, self.digits, 1)
        at = np.cumsum(n) - n
        out = np.repeat(s, n)
        for k in range(self.digits):
            digit = (s[rare] - self.symbols) // 16 ** (self.digits - 1 - k) % 16
            out[at[rare] + k] = self.head + 16 * (k > 0) + digit
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language with the fewest phrases times log2(its sample's length), by symbol, and 1 - best / second."""
        seqs = [self.encode(t) for t in texts]
        letters = np.array([bool(s.any()) for s in seqs])
        segs = np.array([-(-s.size // SEGMENT) for s in seqs], np.int64)
        total = np.zeros((len(self.langs), len(texts)))
        if segs.sum() and self.langs:
            grid = np.full(int(segs.sum()) * SEGMENT, self.symbols, np.int32)
            at = 0
            for s, k in zip(seqs, segs.tolist()):
                grid[at : at + s.size] = s
                at += k * SEGMENT
            doc = np.repeat(np.arange(len(texts)), segs)
            rows = grid.reshape(-1, SEGMENT)
            for lo in range(0, len(rows), 4096):
                columns = np.ascontiguousarray(rows[lo : lo + 4096].T)
                for k, a in enumerate(self.autos):
                    total[k] += np.bincount(doc[lo : lo + 4096], a.phrases(columns) * a.bits, len(texts))
        names, scores = [], []
        for i in range(len(texts)):
            if not letters[i] or not self.langs:
                names.append("und")
                scores.append(0.0)
                continue
            order = np.argsort(total[:, i], kind="stable")
            names.append(self.langs[order[0]])
            scores.append(float(1 - total[order[0], i] / total[order[1], i]) if len(order) > 1 else 1.0)
        return names, scores


_MODELS: dict[int, Model] = {}


def _predict(batches, held, block_bytes: int):
    key = hash(tuple(sorted(held.value.items())))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(held.value)
    model = _MODELS[key]
    for batch in batches:
        texts = batch["text"].to_pylist()
        names, scores, i = [], [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < block_bytes):
                size += len(texts[j] or "")
                j += 1
            a, b = model.predict([t or "" for t in texts[i:j]])
            names += a
            scores += b
            i = j
        yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["held_out"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def training_sample(docs: DataFrame, train_chars: int = 24_000, docs_per_lang: int = 48, max_langs: int = 200) -> dict[str, str]:
    """A bounded sample for each language: at most `docs_per_lang` documents in the order of a hash of
    doc_id, and of them, taken one after the other from their beginnings, `train_chars` characters. Only rows with text, lang and crc32(doc_id) mod 5 <> 0."""
    d = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = d.select("doc_id", "lang").withColumn("r", F.row_number().over(w)).where(F.col("r") <= docs_per_lang)
    chosen = {r[0]: r[2] for r in ids.limit(docs_per_lang * max_langs + 1).collect()}
    if len(chosen) > docs_per_lang * max_langs:
        raise ValueError(f"more than {max_langs} languages")
    first = F.min(F.substring("text", 1, train_chars))  # of rows that share a doc_id, one
    rows = d.where(F.col("doc_id").isin(list(chosen))).groupBy("lang", "doc_id").agg(first).collect()
    out: dict[str, str] = {}
    for lang, _, text in sorted(rows, key=lambda r: (r[0], chosen[r[1]], r[2])):
        if any(c.isalpha() for c in text) and len(out.get(lang, "")) < train_chars:
            out[lang] = (out.get(lang, "") + " " + text)[:train_chars]
    return out


def identify(docs: DataFrame, train_chars: int = 24_000, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs.

    A text is cut greedily into the longest phrases that the automaton of a language's sample holds;
    fewer phrases mean that the language explains it better. `und` and 0 where the text is null or has
    no letter, or nothing was learned. Ties go to the first language by name. Repeated rows give
    a row each; held_out is false for a null doc_id, which is never learned from.
    """
    held = docs.sparkSession.sparkContext.broadcast(training_sample(docs, train_chars))
    d = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "text")
    return d.mapInArrow(lambda it: _predict(it, held, block_bytes), "doc_id long, held_out boolean, lang_pred string, score double")
