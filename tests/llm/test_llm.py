"""The training-data operators against brute force, the libraries they stand for, and odd input."""

import itertools
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from aquilon.llm import common, decontaminate, embedding_dedup, language_id, ngram_join, packing, quality, queries, substring_dedup, suffix_dedup, token_counts, url_filter
from oracle import same

BPE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOCS).repartition(parts)


ODD = [(1, None), (2, ""), (3, "one two three"), (4, "a b c d e f g h i j k l"), (4, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (5, " \n\t "), (6, "é" * 50 + " x"), (7, "word " * 30_000)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


# ---------------------------------------------------------------- shared pieces


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in common.components(spark, spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {v: find(v) for v in root}
    assert common.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_rolling_and_minimum():
    b = np.frombuffer(b"abcabcabc", np.uint8)
    w = common.Rolling(b).windows(3)
    assert w[0] == w[3] == w[6] and len(set(w.tolist())) == 3
    x = np.array([5, 3, 4, 1, 9, 2], np.uint64)
    for k in range(1, 8):
        assert common.slide_min(x, k).tolist() == [min(x[i : i + k].tolist()) for i in range(6 - k + 1)]


# ---------------------------------------------------------------- 1


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(150):
        v = base[i % 12] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 0.4])
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[0][1], None), (204, rows[0][1], 0), (205, rows[0][1], 0), (206, [1.0, None], 1), (207, rows[0][1][:8], 0), (5, rows[5][1], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    good = {i: (np.array(v, float), k) for i, v, k in rows if i is not None and v is not None and k is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    link = {i: [j for j, (w, b) in good.items() if j != i and b == k and len(w) == len(v) and embedding_dedup.cosine(v, w) >= 0.93] for i, (v, k) in good.items()}
    comp = {i: i for i, *_ in rows}
    for _ in range(len(rows)):
        comp.update({i: min([comp[i], *(comp[j] for j in js)]) for i, js in link.items()})
    assert len(got) == len({i for i, *_ in rows})
    assert all(got[i] == (len(link.get(i, [])), comp[i], comp[i] == i) for i in comp if i is not None) and got[None] == (0, None, True)


def test_calibration():
    for bits in (0, 5, 12):
        m, need = embedding_dedup.calibrate(0.93, bits, 0.999)
        assert 3 <= need <= m


def test_links_are_found_at_several_sizes(spark):
    """Recall against all pairs about the threshold, with 1, 5 and 7 sign cells before a line; an empty table."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for label, size in enumerate((40, 400, 1500)):
        x = np.repeat(rng.standard_normal((size // 4, 16)), 4, 0)
        x = x / np.linalg.norm(x, axis=1, keepdims=True) + rng.standard_normal(x.shape) * 0.065
        x = x.astype(np.float32).astype(float)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        links = (unit @ unit.T >= 0.93).sum(1) - 1
        for v, n in zip(x.tolist(), links.tolist()):
            want[len(rows)] = n
            rows.append((len(rows), v, label))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(want.values()) > 1000 and all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.999 * sum(want.values())
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


# ---------------------------------------------------------------- 2


def test_urls(spark):
    urls = ["http://www.Example.com/en/x", "http://example.com/en/", "https://sub.example.com/en", "http://a.net/es/1?q#f", "http://net/fr/", "noscheme", None, "http://", "http://x.com?/en/", "http://xcom/", "http://a.com./", "ftp://B.COM/", "http://www.example.com:80/en/", "http://é.com/ü"] * 3
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit(1))
    rules = url_filter.RULES + [("com", "/", "allow"), ("é.com", "/ü", "block")]
    got = {r.page_id: r for r in url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[1], best[2])
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert url_filter.judge(df, spark.createDataFrame([], "host string, path string, verdict string")).where("rule IS NULL").count() == len(urls)


# ---------------------------------------------------------------- 3 and 8


def _texts():
    rng = random.Random(4)
    bits = [" ", " ", "\n", "a", "word", "Être", "\t", "'s", "1", "!", " ", "<|endoftext|>", "don't", "　", "é", ".", ",,"]
    return ["".join(rng.choice(bits) for _ in range(60)) for _ in range(300)] + ["x  y", " lead", "trail ", "\n\n", "a \n b", "<|endoftext|>"]


def test_token_counts(spark):
    tok = token_counts.tokenizer(open(BPE, encoding="utf-8").read())
    rows = list(enumerate(_texts())) + [(1000, None), (1001, ""), (3, "again"), (3, "again"), (None, "null id")]
    got = token_counts.report(docs(spark, rows).withColumn("part", F.lit(1)), BPE)
    want = Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False)), len(tok.encode(t or "", add_special_tokens=False)) > 512) for i, t in rows)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
    assert token_counts.report(docs(spark, []), BPE).count() == 0


def test_packing(spark):
    tok = token_counts.tokenizer(open(WORDS, encoding="utf-8").read())
    rows = list(enumerate(_texts())) + [(1000, None), (1001, ""), (1002, "w x " * 5000), (1003, "w x " * 5000), (3, "again"), (3, "again"), (None, "x")]
    got = packing.pack_documents(docs(spark, rows).withColumn("length", F.lit("clash")), WORDS).collect()
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            p = np.array(ids[at : at + 4096], "<u4")
            want.append((i, k, at, p.size, zlib.crc32(p.tobytes())))
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // 4096) + 1
    assert packing.pack_documents(docs(spark, []), WORDS).count() == 0


def test_ids_of_two_tokenizers():
    texts = [t.encode() for t in _texts()] + ["Hello <|endoftext|> ABC d'où ÀÉß ﬁ 12-3 (x),".encode()]
    for path in (WORDS, BPE, WORDS):
        spec = open(path, encoding="utf-8").read()
        want = [token_counts.tokenizer(spec).encode(t.decode(), add_special_tokens=False).ids for t in texts]
        assert packing.parts_at_spaces(spec) == (path == WORDS) != token_counts.cuts_before_blanks(spec)
        few = packing.Encoder(spec, keep=10)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(spec).block(texts)] == want == [np.frombuffer(x, "<u4").tolist() for x in few.block(texts)]


def test_plan_is_whole_and_tight():
    rng = random.Random(6)
    for k in range(200):
        c = dict(Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 60))))
        p = packing.plan(c, 30)
        seen = Counter()
        for n, items in p:
            assert n > 0 and sum(items) <= 30
            for w in items:
                seen[w] += n
        assert seen == Counter(c) and sum(n for n, _ in p) <= 1.25 * packing.lower_bound(c, 30) + 1
        places = list(packing.slots(p))
        assert len({(seq + j, at) for _, _, n, seq, at in places for j in range(n)}) == sum(c.values())
    assert packing.plan({20: 2, 15: 2, 3: 1}, 30) and packing.plan({30: 4}, 30) == [(4, [30])]
    with pytest.raises(ValueError):
        packing.plan({31: 1}, 30)


def test_plan_looks_past_used_up_lengths():
    # 10 and 10 fill a sequence; beside 3 both 1 and 11 fit then, so none of them is fixed to it alone
    p = packing.plan({11: 1, 10: 2, 3: 1, 1: 1}, 20)
    assert sum(n for n, _ in p) == 2 and sorted(w for n, x in p for w in x * n) == [1, 3, 10, 10, 11]


# ---------------------------------------------------------------- 4 and 5


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_suffixes(spark, block):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(60):
        x = list("".join(rng.choice(base)[a : a + rng.randint(50, 300)] for a in (rng.randint(0, 150), rng.randint(0, 150))))
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = "é"
        rows.append((i, "".join(x)))
    rows += [(200, None), (201, ""), (202, "ab" * 300), (203, "x" * 100), (204, "x" * 99), (205, "x" * 101), (206, base[0] * 5)]
    want = suffix_dedup.brute_force(rows)
    got = suffix_dedup.remove_repeats(docs(spark, rows).withColumn("bucket", F.lit(9)), keep_text=True, block_bytes=block).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all(len(r.kept) == r.n_bytes - r.n_removed == r.n_bytes - sum(s.end - s.start for s in r.spans) for r in got)


def test_suffixes_odd(spark):
    got = suffix_dedup.report(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.n_removed == 0 for r in got if r.doc_id != 7)
    assert suffix_dedup.report(docs(spark, [])).count() == 0


def test_units(spark):
    a = "This is the first line of a passage that repeats. And here is its second sentence, long enough.\n"
    rows = [(1, a + "Only here stands this sentence of its own."), (2, "Another beginning which nobody else has. " + a), (3, "this IS the first line, of a passage that repeats and here\nShort. Short. Short."), (4, "Short. Short."), (5, None), (6, "")]
    got = {r.doc_id: r for r in substring_dedup.report(docs(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == "Another beginning which nobody else has. " and [tuple(s) for s in got[2].removed] == [(41, 41 + len(a))]
    assert got[3].text == rows[2][1] and got[4].text == "Short. Short." and got[5].text is None and got[6].text == ""
    odd = substring_dedup.report(docs(spark, ODD)).collect()
    assert len(odd) == len(ODD) and Counter(r.doc_id for r in odd) == Counter(i for i, _ in ODD)
    assert substring_dedup.report(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup_units(docs(spark, rows).withColumn("removed", F.lit(1)))
    kept = substring_dedup.dedup_units(docs(spark, rows).withColumn("part", F.lit("x")).withColumn("_bucket", F.lit("y")))
    assert kept.count() == 6 and kept.where("part = 'x' AND _bucket = 'y'").count() == 6


def test_units_by_brute_force(spark):
    rng = random.Random(9)
    sent = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 60))) + "." for _ in range(40)]
    rows = [(i, "".join(rng.choice(sent) + rng.choice([" ", "\n", " "]) for _ in range(rng.randint(1, 12)))) for i in range(50)]
    seen, want = set(), {}
    for i, t in rows:
        parts, at = [], 0
        for k in range(1, len(t) + 1):
            if k == len(t) or t[k - 1] == "\n" or (t[k - 1].isspace() and k > 1 and t[k - 2] == "."):
                parts.append(t[at:k])
                at = k
        norm = ["".join(c for c in p.lower() if c.isalnum()) for p in parts]
        dup = []
        for n in norm:
            dup.append(bool(n) and n in seen)
            seen.add(n)
        gone = substring_dedup.removed_runs(np.array([len(n) for n in norm]), np.array(dup), 50, 30)
        want[i] = "".join(p for p, g in zip(parts, gone) if not g)
    assert {r.doc_id: r.text for r in substring_dedup.report(docs(spark, rows)).collect()} == want


def test_short_lines_and_verse(spark):
    verse = "".join(f"{a} {b} {c}. " for a in "abcd" for b in ("of", "to") for c in ("x1", "y2", "z3")).rstrip()  # 72 words, no unit over 4 bytes
    rows = [(1, "Share this\nFirst text.\n- - -\n"), (2, "Second text.\n share THIS!\n- - -\nHe said: Share this"), (3, "Share this"), (4, "Poem: " + verse), (5, "Another: " + verse + " Its end."), (6, "é\n\nx"), (7, "É\né\ny")]
    want = {**dict(rows), 2: "Second text.\n- - -\nHe said: Share this", 3: "", 5: "Another: a of x1. Its end.", 7: "É\ny"}
    d = common.saved(docs(spark, rows))
    assert {r.doc_id: r.text for r in substring_dedup.report(d, whole_lines=True).collect()} == want
    assert {r.doc_id: r.text for r in substring_dedup.dedup_units(d).collect()} == want


def test_stops_beyond_ascii(spark):
    zh = "这是一个在许多文件中重复出现的很长的段落。它的第二句话也足够长可以单独去掉！"
    ar = "هذه فقرة طويلة تتكرر في كثير من الوثائق؟ "
    rows = [(1, "开头。" + zh + "结尾一"), (2, "另一个开头？" + zh + "结尾二"), (3, "أول؟ " + ar + "نهاية"), (4, "ثان؟ " + ar + "خاتمة")]
    got = {r.doc_id: r.text for r in substring_dedup.report(common.saved(docs(spark, rows))).collect()}
    assert got == {**dict(rows), 2: "另一个开头？结尾二", 4: "ثان؟ خاتمة"}
    # a blank at the start of a text does not follow the stop at the end of the text before
    b = ["One.", " two. Three", "四。", " five"]
    offs = np.cumsum([0] + [len(x.encode()) for x in b])
    assert substring_dedup.units(np.frombuffer("".join(b).encode(), np.uint8), offs)[0].tolist() == [0, 4, 10, 15, 21]


# ---------------------------------------------------------------- 6 and 9


def test_automaton():
    rng = random.Random(1)
    s = np.array([rng.randrange(1, 4) for _ in range(200)], np.int32)
    text = "".join(map(str, s))
    a = language_id.Automaton(s, 5)
    for _ in range(50):
        q = [rng.randrange(1, 5) for _ in range(40)]
        n, i, cur = 1, 0, ""
        while i < len(q):
            if cur + str(q[i]) in text:
                cur += str(q[i])
            else:
                n, cur = n + 1, str(q[i]) if str(q[i]) in text else ""
            i += 1
        assert a.phrases(np.array([q], np.int32).T)[0] == n


def test_language(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = docs(spark, ODD).withColumn("lang", F.lit("en")).withColumn("held_out", F.lit(3))
    rows = language_id.identify(odd).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 5)} == {"und"} and not next(r for r in rows if r.doc_id is None).held_out
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(odd.where("false")).count() == 0


def test_language_without_letters(spark):
    train = [(i, "the cat sat on the mat and slept " * 5) for i in range(20)]
    d = docs(spark, train + [(100, "😀😀😀"), (101, "12 !? 😀"), (102, "𝔱𝔥𝔢"), (0, "the dog")]).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(d).collect()}
    assert got[100] == got[101] == "und" and got[102] == got[1] == "en"


def test_language_of_many_scripts():
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    text = lambda first: "".join(chr(first + ord(c) - 97) if c != " " else c for c in " ".join(rng.choice(plain) for _ in range(300)))
    starts = {"el": 0x3B1, "hy": 0x561, "ka": 0x10D0, "ko": 0xAC00, "zh": 0x4E00, "zz": 0x20000}
    samples = {k: text(v) for k, v in starts.items()} | {"en": " ".join(chr(c) * 900 for c in range(0x430, 0x460)), "ja": "".join(map(chr, range(0x5000, 0x5200)))}
    m = language_id.Model(samples)
    assert m.predict([text(v)[:400] for v in starts.values()])[0] == list(starts) and m.predict([samples["ja"][:90]])[0] == ["ja"]
    assert len({m.encode(c).tobytes() for c in set("".join(samples.values()).replace(" ", ""))}) == len(set("".join(samples.values())) - {" "})


def test_language_by_plain_parsing(spark, sf):
    """The same answers from substring search in the samples."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500")
    plain = lambda t: " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + " " * (not t[-1].isalpha())
    samples = {k: plain(t) for k, t in language_id.training_sample(d).items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(d).collect()}
    tried = [(r.doc_id, plain(r.text)) for r in d.orderBy("doc_id").limit(40).collect() if any(c.isalpha() for c in r.text or "")]
    assert len(tried) > 20 and len(samples) > 1
    for i, t in tried:
        cost = {}
        for lang, sample in samples.items():
            n = 0
            for at in range(0, len(t), language_id.SEGMENT):
                n, cur = n + 1, ""
                for c in t[at : at + language_id.SEGMENT]:
                    if cur + c in sample:
                        cur += c
                    else:
                        n, cur = n + 1, c if c in sample else ""
            cost[lang] = n * np.log2(len(sample) + 2)
        best, second = sorted(cost.items(), key=lambda x: (x[1], x[0]))[:2]
        assert got[i][0] == best[0] and abs(got[i][1] - (1 - best[1] / second[1])) < 1e-9


def test_quality_by_plain_densities(spark, sf):
    """The same scores from covariances and densities as textbooks write them."""
    sf = sf.replace("sf0.001", "sf0.01")  # the least table has too few labels of a class
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: np.array(quality.features(r.text)) for r in d.select("doc_id", "text").collect()}
    learned = [(texts[r.doc_id], r.quality) for r in lab.collect() if r.doc_id in texts and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x = {k: np.array([f for f, q in learned if q == k]) for k in (0, 1)}
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = sum(len(x[k]) * cov[k] for k in x) / len(learned)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    log = {}
    for k in x:
        c = (0.9 * cov[k] + 0.1 * pooled) / np.outer(scale, scale)
        c = 0.99 * c + 0.01 * (np.trace(c) / len(c) + 1e-6) * np.eye(len(c))
        far = {i: (f - x[k].mean(0)) / scale for i, f in texts.items()}
        log[k] = {i: np.log(len(x[k]) / len(learned)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * f @ np.linalg.solve(c, f) for i, f in far.items()}
    for r in quality.score(d, lab).collect():
        want = 1 / (1 + np.exp(np.clip(log[0][r.doc_id] - log[1][r.doc_id], -700, 700)))
        assert abs(r.score - want) < 1e-5


def test_quality(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(d, lab).join(lab, "doc_id").where("held_out").collect()
    assert len({r.score for r in got}) > 10 and np.mean([r.quality == r.predicted for r in got]) >= 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    odd = docs(spark, ODD).withColumn("f", F.lit("clash"))
    rows = quality.score(odd, lab).collect()
    assert len(rows) == len(ODD)
    none = quality.score(odd, lab.where("false")).collect()
    assert {r.score for r in none} == {0.5} and quality.accept(odd, lab.where("false")).count() == len(ODD)
    assert quality.score(odd.where("false"), lab).count() == 0 and quality.accept(odd, lab).columns == odd.columns


def test_quality_reads_texts_in_slices():
    rng = random.Random(3)
    texts = [None, "", *(" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=900)) for _ in range(1500)), "é" * 3_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    assert [b.num_rows for b in common.text_slices([batch, batch.slice(0, 0), batch.slice(1, 1)], 8 << 20)] == [len(texts) - 1, 1, 1]
    rest, none = batch.slice(0, len(texts) - 1), quality.Discriminant({})  # 7.5 MB of text; all scores are 0.5
    tracemalloc.start()
    for made in (quality._features, lambda batches: quality._accepted(batches, none)):
        ids = []
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        for b in made([rest]):
            ids += b["doc_id"].to_pylist()
        assert ids == list(range(len(texts) - 1)) and tracemalloc.get_traced_memory()[1] - before < 4 << 20
    tracemalloc.stop()


# ---------------------------------------------------------------- 7


def test_decontamination(spark):
    rng = random.Random(8)
    vocab = ["alpha", "beta", "c", "dd", "été", "x1", "zz"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 5, 9, 10, 11, 14, 30, 0])] + [(3, "beta c"), (None, "zz zz zz alpha x1"), (50, None)]
    rows = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = (rng.choice(items)[1] or "").split()
        rows.append((i, rng.choice([" ", "-", ". "]).join(w).upper() if i % 2 else " ".join(w)))
    rows += [(100, None), (101, ""), (102, "---")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(None if i is None else str(i), t) for i, t in items]
    for chunk in (1 << 20, 60):
        got = decontaminate.contaminated_words(docs(spark, rows).withColumn("items", F.lit(0)), bench, 10, chunk).collect()
        assert len(got) == len(rows)
        for r in got:
            t = dict(rows)[r.doc_id]
            n, hit, _, _ = decontaminate.brute_force(t, [(str(k), v) for k, v in items])
            found = decontaminate.brute_force(t, [(k, v) for k, v in named if k is not None])[2]
            assert (r.n_words, sum(s.end - s.start for s in r.spans), len(r.items)) == (n, hit, found)
        clean = {r.doc_id for r in decontaminate.clean(docs(spark, rows), bench, 10, chunk).collect()}
        assert clean == {r.doc_id for r in got if not r.spans}
    assert decontaminate.report(docs(spark, []), bench).count() == 0
    assert decontaminate.report(docs(spark, rows), bench.where("false")).where("contaminated").count() == 0


def test_decontamination_keeps_repeated_rows(spark):
    text = "zero one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(i, " ".join(text.split()[i : i + 4])) for i in range(8)] + [(9, "five six seven eight"), (None, "zero one")], "item_id long, text string")
    rows = [(1, text), (1, text), (1, "other"), (None, text), (None, text), (2, None), (2, None), (3, "one two three four")]
    one, many = (sorted((repr(r.doc_id), r.n_words, [tuple(s) for s in r.spans], r.items) for r in decontaminate.contaminated_words(docs(spark, rows), bench, 10, c).collect()) for c in (1 << 20, 40))
    assert len(one) == len(rows) and one == many


# ---------------------------------------------------------------- 10


def test_jaccard(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (1, 3, 4, 6, 9, 15, 30, 60, 150, 400)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w).upper() if i % 5 == 0 else " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \t")]
    want = ngram_join.brute_force(rows)
    got = ngram_join.jaccard_components(docs(spark, rows).withColumn("cls", F.lit(1))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    kept = {r.doc_id for r in ngram_join.keep_one(docs(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_routes_lose_no_pair():
    rng = np.random.default_rng(3)
    th = ngram_join.Threshold(85, 100)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        cut = int(rng.integers(0, max(1, a.size // 8) + 1))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, max(1, a.size // 12) + 1))).astype(np.uint64)]))
        if not b.size:
            continue
        same_ = np.intersect1d(a, b).size
        if 100 * same_ < 85 * (a.size + b.size - same_):
            continue
        h, d = np.concatenate([a, b]), np.repeat([0, 1], [a.size, b.size])
        heavy = np.sort(rng.choice(h, rng.integers(0, h.size + 1), replace=False)) if rng.random() < 0.5 else np.zeros(0, np.uint64)
        key, doc = ngram_join._routes(h, d, np.array([a.size, b.size]), th, np.unique(heavy))
        assert set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())
        counts = [np.bincount((x >> np.uint64(58)).astype(int), minlength=64) for x in (a, b)]
        assert np.minimum(*counts).sum() >= th.overlap(a.size + b.size)


def test_tree_finds_all():
    rng = np.random.default_rng(2)
    th = ngram_join.Threshold(85, 100)
    size = 1500  # three levels of nodes
    base = rng.integers(0, 6, (5, ngram_join.GROUPS))
    vec = np.maximum(0, base[rng.integers(0, 5, size)] + rng.integers(-1, 2, (size, ngram_join.GROUPS)) * (rng.random((size, ngram_join.GROUPS)) < 0.1)).astype(np.uint8)
    vec[7] = ngram_join.FULL
    n = vec.sum(1, dtype=np.int64)
    n[7] = n[8]
    t = ngram_join.Tree(n, vec, th)
    assert len(t.levels) == 2 and t.levels[-1][1].size <= ngram_join.FAN
    label = rng.integers(0, 7, size)
    got = {tuple(sorted((int(t.order[i]), int(t.order[j])))) for i, js in t.candidates(lambda i, j: label[t.order[i]] == label[t.order[j]]) for j in js}
    want = set()
    for i in range(size):
        bound = np.minimum(vec[i], vec[:i]).sum(1, dtype=np.int64)
        need = th.overlap(n[i] + n[:i])
        ok = ((bound >= need) | (vec[:i, 0] == 255) | (vec[i, 0] == 255)) & (np.minimum(n[i], n[:i]) >= need) & (label[i] != label[:i])
        want |= {(int(j), i) for j in np.flatnonzero(ok)}
    assert got == want


def test_alike_below_the_threshold_gives_no_rows():
    """5,000 sets alike but not linked: no link is written, however many pairs are compared; 3,000 linked ones give a forest."""
    rng, th = np.random.default_rng(4), ngram_join.Threshold(80, 100)
    for size, keep, least, most in ((5000, 0.7, 0, 0), (3000, 0.99, 2999, 2999)):
        base = rng.integers(0, 2**63, 120).astype(np.uint64)
        h = np.tile(base, (size, 1))
        gone = rng.random(h.shape) > keep
        h[gone] = rng.integers(0, 2**63, int(gone.sum())).astype(np.uint64)
        h.sort(1)
        found = ngram_join.link_forest(h.ravel(), np.repeat(np.arange(size), 120), np.full(size, 120), np.arange(size), None, th)
        assert least <= len(found) <= most


@pytest.mark.parametrize("how", [{"heavy_least": 2, "heavy_share": 30, "dense": 3}, {"heavy_least": 3, "heavy_share": 50, "dense": 2, "list_max": 4, "cluster_shingles": 600, "block_bytes": 500}])
def test_jaccard_is_alike_however_split(spark, how):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    line = [" ".join(rng.choice(vocab) for _ in range(9)) for _ in range(5)]
    rows = []
    for _ in range(20):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 12, 40, 150, 400]))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w[rng.randrange(len(w)) : 0] = rng.choice(line).split()
            rows.append((len(rows), " ".join(w)))
    rows += [(600 + k, line[0] + " " + line[1]) for k in range(3)]
    got = ngram_join.jaccard_components(docs(spark, rows), 5, 80, 100, **how).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == ngram_join.brute_force(rows, 5, 80, 100)


@pytest.mark.parametrize("shared", [True, False])
def test_blocks_of_a_cluster_send_texts_a_few_times(spark, tmp_path, monkeypatch, shared):
    """A cluster of 22 blocks whose sets are not linked, with or without shingles of their own: no round sends a text to all pairs of blocks."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, line = [[word() for _ in range(40)] for _ in range(8)], [word() for _ in range(20)]
    texts = [[w for k in c for w in passage[k]] if shared else line + [word() for _ in range(100)] for c in itertools.combinations(range(8), 3)]
    texts += [[*t[:90], "new", *t[91:]] for t in texts[::9]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    verify, folder = ngram_join._verify, str(tmp_path)

    def counted(batches, *rest):
        def through():
            for b in batches:
                with open(f"{folder}/{TaskContext.get().stageId()}", "a") as f:
                    f.write("x" * b.num_rows)
                yield b

        return verify(through(), *rest)

    monkeypatch.setattr(ngram_join, "_verify", counted)
    got = ngram_join.jaccard_components(docs(spark, rows), 5, 80, 100, heavy_least=1000, dense=2, list_max=8, cluster_shingles=300).collect()
    want = ngram_join.brute_force(rows, 5, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len({c for _, c in want.values()}) == 56
    sent = [f.stat().st_size for f in tmp_path.iterdir()]
    assert max(sent) <= 2 * ngram_join.OFFSETS * len(rows) if shared else sum(sent) < 2 * len(rows)


@pytest.mark.parametrize("how", [{}, {"heavy_least": 1000, "dense": 2, "list_max": 8, "cluster_shingles": 300}])
def test_one_python_worker_a_task(spark, monkeypatch, how):
    """No table of the join is written by tasks that feed one Python function from another: each would hold two workers."""
    apart = {"RepartitionByExpression", "Aggregate", "Join", "FlatMapGroupsInArrow"}
    most = []

    def workers(node) -> int:
        name, below = node.nodeName(), node.children()
        under = 0 if name in apart else max([workers(below.apply(k)) for k in range(below.size())], default=0)
        return under + ("InArrow" in name)

    def seen(df, *by, write=common.saved):
        most.append(workers(df._jdf.queryExecution().optimizedPlan()))
        return write(df, *by)

    monkeypatch.setattr(common, "saved", seen)
    monkeypatch.setattr(ngram_join, "saved", seen)
    rng = random.Random(11)
    passage = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(6)]
    texts = [[w for k in c for w in passage[k]] for c in itertools.combinations(range(6), 3)]
    rows = [(k, " ".join(t)) for k, t in enumerate([*texts, *([*t[:90], "new", *t[91:]] for t in texts[::3])])]
    got = ngram_join.jaccard_components(docs(spark, rows), 5, 80, 100, **how).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == ngram_join.brute_force(rows, 5, 80, 100)
    assert max(most) == 1


def test_pairs_of_blocks_meet_once(spark):
    made = spark.createDataFrame([(n, b) for n in range(2, 12) for b in range(n)], "blocks int, block int")
    met = Counter()
    for low in range(1, 6, ngram_join.OFFSETS):
        met.update((r.blocks, r.x, r.y, r.side) for r in ngram_join.block_pairs(made, low, low + ngram_join.OFFSETS).collect())
    assert met == Counter((n, x, y, b) for n in range(2, 12) for x in range(n) for y in range(x + 1, n) for b in (x, y))


def test_keep_one_judges_rows(spark):
    same, own = "one two three four five six seven", "a text of its own that nobody else has"
    rows = [(3, same), (7, same), (7, own), (7, own), (None, same), (None, own + " but null"), (9, None), (-(2**63), "least id of all there are")]
    kept = ngram_join.keep_one(docs(spark, rows).withColumn("g_tk", F.lit(1)).withColumn("cls", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "g_tk", "cls"]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(rows) - Counter([(7, same), (None, same)])
    got = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs(spark, rows)).collect()}
    assert got == {(3, 3), (7, 3), (7, 7), (None, 3), (None, None), (9, 9), (-(2**63), -(2**63))}


def test_parts_follow_what_is_read(spark, sf):
    made = docs(spark, [(1, "x")])
    read = spark.read.parquet(f"{sf}/documents.parquet")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.n_parts(made) == common.n_parts(made.join(made, "doc_id")) == least
    assert common.n_parts(read) == common.n_parts(read.join(read.select("doc_id"), "doc_id")) == least


def test_jaccard_odd(spark):
    got = ngram_join.jaccard_components(docs(spark, ODD)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
    assert {r.component_id for r in got if r.doc_id in (4, None)} == {4}
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = common.saved(stage(spark, d, sf))
        assert out.columns == d.columns and 0 < out.count() <= d.count(), name
        if name == "quality_classifier":
            lab = spark.read.parquet(f"{sf}/labels.parquet")
            clean = lab.where("quality = 1").join(d, "doc_id").count()
            assert out.join(lab.where("quality = 1"), "doc_id").count() >= 0.97 * clean
        elif name == "ngram_jaccard_join":
            rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
            want = ngram_join.brute_force(rows, 5, 80, 100)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if c == i}
        elif name == "benchmark_decontamination":
            assert not decontaminate.report(out, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count()
        d = out
    packed = P.STAGES[-1][1](spark, d, sf)
    assert packed.select("doc_id").distinct().count() == d.count()
    odd = docs(spark, ODD).withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(1).cast("long"))
    for _, stage in P.STAGES:
        out = stage(spark, odd.withColumn("removed", F.lit(1)), sf)
        assert 0 < out.count() <= len(ODD) + 30_000 // 4096 + 1 and stage(spark, odd.where("false"), sf).count() == 0


def test_near_duplicate_stage(spark, sf):
    import corpus_pipeline as P

    rng = random.Random(12)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (5, 8, 50, 51, 120, 300)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        if i % 3 == 0:
            w += [f"x{rng.randrange(5000)}" for _ in range(int(len(w) * rng.choice([0.1, 0.2, 0.3])))]
        for _ in range(rng.choice([0, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"y{rng.randrange(5000)}"
        rows.append((i, " ".join(w)))
    want = ngram_join.brute_force(rows, 5, 80, 100)
    kept = {r.doc_id for r in P.near_duplicate_stage(spark, common.saved(docs(spark, rows)), sf).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}
    assert kept < {i for i, (_, c) in ngram_join.brute_force(rows).items() if c == i}
