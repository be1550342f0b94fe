"""op2, op4, op5, op7 and op9 against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import packing, registry, simhash, token_cache, topk, warc
from sparkloom.llm.common import Remembered

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, " \t\n "), (5, "don't  stop\n\n now "), (6, "x " * 9000), (7, "Ünïcode ŞΣ é <|endoftext|> 12 3"), (None, "no id here at all"), (8, "a b c d e f g"), (9, "A b\tC d e f g")]


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return ODD + real


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, id string, n long").repartition(3)


def fp(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, docs):
    got = simhash.near_duplicates(frame(spark, docs)).collect()
    prints = [fp(t) for _, t in docs]
    group = list(range(len(docs)))
    for _ in docs:
        new = [min(group[j] for j in range(len(docs)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(docs))]
        if new == group:
            break
        group = new
    low = {}
    for (i, _), g in zip(docs, group):
        low[g] = min([x for x in (low.get(g), i) if x is not None], default=None)
    want = Counter((i, p, low[g]) for (i, _), p, g in zip(docs, prints, group))
    assert Counter((r.id, r.f0 % (1 << 64), r.component) for r in got) == want


def test_links_in_large_and_cut_buckets(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    f = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 63, 100)}
    f = sorted(x - (1 << 64) if x >> 63 else x for x in f)
    nodes = spark.createDataFrame([(x, x) for x in f], "node long, f0 long")
    got = simhash.components(simhash.links(nodes, 1, 2, simhash.exact_bands(2), chunk=16)).collect()
    root = {r.node: r.root for r in got}
    m = (1 << 64) - 1
    for a in f:
        for b in f:
            if ((a ^ b) & m).bit_count() <= 2:
                assert root.get(a, a) == root.get(b, b)
    for a, r in root.items():
        assert r <= a
    links = simhash.links(nodes, 1, 2, simhash.exact_bands(2), chunk=16).collect()
    assert all(((r.u ^ r.v) & m).bit_count() <= 2 for r in links)


@pytest.mark.parametrize("joins,name", [(True, "byte_bpe_50k.json"), (False, "word_bpe_49k.json")])
def test_piece_encoder(docs, joins, name):
    from tokenizers import Tokenizer

    path = registry.tokenizer(name)
    lib = Tokenizer.from_file(path)
    texts = [t or "" for _, t in docs] + ["a ́b", "İΣ ς", "it's 'S", "tab\there x", "a b c", "x\u0085y z", "​ a", "Don’t can't. WORD!! été, É́ ÉTÉ. ß) ﬁ. Ǆ ᾈ, IJ", "a' b's. x.'", "中文字, 日本"]
    texts += ["a\x1cb c", " lead", "trail ", "a\n\nb", "a \nb", "x\u2003y", "\n", " ", "w" * 300 + " end"]
    coder = token_cache.PieceEncoder(path, joins, tuple, lambda parts: [i for p in parts for i in p])
    for _ in range(2):
        for t in texts:
            assert coder.encode(t) == lib.encode(t, add_special_tokens=False).ids, t


def test_the_older_half_is_forgotten():
    asked = []
    known = Remembered(lambda p: asked.append(p) or len(p), 8, 20)
    for _ in range(3):
        assert [known[p] for p in ("a", "bb", "ccc")] == [1, 2, 3]
    assert asked == ["a", "bb", "ccc"]
    for i in range(50):
        assert known[f"w{i}"] == len(f"w{i}") and len(known) + len(known.old) <= 8
    assert known["x" * 21] == 21 and "x" * 21 not in known


def test_counts_and_cache(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = registry.tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))) for i, t in docs)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = token_cache.count_tokens(frame(spark, docs), path, "v1", cache).collect()
        assert Counter((r.id, r.n_bytes, r.n_tokens) for r in got) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in docs}) == stored.select("digest").distinct().count()


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = registry.tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack(frame(spark, docs), path).collect()
    want = Counter()
    for i, t in docs:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            p = ids[a : a + 2048]
            want[i, k, a, len(p), zlib.crc32(p.tobytes())] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seats = {}
    for r in got:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seats.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seats) <= -(-sum(r.length for r in got) // 2048) * 1.05 + 1


def test_packing_reduction_keeps_the_optimum():
    import random

    def optimum(items, c):
        items, best = sorted(items, reverse=True), [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= c and bins[j] not in bins[:j]:
                    bins[j] += items[i]
                    go(i + 1, bins)
                    bins[j] -= items[i]
            go(i + 1, bins + [items[i]])

        go(0, [])
        return best[0]

    rnd = random.Random(1)
    for _ in range(400):
        c = rnd.choice([10, 20, 50])
        items = [rnd.randint(1, c) for _ in range(rnd.randint(0, 9))]
        fixed, rest = packing.reduce_instance(dict(Counter(items)), c)
        assert sum(n for _, n in fixed) + optimum(list(Counter(rest).elements()), c) == optimum(items, c)


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)]) for i in range(230)] + [(300, None), (400, [1.0, None]), (500, [float("nan")] * 16), (600, [float("inf")] * 16), (7, [0.5] * 16), (100, [0.25] * 4), (None, [1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    scores = lambda mine, own: sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in good if i != own)[:10]
    for q in (0, 100, 200):
        want = Counter((n + 1, i, -s) for _, v in [g for g in good if g[0] == q] for n, (s, i) in enumerate(scores(v, q)))
        mine = [r for r in got if r.query_id == q]
        if q != 100:
            assert Counter((r["rank"], r.vec_id, r.score) for r in mine) == want
        else:  # a repeated query: the best of the scores of either
            both = sorted((-s, i) for _, i, s in want.elements())[:10]
            assert [(-r.score, r.vec_id) for r in sorted(mine, key=lambda r: r["rank"])] == both
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_warc(spark):
    rows = [(1, "u", "same"), (5, "u", "same"), (5, "v", "same"), (2, None, None), (3, "a\r\nb", ""), (4, "u", "é\r\n\r\nWARC/1.1 text" * 50), (None, "u", "same"), (None, "u", "lone"), (9, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, sha string")
    index = warc.write_archive(df, warc.table_path(spark, "w"))
    got = Counter(tuple(r) for r in warc.read_archive(index).collect())
    d = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    firsts = {}
    for i, _, t in rows:
        firsts.setdefault(t or "", []).append(i)
    want, seen = Counter(), set()
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        t = t or ""
        head = t not in seen
        seen.add(t)
        want[i, len(t.encode()), d(t), "response" if head else "revisit", None if head else min(x for x in firsts[t] if x is not None)] += 1
    assert got == want
    bundle = index.first().bundle.removeprefix("file://")
    raw = open(bundle, "rb").read()
    assert zlib.crc32(raw) and raw[-4:] == (0x8F92EAB1).to_bytes(4, "little")
    assert warc.archive(df.limit(0)).count() == 0


def brute_top(rows, query, k=10):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, mine in good:
        if query(q):
            for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in good if i != q)[:k]):
                out[q, n + 1, i, -s] += 1
    return out


def test_top_k_ties_and_few(spark):
    rows = [(i, [float(i % 3), 1.0, -0.5]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = topk.top_k(df, F.col("vec_id") < 5)
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows, lambda q: q < 5)
    few = topk.top_k(df.where("vec_id < 4"), F.lit(True)).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in few) == brute_top(rows[:4], lambda q: True) and len(few) == 12


def test_registered_queries(spark):
    """op2, op4, op5, op7 and op9 as registered, columns and all."""
    from tokenizers import Tokenizer

    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet").collect()
    docs = [(r.doc_id, r.text) for r in read("documents")]
    got = registry.op2_simhash(spark, SF).collect()
    prints = [fp(t) for _, t in docs]
    group = [i for i, _ in docs]
    while True:
        new = [min(group[j] for j in range(len(docs)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(docs))]
        if new == group:
            break
        group = new
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{p:016x}", g) for (i, _), p, g in zip(docs, prints, group))

    lib = Tokenizer.from_file(registry.tokenizer("word_bpe_49k.json"))
    want = Counter()
    for i, t in docs:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    packed = registry.op4_packing(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want

    lib = Tokenizer.from_file(registry.tokenizer("byte_bpe_50k.json"))
    counts = Counter((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False)), n > 512) for i, t in docs)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in registry.op7_token_counts(spark, SF).collect()) == counts

    vectors = [(r.vec_id, r.embedding) for r in read("embeddings")]
    got = registry.op5_maxscore(spark, SF).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(vectors, lambda q: q % 100 == 0)

    first, want = {}, Counter()
    pages = sorted((r.page_id, r.html or "") for r in read("pages"))
    for i, t in pages:
        first.setdefault(t, i)
    for i, t in pages:
        own = first[t] == i
        want[i, len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "response" if own else "revisit", None if own else first[t]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in registry.op9_warc(spark, SF).collect()) == want


def test_empty_tables(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet").limit(0), spark.read.parquet(f"{SF}/pages.parquet").limit(0)
    path = registry.tokenizer("byte_bpe_50k.json")
    assert simhash.near_duplicates(docs).count() == packing.pack(docs, path).count() == token_cache.count_tokens(docs, path).count() == warc.archive(pages).count() == 0


def test_a_changed_tokenizer_is_another_version(spark, tmp_path):
    import json

    path = registry.tokenizer("byte_bpe_50k.json")
    other = tmp_path / "byte_bpe_50k.json"
    raw = json.load(open(path))
    raw["model"]["merges"] = raw["model"]["merges"][:100]
    other.write_text(json.dumps(raw))
    docs, cache = frame(spark, [(1, "counted by two tokenizers of one name")]), f"file://{tmp_path}/cache"
    a, b = (token_cache.count_tokens(docs, p, cache_path=cache).first().n_tokens for p in (path, str(other)))
    assert a < b and spark.read.parquet(cache).count() == 2


def test_essential_terms_follow_the_floor():
    rng = np.random.default_rng(5)
    for _ in range(50):
        top = np.sort(rng.integers(0, 1000, 12))[::-1].astype(float)
        bottom = -rng.integers(0, 1000, 12).astype(float)
        for floor in (-np.inf, -1e4, 0.0, 5.0, float(top.sum() // 2), float(top.sum()), 1e6):
            n = topk.essential(top, bottom, floor)
            reach = [bottom[:j].sum() + top[j:].sum() for j in range(13)]
            assert n == 12 if all(x >= floor for x in reach) else reach[n] < floor and all(x >= floor for x in reach[:n])


def test_floor_is_carried_over_blocks():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(3000, 24)) * 1024)
    ids = rng.permutation(3000)
    best, rows = [np.zeros(0)] * 20, []
    for a in range(0, 3000, 500):
        rows += topk.block_topk(x[:20], ids[:20], x[a : a + 500], ids[a : a + 500], 10, best)
    for n, q in enumerate(ids[:20].tolist()):
        want = sorted((-int(s), int(i)) for s, i in zip(x @ x[n], ids) if i != q)[:10]
        assert sorted((-s, v) for own, v, s in rows if own == q)[:10] == want
    assert len(rows) < 20 * 60 * 0.9
