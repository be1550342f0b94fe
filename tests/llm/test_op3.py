"""op3 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import registry, suffixes


def brute(texts, length):
    where = {}
    raw = [(t or "").encode() for t in texts]
    for d, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            where.setdefault(t[i : i + length], []).append((d, i))
    out = []
    masks = [np.zeros(len(t), bool) for t in raw]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                masks[d][i : i + length] = True
    for t, m in zip(raw, masks):
        kept = bytes(np.frombuffer(t, np.uint8)[~m])
        runs = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum())
        out.append((len(t), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(12) for _ in range(6)]
    docs = [None, "", "a", "z" * 500, "ab" * 90, "same" * 30, "same" * 30, shared[0]]
    for _ in range(60):
        parts = [text(rnd.randint(0, 12))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, 10)
            parts += [s[a : len(s) - rnd.randint(0, 10)], text(rnd.randint(0, 8))]
        docs.append(rnd.choice(["", " "]).join(parts))
    docs += docs[10:14]
    return docs


@pytest.mark.parametrize("length,hot", [(40, 20000), (40, 5), (33, 3), (200, 20000)])
def test_dedup(spark, length, hot):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "d1 int, text string, spans int").repartition(5)
    got = {r[0]: tuple(r)[3:] for r in suffixes.dedup(df, length, hot).collect()}
    for i, want in enumerate(brute(docs, length)):
        assert got[i] == want, (i, docs[i])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter((i, *x) for (i, _), x in zip(docs, brute([t for _, t in docs], 200)))
    assert Counter(tuple(r) for r in registry.op3_suffixes(spark, sf).collect()) == want
    assert suffixes.dedup(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0


@pytest.mark.parametrize("length,gram", [(200, 25), (40, 5), (33, 4), (7, 25), (30, 1)])
def test_refinement(length, gram, monkeypatch):
    monkeypatch.setattr(suffixes, "GRAM", gram)
    rnd = random.Random(length)
    parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(length, 2 * length))) for _ in range(4)]
    raw = b"".join(rnd.choice(parts) + bytes(rnd.choice(b"abc") for _ in range(3)) for _ in range(12)) + b"z" * 3 * length
    starts = np.array(sorted(rnd.sample(range(len(raw) - length + 1), (len(raw) - length) // 2)))
    got = suffixes.refine(np.frombuffer(raw, np.uint8), starts, length)
    strings = [raw[s : s + length] for s in starts.tolist()]
    often = Counter(strings)
    assert all((b >= 0) == (often[s] > 1) for s, b in zip(strings, got.tolist()))
    assert len({(s, b) for s, b in zip(strings, got.tolist()) if b >= 0}) == len({b for b in got.tolist() if b >= 0}) == sum(1 for n in often.values() if n > 1)
