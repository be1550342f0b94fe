"""op1, op6, op8 and op10 against brute force or held-out labels."""

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter
from itertools import combinations

import pytest

from sparkloom.llm import decontaminate, licenses, quality, registry, suffixes, toxicity

ODD = [(1, None), (2, ""), (3, "one two three four"), (3, "one two three four"), (None, "Five, six"), (4, "a1 b2 c3 d4 e5 f6 g7 h8 i9 j0 k1 l2"), (5, "x A1 b2,c3 d4 e5-f6 g7 h8 i9 j0 k1 y k1"), (6, "w " * 5000 + "five SIX"), (7, "Ärger über ärger é 日本")]


def frame(spark, rows=ODD):
    return spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, _score string, item_id int").repartition(3)


def brute(texts, items, k=10):
    parts = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, found = parts(t), set(), set()
        for i, it in items:
            q = parts(it)
            n = min(k, len(q))
            for a in range(len(q) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[a : a + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        out.append((len(w), len(hit), tuple(sorted(found))))
    return out


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_decontamination(spark, block):
    items = [(10, "a1 b2 c3 d4 e5 f6 g7 h8 i9 j0 k1"), (9, "five six"), (8, None), (7, ""), (None, "one two"), (9, "five six"), (11, "Über ärger"), (12, "k1")]
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id int, text string, doc_id int")
    got = decontaminate.annotate(frame(spark).select("doc_id", "text"), bench, block_bytes=block).collect()
    want = Counter((d, *b) for (d, _), b in zip(ODD, brute([t for _, t in ODD], [i for i in items if i[0] is not None])))
    assert Counter((r.doc_id, r._n_words, r._n_hit, tuple(r._items)) for r in got) == want
    none = decontaminate.annotate(frame(spark), bench.limit(0)).collect()
    assert len(none) == len(ODD) and not any(r._n_hit for r in none)


def test_decontamination_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for (d, _), (n, h, i) in zip(docs, brute([t for _, t in docs], items))}
    assert {r.doc_id: tuple(r)[1:] for r in registry.op6_decontamination(spark, sf).collect()} == want


def test_kernel():
    def slow(x, y):
        total = 0.0
        at = lambda s: [(c, s) for c in combinations(range(len(s)), toxicity.ORDER)]
        for a, _ in at(x):
            for b, _ in at(y):
                if [x[i] for i in a] == [y[i] for i in b]:
                    total += toxicity.DECAY ** (a[-1] - a[0] + b[-1] - b[0] + 2)
        return total

    xs, ys = ["idiot", "i.d.i.o.t", "idxiot", "clown", "unrelated", "", "aaaaaa"], ["idiot", "clown", "aaaa"]
    got = toxicity.kernel(xs, ys)
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            lcs = lambda a, b: 0 if not a or not b else 1 + lcs(a[1:], b[1:]) if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))
            lack = len(y) - lcs(x, y)
            want = slow(x, y) / (slow(x, x) * slow(y, y)) ** 0.5 if slow(x, y) and lack <= 1 else 0
            assert abs(got[i, j] - want) < 1e-9


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = registry.op1_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    caught = sum(r.predicted for r in held if truth[r.doc_id]) / sum(truth[r.doc_id] for r in held)
    assert right > 0.96 and caught >= 0.9, (right, caught)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    english = [r for r in held if lang[r.doc_id] == "en" and truth[r.doc_id]]
    assert sum(r.predicted for r in english) / len(english) > 0.9


def test_toxicity_odd_rows(spark):
    filler = lambda i: " ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest()[:6].translate(str.maketrans("0123456789", "ghjklmnpqr")) for k in range(12))
    model = toxicity.fit([(f"you idiot {filler(i)}", 1) for i in range(40)] + [(f"a quiet text {filler(-i)}", 0) for i in range(1, 100)])
    got = {r.doc_id: r._prob for r in toxicity.score(frame(spark, [(1, None), (2, ""), (3, "what an i-d-i-o-t!"), (4, "i d i o t"), (5, "quiet text"), (6, "idxiot")]).drop("_score"), model).withColumnRenamed("_score", "_prob").collect()}
    assert model.landmarks and len(set(got.values())) > 2, got
    assert got[1] == got[2] < 0.3 and got[5] < 0.3 and got[3] >= 0.3 and got[4] >= 0.3 and got[6] >= 0.3
    assert toxicity.fit([]).margins(["x"])[0] < 0


def test_licences(spark):
    rows = [(1, None), (2, ""), (3, "Intro here.\nreleased under the mit license"), (4, licenses.TEMPLATES["gpl-3.0-notice"]), (5, "Released\nunder the MIT\nLicense."), (6, "x " * 3000), (None, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.")]
    got = {r.doc_id: (r._license, round(r._s, 3), r._n_matches) for r in licenses.scan(frame(spark, rows).drop("_score")).withColumnRenamed("_score", "_s").collect()}
    assert got[1] == got[2] == got[6] == (None, 0.0, 0)
    assert got[3] == ("mit-notice", 1.0, 1) and got[4] == ("gpl-3.0-notice", 1.0, 1) and got[5] == ("mit-notice", 1.0, 0)
    assert got[None][1:] == (1.0, 2) and got[None][0] == "cc-by-4.0-notice"


def test_licence_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = Counter(con.execute(licenses.oracle()).fetchall())
    assert Counter((r.doc_id, r.license, r.score, r.n_matches) for r in registry.op8_licenses(spark, sf).collect()) == want


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = registry.op10_quality(spark, sf).collect()
    assert len(got) == 1000
    mine = [r for r in got if r.doc_id in truth]
    right = sum(r.keep == bool(truth[r.doc_id]) for r in mine) / len(mine)
    kept = sum(r.keep for r in mine if truth[r.doc_id]) / sum(truth[r.doc_id] for r in mine)
    assert right > 0.85 and kept > 0.97, (right, kept)
    assert quality.score(frame(spark, []).drop("_score")).count() == 0
    assert quality.score(frame(spark).drop("_score")).count() == len(ODD)


def test_clashing_names_are_replaced(spark):
    """Columns that have a result's name already, left in: they go, the caller's other columns stay."""
    names = ["_score", "_posterior", "_keep", "_license", "_n_matches", "_found", "_best", "_mask", "_items", "_n_words", "_n_hit", "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", "_SCORE2", "other"]
    rows = [(i, t, *["mine"] * len(names)) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    plain = docs.select("doc_id", "text")
    bench = spark.createDataFrame([(9, "five six")], "item_id int, text string")
    model = toxicity.fit([("you idiot", 1)] * 5 + [("a quiet text", 0)] * 9)
    for apply in (lambda d: toxicity.score(d, model), lambda d: decontaminate.annotate(d, bench), licenses.scan, quality.score, suffixes.dedup):
        got, want = apply(docs), apply(plain)
        assert len(set(got.columns)) == len(got.columns) and {"other", "_SCORE2"} <= set(got.columns)
        cols = want.columns
        assert Counter(map(str, got.select(*cols).collect())) == Counter(map(str, want.collect()))
        assert {r.other for r in got.collect()} == {"mine"}


def test_training_rows_do_not_depend_on_partitions(spark):
    docs = [(i, f"text {i} {k}") for i in range(60) for k in range(i % 3 + 1)] + [(None, "no id"), (61, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = [toxicity.training_rows(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), labels, sample=20) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 20
    assert toxicity.training_rows(spark.createDataFrame([], "doc_id long, text string"), labels) == []


def test_training_at_a_small_size(spark):
    """Nine toxic training documents: most of them are found again, and few clean ones are."""
    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r.predicted for r in registry.op1_toxicity(spark, sf).collect()}
    toxic, clean = ([i for i in truth if i in got and truth[i] == y] for y in (1, 0))
    assert sum(got[i] for i in toxic) >= 0.7 * len(toxic) and sum(got[i] for i in clean) <= 0.1 * len(clean)


def test_licences_repeats_and_empty(spark):
    rows = [(1, "Released under the MIT License.")] * 3
    got = licenses.scan(frame(spark, rows).drop("_score")).collect()
    assert [(r._license, r._score, r._n_matches) for r in got] == [("mit-notice", 1.0, 1)] * 3
    assert licenses.scan(frame(spark, []).drop("_score")).count() == 0


def brute_em(counts, rounds=300):
    """Expectation-maximisation written out vote by vote."""
    patterns = list(counts)
    m = len(patterns[0])
    chance = {1: [[0.03, 0.27, 0.7] for _ in range(m)], 0: [[0.5, 0.2, 0.3] for _ in range(m)]}
    prior, post, n = 0.8, [0.0] * len(patterns), sum(counts.values())
    for _ in range(rounds):
        old, post = post, []
        for p in patterns:
            good, bad = math.log(prior), math.log(1 - prior)
            for j, v in enumerate(p):
                good += math.log(chance[1][j][v + 1])
                bad += math.log(chance[0][j][v + 1])
            post.append(1 / (1 + math.exp(min(40, max(-40, bad - good)))))
        if max(abs(a - b) for a, b in zip(old, post)) < 1e-9:
            break
        for c in (0, 1):
            for j in range(m):
                share = [0.5, 0.5, 0.5]
                for p, q in zip(patterns, post):
                    share[p[j] + 1] += (q if c else 1 - q) * counts[p]
                chance[c][j] = [x / sum(share) for x in share]
        prior = min(0.95, max(0.05, sum(q * counts[p] for p, q in zip(patterns, post)) / n))
    return dict(zip(patterns, post))


def test_quality_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    post = brute_em(Counter(quality.votes(t or "") for _, t in docs))
    texts = sorted({t or "" for _, t in docs})
    weights, bias = quality.fit_scorer(texts, [post[quality.votes(t)] for t in texts])

    def linear(t):
        words = (t or "").split()
        z = bias + sum(weights[i] for w in words for i in quality.features(w)) / max(1, len(words))
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    got = registry.op10_quality(spark, sf).collect()
    want = {i: (post[quality.votes(t or "")], linear(t)) for i, t in docs}
    assert len(got) == len(docs)
    for r in got:
        assert abs(r.posterior - want[r.doc_id][0]) < 1e-5 and abs(r.score - want[r.doc_id][1]) < 1e-4 and r.keep == (r.score >= 0.5)


def test_quality_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "one two three")]
    got = quality.score(frame(spark, rows).drop("_score")).collect()
    by = {}
    for r in got:
        by.setdefault(r.text or "", set()).add((r._posterior, r._score, r._keep))
    assert len(got) == 5 and all(len(x) == 1 for x in by.values())


def test_licences_wrapped_and_whole(spark):
    """Notices over several lines inside longer texts, and full texts, plain and wrapped."""
    wrap = lambda t, n: "\n".join(textwrap.wrap(t, n))
    around = "import os\n# a file of code\n{}\n\ndef main():\n    return 1\n" + "more code here\n" * 30
    rows, want = [], {}
    for i, name in enumerate(("apache-2.0-header", "mit-grant", "mpl-2.0-header", "bsd-notice")):
        rows.append((i, around.format(wrap(licenses.TEMPLATES[name], 60))))
        want[i] = name
    for i, name in enumerate(("mit-text", "isc-text", "bsd-2-clause-text")):
        rows += [(10 + i, licenses.TEMPLATES[name]), (20 + i, "Copyright 2020 A. Person\n\n" + wrap(licenses.TEMPLATES[name], 72))]
        want |= {10 + i: name, 20 + i: name}
    rows.append((30, around.format("nothing of the kind")))
    got = {r.doc_id: r._license for r in licenses.scan(frame(spark, rows).drop("_score")).collect()}
    assert got == want | {30: None}
