"""Each stage against a brute-force version, on its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from sparkloom.llm.common import materialise

from test_near_copies import jaccard
from test_op3 import brute as brute_spans
from test_ops_b import brute as brute_windows

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"_score": F.lit("mine"), "_hash": F.lit(1), "kept0": F.lit(2), "_n_words": F.lit("x")})
    cols = docs.columns
    odd = [(10_000, None, "en", "s", 0), (9_999, None, "en", "s", 0), (10_001, "", "en", "s", 0), (None, "lone text without an id", "en", "s", 3), (10_002, "said twice, row by row, word by word", "en", "s", 1), (10_002, "said twice, row by row, word by word", "en", "s", 1)]
    docs = materialise(docs.unionByName(spark.createDataFrame([(*r, "mine", 1, 2, "x") for r in odd], docs.schema)), "in")
    one = materialise(cp.toxicity(spark, docs, SF), "one")
    assert one.columns == cols and one.select("_score", "_hash", "kept0", "_n_words").distinct().collect() == [("mine", 1, 2, "x")]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    toxic, clean = ({i for i, y in labels.items() if y == x} for x in (1, 0))
    gone = set((Counter(r.doc_id for r in docs.collect()) - Counter(r.doc_id for r in one.collect())).keys())
    # fitted on nine toxic documents: most of those with labels are found, and few clean ones go
    assert len(gone & toxic) >= 0.7 * len(toxic) and len(gone & clean) <= 0.1 * len(clean), (len(gone & toxic), len(toxic), len(gone & clean), len(clean))
    assert not gone & {10_000, 9_999, 10_001, 10_002}

    two = materialise(cp.near_duplicates(spark, one, SF), "two")
    rows = [(r.doc_id, r.text) for r in one.collect()]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, (d, t) in enumerate(rows):
        k = (d is None, d or 0)
        if top(i) not in best or k < best[top(i)][0]:
            best[top(i)] = (k, d)
    assert two.columns == cols and Counter(r.doc_id for r in two.collect()) == Counter(d for _, d in best.values())

    three = materialise(cp.repeated_passages(spark, two, SF), "three")
    rows = [(r.doc_id, r.text) for r in two.collect()]
    want = {d: b[0] - b[1] for (d, _), b in zip(rows, brute_spans([t for _, t in rows], 200)) if not b[1] or b[1] < b[0]}
    got = {r.doc_id: r for r in three.collect()}
    assert three.columns == cols and got.keys() == want.keys()
    assert all(0 <= want[d] - len((r.text or "").encode()) <= 6 for d, r in got.items())

    four = materialise(cp.decontamination(spark, three, SF), "four")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in three.collect()]
    clean = Counter(d for (d, _), b in zip(rows, brute_windows([t for _, t in rows], items)) if not b[1])
    assert Counter(r.doc_id for r in four.collect()) == clean

    five = cp.best_fit_packing(spark, four, SF).collect()
    assert Counter(r.doc_id for r in five if not r.piece) == clean
    assert all(sum(r.length for r in five if r.sequence_id == s) <= 2048 for s in {r.sequence_id for r in five})


def test_run_and_empty(spark):
    assert cp.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0
