"""Counts, models and thresholds of the pipeline come from all rows."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as cp
from sparkloom.llm import simhash
from sparkloom.llm import toxicity as tox


def rows():
    """6000 short documents; one insult is in nine of them only, and some are near copies of others."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvz", k=rng.randrange(3, 11))) for _ in range(1500)]
    out = []
    for i in range(6000):
        insult = "gobermouch" if i % 700 == 5 else "snollygoster" if i % 20 == 1 else ""
        out.append((i, " ".join([*rng.choices(words, k=8), insult, "snolly" if i % 50 == 2 else ""]), int(bool(insult))))
    for i in range(0, 300, 3):
        out[i] = (i, out[i + 2][1], out[i + 2][2])
    return out


def test_every_labelled_row_counts(spark, tmp_path, monkeypatch):
    data = rows()
    spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (7, None), (9, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(9, "zz")], "doc_id long, text string").repartition(5)
    seen = []
    monkeypatch.setattr(tox, "score", lambda d, model: seen.append(model) or d.selectExpr("*", "0.0 AS _score"))
    cp.toxicity(spark, docs, str(tmp_path))
    train = [(t, y) for i, t, y in data if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(train) > 4000
    want, got = tox.fit(train), seen[0]
    assert want.landmarks == got.landmarks and "^snollygoster" in got.landmarks
    assert np.allclose(want.root @ want.weights, got.root @ got.weights, atol=1e-6) and abs(want.bias - got.bias) < 1e-6 and abs(want.cut - got.cut) < 1e-6
    assert tox.score_text(got, "you snollygoster", {}) >= 0.3 > tox.score_text(got, "you snolly", {})


def test_every_text_counts_for_rarity(spark):
    texts = [f"a{i % 7} b{i % 5} c d e f{i % 3} g" for i in range(200)] + [None, "", "one"]
    want, known = Counter(), simhash.word_hashes()
    for t in texts:
        want.update({int(x) % simhash.COUNTERS for x in simhash.shingle_hashes(t.encode() if t else None, 5, known)})
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "h long, t string").repartition(3)
    got = simhash._frequency(frame, 5)
    assert {i: int(got[i]) for i in np.nonzero(got)[0].tolist()} == dict(want)
