"""The pipeline's near-duplicate stage against true Jaccard similarities of five-word shingles."""

import random

import pytest

import corpus_pipeline as cp
from sparkloom.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    if a is None or b is None:
        return 0.0  # null texts are no copies of anything
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def rows():
    """Originals, each with a copy at about a stated similarity, then odd rows."""
    rng = random.Random(1)
    out = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 200, 600)))]
        copy, aim = list(words), (0.7, 0.75, 0.801, 0.81, 0.83, 0.86)[k % 6]
        while jaccard(" ".join(words), " ".join(trial := [*copy[: (at := rng.randrange(len(copy)))], "new", *copy[at + 1 :]])) >= aim:
            copy = trial
        out += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    common = " ".join(f"line{i}" for i in range(12))
    out += [(200 + i, f"{common} own{i} a{i} b{i} c{i} d{i} e{i}") for i in range(40)]
    return out + [(300, None), (299, None), (301, ""), (305, " \n"), (302, "Two  words"), (303, "two words"), (None, "lone text here"), (304, out[0][1].upper())]


@pytest.mark.parametrize("meet,pairs", [(8192, 1 << 20), (8, 7)])
def test_every_near_copy_and_no_other(spark, meet, pairs, monkeypatch):
    monkeypatch.setattr(simhash, "MEET", meet)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    data = rows()
    near = [(i, j) for i in range(len(data)) for j in range(i) if jaccard(data[i][1], data[j][1]) >= 0.8]
    root = list(range(len(data)))
    for i, j in near:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    want = sorted(str(min((data[i][0] is None, data[i][0] or 0, data[i][0]) for i in range(len(data)) if root[i] == r)[2]) for r in set(root))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted(str(r.doc_id) for r in cp.near_duplicates(spark, docs, "").collect())
    assert len(near) > 30 and got == want
