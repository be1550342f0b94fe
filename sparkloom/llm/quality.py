"""Quality from weak labels.

Overlapping heuristics vote good, bad or nothing on each document. Votes
of all documents are counted by pattern - at most 3^labellers rows - and
expectation-maximisation on those counts gives each labeller's accuracy and
each pattern's posterior. A linear scorer over hashed word features learns
the posteriors of a bounded sample and scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, small_batches, without

DIM = 1 << 16
#: Documents that the scorer is fitted on, by smallest hash of their text.
SAMPLE = 4000
LABELLERS = ("symbols", "capitals", "shouting", "repeated_lines", "repeated_words", "tiny", "markup")


def votes(text: str) -> tuple[int, ...]:
    """Each labeller's vote: 1 good, -1 bad, 0 none. Empty texts are bad by all that can tell."""
    words = text.split()
    n = len(words)
    if not n:
        return (-1, 0, 0, 0, 0, -1, 0)
    odd = sum(map(text.count, "#$%&*@^~|")) / n
    upper = sum(1 for w in words if w.isupper() and len(w) > 1) / n
    bangs = (text.count("!") + text.count("?!")) / n
    lines = [x for x in text.split("\n") if len(x) > 20]
    again = 1 - len(set(lines)) / len(lines) if lines else 0
    share = max(Counter(words).values()) / n
    tags = len(re.findall(r"https?://|www\.|<[a-z/]|click here|subscribe", text, re.I)) / n
    return (
        -1 if odd > 0.3 else 1 if odd < 0.02 else 0,
        -1 if upper > 0.5 else 1 if upper < 0.1 else 0,
        -1 if bangs > 0.3 else 1 if bangs < 0.03 else 0,
        -1 if again > 0.3 else 1 if len(lines) > 3 and not again else 0,
        -1 if n > 20 and share > 0.2 else 1 if n > 50 and share < 0.12 else 0,
        -1 if n < 5 else 1 if n > 60 else 0,
        -1 if tags > 0.05 else 0,
    )


def fit_labellers(counts: dict[tuple[int, ...], int], rounds: int = 300) -> tuple[np.ndarray, dict[tuple[int, ...], float]]:
    """(accuracy of each labeller where it votes, posterior of good for each pattern) by expectation-maximisation.

    Each labeller has its own chances of a good, bad or missing vote under
    either class, so that a rare bad vote may weigh more than common good ones.
    """
    if not counts:
        return np.full(len(LABELLERS), 0.5), {}
    v = np.array(list(counts)) + 1
    n = np.array(list(counts.values()), float)
    at = np.arange(v.shape[1])
    chance = np.stack([np.tile([0.5, 0.2, 0.3], (v.shape[1], 1)), np.tile([0.03, 0.27, 0.7], (v.shape[1], 1))])
    prior, post = 0.8, np.zeros(len(v))
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + (np.log(chance[1][at, v]) - np.log(chance[0][at, v])).sum(1)
        old, post = post, 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(post - old).max() < 1e-9:
            break
        for c, p in ((0, (1 - post) * n), (1, post * n)):
            for k in range(3):
                chance[c][:, k] = ((v == k) * p[:, None]).sum(0) + 0.5
            chance[c] /= chance[c].sum(1, keepdims=True)
        prior = float(np.clip((post * n).sum() / n.sum(), 0.05, 0.95))
    right = ((v == 2) * (post * n)[:, None] + (v == 0) * ((1 - post) * n)[:, None]).sum(0)
    cast = ((v != 1) * n[:, None]).sum(0)
    return np.divide(right, cast, out=np.full(v.shape[1], 0.5), where=cast > 0), dict(zip(counts, post.tolist()))


def features(word: str) -> tuple[int, int]:
    """Hashed ending and hashed shape of a word."""
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[A-ZÀ-ÖØ-Þ]", "A", re.sub(r"\d", "0", word))).replace("_", "-"))
    return zlib.crc32(word[-3:].encode()) % DIM, zlib.crc32(b"\0" + shape[:8].encode()) % DIM


def fit_scorer(texts: list[str], target: np.ndarray, epochs: int = 30, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on mean hashed features."""
    rows, cols = [], []
    known: dict[str, tuple[int, int]] = {}
    sizes = np.ones(len(texts))
    for i, t in enumerate(texts):
        words = t.split()
        sizes[i] = max(1, len(words))
        for w in words:
            if w not in known:
                known[w] = features(w)
            cols += known[w]
        rows.append(2 * len(words))
    at = np.repeat(np.arange(len(texts)), rows)
    cols = np.array(cols, np.int64)
    value = 1 / sizes[at]
    weights, bias, total = np.zeros(DIM), 0.0, np.full(DIM, 1e-6)
    for _ in range(epochs if len(texts) else 0):
        z = np.bincount(at, weights[cols] * value, len(texts)) + bias
        slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.bincount(cols, slope[at] * value, DIM) / len(texts)
        total += grad**2
        weights -= rate * grad / np.sqrt(total)
        bias -= 0.5 * slope.mean()
    return weights, bias


def score(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """docs with _posterior (of the votes), _score (of the scorer) and _keep (score of at least 0.5).

    Null texts count as empty; repeated rows score alike; empty input gives no
    rows. Columns that have the results' names already are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "_posterior", "_score", "_keep")
    at = docs.columns.index(text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def vote(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(t) for t in b.column(0).to_pylist()], pa.list_(pa.int8()))], names=["v"])

    voted = docs.select(text.alias("t")).mapInArrow(vote, "v array<byte>").groupBy("v").agg(F.count("*").alias("n"))
    acc, post = fit_labellers({tuple(r.v): r.n for r in voted.collect()})  # at most 3^labellers rows
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("t"))
    cut = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    texts = sorted({r.t for r in rows.where(F.col("h") <= F.lit(cut)).dropDuplicates(["h"]).limit(sample).collect()}) if cut is not None else []
    weights, bias = fit_scorer(texts, np.array([post.get(votes(t), 0.5) for t in texts]))
    shared, names = spark.sparkContext.broadcast((weights, bias, post)), [*docs.columns, "_posterior", "_score"]

    def run(batches):
        fresh()
        w, b0, post = shared.value
        known: dict[str, float] = {}
        for b in batches:
            ps, ss = [], []
            for t in b.column(at).cast(pa.string()).to_pylist():
                t = t or ""
                words = t.split()
                for x in words:  # not a difference with known's keys, which goes through all of them for each text
                    if x not in known:
                        i, j = features(x)
                        known[x] = w[i] + w[j]
                z = sum(map(known.__getitem__, words)) / max(1, len(words)) + b0
                ps.append(post.get(votes(t), 0.5))
                ss.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
                if len(known) > 500_000:
                    known = {}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ps), pa.array(ss)], names=names)
        release()

    schema = docs.withColumn("_posterior", F.lit(0.0)).withColumn("_score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema).withColumn("_keep", F.col("_score") >= 0.5)
