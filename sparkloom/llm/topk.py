"""Exact top-k inner products by MaxScore over vector components.

A component is a query's term and a block of vectors its postings; a term's
bounds are the most and the least it can add in the block. Terms are ordered
by how far these lie apart. Those at the end of the order are non-essential as
long as a vector that gets the least from all others and the most from them
stays below the k-th best score so far; a block where that holds of all terms
is passed over. The essential terms are traversed for all vectors, the others
probed in turn only for vectors whose bound is still competitive. The k-th best
score is carried from block to block, so that more terms become non-essential.
Blocks of queries meet blocks of vectors through an equi-join on the shard
number; each task returns k rows at most for each of its queries and blocks,
and shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block; a block of this many 64-dimension vectors is 2 MB.
BLOCK = 4096
QUERY_BLOCK = 256


def essential(top: np.ndarray, bottom: np.ndarray, floor: float) -> int:
    """How many of the first terms are essential: the fewest such that the least of them and the most of all others stay below the floor."""
    reach = np.concatenate(([0], np.cumsum(bottom))) + np.concatenate((np.cumsum(top[::-1])[::-1], [0]))
    return int(np.searchsorted(-reach, -floor, "right")) if reach[-1] < floor else len(top)


def block_topk(queries: np.ndarray, qids: np.ndarray, vectors: np.ndarray, vids: np.ndarray, k: int, best: list[np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(query id, vector id, score): those of one block that can be among each query's k best; ties to the smaller id; a row does not match its own id.

    best holds each query's k best scores so far, ascending, and is brought up to date.
    """
    out = []
    high, low = vectors.max(0), vectors.min(0)
    columns = np.asfortranarray(vectors)
    best = [np.zeros(0)] * len(qids) if best is None else best
    for n, (q, own) in enumerate(zip(queries, qids.tolist())):
        top, bottom = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        order = np.argsort(-(top - bottom), kind="stable")
        floor = best[n][0] if len(best[n]) == k else -np.inf
        first = essential(top[order], bottom[order], floor)
        if not first and len(order):
            continue  # no vector of the block reaches the floor
        score = columns[:, order[:first]] @ q[order[:first]]
        live = np.nonzero(vids != own)[0]
        score = score[live]
        above, below = (np.concatenate((np.cumsum(x[order][::-1])[::-1], [0])) for x in (top, bottom))
        for i in range(first, len(order) + 1):
            if (i - first) % 8 == 0:
                if len(live) > k:
                    floor = max(floor, np.partition(score, len(score) - k)[len(score) - k] + below[i])
                keep = score + above[i] >= floor
                live, score = live[keep], score[keep]
            if i < len(order):
                score = score + columns[live, order[i]] * q[order[i]]
        at = np.lexsort((vids[live], -score))[:k]
        best[n] = np.sort(np.concatenate((best[n], score[at])))[-k:]
        out += [(own, v, int(s)) for v, s in zip(vids[live][at].tolist(), score[at].tolist())]
    return out


def quantised(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): components as floor(scale * x); rows with a null or non-finite component or a null vector or id are left out."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("x"))


def _blocks(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Rows packed into binary blocks of at most `rows` vectors; a task holds one block."""

    def run(batches):
        ids, xs, width = [], [], 0

        def emit():
            d = max(map(len, xs))
            a = np.zeros((len(xs), d))
            for i, x in enumerate(xs):
                a[i, : len(x)] = x
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([a.tobytes()], pa.binary()), pa.array([d], pa.int32())], names=[f"{name}_ids", name, f"{name}_d"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                xs.append(x)
                if len(ids) == rows:
                    yield emit()
                    ids, xs = [], []
        if ids:
            yield emit()

    return df.mapInArrow(run, f"{name}_ids binary, {name} binary, {name}_d int")


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row where is_query holds against all other rows.

    Vectors of different lengths are compared over their common components.
    Scores are whole numbers, exact while they and the scaled components
    stay below 2^53. Ties go to the smaller id. An empty table gives no rows. Repeated rows are candidates each on their own; of
    repeated query ids each keeps k rows of its own scores.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, id_col, vec_col)
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    qs = _blocks(quantised(vectors.where(is_query), scale, id_col, vec_col).repartition(max(1, parts // 4)), "q", QUERY_BLOCK)
    qs = qs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cs = _blocks(rows.repartition(parts), "c", BLOCK).withColumn("shard", F.spark_partition_id())

    def run(batches):
        last, best = None, []
        for b in batches:
            out = []
            for r in b.to_pylist():
                d = max(r["q_d"], r["c_d"])
                grow = lambda raw, n: np.pad(np.frombuffer(raw).reshape(-1, n), ((0, 0), (0, d - n)))
                qids, cids = (np.frombuffer(r[x], np.int64) for x in ("q_ids", "c_ids"))
                if (r["q_ids"], r["q"]) != last:  # the join gives all blocks of vectors for one of queries in a row
                    last, best = (r["q_ids"], r["q"]), [np.zeros(0)] * len(qids)
                if d == 0:
                    out += [(q, v, 0) for q in qids.tolist() for v in sorted(c for c in cids.tolist() if c != q)[:k]]
                    continue
                out += block_topk(grow(r["q"], r["q_d"]) if r["q_d"] else np.zeros((len(qids), d)), qids, grow(r["c"], r["c_d"]) if r["c_d"] else np.zeros((len(cids), d)), cids, k, best)
            a = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, i]) for i in range(3)], names=["query_id", "vec_id", "score"])

    found = qs.repartition(parts, "shard").join(cs.repartition(parts, "shard"), "shard").select("q_ids", "q", "q_d", "c_ids", "c", "c_d").mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
