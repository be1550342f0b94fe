"""Best-fit packing after Martello-Toth dominance reduction.

Only lengths matter to a packing, and there are at most `capacity` of them:
the driver gets one row for each length with its count, plans patterns with
multiplicities, and the plan goes out as a table of rank ranges for each
length. Documents never meet in one task: ranks are running numbers within
(partition, length) on top of prefix sums of the partitions' counts.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, small_batches
from .token_cache import PieceEncoder, slices


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix bins that dominate every other bin with their largest item; returns (fixed bins with multiplicity, what remains).

    For the largest item and the room it leaves: no item fits - it stands
    alone; the largest fitting item fills the room, or no two items fit
    together, or it is at least as large as any two that fit together while
    no three do - that pair dominates.
    """
    left = {k: n for k, n in counts.items() if n}
    sizes, fixed = sorted(left), []

    def drop(x: int, n: int) -> None:
        left[x] -= n
        if not left[x]:
            del left[x]
            sizes.remove(x)

    at = len(sizes) - 1
    while at >= 0:
        big = sizes[at]
        room = capacity - big
        k = bisect_left(sizes, room + 1) - 1
        if k >= 0 and sizes[k] == big and left[big] == 1:
            k -= 1
        if k < 0:
            fixed.append(((big,), left[big]))
            drop(big, left[big])
            at -= 1
            continue
        mate = sizes[k]
        small = []
        for s in sizes[: min(k + 1, 3)]:
            small += [s] * min(3, left[s] - (s == big))
        small = sorted(small)[:3]
        two = len(small) < 2 or small[0] + small[1] > room
        three = len(small) < 3 or sum(small) > room
        best = 0
        if not two and three and mate != room:
            i, j = 0, k
            while i <= j:
                if sizes[i] + sizes[j] > room:
                    j -= 1
                elif i == j and left[sizes[i]] < 2 + (sizes[i] == big):
                    break
                else:
                    best = max(best, sizes[i] + sizes[j])
                    i += 1
        if mate == room or two or (three and mate >= best):
            n = left[big] // 2 if mate == big else min(left[big], left[mate])
            fixed.append(((big, mate), n))
            drop(big, n)
            drop(mate, n)
            at = min(bisect_left(sizes, big + 1), len(sizes)) - 1
        else:
            at -= 1
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counted lengths: bins with multiplicity. Each item goes to the fullest bin that takes it."""
    rooms: list[int] = []
    bins: dict[int, list] = {}

    def put(room, pattern, n):
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((pattern, n))

    for size in sorted(counts, reverse=True):
        todo = counts[size]
        while todo:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                full, rest = divmod(todo, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[i]
            pattern, n = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(i)
            each = room // size
            full, rest = divmod(todo, each)
            used = min(full, n)
            todo -= used * each
            if used:
                put(room - each * size, pattern + (size,) * each, used)
            if used < n and rest and used == full:
                put(room - rest * size, pattern + (size,) * rest, 1)
                todo -= rest
                used += 1
            if used < n:
                put(room, pattern, n - used)
    return [x for b in bins.values() for x in b]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies in a bin, first bin, offset): rank r lies in bin first + (r - first rank) // copies."""
    fixed, rest = reduce_instance(counts, capacity)
    merged: dict[tuple[int, ...], int] = {}
    for pattern, n in fixed + best_fit(rest, capacity):
        merged[pattern] = merged.get(pattern, 0) + n
    rank: dict[int, int] = {}
    rows, first = [], 0
    for pattern, n in merged.items():
        at, i = 0, 0
        while i < len(pattern):
            size = pattern[i]
            m = pattern.count(size)
            r = rank.get(size, 0)
            rows.append((size, r, r + n * m, m, first, at))
            rank[size] = r + n * m
            at += m * size
            i += m
        first += n
    return rows


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, part, piece, start, length, ids_crc32): each document's ids and end_id, cut at the capacity only."""

    def run(batches):
        coder = PieceEncoder.of(tokenizer_path, False, _packed, b"".join)
        tail = int(end_id).to_bytes(4, "little")
        for b in batches:
            for s in slices(b):
                out = [[], [], [], [], []]
                for i, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                    ids = coder.encode(t or "") + tail
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        for col, x in zip(out, (i, k, a // 4, len(part) // 4, zlib.crc32(part))):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["id", "piece", "start", "length", "ids_crc32"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long").withColumn("part", F.spark_partition_id())


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    Null and empty texts are one piece of the end id alone. Repeated rows are
    packed each on their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cut = materialise(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    per = materialise(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    seat = Window.partitionBy("part", "length").orderBy("id", "start")
    ranked = cut.withColumn("r", F.row_number().over(seat) - 1).join(bases, ["length", "part"]).withColumn("r", F.col("base") + F.col("r"))
    by_length = {}
    for size, lo, hi, m, first, at in rows:
        by_length.setdefault(size, []).append((lo, hi, m, first, at))
    shared = spark.sparkContext.broadcast({k: sorted(v) for k, v in by_length.items()})  # bounded by the capacity, not by the documents

    def seats(batches):
        import numpy as np

        table = {k: np.array(v, np.int64) for k, v in shared.value.items()}
        for b in batches:
            size, r = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            for k in np.unique(size):
                at = np.nonzero(size == k)[0]
                t = table[int(k)]
                row = t[np.searchsorted(t[:, 0], r[at], "right") - 1]
                j = r[at] - row[:, 0]
                seq[at] = row[:, 3] + j // row[:, 2]
                off[at] = row[:, 4] + j % row[:, 2] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("id", "piece", "start", "length", "ids_crc32", "r").mapInArrow(seats, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
