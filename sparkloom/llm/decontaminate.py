"""Benchmark decontamination as a prefix-filtered set join.

Each item's windows of `window` consecutive words (a shorter item is one
window) must occur whole, so of a window's shingles - SHINGLE consecutive words,
fewer in shorter windows - all must be in the document, and its necessary
prefix is one token: its rarest shingle, by counts over all documents.
Documents meet the index at shingles that are some window's prefix; the
shingle's place in the window and the document's length bound where the window
can lie; what passes is compared word by word.

The item index goes out in blocks whose text is at most `block_bytes`; a
larger benchmark takes more passes over the documents, each of them whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialise, release, small_batches, without

BLOCK_BYTES = 16 << 20
#: Words of a shingle.
SHINGLE = 3
#: Everything but letters, digits and bytes of other scripts parts words; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def shingles(w: list[bytes], n: int):
    """Runs of n words, as tuples."""
    return zip(*(w[i:] for i in range(n)))


def windows_of(text: bytes, window: int) -> tuple[list[list[bytes]], int]:
    """An item's windows and the length of their shingles."""
    w = words_of(text)
    k = min(window, len(w))
    return [w[i : i + k] for i in range(len(w) - k + 1 if k else 0)], min(SHINGLE, k)


def build(items: list[tuple[str, bytes]], window: int, rarity: dict[tuple, int]) -> tuple[dict, dict]:
    """(windows, probes): windows maps joined words to item ids; probes maps a length to prefix shingles and their (place, window length) pairs."""
    windows: dict[bytes, set] = {}
    probes: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        parts, n = windows_of(text, window)
        for part in parts:
            windows.setdefault(b" ".join(part), set()).add(item)
            at, prefix = min(enumerate(shingles(part, n)), key=lambda x: (rarity.get(x[1], 0), x[1], x[0]))
            probes.setdefault(n, {}).setdefault(prefix, set()).add((at, len(part)))
    return windows, probes


def hits(w: list[bytes], windows: dict, probes: dict) -> tuple[np.ndarray, set]:
    """(hit mask over the words, items with an occurring window)."""
    mask, found = np.zeros(len(w), bool), set()
    for n, tokens in probes.items():
        for p, x in enumerate(shingles(w, n)):
            if x in tokens:
                for at, k in tokens[x]:
                    a = p - at
                    if a >= 0 and a + k <= len(w) and (got := windows.get(b" ".join(w[a : a + k]))):
                        mask[a : a + k] = True
                        found |= got
    return mask, found


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with _n_words, _n_hit and _items (sorted item ids as strings); one row for each input row.

    Null texts have no words, long ones are read whole; null item ids are left
    out; repeated items and rows change nothing; with no items nothing is hit.
    Columns that have the results' names already are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "_mask", "_n_words", "_n_hit", "_items")
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    names = docs.columns
    bits = docs
    for c, e in (("_mask", F.lit(None).cast("binary")), ("_items", F.array().cast("array<string>")), ("_n_words", F.lit(0).cast("long"))):
        bits = bits.withColumn(c, e)
    at, out_names = names.index(text_col), bits.columns
    for block in range(blocks):
        rows = [(r.i, r.t.encode()) for r in items.where(F.col("block") == block).select("i", "t").toLocalIterator()]
        parts = [windows_of(t, window) for _, t in rows]
        vocabulary = spark.sparkContext.broadcast({n: {x for ws, m in parts if m == n for w in ws for x in shingles(w, n)} for n in {m for _, m in parts if m}})

        def count(batches, vocabulary=vocabulary):
            tally, wanted = Counter(), vocabulary.value
            for b in batches:
                for t in b.column(0).cast(pa.binary()).to_pylist():
                    w = words_of(t)
                    for n, known in wanted.items():
                        tally.update(x for x in shingles(w, n) if x in known)
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(x) for x in tally], pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["w", "n"])

        counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
        rarity = {tuple(bytes(r.w).split(b" ")): r.n for r in counted.toLocalIterator()}  # the block's shingles at most
        index = spark.sparkContext.broadcast(build(rows, window, rarity))

        def run(batches, index=index):
            fresh()
            windows, probes = index.value
            for b in batches:
                texts = b.column(at).cast(pa.binary()).to_pylist()
                masks, found, sizes = [], [], []
                for t, old, had in zip(texts, b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()):
                    w = words_of(t)
                    mask, got = hits(w, windows, probes)
                    mask = np.packbits(mask).tobytes()
                    masks.append(mask if old is None else bytes(x | y for x, y in zip(mask, old)))
                    found.append(sorted(got.union(had or ())))
                    sizes.append(len(w))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(masks, pa.binary()), pa.array(found, pa.list_(pa.string())), pa.array(sizes, pa.int64())], names=out_names)
            release()

        last, bits = bits, bits.mapInArrow(run, bits.schema)
        if block < blocks - 1:
            bits = materialise(bits, "hits")
            if block:
                discard(last)
    ones = F.aggregate(F.transform(F.sequence(F.lit(1), F.octet_length("_mask")), lambda i: F.bit_count(F.conv(F.hex(F.substring("_mask", i, 1)), 16, 10).cast("int")).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    n_hit = F.when(F.size("_items") == 0, F.lit(0).cast("long")).otherwise(ones)
    return bits.withColumn("_n_hit", n_hit).drop("_mask")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
