"""Removal of repeated passages by bucket-pointer refinement.

A byte goes if a string of `length` bytes that also starts elsewhere covers
it. Suffixes of the whole corpus are bucketed by the q-gram of q = length / 2
bytes at their anchors: of all q-grams in a string of `length` bytes the one
with the smallest hash, so equal strings have equal anchors at equal places
and only about one position in length / 4 is stored. Buckets of one suffix are
done. Within a bucket, suffixes whose whole context is equal are settled by a
hash of it; the remaining contexts travel to their bucket and are refined
there: every position starts in the bucket of its GRAM bytes, and buckets are
split by sorting on the identifiers at the offset that the bucket's depth has
reached, each step using the identifiers that the step before has written, until
they stand for `length` bytes. Only buckets that still hold two are sorted
again. The first identifiers stand for 64-bit hashes of q-grams.

A bucket with more than HOT contexts is cut into parts that are refined apart;
what is single in its part is settled by a shuffle on 128-bit digests of the
strings. Nothing is dropped and no bucket has to fit in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialise, release, small_batches, without

LENGTH = 200
#: Bytes of the q-grams that refinement starts from, at most.
GRAM = 50
HOT = 20_000
#: Bytes that are hashed, or refined, at a time.
BUFFER = 1 << 20
U = np.uint64


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U(0x9E3779B97F4A7C15) + b
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


_TABLE = _mix(np.arange(256, dtype=U) + U(1), np.full(256, 0x1234567, U))


def _gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes from each position, by doubling."""
    h, n = _TABLE[data], 1
    while 2 * n <= q:
        h = _mix(h[: len(h) - n], h[n:])
        n *= 2
    if n < q and len(h) > q - n:
        h = _mix(h[: len(h) - (q - n)], h[q - n :])
    return h


def _slide(x: np.ndarray, w: int, op, pad) -> np.ndarray:
    """op over x[i : i + w], past the end with pad."""
    out, n = x, 1
    grow = lambda a, d: np.concatenate((a[d:], np.full(min(d, len(a)), pad, a.dtype)))
    while 2 * n <= w:
        out = op(out, grow(out, n))
        n *= 2
    return op(out, grow(out, w - n)) if n < w else out


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in the text, q-gram hash, place in the joined texts) of every anchor."""
    q = length // 2
    w = length - q + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(U), none
    starts = np.cumsum(sizes) - sizes
    h = _gram_hashes(data, q) | U(1)
    h = np.concatenate((h, np.zeros(len(data) - len(h), U)))
    low = _slide(h, w, np.minimum, U(0xFFFFFFFFFFFFFFFF))
    delta = np.zeros(len(data) + 1, np.int32)
    able = sizes >= length
    np.add.at(delta, starts[able], 1)
    np.add.at(delta, (starts + sizes - length + 1)[able], -1)
    low[np.cumsum(delta[:-1]) == 0] = 0
    back = _slide(low[::-1], w, np.maximum, U(0))[::-1]
    at = np.nonzero((back == h) & (h > 0))[0]
    doc = np.searchsorted(starts, at, "right") - 1
    return doc, at - starts[doc], h[at], at


def _buckets(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each key, size of each bucket), by sorting."""
    order = np.argsort(keys)
    first = np.ones(len(keys), bool)
    first[1:] = np.diff(keys[order]) != 0
    bucket = np.empty(len(keys), np.int64)
    bucket[order] = np.cumsum(first) - 1
    return bucket, np.bincount(bucket)


def refine(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket of the `length` bytes from each start, -1 where no other start has them. Starts are places with that much data after them.

    Buckets of q-grams first, for every place that a start can come to look
    at. A step sorts the places by their own bucket and by the bucket at the
    offset that this one's depth has reached, and so doubles the depth; the
    next step looks up the identifiers that this one has written. Places
    whose bucket holds one are not sorted again, and neither are those that
    look at one. Places that only the steps so far had to look at drop out.
    """
    out = np.full(len(starts), -1)
    if len(starts) < 2:
        return out
    depths = [length]  # of the steps, last first: each at most twice the one before
    while depths[0] > GRAM:
        depths.insert(0, -(-depths[0] // 2))
    mask = np.zeros(len(data) + 1, bool)
    mask[starts] = True
    needed = [mask]  # places whose bucket each step needs, last first
    for d, e in zip(depths[-2::-1], depths[:0:-1]):
        more = needed[-1].copy()
        more[e - d :] |= needed[-1][: d - e]
        needed.append(more)
    places = np.nonzero(needed.pop())[0]
    bucket, size = _buckets(_gram_hashes(data, depths[0])[places])
    at = np.zeros(len(data) + 1, np.int64)  # bucket of each place, as the last step left it
    at[places] = bucket
    alone = np.ones(len(data) + 1, bool)
    alone[places] = size[bucket] == 1
    total = len(size)
    for d, e in zip(depths, depths[1:]):
        places = np.nonzero(needed.pop())[0]
        # alone at either end is alone in the whole
        some = places[~(alone[places] | alone[places + (e - d)])]
        bucket, size = _buckets(at[some] * np.int64(total) + at[some + (e - d)])
        alone[places] = True
        alone[some] = size[bucket] == 1
        at[some] = bucket
        total = len(size)
    mine = ~alone[starts]
    out[mine] = at[starts][mine]
    return out


def _key(text: bytes) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(text)
    return (n >> 64) - (1 << 63), (n & ((1 << 64) - 1)) - (1 << 63)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(d1, d2, spans) for keyed(d1, d2, z) texts: sorted, possibly overlapping [start, end) runs of repeated strings. Equal texts count once."""
    q = length // 2
    reach = length - q

    def find(batches):
        press, seen = zstandard.ZstdDecompressor(), set()
        for b in batches:
            hold, size = [], 0
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            for k, (d1, d2, z) in enumerate(rows):
                if (d1, d2) not in seen:
                    seen.add((d1, d2))
                    text = press.decompress(z) if z else b""
                    if len(text) >= length:
                        hold.append((d1, d2, text))
                        size += len(text)
                if hold and (size >= BUFFER or k == len(rows) - 1):
                    doc, pos, gram, _ = anchors([t for *_, t in hold], length)
                    digest = xxhash.xxh64_intdigest
                    ctx = np.fromiter((digest(hold[d][2][max(0, p - reach) : p + length], min(p, reach)) for d, p in zip(doc.tolist(), pos.tolist())), U, len(doc))
                    ds = np.array([h[:2] for h in hold], np.int64)[doc]
                    yield pa.RecordBatch.from_arrays([_signed(gram), _signed(ctx), pa.array(ds[:, 0]), pa.array(ds[:, 1]), pa.array(pos.astype(np.int32)), pa.array(np.array([len(h[2]) for h in hold], np.int32)[doc])], names=["g", "c", "d1", "d2", "pos", "n"])
                    hold, size = [], 0
        release()

    found = keyed.select("d1", "d2", "z").mapInArrow(find, "g long, c long, d1 long, d2 long, pos int, n int")
    anchored = materialise(found, "anchors")
    found = anchored.withColumn("p", F.xxhash64("d1", "d2", "pos"))
    # aggregates are written before they are joined: a join of two plain shuffles can part a bucket that holds very many rows
    buckets = materialise(found.groupBy("g").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo <> hi").select("g"), "buckets")
    found = materialise(found.join(buckets, "g"), "shared")
    discard(anchored, buckets)
    settled = materialise(found.groupBy("g", "c").agg(F.min("p").alias("lo"), F.max("p").alias("hi")), "settled")
    spread = materialise(settled.groupBy("g").agg(F.count("*").alias("contexts"), F.max((F.col("lo") == F.col("hi")).cast("int")).alias("open")), "spread")
    state = materialise(settled.join(spread, "g"), "state")
    discard(settled, spread)
    marked = materialise(found.join(state, ["g", "c"]), "marked")
    discard(found, state)
    span = [F.greatest(F.col("pos") - reach, F.lit(0)).alias("s"), F.least(F.col("pos") + length, F.col("n")).alias("e")]
    sure = marked.where("lo <> hi").select("d1", "d2", *span)
    # one of each settled context stands witness for the open ones
    needed = marked.where("contexts > 1 AND open = 1 AND (lo = hi OR p = lo)")
    part = F.pmod(F.xxhash64("p"), F.ceil(F.col("contexts") / hot)).cast("int")
    wanted = needed.select("d1", "d2", F.struct("pos", "g", part.alias("part"), (F.col("contexts") > hot).alias("cut"), (F.col("lo") == F.col("hi")).alias("single")).alias("w"))
    wanted = wanted.groupBy("d1", "d2").agg(F.collect_set("w").alias("w"))  # bounded by the text's length

    def contexts(batches):
        press, seen = zstandard.ZstdDecompressor(), set()
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["d1"], r["d2"]) in seen:
                    continue
                seen.add((r["d1"], r["d2"]))
                text = press.decompress(r["z"])
                for w in r["w"]:
                    a = max(0, w["pos"] - reach)
                    out.append((w["g"], w["part"], w["cut"], r["d1"], r["d2"], a, text[a : w["pos"] + length]))
                    if len(out) >= 4096:
                        yield _context_batch(out)
                        out = []
            if out:
                yield _context_batch(out)

    texts = keyed.select("d1", "d2", "z").join(wanted, ["d1", "d2"])
    shipped = texts.mapInArrow(contexts, CONTEXT).repartition("g", "part").sortWithinPartitions("g", "part")

    def settle(batches):
        hold, size, last = [], 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size >= BUFFER and r[:2] != last:
                    yield from _refined(hold, length, q)
                    hold, size = [], 0
                hold.append(r)
                size += len(r[6])
                last = r[:2]
        if hold:
            yield from _refined(hold, length, q)
        release()

    local = materialise(shipped.mapInArrow(settle, "d1 long, d2 long, s int, e int, n1 long, n2 long"), "refined")
    pending = local.where("n1 IS NOT NULL").withColumn("p", F.xxhash64("d1", "d2", "s"))
    again = materialise(pending.groupBy("n1", "n2").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo <> hi").select("n1", "n2"), "again")
    across = pending.join(again, ["n1", "n2"]).select("d1", "d2", "s", "e")
    spans = sure.unionByName(local.where("n1 IS NULL").select("d1", "d2", "s", "e")).unionByName(across)
    spans = materialise(spans.groupBy("d1", "d2").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")  # a text's spans are bounded by its length
    discard(marked, local, again)
    return spans


CONTEXT = "g long, part int, cut boolean, d1 long, d2 long, a int, ctx binary"


def _context_batch(rows) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["g", "part", "cut", "d1", "d2", "a", "ctx"])


def _refined(rows, length: int, q: int):
    """Spans of strings with a second start among the rows; strings of cut buckets come with their digest too."""
    sizes = np.array([len(r[6]) for r in rows], np.int64)
    data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    base = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(rows)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = base[owner] + inner
    bucket = refine(data, starts, length)
    d = np.array([(r[3], r[4]) for r in rows], np.int64).reshape(-1, 2)
    a = np.array([r[5] for r in rows], np.int64)
    place = a[owner] + inner
    # a bucket counts only if two different places are in it
    place_id = _mix(_mix(d[owner, 0].view(U), d[owner, 1].view(U)), place.view(U))
    again = np.zeros(len(owner), bool)
    hit = np.nonzero(bucket >= 0)[0]
    if len(hit):
        order = hit[np.argsort(bucket[hit], kind="stable")]
        first = np.nonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))[0]
        ids = place_id[order]
        mixed = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        again[order] = np.repeat(mixed, np.diff(np.concatenate((first, [len(order)]))))
    edge = np.nonzero(again)[0]
    out = []
    if len(edge):
        cut = np.nonzero((np.diff(edge) != 1) | (np.diff(owner[edge]) != 0))[0] + 1
        for run in np.split(edge, cut):
            o = owner[run[0]]
            out.append((d[o, 0], d[o, 1], place[run[0]], place[run[-1]] + length, None, None))
    split = np.array([r[2] for r in rows], bool)
    if split.any():
        raw = data.tobytes()
        told = set()
        for i in np.nonzero(split[owner])[0].tolist():
            if again[i]:
                if bucket[i] in told:
                    continue
                told.add(bucket[i])
            n1, n2 = _key(raw[starts[i] : starts[i] + length])
            out.append((d[owner[i], 0], d[owner[i], 1], place[i], place[i] + length, n1, n2))
    for i in range(0, len(out), 50_000):
        cols = zip(*out[i : i + 50_000])
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["d1", "d2", "s", "e", "n1", "n2"])


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT, text_col: str = "text") -> DataFrame:
    """docs with the text cut, and _n_bytes, _n_removed, _n_spans, _kept_sha256; one row for each input row.

    Null texts are empty and stay null; an empty table gives no rows; columns
    that have the results' names already are replaced. Repeated rows are each other's copies:
    a text of at least `length` bytes that occurs twice goes whole. Matches
    never cross rows. Where a cut parts a UTF-8 letter, the text column leaves
    out its other bytes; counts and digest are those of the bytes.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256")
    names = docs.columns
    at = names.index(text_col)

    def key(batches):
        fresh()
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            ks = np.array([_key(t or b"") for t in texts], np.int64).reshape(-1, 2)
            z = pa.array([None if t is None else press.compress(t) for t in texts], pa.binary())
            cols = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ks[:, 0]), pa.array(ks[:, 1]), z], names=[*(f"o{i}" for i in range(len(names)) if i != at), "d1", "d2", "z"])

    rest = [(f"o{i}", n) for i, n in enumerate(names) if i != at]
    fields = [docs.schema[n].dataType for _, n in rest]
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    schema = StructType([StructField(o, t) for (o, _), t in zip(rest, fields)] + [StructField("d1", LongType()), StructField("d2", LongType()), StructField("z", BinaryType())])
    keyed = materialise(docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(key, schema), "texts")
    spans = repeated_spans(keyed, length, hot)
    copies = keyed.groupBy("d1", "d2").agg(F.count("*").alias("copies"))
    notes = copies.join(spans, ["d1", "d2"], "left").where("copies > 1 OR spans IS NOT NULL").select("d1", "d2", "copies", "spans")
    joined = keyed.join(notes, ["d1", "d2"], "left").select(*(o for o, _ in rest), "z", "copies", "spans")

    def cut(batches):
        press = zstandard.ZstdDecompressor()
        for b in batches:
            got = []
            for z, copies, spans in zip(*(b.column(len(rest) + i).to_pylist() for i in range(3))):
                text = press.decompress(z) if z else b""
                runs = []
                if copies and copies > 1 and len(text) >= length:
                    runs = [(0, len(text))]
                else:
                    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                        if runs and s <= runs[-1][1]:
                            runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
                        else:
                            runs.append((s, e))
                kept, p = [], 0
                for s, e in runs:
                    kept.append(text[p:s])
                    p = e
                kept = b"".join([*kept, text[p:]])
                new = None if z is None else kept.decode(errors="ignore")
                got.append((new, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            cols = list(b.columns[: len(rest)])
            extra = [pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))] if got else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
            cols.insert(at, extra[0])
            yield pa.RecordBatch.from_arrays([*cols, *extra[1:]], names=[*names, "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256"])

    out = docs.withColumn(text_col, F.col(text_col).cast("string"))
    for c in ("_n_bytes", "_n_removed", "_n_spans"):
        out = out.withColumn(c, F.lit(0).cast("long"))
    return joined.mapInArrow(cut, out.withColumn("_kept_sha256", F.lit("")).schema)
