"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit set where over half the XXH64 hashes (seed 42) of the
shingles do; wider ones have further words from the hashes mixed anew. Candidate pairs
share a band key. With `exact_bands(radius)` no pair within the radius is
missed: the word is cut into radius + 2 blocks and every choice of two that
must agree is a key. Within a bucket the fingerprints are turned into bit
planes and distances counted for 64 of them at a time with carry-save
counters; a block is abandoned once every lane is beyond the radius.

Large buckets are cut into chunks and each pair of chunks is a group of its
own, so no task holds more than two chunks. Tasks return spanning links only,
never all pairs. Null and empty texts have fingerprint zero and link like any
other; repeated rows share a fingerprint; null ids stay and take the
component's smallest id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, components, discard, fresh, materialise, release, small_batches

CHUNK = 8192
SEED = 42


def exact_bands(radius: int) -> list[list[tuple[int, int, int]]]:
    """Keys as lists of (word, shift, width) that miss no pair within the radius of one 64-bit word."""
    n = radius + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    blocks = [(0, cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]
    return [list(c) for c in combinations(blocks, 2)]


def sliding_bands(words: int, width: int, step: int) -> list[list[tuple[int, int, int]]]:
    """Keys of `width` neighbouring bits inside each word."""
    return [[(w, s, width)] for w in range(words) for s in range(0, 64 - width + 1, step)]


def _majority(h: np.ndarray) -> int:
    """The word that has a bit set where over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 32768):
        ones += np.unpackbits(h[i : i + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Fingerprint of one UTF-8 text, A-Z lower-cased and split at ASCII white space, by XXH64 of each shingle, repeats included."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(parts))
    digest = xxhash.xxh64_intdigest
    return _majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(parts) - k + 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes() -> Remembered:
    return Remembered(lambda w: xxhash.xxh64_intdigest(w, SEED), WORDS)


def shingle_hashes(text: bytes | None, shingle: int, known: Remembered) -> np.ndarray:
    """A hash of each shingle of one UTF-8 text, repeats included, made from those of its words."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    k = min(shingle, len(parts))
    n = len(parts) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n])
    return h


def wide_print(h: np.ndarray, words: int) -> list[int]:
    """Fingerprint words from shingle hashes; each word but the first mixes them anew."""
    return [_majority(h if w == 0 else _mix(h + np.uint64(w))) if len(h) else 0 for w in range(words)]


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0): one row for each document, fingerprints as signed longs."""

    def run(batches):
        fresh()
        for b in batches:
            a = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a)], names=["id", "f0"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, f0 long")


def bit_planes(f: np.ndarray) -> np.ndarray:
    """Vertical layout of fingerprints (n, words): plane b holds bit b of all, 64 to a word."""
    n = len(f)
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    lanes = np.zeros((bits.shape[0], -(-n // 64) * 64), np.uint8)
    lanes[:, :n] = bits
    return np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)


def beyond(planes_a, planes_b, radius: int, done: np.ndarray) -> np.ndarray:
    """Bit lanes whose distance exceeds the radius; `done` lanes count as exceeded. Carry-save counters, early abandonment."""
    k = max(1, int(radius + 1).bit_length())
    start = (1 << k) - (radius + 1)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    count = [np.full(done.shape, full if start >> i & 1 else 0, np.uint64) for i in range(k)]
    over = done.copy()
    for i in range(len(planes_b)):
        carry = planes_a[i] ^ planes_b[i]
        for j in range(k):
            count[j], carry = count[j] ^ carry, count[j] & carry
        over |= carry
        if i % 8 == 7 and (over == full).all():
            break
    return over


def spanning_links(f: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect what the links within the radius connect. Each fingerprint is compared with all not yet reached."""
    n = len(f)
    planes = bit_planes(f)
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").astype(bool)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    reached = np.zeros(planes.shape[1] * 64, bool)
    reached[n:] = True
    links = []
    for seed in range(n):
        if reached[seed]:
            continue
        reached[seed], todo = True, [seed]
        while todo:
            q = todo.pop()
            done = np.packbits(reached, bitorder="little").view(np.uint64)
            if (done == full).all():
                break
            mine = np.where(bits[q], full, np.uint64(0))
            over = beyond(mine, planes, radius, done)
            new = np.nonzero(np.unpackbits((~over).view(np.uint8), bitorder="little"))[0]
            reached[new] = True
            links += [(q, int(x)) for x in new]
            todo += new.tolist()
    return links


def short_runs(f: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many short runs at once: all lanes against the lanes d places on."""
    left, right = [], []
    d = 1
    while d < len(f):
        at = np.nonzero(run[d:] == run[:-d])[0]
        if not len(at):
            break
        a, b = bit_planes(f[at]), bit_planes(f[at + d])
        done = np.packbits(np.arange(a.shape[1] * 64) >= len(at), bitorder="little").view(np.uint64)
        hit = np.nonzero(np.unpackbits((~beyond(a, b, radius, done)).view(np.uint8), bitorder="little"))[0]
        left.append(at[hit])
        right.append(at[hit] + d)
        d += 1
    e = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else e, np.concatenate(right) if right else e)


def bucket_links(radius: int, words: int):
    """mapInArrow body over rows (g, node, f0..) sorted by g: links (u, v) between nodes."""

    def solve(g, node, f):
        _, run, sizes = np.unique(g, return_inverse=True, return_counts=True)
        small = sizes[run] <= 32
        us, vs = [], []
        i, j = short_runs(f[small], run[small], radius)
        us.append(node[small][i])
        vs.append(node[small][j])
        for r in np.nonzero(sizes > 32)[0]:
            at = np.nonzero(run == r)[0]
            pairs = np.array(spanning_links(f[at], radius), np.int64).reshape(-1, 2)
            us.append(node[at][pairs[:, 0]])
            vs.append(node[at][pairs[:, 1]])
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        held = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            g = held[0]
            if len(g) and g[0] != g[-1] and len(g) >= 20000:
                cut = int(np.searchsorted(g, g[-1]))
                yield solve(g[:cut], held[1][:cut], np.stack([c[:cut] for c in held[2:]], 1).view(np.uint64))
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield solve(held[0], held[1], np.stack(held[2:], 1).view(np.uint64))

    return run


def links(nodes: DataFrame, words: int, radius: int, bands, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) between distinct nodes(node long, f0..) within the radius, enough of them to connect what is connected."""
    fs = [f"f{w}" for w in range(words)]

    def key(band):
        k = F.lit(0).cast("long")
        for w, s, width in band:
            part = F.shiftrightunsigned(F.col(f"f{w}"), s).bitwiseAND(F.lit((1 << width) - 1))
            k = F.shiftleft(k, width).bitwiseOR(part)
        return k

    # rows travel with their key alone until it is known which keys are shared; a chance collision of two keys only adds comparisons
    slim = fs if words == 1 else []
    keyed = nodes.select("node", *slim, F.posexplode(F.array(*[key(b) for b in bands])).alias("t", "k")).withColumn("k", F.xxhash64("t", "k")).drop("t")
    sizes = materialise(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    rows = keyed.join(sizes, "k")
    if not slim:
        rows = materialise(rows, "held").join(nodes.select("node", *fs), "node")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.when(parts > 1, F.pmod(F.xxhash64("node", F.lit(7)), parts)).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("p", parts).withColumn("c", mine)
    rows = rows.withColumn("j", F.explode(F.expr("sequence(0, p - 1)"))).where("p = 1 OR j <> c")
    rows = rows.select(F.xxhash64("k", F.least("c", "j"), F.greatest("c", "j")).alias("g"), "node", *fs)
    rows = rows.repartition(F.col("g")).sortWithinPartitions("g")
    return rows.mapInArrow(bucket_links(radius, words), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, component): the smallest id reachable over fingerprint links, itself included. Empty input gives no rows."""
    small_batches(docs.sparkSession)
    prints = materialise(fingerprints(docs, shingle, id_col, text_col), "prints")
    nodes = materialise(prints.groupBy("f0").agg(F.min("id").alias("low")).select(F.col("f0").alias("node"), "f0", "low"), "nodes")
    found = components(links(nodes, 1, radius, exact_bands(radius)))
    rooted = materialise(nodes.select("node", "low").join(found, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "rooted")
    lows = materialise(rooted.groupBy("root").agg(F.min("low").alias("component")), "lows")
    of = materialise(rooted.join(lows, "root").select(F.col("node").alias("f0"), "component"), "classes")
    discard(nodes, rooted, lows)
    return prints.join(of, "f0", "left").select("id", "f0", "component")


#: For near copies of five-word shingles: 128 bits, keys of 20 neighbouring bits, at most 22 bits apart. They only group most copies early.
WIDE = {"shingle": 5, "words": 2, "radius": 22, "bands": sliding_bands(2, 20, 6)}
#: Words whose hashes a task remembers.
WORDS = 400_000
#: Near copies share this part of their shingles at least: NEAR[0] of NEAR[1].
NEAR = (4, 5)
#: Counters of the shingles' frequency. They set the order of shingles only, never which pairs are found.
COUNTERS = 1 << 18
#: Rows of one shingle that meet in a task are twice as many at most.
MEET = 8192
#: Pairs that a task looks at together.
PAIRS = 1 << 20
#: Cells that a set's shingles are counted in, for a bound on what two sets share.
CELLS = 256


def _node(distinct: np.ndarray) -> int:
    """Identity of a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(distinct.tobytes(), SEED)).view(np.int64))


def _frequency(texts: DataFrame, shingle: int) -> np.ndarray:
    """Texts for each counter of shingle hashes."""

    def run(batches):
        n, known = np.zeros(COUNTERS, np.int64), word_hashes()
        for b in batches:
            each = [np.unique(shingle_hashes(t, shingle, known)) % np.uint64(COUNTERS) for t in b.column(0).cast(pa.binary()).to_pylist()]
            if each:
                n += np.bincount(np.concatenate(each).astype(np.int64), minlength=COUNTERS)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for r in texts.select("t").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():  # COUNTERS rows at most
        out[r.at] = r.n
    return out


def _prefixes(texts: DataFrame, shingle: int, words: int) -> DataFrame:
    """(id, h, f0.., node, n, prefix, cells): n distinct shingles, counted by cells of their hashes, of which the prefix holds the rarest, so many that sets NEAR each other share one.

    A shingle's key has its counter's logarithm in the upper 12 bits and
    its hash in the others, so that keys in order are shingles by rarity.
    """
    num, den = NEAR
    often = np.round(64 * np.log2(1 + _frequency(texts, shingle))).clip(0, 2047).astype(np.uint64) << np.uint64(52)
    shared = texts.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        often, known = shared.value, word_hashes()
        fresh()
        for b in batches:
            prints, node, size, prefix, cells = [], [], [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                h = shingle_hashes(t, shingle, known)
                s = np.unique(h)
                keep = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                keys = often[(s % np.uint64(COUNTERS)).astype(np.int64)] | (s >> np.uint64(12))
                prints.append(wide_print(h, words))
                node.append(_node(s))
                size.append(len(s))
                prefix.append(np.sort(keys)[:keep].view(np.int64))
                cells.append(np.bincount((s >> np.uint64(20)).astype(np.int64) % CELLS, minlength=CELLS).clip(0, 65535).astype(np.uint16).tobytes())
            a = np.array(prints, np.uint64).reshape(-1, words).view(np.int64)
            fs = [pa.array(a[:, w]) for w in range(words)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *fs, pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(cells, pa.binary())],
                names=["id", "h", *(f"f{w}" for w in range(words)), "node", "n", "prefix", "cells"],
            )
        known.clear()
        release()

    cols = ", ".join(f"f{w} long" for w in range(words))
    return texts.select("id", "h", "t").mapInArrow(run, f"id long, h long, {cols}, node long, n int, prefix array<long>, cells binary")


def _shared(nodes: DataFrame) -> DataFrame:
    """(k, node, i): the shingles that stand in the prefixes of several nodes, and their places there. Most stand in one alone, so rows travel with nothing else."""
    keyed = nodes.select("node", F.posexplode("prefix").alias("i", "k"))
    several = materialise(keyed.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k"), "several")
    out = materialise(keyed.join(several, "k").select("k", "node", "i"), "shared")
    discard(several)
    return out


def _meetings(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes(node, root, n) with other roots that share a shingle of both prefixes and can be NEAR by size and place."""
    num, den = NEAR

    def pairs(g, node, root, n, i, c, cross):
        """Rows are sorted by g and root: each meets the rows of its group before its own root's, so that one large class costs no more than it has rows."""
        begins = lambda *keys: np.maximum.accumulate(np.where(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))), np.arange(len(g)), 0))
        group = begins(g)
        count = begins(g, root) - group
        total = np.cumsum(count)
        done = 0
        while done < len(g):
            end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
            k = count[done:end]
            b = np.repeat(np.arange(done, end), k)
            a = np.repeat(group[done:end], k) + np.arange(len(b)) - np.repeat(np.cumsum(k) - k, k)
            most = np.minimum(n[a] - i[a], n[b] - i[b])  # common shingles from this one on
            ok = ((num + den) * most >= num * (n[a] + n[b])) & (~cross[a] | (c[a] != c[b]))
            x, y = node[a[ok]], node[b[ok]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["u", "v"])
            done = end

    def run(batches):
        held = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            g = held[0]
            if len(g) and g[0] != g[-1] and len(g) >= 20000:
                cut = int(np.searchsorted(g, g[-1]))
                yield from pairs(*(c[:cut] for c in held))
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield from pairs(*held)
        release()

    keyed = materialise(shared.join(nodes.select("node", "root", F.col("n").cast("long").alias("n")), "node"), "keyed")
    sizes = keyed.groupBy("k").agg(F.count("*").alias("m"), F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("k", "m")
    sizes = materialise(sizes, "sizes")  # so that the join is one of two plain shuffles, which can part a hot shingle
    parts = F.ceil(F.col("m") / MEET).cast("int")
    mine = F.when(parts > 1, F.pmod(F.xxhash64("node", F.lit(7)), parts)).otherwise(F.lit(0)).cast("int")
    rows = keyed.join(sizes, "k").withColumn("p", parts).withColumn("c", mine)
    rows = rows.withColumn("j", F.explode(F.expr("sequence(0, p - 1)")))  # two parts meet each other, and each itself
    rows = rows.select(F.xxhash64("k", F.least("c", "j"), F.greatest("c", "j")).alias("g"), "node", "root", "n", F.col("i").cast("long").alias("i"), "c", (F.col("c") != F.col("j")).alias("cross"))
    return rows.repartition(F.col("g")).sortWithinPartitions("g", "root").mapInArrow(run, "u long, v long")


def _near(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """The pairs (u, v) whose sets of shingles are NEAR each other, by counting what they share."""
    num, den = NEAR

    def run(batches):
        known = word_hashes()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                sets = [np.unique(shingle_hashes(t, shingle, known)) for t in b.column(0).slice(k, 256).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "s"])
        known.clear()
        release()

    def able(batches):
        """Pairs that share enough if each cell shares all it can: 65535 shingles in a cell, the most that is counted, let a pair through."""
        for b in batches:
            u, v, a, c, n, m = b.columns
            x, y = (np.frombuffer(b"".join(z.to_pylist()), np.uint16).reshape(-1, CELLS) for z in (a, c))
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            ok = ((num + den) * most >= num * (n.to_numpy().astype(np.int64) + m.to_numpy())) | (x == 65535).any(1) | (y == 65535).any(1)
            yield pa.RecordBatch.from_arrays([u.filter(pa.array(ok)), v.filter(pa.array(ok))], names=["u", "v"])

    pairs = materialise(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "pairs")
    every = pairs
    counted = nodes.select("node", "cells", "n")
    pairs = pairs.join(counted.toDF("u", "a", "n"), "u").join(counted.toDF("v", "c", "m"), "v").select("u", "v", "a", "c", "n", "m")
    pairs = materialise(pairs.mapInArrow(able, "u long, v long"), "able")
    discard(every)
    ends = materialise(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ends")
    needed = materialise(nodes.select("node", "some").join(ends, "node").select(F.col("some").alias("h")).distinct(), "needed")
    sets = texts.select("t", "h").join(needed, "h", "left_semi").select("t").mapInArrow(run, "node long, s array<long>")
    sets = materialise(sets.groupBy("node").agg(F.first("s").alias("s")), "sets")
    left, right = sets.select(F.col("node").alias("u"), F.col("s").alias("a")), sets.select(F.col("node").alias("v"), F.col("s").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    out = pairs.join(left, "u").join(right, "v").where((num + den) * both >= num * (F.size("a") + F.size("b"))).select("u", "v")
    out = materialise(out, "near")
    discard(pairs, ends, needed, sets)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, root): classes of texts linked by a Jaccard similarity of NEAR or more over their shingles.

    Fingerprints within WIDE's radius find most links; what they join is no
    longer compared. Between the classes so far a prefix filter on the rarest
    shingles gives every pair that can be NEAR, so none is missed. All links,
    of both kinds, are held against the sets of shingles themselves.
    """
    shingle, words = WIDE["shingle"], WIDE["words"]
    fs = [f"f{w}" for w in range(words)]
    text = F.col(text_col).cast("string")
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("h"))
    full = materialise(_prefixes(texts, shingle, words), "prints")
    prints = materialise(full.select("id", "h", "node"), "ids")
    first = [F.first(c).alias(c) for c in (*fs, "n", "prefix", "cells")]
    nodes = materialise(full.groupBy("node").agg(F.min("h").alias("some"), *first), "nodes")
    discard(full)
    early = _near(links(nodes.select("node", *fs), words, WIDE["radius"], WIDE["bands"]), texts, nodes, shingle)
    rooted = lambda found: nodes.select("node", "n").join(found, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    classes = materialise(rooted(components(early)), "roots")
    shared = _shared(nodes)
    late = _near(_meetings(shared, classes), texts, nodes, shingle)
    of = materialise(rooted(components(early.unionByName(late))), "classes")
    discard(nodes, classes, shared, early, late)
    return prints.join(of, "node").select("id", "h", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one document of each class of near copies: that of the smallest id (nulls last), of repeated rows one.

    Null texts are no copies of anything: all of them stay. Texts without
    words are copies of one another. All columns stay as they are.
    """
    text = F.col(text_col).cast("string")
    some = docs.where(text.isNotNull())
    found = near_copies(some, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("h").alias("h"))).alias("k")
    same = materialise(found.groupBy("root", "id", "h").agg(F.count("*").alias("copies")), "same")
    heads = same.groupBy("root").agg(first).select("root", "k.id", "k.h")
    heads = heads.join(same, (heads.root == same.root) & heads.id.eqNullSafe(same.id) & (heads.h == same.h)).select(heads.id.alias("__loom_id"), heads.h.alias("__loom_h"), "copies")
    keyed = some.withColumn("__loom_hash", F.xxhash64(text))
    match = keyed[id_col].cast("long").eqNullSafe(F.col("__loom_id")) & (F.col("__loom_hash") == F.col("__loom_h"))
    heads = materialise(heads, "heads")
    discard(same)
    once = keyed.join(heads.where("copies = 1"), match, "left_semi")
    more = keyed.join(heads.where("copies > 1"), match, "left_semi").dropDuplicates([id_col, "__loom_hash"])
    return once.unionByName(more).drop("__loom_hash").unionByName(docs.where(text.isNull()))
