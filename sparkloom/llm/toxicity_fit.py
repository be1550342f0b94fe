"""The toxicity classifier fitted on all labelled rows of tables.

`fit_tables` gives the model that `toxicity.fit` gives for a list of the same
rows, without a list: units are counted by Spark, those that can mark toxicity
are narrowed down by bounds that lose none before they are counted by families
of near copies, Newton steps add up each task's share of the loss, and the cut
comes from the worst margin of every document. The driver sees counts of the
units that can mark toxicity, of the patterns in which toxic documents hold
them, and of distinct margins.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import toxicity as tox
from .common import Remembered, components, discard, fresh, materialise, release, small_batches

#: Words whose units a task remembers, and units whose marks it remembers.
WORDS = 200_000
TURNS = (np.arange(16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def _units(text: str, known: Remembered) -> set[str]:
    """Distinct units of all sentences."""
    words = text.lower().split()
    distinct = set(words)
    bare = {w.strip(tox.EDGE) for w in distinct}
    # what tox._plain says, without a call for each word
    plain = {w for w in bare if w.isalpha() and 1 < len(w) < tox.WINDOW and (len(w) < 2 * tox.ORDER - 1 or w[1] != w[3])}
    out, single = {"^" + w for w in plain}, set()
    for w in bare - plain:
        out.update(known[w])
        if len(w) == 1 and w.isalpha():
            single.add(w)
    if single:
        out.update(tox.text_runs(text, words, {w for w in distinct if w.strip(tox.EDGE) in single}))
    return out


def _bands(units: set[str]) -> list[int]:
    """Keys of four min-hashes in a row of the longer units."""
    long = [u for u in units if len(u) >= 6]
    try:
        hashes = np.array(list(map(zlib.crc32, map(str.encode, long))), np.uint64)
    except UnicodeEncodeError:
        hashes = np.array([zlib.crc32(u.encode("utf-8", "surrogatepass")) for u in long], np.uint64)
    if not len(hashes):
        return []
    x = hashes[:, None] * TURNS
    low = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(0)
    return [int(np.uint64(xxhash.xxh64_intdigest(low[k : k + 4].tobytes(), k)).view(np.int64)) for k in range(0, 16, 4)]


def _tokens(rows: DataFrame) -> DataFrame:
    """(node, toxic, us, bands): each document's distinct units and the keys of its near copies."""

    def run(batches):
        fresh()
        known = Remembered(tox.word_units, WORDS)
        for b in batches:
            us = [_units(t or "", known) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(u) for u in us], pa.list_(pa.string())), pa.array([_bands(u) for u in us], pa.list_(pa.int64()))], names=["node", "toxic", "us", "bands"])
        known.clear()
        release()

    return rows.select(F.xxhash64("_id").alias("node"), "_toxic", "_text").mapInArrow(run, "node long, toxic int, us array<string>, bands array<long>")


def _family(tokens: DataFrame) -> DataFrame:
    """(node, root) of documents that have near copies, as toxicity._families finds them."""
    keyed = tokens.select("node", F.explode("bands").alias("k"))
    low = keyed.groupBy("k").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("k", "low")
    return materialise(components(keyed.join(low, "k").select(F.col("node").alias("u"), F.col("low").alias("v"))), "families")


def _holding(tokens: DataFrame, stems: set[str]) -> DataFrame:
    """(node, toxic, hits): the documents that hold units which begin with some of the stems, and those stems."""
    shared = tokens.sparkSession.sparkContext.broadcast(stems)

    def run(batches):
        fresh()
        wanted = shared.value
        least = tox.ORDER + 1  # letters of the shortest stems
        begins = pa.array(sorted({s[:least] for s in wanted}), pa.string())
        known = Remembered(lambda u: tuple(tox._stems({u}) & wanted), WORDS)
        for b in batches:
            us = b.column(2)
            # most units begin like no stem, which their first letters tell
            flat, of = us.flatten(), pc.list_parent_indices(us)
            may = pc.is_in(pc.utf8_slice_codeunits(flat, 0, least), begins)
            hits = [set() for _ in range(b.num_rows)]
            for i, u in zip(of.filter(may).to_pylist(), flat.filter(may).to_pylist()):
                hits[i].update(known[u])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(sorted, hits)), pa.list_(pa.string()))], names=["node", "toxic", "hits"])
        known.clear()
        release()

    return tokens.select("node", "toxic", "us").mapInArrow(run, "node long, toxic int, hits array<string>").where("size(hits) > 0")


def _patterns(held: DataFrame, able: set[str]) -> DataFrame:
    """(p): the able ones of each toxic document's stems."""
    shared = held.sparkSession.sparkContext.broadcast(able)

    def run(batches):
        wanted = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[w for w in hits if w in wanted] for hits in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["p"])

    return held.where("toxic > 0").select("hits").mapInArrow(run, "p array<string>")


def _seeds(tokens: DataFrame, families: DataFrame, counted: DataFrame) -> list[str]:
    """What toxicity._cover finds. counted(u, t, c, r): toxic and clean documents of each unit, and the clean ones that are their family's first, so at most as many as there are clean families."""
    of = lambda rows: rows.join(families, "node", "left").withColumn("family", F.coalesce("root", "node"))
    sizes = {r.toxic: r.n for r in of(tokens.select("node", F.least("toxic", F.lit(1)).alias("toxic"))).groupBy("toxic").agg(F.count_distinct("family").alias("n")).collect()}
    n0, n1 = (max(1, sizes.get(y, 0)) for y in (0, 1))
    ends = F.sequence(F.lit(tox.ORDER + 1), F.least(F.length("u"), F.lit(tox.WINDOW // 2)))
    stems = counted.where(F.length("u") > tox.ORDER).select(F.explode(F.transform(ends, lambda n: F.col("u").substr(F.lit(1), n))).alias("w"), "t", "r")
    stems = materialise(stems.groupBy("w").agg(F.sum("t").alias("t"), F.max("r").alias("r")).where("t > 0"), "stems")
    tried = max(1, stems.count())
    # no fewer toxic documents than families, no more clean ones of a unit than families of the stem: none of those able is lost
    sure = (F.col("t") > F.lit(float(tox._bar(tried, n0, n1)))) & (F.col("t") / n1 > 20 * (F.col("r") + 1) / n0)
    spare = (F.col("r") == 0) & (F.length("w") > tox.ORDER + 1)
    found, able, least = [], set(), 3
    for which in (sure, spare):
        some = {r.w for r in stems.where(F.col("t") >= 2).where(which).select("w").toLocalIterator()}
        if not some:
            continue
        held = materialise(_holding(tokens, some), "held")
        n = of(held.select("node", (F.col("toxic") > 0).alias("toxic"), F.explode("hits").alias("w"))).groupBy("w", "toxic").agg(F.count_distinct("family").alias("n"))
        rows = n.collect()  # two rows for each stem that may mark toxicity
        bad, good = {r.w: r.n for r in rows if r.toxic and r.n >= 2}, {r.w: r.n for r in rows if not r.toxic}
        able, least = tox._able(bad, good, tried, n0, n1)
        # the second kind of mark counts only once all of its candidates were counted
        if able and (least == 3 or which is spare):
            left = Counter({frozenset(r.p): r.n for r in _patterns(held, able).groupBy("p").agg(F.count("*").alias("n")).toLocalIterator()})
            found = tox._greedy(left, bad, able, least, n1)
        discard(held)
        if found or (able and least == 3):
            break
    discard(stems)
    return found


def _similar(counted: DataFrame, marks: list[str]) -> DataFrame:
    """(u, t, c, x): units of which x, their kernel with the marks, is not all zero."""
    shared = counted.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        fresh()
        marks = shared.value

        def solve(held):
            b = pa.Table.from_batches(held).combine_chunks()
            us = b.column(0).to_pylist()
            order = sorted(range(len(us)), key=lambda i: len(us[i]))
            for k in range(0, len(order), tox.PARTS // 2):
                at = order[k : k + tox.PARTS // 2]
                x = tox.features([us[i] for i in at], marks)
                some = np.nonzero(x.any(1))[0]
                own = b.take(pa.array([at[i] for i in some.tolist()], pa.int64())).combine_chunks()
                for r in own.to_batches():
                    yield pa.RecordBatch.from_arrays([*r.columns, pa.array([y.tobytes() for y in x[some]], pa.binary())], names=["u", "t", "c", "x"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 2 * tox.PARTS:
                yield from solve(held)
                held, n = [], 0
        if n:
            yield from solve(held)
        release()

    return counted.select("u", "t", "c").mapInArrow(run, "u string, t long, c long, x binary")


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, width)


def _beside(near: DataFrame, seeds: list[str], landmarks: int) -> list[str]:
    """The clean units that are most like each seed, best of all seeds first."""

    def run(batches):
        for b in batches:
            x = np.round(_matrix(b.column(2), len(seeds)), 12)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["u", "c", "x"])

    x = materialise(near.where("c > 0").where(F.length("u") > tox.ORDER).select("u", "c", "x").mapInArrow(run, "u string, c long, x array<double>"), "near")
    best = None
    for j in range(len(seeds)):
        one = x.select("u", "c", F.col("x")[j].alias("x")).where(F.col("x") > tox.NEAR).orderBy(F.desc("x"), F.desc("c"), "u").limit(landmarks).withColumn("j", F.lit(j))
        best = one if best is None else best.unionByName(one)
    rows = sorted(best.collect(), key=lambda r: (r.j, -r.x, -r.c, r.u))
    discard(x)
    ranked: dict[int, list[str]] = {}
    for r in rows:
        ranked.setdefault(r.j, []).append(r.u)
    return list(dict.fromkeys(us[k] for k in range(landmarks) for _, us in sorted(ranked.items()) if k < len(us)))


def fit_tables(docs: DataFrame, labels: DataFrame, landmarks: int = tox.LANDMARKS, id_col: str = "doc_id", text_col: str = "text") -> tox.Model:
    """The model of all labelled rows that `toxicity.labelled` gives. Without both classes every score is that of an untrained, clean verdict."""
    spark = docs.sparkSession
    small_batches(spark)
    tokens = materialise(_tokens(tox.labelled(docs, labels, id_col, text_col)), "tokens")
    families = _family(tokens)
    each = tokens.select("node", (F.col("toxic") > 0).cast("int").alias("toxic"), "us").join(families, "node", "left")
    first = (F.coalesce("root", "node") == F.col("node")).cast("int")
    each = each.select("toxic", first.alias("first"), F.explode("us").alias("u"))
    counted = materialise(each.groupBy("u").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.sum((1 - F.col("toxic")) * F.col("first")).alias("r")), "units")
    seeds = _seeds(tokens, families, counted)
    if not seeds:
        discard(tokens, families, counted)
        return tox.Model((), np.zeros((0, 0)), np.zeros(0), tox.NOTHING)
    near = materialise(_similar(counted, seeds), "seeded")
    marks, root = tox._landmarks(seeds, _beside(near, seeds, landmarks), landmarks)
    table = materialise(_similar(counted, marks), "kernel")

    begins = F.lit(False)
    for s in seeds:
        begins = begins | F.col("u").startswith(s)
    clean, bad = (F.col("c") > 0) & (F.length("u") > tox.ORDER), (F.col("t") > 0) & begins
    n_clean, n_bad = counted.agg(F.count_if(clean), F.count_if(bad)).first()
    width = len(seeds)
    rows = table.select(F.col("x"), clean.cast("int").alias("clean"), bad.cast("int").alias("bad"))

    def hard_of(x, clean):
        return (np.round(x[:, :width], 12).max(1, initial=0) > tox.NEAR) & (clean > 0)

    def sums(batches):
        n = [0, 0, 0]
        for b in batches:
            c, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            n = [n[0] + int(c.sum()), n[1] + int(hard_of(_matrix(b.column(0), len(marks)), c).sum()), n[2] + int(t.sum())]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], names=["c", "h", "t"])

    some_clean, n_hard, some_bad = (x or 0 for x in rows.mapInArrow(sums, "c long, h long, t long").agg(F.sum("c"), F.sum("h"), F.sum("t")).first())
    worn = tox._worn(seeds)
    of = tox.Masses(n_clean, n_hard, n_bad, len(worn))
    worn = np.column_stack([tox.features(worn, marks) @ root, np.ones(len(worn))])
    zero = np.zeros((1, worn.shape[1]))
    zero[0, -1] = 1  # what all units have that are like no mark

    def stats(v):
        def run(batches):
            total = [0.0, np.zeros(len(v)), np.zeros((len(v), len(v)))]
            for b in batches:
                c, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                x = _matrix(b.column(0), len(marks))
                z = np.column_stack([x @ root, np.ones(len(x))])
                for y, weight in ((1.0, t * of.toxic), (-1.0, c * of.far + hard_of(x, c) * of.hard)):
                    total = [a + b for a, b in zip(total, tox._hinge(z, np.full(len(z), y), weight, v))]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[total[0]], total[1], total[2].ravel()]).tobytes()], pa.binary())], names=["s"])

        out = [tox._hinge(worn, np.ones(len(worn)), np.full(len(worn), of.worn), v)]
        out += [tox._hinge(zero, np.full(1, y), np.full(1, k), v) for y, k in ((1.0, (n_bad - some_bad) * of.toxic), (-1.0, (n_clean - some_clean) * of.far))]
        for r in sorted(bytes(r.s) for r in rows.mapInArrow(run, "s binary").collect()):  # one small row for each task
            x = np.frombuffer(r)
            out.append((x[0], x[1 : 1 + len(v)], x[1 + len(v) :].reshape(len(v), len(v))))
        return tuple(sum(p) for p in zip(*out))

    w, b = tox._newton(stats, root.shape[1])
    each = root @ w

    def margins(batches):
        for r in batches:
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array(_matrix(r.column(1), len(marks)) @ each + b)], names=["u", "m"])

    known = materialise(table.select("u", "x").mapInArrow(margins, "u string, m double"), "margins")
    met = tokens.select("node", F.explode("us").alias("u")).join(known, "u").groupBy("node").agg(F.max("m").alias("m"), F.count("*").alias("n"))
    worst = tokens.select("node", "toxic", F.size("us").alias("size")).join(met, "node", "left")
    m = F.when(F.col("size") == 0, F.lit(tox.NOTHING)).when(F.col("n") == F.col("size"), F.col("m")).otherwise(F.greatest("m", F.lit(b)))
    worst = worst.select(m.alias("m"), (F.col("toxic") > 0).cast("int").alias("t")).groupBy("m").agg(F.sum(1 - F.col("t")).alias("n0"), F.sum("t").alias("n1"))
    cut = tox._cut([(r.m, r.n0, r.n1) for r in worst.toLocalIterator()])  # distinct margins
    discard(tokens, families, counted, near, table, known)
    return tox.Model(tuple(marks), root, w, b, cut)
