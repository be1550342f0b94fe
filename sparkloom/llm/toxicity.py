"""Toxicity by a subsequence string-kernel SVM on Nystroem landmarks.

The kernel counts common letter subsequences of length ORDER, each weighted
by DECAY to the power of the two spans, so gapped and inserted letters still
match. Kernel rows against the landmarks times the inverse square root of the
landmarks' own kernel are explicit features; a linear SVM on them scores units
of a sentence, and a document is as toxic as its worst unit.

Labels mark documents, not sentences. Training finds the units that explain
the toxic documents by greedy cover, takes the sentences that hold them as
toxic ones and sentences of clean documents as the rest.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, small_batches, without

ORDER = 4
DECAY = 0.6
LANDMARKS = 48
SPLIT = re.compile(r"[.!?\n]+(?=\s|\Z)")
EDGE = ".,;:!?\"'()[]{}<>*#$%&-_~|/\\“”«»…"
#: Letters of a unit; longer words are read in windows of so many, each half over the one before.
WINDOW = 48
STEMS = 24
#: Weight of the SVM's norm against its mean loss.
RIDGE = 1e-4
#: Times that each insult with inserted letters is trained on.
WORN = 2
#: Units whose kernel rows are found at once.
PARTS = 4096
#: Pairs of units whose common subsequences are weighed at once.
PAIRS = 256
#: Clean units at least so like an insult weigh more in training.
NEAR = 0.2
#: Margin of a text without units.
NOTHING = -1.5
#: Texts whose new words are scored at once.
TOGETHER = 3000
#: Words whose margins a task remembers.
KNOWN = 400_000


def word_units(w: str) -> list[str]:
    """What is scored of one lower-case word: the word without edge marks, its letters alone, and, where one letter stands
    between all others, the word without it; all whole, after a mark for the beginning. Insults are inflected at their end,
    so `features` takes as much of a unit as a landmark matches. Single letters count in runs only."""
    w = w.strip(EDGE)
    if not w or len(w) == 1 and w.isalpha():
        return []
    if _plain(w):
        return ["^" + w]
    out = [w]
    if not w.isalpha() and len(letters := "".join(filter(str.isalpha, w))) >= ORDER:
        out.append(letters)
    if len(w) >= 2 * ORDER - 1 and len(set(w[1::2])) == 1:
        out.append(w[::2])
    return [u for x in out for u in _windows("^" + x)]


def _plain(w: str) -> bool:
    """Of a word without edge marks: that it is its only unit, after the mark for the beginning, as with nearly all words."""
    return w.isalpha() and 1 < len(w) < WINDOW and (len(w) < 2 * ORDER - 1 or w[1] != w[3])


def runs(words: list[str]) -> list[str]:
    """Units of single letters that follow one another, joined."""
    out, run = [], []
    for w in [*words, ""]:
        w = w.strip(EDGE)
        if len(w) == 1 and w.isalpha():
            run.append(w)
            continue
        if len(run) >= ORDER:
            out += _windows("^" + "".join(run))
        run = []
    return out


def units(sentence: str) -> list[str]:
    """All that is scored of a sentence."""
    words = sentence.lower().split()
    return [u for w in words for u in word_units(w)] + runs(words)


def text_runs(text: str, words: list[str], single: set[str]) -> list[str]:
    """Units of single letters in a row, inside a sentence; words are the text's, single those that are one letter but for edge marks."""
    if not single or (b"\1" * ORDER) not in bytes(map(single.__contains__, words)):
        return []
    return [u for s in SPLIT.split(text) for u in runs(s.lower().split())]


def _windows(u: str) -> list[str]:
    """u itself, or where it is long, windows that hold all of it."""
    return [u] if len(u) <= WINDOW else [u[i : i + WINDOW] for i in range(0, len(u) - WINDOW // 2, WINDOW // 2)]


def features(xs: list[str], ys: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Normalised kernel of every landmark y with the beginning of x that reaches as far as y's letters do. Zero where the whole x lacks more than one of them."""
    out = np.zeros((len(xs), len(ys)))
    if not xs:
        return out
    a = np.minimum(_codes(xs), 0xFFFF)
    holds, sizes = _letters(a), np.array([len(x) for x in xs])
    met = []
    for j, y in enumerate(ys):
        # each letter that x does not hold at all is one it lacks
        own = _letters(np.minimum(_codes([y]), 0xFFFF))[0]
        at = np.nonzero((np.bitwise_count(own & ~holds) <= 1) & (sizes >= max(order, len(y) - 1)))[0]
        common, end = _common(a[at], y)
        ok = common >= max(order, len(y) - 1)
        met.append((at[ok], [xs[i][:e] for i, e in zip(at[ok].tolist(), end[ok].tolist())]))
    own_x = _by_length(lambda some: _self(some, order, decay), {x for _, parts in met for x in parts})
    for j, (y, (at, parts)) in enumerate(zip(ys, met)):
        raw = _by_length(lambda some: _against(some, y, order, decay), set(parts))  # noqa: B023
        own_y = _own(y, order, decay)
        out[at, j] = [raw[x] / (own_x[x] * own_y) ** 0.5 for x in parts]
    return out


def _letters(a: np.ndarray) -> np.ndarray:
    """One word for each row, with a bit for each letter it holds; letters may share a bit."""
    return np.bitwise_or.reduce(np.where(a > 0, np.uint64(1) << (a % 64).astype(np.uint64), np.uint64(0)), axis=1)


def _by_length(f, xs: set) -> dict[str, float]:
    """f of each x, found for many of like length at once."""
    xs, out = sorted(xs, key=lambda x: (len(x), x)), {}
    for k in range(0, len(xs), PARTS // 4):
        out.update(zip(xs[k : k + PARTS // 4], f(xs[k : k + PARTS // 4]).tolist()))
    return out


def kernel(xs: list[str], ys: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Normalised gap-weighted subsequence kernel of every x with every y."""
    raw = _raw(xs, ys, order, decay)
    own_y = np.array([_own(y, order, decay) for y in ys])
    own_x = np.ones(len(xs))
    hit = np.nonzero(raw.any(1))[0]
    if len(hit):
        own_x[hit] = _self([xs[i] for i in hit], order, decay)
    d = np.sqrt(own_x[:, None] * own_y[None, :])
    return np.divide(raw, d, out=np.zeros_like(raw), where=d > 0)


@lru_cache(4096)
def _own(y: str, order: int, decay: float) -> float:
    return float(_raw([y], [y], order, decay)[0, 0])


def _raw(xs, ys, order, decay) -> np.ndarray:
    """Kernel before normalising; zero where x lacks more than one of y's letters in their order, which no mere gap or insertion causes."""
    out = np.zeros((len(xs), len(ys)))
    if not xs:
        return out
    a = np.minimum(_codes(xs), 0xFFFF)
    for j, y in enumerate(ys):
        at = np.nonzero(_common(a, y)[0] >= max(order, len(y) - 1))[0]
        if len(at):
            out[at, j] = _against([xs[i] for i in at], y, order, decay)
    return out


def _common(a: np.ndarray, y: str) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest common subsequence of y with each row of letters, bit-parallel, and how many letters of the row it takes."""
    holds = np.zeros(0x10000, np.uint64)
    for i, c in enumerate(y):
        holds[min(ord(c), 0xFFFF)] |= np.uint64(1 << i)
    mask = np.uint64((1 << len(y)) - 1)
    v = np.full(len(a), mask, np.uint64)
    lacks, end = np.full(len(a), len(y), np.uint8), np.zeros(len(a), np.int64)
    for p, h in enumerate(holds[a.T]):
        u = v & h
        v = (v + u) | (v - u)
        n = np.bitwise_count(v & mask)
        end[n < lacks] = p + 1
        lacks = n
    return len(y) - lacks.astype(np.int64), end


def _codes(xs):
    n = max(map(len, xs))
    return np.frombuffer("".join(x.ljust(n, "\0") for x in xs).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(xs), n).astype(np.int32)


def _against(xs, y, order, decay) -> np.ndarray:
    """Dynamic programme over the letters of all xs at once."""
    a, b = _codes(xs).T, np.array([ord(c) for c in y])[None, :, None]
    return np.concatenate([_paths(x[:, None, :] == b, order, decay) for x in _some(a)])


def _self(xs, order, decay) -> np.ndarray:
    return np.concatenate([_paths((x[:, None, :] == x[None, :, :]) & (x[:, None, :] != 0), order, decay) for x in _some(_codes(xs).T)])


def _some(a: np.ndarray) -> list[np.ndarray]:
    """Columns of a, so many at once that a processor's cache holds what is found of them."""
    return [a[:, k : k + PAIRS] for k in range(0, a.shape[1], PAIRS)]


def _paths(same: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Weighted common subsequences of pairs of words; same[s, t, i]: letter s of pair i's one word is letter t of its other. Steps take all of the letters of one side and all pairs together."""
    m, n, b = same.shape
    on = np.ones((m, n, b))
    for _ in range(order - 1):
        gap, cur = (decay**2 * on) * same, np.zeros((m, n, b))
        for t in range(1, n):
            gap[:, t] += decay * gap[:, t - 1]
        # ends before letter s of the one word and t of the other
        for s in range(1, m):
            np.multiply(cur[s - 1, 1:], decay, out=cur[s, 1:])
            cur[s, 1:] += gap[s - 1, :-1]
        on = cur
    # letter by letter, so that what shorter words are filled up with changes nothing
    return decay**2 * (on * same).sum(0).sum(0)


@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...]
    root: np.ndarray
    weights: np.ndarray
    bias: float
    cut: float = 0.0
    slope: float = 3.0

    def margins(self, xs: list[str]) -> np.ndarray:
        """SVM margin of each unit."""
        if not self.landmarks or not xs:
            return np.full(len(xs), self.bias)
        order = sorted(range(len(xs)), key=lambda i: len(xs[i]))
        out, each = np.zeros(len(xs)), self.root @ self.weights
        for k in range(0, len(order), PARTS):
            at = order[k : k + PARTS]
            out[at] = (features([xs[i] for i in at], list(self.landmarks)) * each).sum(1) + self.bias
        return out

    def probability(self, margin: float) -> float:
        """0.3 at the cut that parts the training documents best."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * (margin - self.cut) + np.log(3 / 7), -30, 30))))


def _families(docs: list[set]) -> list[int]:
    """A number for each document, one for all near copies: documents that share four min-hashes of their longer units in a row."""
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen: dict = {}
    turns = (np.arange(16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for i, us in enumerate(docs):
        hashes = np.array([zlib.crc32(u.encode()) for u in us if len(u) >= 6], np.uint64)
        if len(hashes):
            x = hashes[:, None] * turns
            low = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(0).tolist()
            for k in range(0, 16, 4):
                j = seen.setdefault((k, *low[k : k + 4]), i)
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(docs))]


def _stems(units: set) -> set:
    """Units and their beginnings: insults are inflected."""
    return {u[:n] for u in units for n in range(ORDER + 1, min(len(u), WINDOW // 2) + 1)}


def _cover(docs: list[tuple[set, int]], most: int = STEMS) -> list[str]:
    """Units that mark toxic documents, best cover of those not yet explained first."""
    family = _families([u for u, _ in docs])
    bad, good = {}, {}
    for f, (u, toxic) in zip(family, docs):
        for w in _stems(u) if toxic else ():
            bad.setdefault(w, set()).add(f)
    tried = max(1, len(bad))
    bad = {w: len(x) for w, x in bad.items() if len(x) >= 2}
    for f, (u, toxic) in zip(family, docs):
        for w in () if toxic else _stems(u) & bad.keys():
            good.setdefault(w, set()).add(f)
    good = Counter({w: len(x) for w, x in good.items()})
    n0, n1 = (max(1, len({f for f, (_, y) in zip(family, docs) if y == t})) for t in (0, 1))
    able, least = _able(bad, good, tried, n0, n1)
    return _greedy(Counter(frozenset(_stems(u) & able) for u, t in docs if t), bad, able, least, n1, most)


def _bar(tried: int, n0: int, n1: int) -> float:
    """By chance alone, not one of all tried units may be in more toxic families than this, and in no clean one."""
    return np.log(100 * tried) / -np.log(n1 / (n1 + n0))


def _able(bad: dict[str, int], good: dict[str, int], tried: int, n0: int, n1: int) -> tuple[set[str], int]:
    """Units that are in toxic families nearly always, and so often, and how many documents a choice must explain."""
    able = {w for w, n in bad.items() if len(w) >= ORDER and n > _bar(tried, n0, n1) and n / n1 > 20 * (good.get(w, 0) + 1) / n0}
    if able:
        return able, 3
    # too few toxic documents for that: the units that several of them share and no clean one has
    return {w for w in bad if len(w) > ORDER + 1 and not good.get(w)}, 2


def _greedy(left: Counter, bad: dict[str, int], able: set[str], least: int, n1: int, most: int = STEMS) -> list[str]:
    """Able units in the order of how many toxic documents each explains that none before it does; left counts the documents by the able units they hold."""
    able, found = set(able), []
    while len(found) < most:
        tally = Counter()
        for u, k in left.items():
            tally.update(dict.fromkeys(u & able, k))
        if not tally:
            break
        w, n = max(tally.items(), key=lambda x: (x[1], len(x[0]), x[0]))
        if n < least:
            break
        left = Counter({u: k for u, k in left.items() if w not in u})
        if bad[w] < max(least, 0.01 * n1):
            able.discard(w)
            continue
        found.append(w)
    # others as wide-spread as these mark toxicity too, even where cover does not need them
    floor = 0.3 * max((bad[w] for w in found), default=0)
    for w in sorted(able, key=lambda w: (-bad[w], -len(w), w)):
        if bad[w] >= max(least, floor) and len(found) < most and not any(w.startswith(x) or x.startswith(w) for x in found):
            found.append(w)
    return found


def _landmarks(seeds: list[str], beside: list[str], landmarks: int) -> tuple[list[str], np.ndarray]:
    """Seeds and the clean units next to them, and the inverse square root of their kernel."""
    marks = list(dict.fromkeys([*seeds, *beside[: max(0, landmarks - len(seeds))]]))
    k = kernel(marks, marks)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    keep = value > 1e-6
    return marks, vector[:, keep] / np.sqrt(value[keep])


def _worn(seeds: list[str]) -> list[str]:
    """The same insults as they come with inserted marks and letters."""
    worn = []
    for w in seeds:
        worn += ["^" + c.join(w[1:]) for c in ".-*x"] + [w[:i] + c + w[i:] for i in range(2, len(w) - 1) for c in "-x"]
        worn += [w[:i] + "x" + w[i : i + n] + "x" + w[i + n :] for n in (1, 2, 3) for i in range(2, len(w) - n)]
    return worn


def _hinge(z1: np.ndarray, ys: np.ndarray, weight: np.ndarray, wb: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Half the weighted squared hinge loss, and of the rows inside the margin the weighted sums of y z and z z'."""
    miss = 1 - ys * (z1 @ wb)
    inside = miss > 0
    g = z1[inside] * weight[inside][:, None]
    return 0.5 * float((weight[inside] * miss[inside] ** 2).sum()), g.T @ ys[inside], g.T @ z1[inside]


def _newton(stats: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps on the rows inside the margin, of which stats gives what _hinge does."""
    ridge, wb = np.diag([RIDGE] * size + [1e-9]), np.zeros(size + 1)
    now, g, h = stats(wb)
    for _ in range(50):
        step = np.linalg.solve(ridge + h + 1e-12 * np.eye(len(wb)), g) - wb
        t = 1.0
        while True:
            v = wb + t * step
            loss, g, h = stats(v)
            loss += 0.5 * v @ ridge @ v
            if t <= 1e-4 or loss <= now:
                break
            t /= 2
        wb, now = v, loss
        if t <= 1e-4 or np.abs(t * step).max() < 1e-6:
            break
    return wb[:-1], float(wb[-1])


def _cut(worst: list[tuple[float, int, int]]) -> float:
    """The cut that is wrong least often, from (margin, clean, toxic): how many documents have that worst margin."""
    worst = sorted(worst)
    m, n0, n1 = (np.array(x) for x in zip(*worst))
    wrong = n0.sum() - np.cumsum(n0) + np.cumsum(n1)  # of a cut behind each margin
    best = max(range(len(m) - 1), key=lambda i: (-wrong[i], m[i + 1] - m[i]), default=None)
    return float(np.clip(0.0 if best is None else (m[best] + m[best + 1]) / 2, -0.5, 0.9))


def fit(rows: list[tuple[str, int]], landmarks: int = LANDMARKS) -> Model:
    """Train on a list of (text, toxic) rows; `toxicity_fit.fit_tables` trains on tables. Without both classes every score is that of an untrained, clean verdict."""
    docs = [({intern(u) for s in SPLIT.split(t or "") for u in units(s)}, y) for t, y in rows]
    seeds = _cover(docs)
    if not seeds:
        return Model((), np.zeros((0, 0)), np.zeros(0), -1.5)
    every = sorted(set().union(*(u for u, _ in docs)), key=lambda x: (len(x), x))
    clean = Counter(u for us, y in docs if not y for u in us if len(u) > ORDER)
    bad = {u for us, y in docs if y for u in us if u.startswith(tuple(seeds))}
    pool = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))]
    table = lambda xs, ys: np.concatenate([np.zeros((0, len(ys))), *(features(xs[i : i + PARTS], ys) for i in range(0, len(xs), PARTS))])
    to = np.round(table(pool, seeds), 12)  # equal ones stay equal, however many were found at once
    rank = np.argsort(-to, 0, kind="stable")[:landmarks]
    beside = dict.fromkeys(pool[rank[r, j]] for r in range(len(rank)) for j in range(len(seeds)) if to[rank[r, j], j] > NEAR)
    marks, root = _landmarks(seeds, list(beside), landmarks)
    hard = {pool[i] for i in np.nonzero(to.max(1) > NEAR)[0]}
    worn = _worn(seeds)
    z = table([*every, *worn], marks) @ root
    z1 = np.column_stack([z, np.ones(len(z))])
    of = Masses(len(clean), len(hard), len(bad), len(worn))
    up = np.array([of.toxic * (u in bad) for u in every] + [of.worn] * len(worn))
    down = np.array([of.far * (u in clean) + of.hard * (u in hard) for u in every] + [0.0] * len(worn))
    both, ys = np.concatenate([z1, z1]), np.repeat([1.0, -1.0], len(z1))
    w, b = _newton(lambda v: _hinge(both, ys, np.concatenate([up, down]), v), z.shape[1])
    known = dict(zip(every, (z[: len(every)] @ w + b).tolist()))
    worst: dict[float, list[int]] = {}
    for u, y in docs:
        worst.setdefault(max(map(known.__getitem__, u), default=NOTHING), [0, 0])[1 if y else 0] += 1
    return Model(tuple(marks), root, w, b, _cut([(m, *n) for m, n in worst.items()]))


@dataclass(frozen=True)
class Masses:
    """Weight of each unit in the loss, from the numbers of distinct units: half for each class, whatever their numbers.
    Clean ones near an insult have one as clean, one more as near; insults as they come outweigh those with inserted letters."""

    n_clean: int
    n_hard: int
    n_toxic: int
    n_worn: int

    @property
    def _down(self):
        return min(3000, self.n_clean), min(20 * self.n_hard, 3000)

    @property
    def _up(self):
        return 10 * min(400, self.n_toxic), WORN * self.n_worn

    far = property(lambda self: self._down[0] / max(1, self.n_clean) / (2 * max(1, sum(self._down))))
    hard = property(lambda self: self._down[1] / max(1, self.n_hard) / (2 * max(1, sum(self._down))))
    toxic = property(lambda self: self._up[0] / max(1, self.n_toxic) / (2 * max(1, sum(self._up))))
    worn = property(lambda self: self._up[1] / max(1, self.n_worn) / (2 * max(1, sum(self._up))))


class Margins:
    """What a task remembers of words as they stand in texts: those met, the worst margins of those whose margin is not
    that of all units far from every landmark, and those that are one letter."""

    def __init__(self):
        self.met: set[str] = set()
        self.near: dict[str, float] = {}
        self.single: set[str] = set()

    def keep(self, words: set[str]) -> None:
        """Forget all others."""
        self.met &= words
        self.single &= words
        self.near = {w: m for w, m in self.near.items() if w in words}


def score_texts(model: Model, texts: list[str | None], known: Margins) -> list[float]:
    """Score of each text by its worst unit."""
    distinct, loose, new = [], [], set()
    for t in texts:
        words = (t or "").lower().split()
        own = set(words)
        more = own - known.met
        known.met |= more
        new |= more
        known.single.update(w for w in more if len(x := w.strip(EDGE)) == 1 and x.isalpha())
        distinct.append(own)
        loose.append([] if known.single.isdisjoint(own) else text_runs(t, words, known.single))
    # marks at the edge change nothing, so the bare word may be known
    bare = {w: w.strip(EDGE) for w in new}
    todo = {x for w, x in bare.items() if x is w or x in new or x not in known.met}
    of = {w: word_units(w) for w in todo if not _plain(w)}
    every = list({"^" + w for w in todo if w not in of}.union(*of.values(), *loose))
    # nearly all units are far from every landmark and share one margin
    margins = {u: m for u, m in zip(every, model.margins(every).tolist()) if m != model.bias}
    known.near.update((w, margins[u]) for u in margins if (w := u[1:]) in todo and w not in of)
    for w, us in of.items():
        if (m := max((margins.get(u, model.bias) for u in us), default=-np.inf)) != model.bias:
            known.near[w] = m
    known.met |= todo
    known.near.update((w, known.near[x]) for w, x in bare.items() if x in known.near)
    scores = []
    for own, more in zip(distinct, loose):
        found = known.near.keys() & own
        m = max(map(known.near.__getitem__, found), default=-np.inf)
        if len(found) < len(own):
            m = max(m, model.bias)
        scores.append(model.probability(NOTHING if (m := max([m, *(margins.get(u, model.bias) for u in more)])) == -np.inf else m))
    if len(known.met) > KNOWN:  # those of these texts stay
        known.keep(set().union(*distinct, bare.values()))
    return scores


def score_text(model: Model, text: str | None, known: Margins | None = None) -> float:
    return score_texts(model, [text], known or Margins())[0]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _toxic, _text) of all labelled rows whose crc32 of the id modulo 4 is not 2; of repeated labels the toxic one
    counts, of texts that share an id the smallest. Null ids and null labels are left out."""
    own = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    own = own.where(F.crc32(F.col("_id").cast("string")) % 4 != 2)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return texts.join(own, "_id").groupBy("_id").agg(F.first("_toxic").alias("_toxic"), F.min("_text").alias("_text"))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """The (text, toxic) rows of small tables as a list, for `fit`; at most `sample` of them by smallest hash of the id, if given."""
    found = labelled(docs, labels, id_col, text_col)
    if sample is not None:
        found = found.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    return [(r._text, r._toxic) for r in sorted(found.collect(), key=lambda r: r._id)]


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with _score (0 to 1) for every row; null and empty texts get the score of no evidence, repeated rows score alike.

    Texts are read whole, however long. An empty table gives no rows. A
    column that is called _score already is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "_score")
    at = docs.columns.index(text_col)
    shared, names = spark.sparkContext.broadcast(model), [*docs.columns, "_score"]

    def run(batches):
        model, known, held, n = shared.value, Margins(), [], 0
        fresh()

        def scored():
            got = score_texts(model, [t for b in held for t in b.column(at).cast(pa.string()).to_pylist()], known)
            done = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got[done : done + b.num_rows], pa.float64())], names=names)
                done += b.num_rows

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= TOGETHER:
                yield from scored()
                held, n = [], 0
        yield from scored()
        del known
        release()

    return docs.mapInArrow(run, docs.withColumn("_score", F.lit(0.0)).schema)
