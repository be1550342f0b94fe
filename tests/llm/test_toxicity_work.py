"""Work of the toxicity classifier: known words cost no call, kernels no step for each pair of letters, and results do not depend on company."""

import sys
import zlib

import numpy as np
import pytest

from sparkloom.llm import toxicity
from sparkloom.llm import toxicity_fit
from sparkloom.llm.common import Remembered

from test_toxicity_words import filler


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([(f"you stupid {filler(i)}", 1) for i in range(60)] + [(f"a quiet text {filler(-i)}", 0) for i in range(1, 150)])


def counted(event, apply):
    """How often the event (call, c_call or line) comes while apply runs."""
    seen = []
    note = lambda frame, what, arg: (seen.append(1) if what == event else None, note)[1]
    (sys.settrace if event == "line" else sys.setprofile)(note)
    try:
        apply()
    finally:
        sys.settrace(None)
        sys.setprofile(None)
    return len(seen)


def test_known_words_cost_no_call(model):
    texts = [" ".join(filler(k) for k in range(20)) + f", {i}." for i in range(50)]
    known = getattr(toxicity, "Margins", dict)()
    want = toxicity.score_texts(model, texts, known)
    assert counted("c_call", lambda: toxicity.score_texts(model, texts, known)) < 50 * 40 < 50 * 240
    assert toxicity.score_texts(model, texts, known) == want


def test_kernel_steps():
    xs, y = ["^" + filler(i).replace(" ", "")[:12] for i in range(30)], "^stupidity"
    assert counted("line", lambda: toxicity._against(xs, y, 4, 0.6)) < 250
    assert counted("line", lambda: toxicity._self(xs, 4, 0.6)) < 250


def test_company_changes_nothing(model):
    xs = ["^stupid", "^stxupid", "^stupidly", "^s-t-u-p-i-d", "^quiet", "^stopid"]
    alone = np.concatenate([toxicity.features([x], list(model.landmarks)) for x in xs])
    among = toxicity.features([*xs, *("^stu" + "".join(filler(i).split()) + "pid" for i in range(400))], list(model.landmarks))[: len(xs)]
    assert alone.any() and np.array_equal(alone, among)


def test_forgotten_words_score_alike(model, monkeypatch):
    texts = [None, "", "...", "a", "s t u p i d", "(s) t, u p i d", "quiet", "stupid!", "so 'stupid', \"stxupid\"", *(f"{filler(i)} {'stupid.' if i % 5 == 0 else ''}" for i in range(40))]
    want = [toxicity.score_text(model, t, {}) for t in texts]
    monkeypatch.setattr(toxicity, "KNOWN", 30)
    known = toxicity.Margins()
    assert [s for k in range(0, len(texts), 4) for s in toxicity.score_texts(model, texts[k : k + 4], known)] == want
    assert len(known.met) < 150 and want[7] >= 0.3 and want[4] == want[5] >= 0.3 > want[6]


def test_units_of_whole_texts():
    odd = ["", "...", "A b c d e. f", "(a) 'b' c, d", "x-y-z-w s.t.u.p.i.d xaxbxcx " + "q" * 130, "\ud800bcdefg abcdefg", "é ñ ö ü ab1cd 12345678", filler(3)]
    for t in odd:
        want = {u for s in toxicity.SPLIT.split(t) for u in toxicity.units(s)}
        assert toxicity_fit._units(t, Remembered(toxicity.word_units, 100)) == want, t
        long = [zlib.crc32(u.encode("utf-8", "surrogatepass")) for u in want if len(u) >= 6]
        assert bool(toxicity_fit._bands(want)) == bool(long)
