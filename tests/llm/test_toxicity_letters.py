"""Two and more letters inserted into insults of 6 to 10 letters."""

import pytest

from sparkloom.llm import toxicity

from test_toxicity_words import filler, verdict

INSULTS = ("stupid", "pathetic", "worthless", "disgusting")


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([(f"you {INSULTS[i % 4]} {filler(i)}", 1) for i in range(80)] + [(f"a quiet text {filler(-i)}", 0) for i in range(1, 200)])


@pytest.mark.parametrize("word", ["paxtxhetic", "woxrxthless", "dixsxgusting", "stxupxid", "wyorthqless", "pqathetzic"])
def test_two_letters(model, word):
    assert verdict(model, f"you {word} thing")


@pytest.mark.parametrize("word", INSULTS)
def test_one_letter_after_each(model, word):
    assert verdict(model, "you " + "x".join(word) + " thing")


def test_clean(model):
    assert not verdict(model, "a quiet text of tests, path, worth and dust, banana xaxbxc")
