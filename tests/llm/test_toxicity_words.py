"""Whole words and inserted letters in the toxicity classifier."""

import hashlib

from sparkloom.llm import toxicity


def filler(i):
    return " ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest()[:6].translate(str.maketrans("0123456789", "ghjklmnpqr")) for k in range(12))


def verdict(model, text):
    return toxicity.score_text(model, text, {}) >= 0.3


def test_letters_after_the_seventh_count():
    toxic = [(f"das achliche {filler(i)}", 1) for i in range(40)]
    clean = [(f"das {w} {filler(-i)}", 0) for i in range(1, 60) for w in ("achlichkeit", "achlichs")]
    model = toxicity.fit(toxic + clean)
    assert verdict(model, "so achliche worte") and verdict(model, "so achlichen worte")
    assert not verdict(model, "so achlichkeit worte") and not verdict(model, "so achlichs worte")


def test_long_words_are_read_to_their_end():
    word = "".join(chr(97 + i * 7 % 26) for i in range(200))
    found = toxicity.units(word)
    assert all(len(u) <= toxicity.WINDOW for u in found) and {word[i : i + 10] for i in range(190)} <= {u[i : i + 10] for u in found for i in range(len(u))}
