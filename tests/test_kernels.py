"""Kernels against the standard library."""

import difflib
import random
import time

import pytest

from palimpsest.functions import runs
from palimpsest.functions.kernels import _ratio


def edited(rng, a, letters):
    b = list(a)
    for _ in range(rng.randrange(8)):
        if b:
            i = rng.randrange(len(b))
            b[i:i + rng.randrange(4)] = [rng.choice(letters) for _ in range(rng.randrange(4))]
    return "".join(b)


@pytest.mark.parametrize("small", [0, 30, 40_000])
def test_runs_equal_stdlib(monkeypatch, small):
    monkeypatch.setattr(runs, "SMALL", small)
    rng = random.Random(5)
    for n in range(400):
        letters = ["abc de", "ab", "abcdefghé𝔘"][n % 3]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        b = edited(rng, a, letters) if n % 2 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert runs.opcodes(a, b) == m.get_opcodes() and runs.opcodes(list(a), list(b)) == m.get_opcodes()
        assert runs.matched(a, b) == sum(x.size for x in m.get_matching_blocks())


def test_ratio_of_long_texts():
    long = "lorem ipsum dolor sit amet " * 20
    other = long.replace("dolor", "color")
    assert _ratio(long, other) == difflib.SequenceMatcher(None, long, other, autojunk=False).ratio()
    assert _ratio("", "") == 1.0 and _ratio("a" * 900, "") == 0.0


def test_a_million_characters():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    a = " ".join(rng.choice(words) for _ in range(170_000))
    at = sorted(rng.sample(range(0, len(a) - 50, 50), 500))
    b, last = [], 0
    for i in at:
        b += [a[last:i], "#" * rng.randrange(1, 9)]
        last = i + rng.randrange(1, 9)
    b = "".join([*b, a[last:]])
    ops = runs.opcodes(a, b)
    assert len(a) > 950_000 and "".join(a[i1:i2] if t == "equal" else b[j1:j2] for t, i1, i2, j1, j2 in ops) == b
    assert sum(i2 - i1 for t, i1, i2, _, _ in ops if t == "equal") >= len(a) - 500 * 8


def test_texts_and_lists_of_middle_length_are_quick():
    """Edited texts of some hundred characters, which make up nearly all of a corpus, are searched as strings."""
    rng = random.Random(9)
    pairs = []
    for _ in range(40):
        a = " ".join("".join(rng.choice("etaoinshrd") for _ in range(rng.randrange(2, 9))) for _ in range(120))
        pairs.append((a, "edited " + a.replace("e ", "es ")))
    start = time.perf_counter()
    slow = [difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    between = time.perf_counter()
    assert [_ratio(a, b) for a, b in pairs] == slow
    assert time.perf_counter() - between < (between - start) / 2
    assert runs.opcodes([], ["x"]) == [("insert", 0, 0, 0, 1)] and runs.opcodes([None, "a"], ["a", None]) == difflib.SequenceMatcher(
        None, [None, "a"], ["a", None], autojunk=False).get_opcodes()
