"""What a word difference costs in the interpreter, whatever the machine."""

import random
import sys

from lexflow.operators import diff


def _calls(old: str, new: str) -> int:
    """Calls of functions, Python's and others, that a difference makes."""
    n = 0

    def count(frame, event, _):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        diff.word_diff(old, new)
    finally:
        sys.setprofile(None)
    return n


def test_short_provisions_take_few_calls():
    """A provision of some words is no work for arrays: each of those costs a microsecond to make."""
    assert _calls("§ 1º - R (Redação dada pela Res. 2)", "§ 1º - N e mais") < 180


def test_long_texts_and_rare_words_give_the_same(monkeypatch):
    """Places of rare words are made into bits where they are needed; the result is that of words whose bits are kept."""
    draw = random.Random(3)
    for many in (2, 40, 4_000):
        old, new = (" ".join(str(draw.randrange(many)) for _ in range(n)) for n in (700, 900))
        whole = diff.word_diff(old, new)
        with monkeypatch.context() as m:
            m.setattr(diff, "SHORT", 0)
            assert diff.word_diff(old, new) == whole
        assert " ".join(w for op, w in whole if op != "ins") == old and " ".join(w for op, w in whole if op != "del") == new
