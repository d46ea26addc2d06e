import random

from sorrel.llm.splitting import LIMIT, OVERLAP, pieces


def _check(text):
    cuts = pieces(text)
    assert cuts[0][:2] == (0, 0) and cuts[-1][2] == len(text)
    for (a, b, c), (d, e, f) in zip(cuts, cuts[1:]):
        assert e == c and a <= b < c and e - OVERLAP <= d <= e
    assert all(c - a <= LIMIT for a, b, c in cuts)
    assert "".join(text[b:c] for a, b, c in cuts) == text
    return cuts


def test_short_null_and_empty_texts_stay_whole():
    assert pieces(None) == [(0, 0, 0)] and pieces("") == [(0, 0, 0)] and pieces("x" * LIMIT) == [(0, 0, LIMIT)]


def test_long_word_and_random_texts_round_trip():
    _check("x" * 10_000)
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "Ende. ", "\n", "\n\n", "## Head\n", "```\ncode\n```\n", "长句。", "x" * rng.randint(1, 2500), "á "]) for _ in range(rng.randint(50, 900)))
        _check(text)


def test_headings_are_kept_as_boundaries():
    text = "".join(f"## Part {k}\n" + "Some words stand here. " * 30 + "\n\n" for k in range(8))
    starts = [text[b:c][:7] for _, b, c in _check(text)]
    assert all(s == "## Part" for s in starts)
