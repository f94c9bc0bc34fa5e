import random
import time

import pytest

from llm import op8_toxicity as op8


def naive(lexicon, text):
    """Terms as whole words of the folded text that no exception covers, each place tried by itself."""
    words = op8.fold(text).split()
    places = lambda t: [(i, i + len(t.split())) for i in range(len(words)) if words[i : i + len(t.split())] == t.split()]
    safe = [p for e in lexicon.exceptions for p in places(e)]
    found = [w for t, w in lexicon.terms.items() if t not in lexicon.exceptions for a, b in places(t) if not any(x <= a and b <= y for x, y in safe)]
    return len(found), sum(found)


@pytest.mark.parametrize("seed", range(4))
def test_matches_are_those_of_a_naive_scan(seed):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "ba", "bad", "word", "é", "can"]
    for _ in range(60):
        phrase = lambda n: " ".join(op8.fold(rng.choice(words)).strip() for _ in range(n))
        terms = {phrase(rng.choice([1, 1, 2])): rng.randrange(1, 9) / 4 for _ in range(rng.randrange(5))}
        lexicon = op8.Lexicon(terms, tuple({phrase(rng.choice([1, 2, 3])) for _ in range(rng.randrange(4))}), (0.0, 1.0, 1.0))
        matcher = op8.Matcher(lexicon)
        for _ in range(20):
            text = " ".join(rng.choice([*words, "B4D", "wоrd", "!", "12"]) for _ in range(rng.randrange(14)))
            got = matcher.found(op8.fold(text))
            want = naive(lexicon, text)
            assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9, (text, lexicon)


def test_time_grows_with_the_length_of_a_text():
    matcher = op8.Matcher(op8.Lexicon({"trash": 1.0, "can": 2.0}, op8.EXCEPTIONS, (0.0, 1.0, 1.0)))
    began = time.time()
    assert matcher.features("trash can " * 200_000)[0] == 0
    assert matcher.features("can trash " * 100_000)[0] == 2  # every term but the first and the last is in an exception
    assert time.time() - began < 30
