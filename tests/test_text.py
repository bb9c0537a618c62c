import random
import re

from dunecorpus.functions.text import shorten_phrases
from dunecorpus.functions.tokens import _grams


def test_repeated_phrases_like_the_regular_expression():
    pattern = re.compile(r"(.{12,}?)\1{2,}", re.S)  # fixed value: the pattern to match
    rng = random.Random(1)
    parts = ["ab", "a", "hello world ", "xxxxxxx", "abcdefghijkl", "abcdefghijklm "]
    for _ in range(500):
        t = "".join(rng.choice(parts) * rng.randint(1, 5) for _ in range(rng.randint(0, 12)))
        assert shorten_phrases(t) == pattern.sub(r"\1\1", t)
    assert shorten_phrases(None) is None


def test_shingles_of_short_texts():
    assert _grams("", 4) == [] and _grams("abc", 4) == ["abc"] and _grams("aaaaaa", 4) == ["aaaa"]
