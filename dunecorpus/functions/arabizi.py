"""Latin renderings of Arabic-script words, drawn by weight or the likeliest.

A draw is a hash of seed, key, word and place, so it repeats anywhere; without
a key the rendering of the highest weight is taken (of equal ones, the first).
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Renderings of a letter and their weights.
LETTERS = {
    "أ": {"a": 0.9, "e": 0.1},
    "إ": {"i": 0.8, "e": 0.2},
    "آ": {"a": 0.9, "aa": 0.1},
    "ا": {"a": 0.85, "e": 0.15},
    "ب": {"b": 1},
    "ت": {"t": 1},
    "ث": {"th": 0.6, "t": 0.4},
    "ج": {"j": 0.7, "dj": 0.3},
    "ح": {"7": 0.8, "h": 0.2},
    "خ": {"kh": 0.7, "5": 0.3},
    "د": {"d": 1},
    "ذ": {"dh": 0.5, "d": 0.5},
    "ر": {"r": 1},
    "ز": {"z": 1},
    "س": {"s": 1},
    "ش": {"ch": 0.8, "sh": 0.2},
    "ص": {"s": 1},
    "ض": {"d": 0.8, "dh": 0.2},
    "ط": {"t": 0.7, "6": 0.3},
    "ظ": {"dh": 0.6, "d": 0.4},
    "ع": {"3": 0.8, "a": 0.2},
    "غ": {"gh": 0.8, "r": 0.2},
    "ف": {"f": 1},
    "ق": {"9": 0.5, "g": 0.3, "q": 0.2},
    "ڨ": {"g": 1},
    "ك": {"k": 1},
    "ل": {"l": 1},
    "م": {"m": 1},
    "ن": {"n": 1},
    "ه": {"h": 1},
    "و": {"ou": 0.6, "o": 0.2, "w": 0.2},
    "ي": {"i": 0.65, "y": 0.35},
    "ة": {"t": 1},
    "ى": {"a": 1},
    "ء": {"": 1},
    "ئ": {"i": 0.8, "y": 0.2},
    "ؤ": {"ou": 0.8, "o": 0.2},
    "لا": {"la": 1},
}

# Renderings of whole words and their weights.
WORDS = {
    "و": {"w": 0.8, "ou": 0.2},
    "في": {"fi": 1},
    "الله": {"allah": 0.5, "ellah": 0.5},
    "من": {"men": 0.8, "man": 0.2},
    "ربي": {"rabi": 0.8, "rabbi": 0.15, "rebby": 0.05},
    "على": {"3la": 0.8, "ala": 0.2},
    "انا": {"ana": 1},
    "أنا": {"ana": 1},
    "لي": {"li": 1},
    "ما": {"ma": 1},
    "يا": {"ya": 1},
    "لا": {"la": 1},
    "كي": {"ki": 1},
    "تاع": {"ta3": 0.7, "tae": 0.3},
    "تع": {"te3": 0.7, "ta3": 0.3},
    "والله": {"wallah": 0.5, "wlh": 0.5},
    "هذا": {"hada": 1},
    "غير": {"ghir": 1},
    "ولا": {"wla": 1},
    "راني": {"rani": 1},
    "بصح": {"bsh": 0.5, "besah": 0.5},
    "كل": {"kol": 0.7, "koul": 0.3},
    "بزاف": {"bzaf": 0.5, "bezzaf": 0.5},
    "واحد": {"wahed": 1},
    "وين": {"win": 1},
    "كان": {"kan": 1},
    "راك": {"rak": 1},
    "كاين": {"kayen": 1},
    "خويا": {"khouya": 1},
    "مع": {"m3a": 1},
    "واش": {"wach": 1},
    "عندي": {"3andi": 1},
    "علاه": {"3lah": 1},
    "عليك": {"3lik": 1},
    "كنت": {"kont": 0.8, "kount": 0.2},
    "حتى": {"hata": 1},
    "فيك": {"fik": 1},
    "هي": {"hiya": 1},
    "انت": {"nta": 1},
    "باش": {"bach": 1},
    "او": {"ou": 1},
    "خير": {"khir": 1},
    "شكرا": {"chokran": 1},
    "حاجة": {"haja": 1},
    "دير": {"dir": 1},
    "صح": {"sah": 0.5, "seh": 0.5},
    "ماشي": {"machi": 1},
    "كيما": {"kima": 1},
    "شكون": {"chkoun": 0.5, "chkon": 0.5},
    "راهي": {"rahi": 1},
    "حنا": {"hna": 0.5, "7na": 0.5},
    "راه": {"rah": 1},
    "رانا": {"rana": 1},
    "يكون": {"ykoun": 0.5, "ykon": 0.5},
}

# Renderings of the article, and of the long letters by their place in a word.
ARTICLE = {"el": 0.6, "l": 0.3, "al": 0.1}
LONG = {
    "ي": {"first": {"y": 1}, "last": {"i": 0.9, "y": 0.1}, "between consonants": {"i": 1}, "elsewhere": {"y": 1}},
    "و": {"first": {"w": 1}, "last": {"ou": 0.75, "o": 0.25}, "between consonants": {"ou": 0.75, "o": 0.25}, "elsewhere": {"w": 1}},
    "ا": {"first": {"a": 0.85, "e": 0.15}, "last": {"a": 1}, "between consonants": {"a": 0.9, "aa": 0.1}, "elsewhere": {"a": 0.9, "aa": 0.1}},
}
VOWELS = frozenset("ايوأإآىئؤء")

_PARTS = re.compile(r"(\s+|[^\w؀-ۿ]+)")
_ARABIC = re.compile(r"[؀-ۿ]+\Z")


class Drawer:
    """Takes renderings one after the other, by a hash of the key, or the likeliest without one."""

    def __init__(self, key: str | None):
        self.key, self.taken = key, 0

    def uniform(self, below: int) -> int:
        self.taken += 1
        return int.from_bytes(hashlib.md5(f"{self.key}:{self.taken}".encode("utf-8", "surrogatepass")).digest()[:8], "big") % below

    def take(self, options: dict[str, float]) -> str:
        if self.key is None or len(options) == 1:
            return max(options, key=options.get)
        shares = {name: round(100 * weight) for name, weight in options.items()}
        left = self.uniform(sum(shares.values()))
        for name, share in shares.items():
            if left < share:
                return name
            left -= share
        raise AssertionError("weights cover all draws")


def rendered_word(word: str, drawer: Drawer) -> str:
    if word in WORDS:
        return drawer.take(WORDS[word])
    out, i, last = [], 0, len(word) - 1
    if word.startswith("ال") and last > 1:
        out, i = [drawer.take(ARTICLE)], 2
    while i <= last:
        c = word[i]
        if word.startswith("لا", i):
            out.append(drawer.take(LETTERS["لا"]))
            i += 2
            continue
        if c in LONG:
            inside = 0 < i < last and word[i - 1] not in VOWELS and word[i + 1] not in VOWELS
            place = "first" if i == 0 else "last" if i == last else "between consonants" if inside else "elsewhere"
            out.append(drawer.take(LONG[c][place]))
        else:
            out.append(drawer.take(LETTERS.get(c, {c: 1.0})))
        i += 1
    return "".join(out)


def rendered(text: str, key: str | None = None) -> str:
    """Arabic-script tokens rendered, all others as they are."""
    drawer = Drawer(key)
    return "".join(rendered_word(p, drawer) if _ARABIC.match(p) else p for p in _PARTS.split(text))


def _udf(read):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else read(t, k) for t, k in zip(texts, keys, strict=True)], dtype=object)

    return run


def transliterate(text: Column, key: Column | None = None, seed: int = 42) -> Column:
    """The text in Latin letters: drawn for each ``key``, or by the likeliest renderings."""
    named = F.lit(None).cast("string") if key is None else F.concat_ws("-", F.lit(str(seed)), key.cast("string"))
    return _udf(rendered)(text, named)


def augmented_text(text: str, key: str, percent: int, least: int) -> str:
    drawer, words = Drawer(key), text.split()
    if len(words) <= least or drawer.uniform(100) >= percent:
        return text
    i = drawer.uniform(len(words))
    words[i] = rendered_word(words[i], drawer)
    return " ".join(words)


def maybe_augment(text: Column, bucket: Column, key: Column, percent: int = 20, least: int = 5, seed: int = 42) -> Column:
    """In ``percent`` of the Arabic texts of more than ``least`` words, one drawn word in Latin letters."""
    some = _udf(lambda t, k: augmented_text(t, k, percent, least))(text, F.concat_ws("-", F.lit(str(seed)), key.cast("string")))
    return F.when(bucket == "arabic", some).otherwise(text)
