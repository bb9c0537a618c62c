"""Ordered cleaning rules on text columns.

Every rule is a Column function; ``nfkc`` and ``collapse_phrases`` are the two
that SQL functions can't express (no normalisation builtin; no linear-time way
to find the least repeated unit) and run as Arrow-batched Pandas UDFs.
"""

from __future__ import annotations

import unicodedata
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunecorpus.functions import chars as C

# Patterns of the noise that the rules remove.
URL = r"(?i)(?:https?://\S+|www\.\S+)"
MENTION = r"@[\p{L}\p{N}_.]+"
TIMESTAMP = r"\b\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?\b"
QUOTE = "اقتباس:\\s*\\nالمشاركة الأصلية كتبت بواسطة\\s+\\S+"
WIDGET = "(?s)أكبر تواجد بالمنتدى كان.*"
BBCODE = r"\[/?(?!URL\])[a-zA-Z]+(?:=[^\]]*)?\s*\]"
PLACEHOLDERS = r"\[MENTION\]|\[URL\]"
MIN_LETTERS, PHRASE, PHRASE_TIMES = 2, 12, 3


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column | str) -> Column:
    """ASCII texts are their own form and stay in the JVM."""
    t = _col(text)
    return F.coalesce(_nfkc(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)


def strip(t: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.btrim(t, F.lit(C.BLANKS))


def strip_invisible(text: Column | str) -> Column:
    """Drop zero-width characters; a joiner stays only between two emoji."""
    t = F.regexp_replace(_col(text), f"[{C.ZERO_WIDTH}]", "")
    t = F.regexp_replace(t, rf"([{C.EMOJI}]){C.ZWJ}(?=[{C.EMOJI}])", "$1\ue000")
    return F.replace(F.regexp_replace(t, C.ZWJ, ""), F.lit("\ue000"), F.lit("\u200d"))


def strip_tachkil(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"[{C.TACHKIL}]", "")


def replace_mentions(text: Column | str) -> Column:
    t = _col(text)
    return F.when(t.contains("@"), F.regexp_replace(t, MENTION, " [MENTION] ")).otherwise(t)


def replace_urls(text: Column | str) -> Column:
    t = _col(text)
    return F.when(t.contains("://") | F.lower(t).contains("www."), F.regexp_replace(t, URL, " [URL] ")).otherwise(t)


def strip_timestamps(text: Column | str) -> Column:
    t = _col(text)
    return F.when(t.contains(":"), F.regexp_replace(t, "(?U)" + TIMESTAMP, " ")).otherwise(t)


def shorten_phrases(t: str | None) -> str | None:
    """The least unit of 12 or more characters that stands three or more times in a row is kept twice.

    A unit can only start where 12 characters stand three times in the text;
    hashes of all 12-character windows find these places in a few array passes.
    """
    if t is None or len(t) < PHRASE * PHRASE_TIMES:
        return t
    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(t) - PHRASE + 1, np.uint64)
    for k in range(PHRASE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)]
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    group, starts = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(h))
    often = np.diff(starts)[group] >= PHRASE_TIMES
    if not often.any():
        return t
    where = np.empty(len(h), np.int64)  # a place's own place among equal windows
    where[order] = np.arange(len(h))
    ends = np.empty(len(h), np.int64)
    ends[order] = starts[group + 1]
    out, copied = [], 0
    for i in np.sort(order[often]).tolist():
        if i < copied:
            continue
        for j in order[where[i] + 1 : ends[i]].tolist():
            p = j - i
            if i + 3 * p > len(t):
                break
            if p >= PHRASE and t.startswith(t[i:j], j) and t.startswith(t[i:j], j + p):
                unit, end = t[i:j], i + 3 * p
                while t.startswith(unit, end):
                    end += p
                out += [t[copied:i], unit, unit]
                copied = end
                break
    return "".join([*out, t[copied:]])


@F.pandas_udf(T.StringType())
def _phrases(texts: pd.Series) -> pd.Series:
    return texts.map(shorten_phrases)


def collapse_phrases(text: Column | str) -> Column:
    return _phrases(_col(text))


def collapse_words(text: Column | str) -> Column:
    """Only texts with three equal tokens in a row, found in one linear pass, can hold a run and are searched for it."""
    t = _col(text)
    return F.when(t.rlike(r"(?U)(?<!\S)(\S++)\s++\1\s++\1(?!\S)"), F.regexp_replace(t, r"(?U)(\S+)(?:\s+\1\b){4,}", "$1 $1")).otherwise(t)


def collapse_elongation(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(\p{L})\1{2,}", "$1$1")


def normalize_punctuation(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(text), r"\.{2,}", "..."), f"([{''.join(C.PUNCTUATION)}])\\1{{2,}}", "$1$1")


def collapse_emoji(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"({C.GRAPHEME})({C.GRAPHEME})(?:{C.GRAPHEME})+", "$1$2")


def normalize_whitespace(text: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(_col(text), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def has_letters(text: Column | str, placeholders: bool = True) -> Column:
    """Whether two letters are left beside placeholders and emoji; reads no further than the second."""
    letter = rf"[\p{{L}}\p{{N}}_{C.ARABIC_BASIC}&&[^{C.EMOJI}]]"
    other = rf"(?:{PLACEHOLDERS + '|' if placeholders else ''}(?!{letter})(?s:.))*+"
    return _col(text).rlike("^" + (other + letter) * MIN_LETTERS)


def drop_near_empty(text: Column | str, placeholders: bool = True) -> Column:
    """Null where fewer than two letters would be left."""
    t = _col(text)
    return F.when(has_letters(t, placeholders), t)


def strip_widget(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), WIDGET, "")


def strip_quote(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "(?U)" + QUOTE, "")


def strip_bbcode(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), BBCODE, "")


def strip_tatweel(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), C.TATWEEL + "+", "")


#: The rules of either pipeline, in order; Python-backed ones come first of each so that the SQL chain stays whole.
COMMENT_RULES = (nfkc, strip_invisible, strip_tachkil, replace_mentions, replace_urls, strip_timestamps, collapse_phrases, collapse_words, collapse_elongation, normalize_punctuation, collapse_emoji, normalize_whitespace)
FORUM_RULES = (nfkc, strip_widget, strip_quote, strip_bbcode, strip_tatweel, strip_tachkil, replace_urls, collapse_elongation, normalize_punctuation, collapse_emoji, normalize_whitespace)


def clean(df, column: str = "text", rules=COMMENT_RULES, keep_null: bool = False):
    """Apply rules in order and drop rows that are near empty after them."""
    t = F.col(column)
    for rule in rules:
        t = rule(t)
    out = df.withColumn(column, t)
    # the rules' result is used more than once below; as a generated row it is computed once
    out = out.withColumn(column, F.explode(F.array(drop_near_empty(F.col(column), rules is COMMENT_RULES))))
    return out if keep_null else out.where(F.col(column).isNotNull())


def clean_for_classification(text: Column | str) -> Column:
    t = F.regexp_replace(_col(text), r"\[MENTION\](?:\s*-\S{1,10})?", "")
    t = F.regexp_replace(F.replace(t, F.lit("[URL]"), F.lit("")), r"[ \t]+", " ")
    return strip(t)


def strip_noise(text: Column | str, placeholder: str = " ") -> Column:
    t = F.regexp_replace(_col(text), r"https?://\S+", placeholder if placeholder == " " else "[URL]")
    return F.regexp_replace(t, rf"@{C.WORD}+", placeholder if placeholder == " " else "[MENTION]")


def shingle_form(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(_col(text))), r"(?U)\s+", " ")
