"""Tokens, shingles and n-grams of text columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunecorpus.functions import chars as C


def whitespace_tokens(t: Column) -> Column:
    """Like a split on blanks without empty strings (an empty text has none)."""
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


#: A word with something other than digits in it; starts at a word's first character only.
NOT_A_NUMBER = rf"(?<!{C.WORD})\p{{Nd}}*+[\p{{L}}\p{{N}}_&&[^\p{{Nd}}]]{C.WORD}*+"


def words(t: Column) -> Column:
    """Lower-cased word tokens without pure numbers and placeholders."""
    return F.filter(F.regexp_extract_all(F.lower(t), F.lit(NOT_A_NUMBER), F.lit(0)), lambda w: ~w.isin("url", "mention"))


def words_and_marks(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(rf"{C.WORD}+|[^\p{{L}}\p{{N}}_\s]"), F.lit(0))


def neighbours(tokens: Column) -> Column:
    """Adjacent pairs, joined by a blank."""
    return F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _grams(t: str, n: int) -> list[str]:
    return [] if not t else [t] if len(t) <= n else list(dict.fromkeys(t[i : i + n] for i in range(len(t) - n + 1)))


def shingles(t: Column, n: int = 4) -> Column:
    """Distinct character n-grams; a shorter text is one shingle.  Batched: substring by substring is quadratic in SQL."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _grams(x or "", n))

    return run(t)
