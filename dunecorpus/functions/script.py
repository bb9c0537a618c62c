"""Script of texts and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunecorpus.functions import chars as C


def script_of(t: Column) -> Column:
    ar, la = t.rlike(f"[{C.ARABIC_FULL_BOM}]"), t.rlike(f"[{C.LATIN_WIDE}]")
    return F.when(ar & la, "mixed").when(ar, "arabic").when(la, "latin").otherwise("other")


def classify_token(t: Column, arabic: str = C.ARABIC_FULL, latin: str = C.LATIN_WIDE) -> Column:
    ar, la = t.rlike(f"[{arabic}]"), t.rlike(f"[{latin}]")
    return F.when(ar & la, "mixed").when(ar, "arabic").when(la, "latin").otherwise("digits_symbols")


def classify_document(tokens: Column) -> Column:
    """Bucket of a token array; a text with only mixed tokens counts as arabic."""

    def n(kind: str) -> Column:
        return F.size(F.filter(tokens, lambda t: classify_token(t) == kind))

    a, la, m = n("arabic"), n("latin"), n("mixed")
    return F.when(a + la + m == 0, F.lit(None)).when(la == 0, "arabic").when((a == 0) & (m == 0), "latin").otherwise("mixed")


def ratio_bucket(t: Column) -> Column:
    a, la = F.regexp_count(t, F.lit(f"[{C.ARABIC_THREE}]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    share = a / (a + la)
    return F.when(a + la == 0, "no_letters").when(share >= 0.85, "arabic").when(share <= 0.15, "latin").otherwise("mixed")


def dominance(tokens: Column, share: float = 0.7) -> Column:
    def part(kind: str) -> Column:
        return F.size(F.filter(tokens, lambda t: classify_token(t, C.ARABIC_BASIC, C.LATIN_BASIC) == kind)) / F.size(tokens)

    return F.when(F.size(tokens) == 0, "Empty").when(part("arabic") >= share, "Arabic").when(part("latin") >= share, "Latin").when(part("arabic") + part("latin") + part("mixed") >= share, "Code-Switched").otherwise("Symbols")
