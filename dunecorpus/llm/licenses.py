"""License scans: a positional index of rare licence words.

Texts become words (A-Z lower-cased; anything of ASCII but letters and digits
parts them).  The templates' words, but for common ones, form a small
vocabulary whose document frequencies are counted over all texts.  Each
template is posted under its ``RARE`` words of the highest inverse document
frequency, with their places, and a file looks up all its vocabulary words, so
one notice takes no votes from another.  A posting votes for a template at a
relative position (place in the file minus place in the template), and counts
where the template's mandatory key phrase stands at that position, give or take
``SLACK`` words: votes of neighbouring positions meet at the phrase.  An
alignment counts if the different words that vote for it hold at least
``SHARE`` of the weight of the template's posted words.

SQL functions only; at most a few hundred word counts reach the driver.

Edge cases: a null text counts as empty; rows repeat as often as in the input;
additional columns are ignored; an empty table gives an empty result; a very
long text is read whole, and running sums keep its places near linear; words of
equal frequency are taken in alphabetical order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunecorpus.llm.common import cut, running_sums

# Base phrases and labels of the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Public licence notices, (label, words, mandatory key phrase).
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)
COMMON = set("the a an of to in is are be it this that you not for with or and at by any under may use can 0 2 3 4 v".split())
RARE = 8
SHARE, SLACK = 0.5, 3
#: The templates' key phrases.
KEYS = sorted({k for _, _, k in TEMPLATES})
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The one character beyond ASCII whose lower-case form is an ASCII letter, and one in its place.
KELVIN, OTHER = "\u212a", "\u212b"
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The text's words, each between single blanks."""
    # what lower() does beyond ASCII parts no words and makes no ASCII letter; translate() would make a string of each character
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit(KELVIN), F.lit(OTHER))), PARTS, " ")), F.lit(" "))


def blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def places(norm: Column, phrase: str) -> Column:
    """Word numbers at which a phrase starts (in a text of normal form)."""
    n_words = len(phrase.split())
    pieces = F.split(norm, f"(?<= ){phrase}(?= )", -1)
    counts = F.transform(pieces, blanks)
    # inner pieces start and end with a blank, so the words before match i are the blanks so far, less one
    start = F.transform(F.arrays_zip(running_sums(counts).alias("s"), counts.alias("c"), F.sequence(F.lit(0), F.size(counts) - 1).alias("i")), lambda z: (z["s"] + z["c"] - 1 + z["i"] * (n_words - 1)).cast("long"))
    return F.when(F.instr(norm, f" {phrase} ") > 0, F.slice(start, F.lit(1), F.size(start) - 1)).otherwise(F.array().cast("array<long>"))


def anchors() -> list[str]:
    return sorted({w for _, words, _ in TEMPLATES for w in words.split()} - COMMON)


def one_of(words: list[str]) -> str:
    """A pattern of any of the words, with the blank before it; words are tried by their first character."""
    first = sorted({w[0] for w in words})
    return " (" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in first) + ")(?= )"


def word_places(norm: Column, pattern: str) -> Column:
    """Word numbers of the matches of :func:`one_of`."""
    counts = F.transform(F.split(norm, pattern, -1), blanks)
    # each match takes the blank before it, so the words before match i are the blanks so far and the i earlier matches
    at = F.zip_with(running_sums(counts), counts, lambda s, c: s + c)
    return F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda x, i: (x + i).cast("int"))


def read(docs: DataFrame) -> DataFrame:
    """One row per document: words counted, base places, which words of the vocabulary it holds, and where, if it holds a key phrase."""
    vocabulary = anchors()
    pattern = one_of(vocabulary)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    docs = docs.select("doc_id", "norm", F.regexp_extract_all("norm", F.lit(pattern), F.lit(1)).alias("words"))
    known = F.array(*[F.lit(w) for w in vocabulary])
    keyed = (F.size("words") > 0) & F.regexp_like("norm", F.lit(f" (?:{'|'.join(KEYS)}) "))
    held = F.zip_with("words", word_places(F.col("norm"), pattern), lambda w, at: F.struct(at.alias("at"), F.array_position(known, w).cast("int").alias("word")))
    keys = F.array(*[places(F.col("norm"), k) for k in KEYS])
    return docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.greatest(F.lit(0), F.when(F.col("norm") == "  ", 0).otherwise(blanks(F.col("norm")) - 1)).cast("long").alias("n_words"),
        *[places(F.col("norm"), p).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)],
        F.array_distinct("words").alias("kinds"),
        F.when(keyed, held).otherwise(F.array().cast("array<struct<at:int,word:int>>")).alias("held"),
        F.when(keyed, keys).otherwise(F.array().cast("array<array<long>>")).alias("keys"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    vocabulary = anchors()
    rows = cut(read(docs))
    n_docs = rows.count()
    df = {vocabulary.index(r["word"]) + 1: r["count"] for r in rows.select(F.explode("kinds").alias("word")).groupBy("word").count().collect()}
    idf = {i: math.log((1 + n_docs) / (1 + df.get(i, 0))) + 1e-3 for i in range(1, len(vocabulary) + 1)}
    weight = F.array(*[F.lit(idf[i]) for i in range(1, len(vocabulary) + 1)])
    postings: dict[str, list[tuple[int, int]]] = {w: [] for w in vocabulary}
    total = []
    for t, (_, words, _) in enumerate(TEMPLATES):
        number = {w: vocabulary.index(w) + 1 for w in words.split() if w in postings}
        rare = sorted(number, key=lambda w: (-idf[number[w]], w))[:RARE]
        for at, w in enumerate(words.split()):
            if w in rare:
                postings[w].append((t, at))
        total.append(sum(idf[number[w]] for w in rare))
    posted = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(at).alias("pos")) for t, at in postings[w]]) if postings[w] else F.array().cast("array<struct<t:int,pos:int>>") for w in vocabulary])
    label = F.array(*[F.lit(x) for x, _, _ in TEMPLATES])
    key = F.array(*[F.lit(KEYS.index(k)) for _, _, k in TEMPLATES])
    key_at = F.array(*[F.lit(len(words[: words.index(k)].split())) for _, words, k in TEMPLATES])
    whole = F.array(*[F.lit(x) for x in total])
    some = rows.where((F.size("held") > 0) & F.exists("keys", lambda k: F.size(k) > 0)).select("row", "keys", F.explode("held").alias("s"))

    def anchored(p: Column) -> Column:
        """(template, place of its key phrase) wherever the phrase stands as the posting wants it."""
        wanted = F.col("s.at") - p["pos"] + F.element_at(key_at, p["t"] + 1)
        near = F.filter(F.element_at("keys", F.element_at(key, p["t"] + 1) + 1), lambda at: F.abs(at - wanted) <= SLACK)
        return F.transform(near, lambda at: F.struct(p["t"].alias("t"), at.alias("at")))

    votes = some.select("row", "s.word", F.inline(F.flatten(F.transform(F.element_at(posted, F.col("s.word")), anchored)))).distinct()
    lined = votes.groupBy("row", "t", "at").agg(F.sum(F.element_at(weight, F.col("word"))).alias("votes"))
    at = F.col("t") + 1
    fits = lined.select("row", F.element_at(label, at).alias("label"), F.least(F.lit(1.0), F.col("votes") / F.element_at(whole, at)).alias("score")).where(F.col("score") >= SHARE)
    best = fits.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
    base = F.concat(*[F.when(F.size(f"p{i}") > 0, F.array(F.lit(x))).otherwise(F.array().cast("array<string>")) for i, (_, x) in enumerate(PHRASES)])
    every = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    out = rows.drop("kinds", "held", "keys").join(best, "row", "left")
    return out.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.when(F.size(every) > 0, 1.0).otherwise(0.0), F.coalesce("score", F.lit(0.0))).alias("score"),
    )
