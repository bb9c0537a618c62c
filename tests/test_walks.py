"""Greedy walks, hidden states and prefix codes against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dunecorpus.operators import minhash, models
from dunecorpus.plans import registry

SF = "/root/testdata/sf0.001"


def plain_walk(texts):
    index, dropped = set(), []
    for t in texts:
        form = " ".join((t or "").strip().lower().split())
        keys = set(minhash.band_keys(minhash._signature(form).astype(np.int64))) if form else set()
        dropped.append(bool(keys & index))
        if not dropped[-1]:
            index |= keys
    return dropped


def test_banding_of_the_index():
    assert (minhash.BANDS, minhash.ROWS) == (9, 13)


def test_signatures_estimate_similarity_and_meet_by_chance():
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    error, met, chance = [], [], []
    for _ in range(150):
        a = "".join(rng.choice(letters, 400))
        at = rng.choice(400, rng.integers(0, 20), replace=False)
        b = "".join(rng.choice(letters) if i in set(at.tolist()) else c for i, c in enumerate(a))
        x, y = ({t[i : i + 4] for i in range(len(t) - 3)} for t in (a, b))
        assert len(minhash.shingle_hashes(a)) == len(x)
        true = len(x & y) / len(x | y)
        s, t = minhash._signature(a), minhash._signature(b)
        error.append((s == t).mean() - true)
        met.append(bool(set(minhash.band_keys(s)) & set(minhash.band_keys(t))))
        chance.append(minhash.chance_met(true))
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.05
    assert abs(np.mean(met) - np.mean(chance)) < 0.08
    assert 0.3 < minhash.chance_met(0.8) < 0.5 and minhash.chance_met(0.95) > 0.99  # the recall of this index


def test_walk_like_a_plain_one(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice("the quick brown fox jumps over lazy dogs and cats".split(), 30)) for _ in range(6)]
    texts = ["", None, "", *base]
    for b in base:
        w = b.split()
        for i in range(12):  # a chain in which each differs a little more from the first
            w[i * 2] = f"w{i}"
            texts.append(" ".join(w))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    got = {r["id"]: r["duplicate"] for r in minhash.duplicates(df, "id", "text").collect()}
    want = plain_walk(texts)
    assert any(want) and [got[i] for i in range(len(texts))] == want


def test_batches_drop_what_one_walk_drops(spark):
    rows = [{(r["id"], r["duplicate"]) for r in registry.queries()[n](spark, SF).collect()} for n in ("d4_near_duplicates", "i3_persisted_index")]
    texts = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert rows[0] == rows[1] == set(zip([r["doc_id"] for r in texts], plain_walk([r["text"] for r in texts]), strict=True))


def test_hidden_states_like_a_plain_search(spark):
    rng = np.random.default_rng(2)
    docs = [(i, "ab"[i % 3 > 0], rng.choice(list("pqrstu") if i % 3 else list("qrsxyz"), rng.integers(1, 6)).tolist()) for i in range(30)]
    df = spark.createDataFrame(docs, "id long, label string, w array<string>")
    got = {r["id"]: r["predicted"] for r in models.decode_hidden(df, "id", "w", models.train_hidden(df, "label", "w"), 0.8).collect()}
    counts = {c: Counter(x for _, label, w in docs for x in w if label == c) for c in "ab"}
    v = len(set().union(*counts.values()))
    prior = {c: math.log(sum(label == c for _, label, _ in docs) / len(docs)) for c in "ab"}
    emit = {c: {x: math.log((counts[c][x] + 0.5) / (counts[c].total() + 0.5 * v)) for x in "pqrstuxyz"} for c in "ab"}
    for i, _, w in docs:
        paths = []
        for bits in range(2 ** len(w)):
            states = ["ab"[bits >> k & 1] for k in range(len(w))]
            score = prior[states[0]] + sum(emit[s][x] for s, x in zip(states, w, strict=True)) + sum(math.log(0.8 if a == b else 0.2) for a, b in zip(states, states[1:], strict=False))
            paths.append((score, states))
        best = max(p[0] for p in paths)
        votes = [Counter(s) for p, s in paths if p > best - 1e-9]
        assert got[i] in {max(c, key=lambda s: (c[s], prior[s])) for c in votes}


def test_documents_without_words_have_the_largest_prior(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, "a", ["x", "y"]), (3, "b", [])], "id long, label string, w array<string>")
    got = {r["id"]: r["predicted"] for r in models.decode_hidden(df, "id", "w", models.train_hidden(df, "label", "w")).collect()}
    assert got[3] == "a"


def test_hash_buckets(spark):
    want = Counter()
    from dunecorpus.functions import tokens
    from dunecorpus.plans.corpus import corpus

    for r in corpus(spark, SF).select(tokens.words(F.col("text")).alias("w")).collect():
        want.update(zlib.crc32(f"UNI:{x}".encode()) % 200_000 for x in r["w"])
        want.update(zlib.crc32(f"BI:{a} {b}".encode()) % 200_000 for a, b in zip(r["w"], r["w"][1:], strict=False))
    assert {r["bucket"]: r["n"] for r in registry.queries()["p20_hash_buckets"](spark, SF).collect()} == dict(want)
