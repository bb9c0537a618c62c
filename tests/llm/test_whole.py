"""Importance resampling, spelling variants and exact top-k against brute force, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dunecorpus.llm import importance, topk, toxicity, variants

# additional columns whose names clash with the operators' own
ODD = "doc_id long, text string, n_features long, weight long, rank int, bucket int, word string, n long, start int, score double"
MORE = (1, 2, 3, 4, "x", 5, 6, 0.5)


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, *MORE) for i, t in rows], ODD)


def features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resample(rows, target, least=20, percent=25):
    def buckets(t):
        return Counter(zlib.crc32(f.encode()) % 10_000 for f in features(t)[1])

    s, t = sum((buckets(x) for _, x in rows), Counter()), sum(map(buckets, target), Counter())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in rows:
        own = buckets(x)
        weight = sum(gain[b] * n for b, n in own.items()) // max(1, own.total())
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, own.total(), weight, score, None, len(features(x)[0])])
    own = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for rank, r in enumerate(own[: percent * len(own) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def test_resampling_against_brute_force_on_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = ["The", "quick", "brown", "fox", "über", "10", "x" * 70, "日本", "a.b"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n!?"), (203, "Long text, " * 30_000), (204, "y" * 100_000), (None, "no id " * 30)]
    rows += [(300, "copy of one " * 20)] * 40 + [(301, "the quick"), (301, "the quick brown fox " * 9)]
    monkeypatch.setattr(importance, "RUN", 7)
    target = ["the quick brown fox", None, "über 10", ""]
    found = importance.resample(odd_docs(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    assert Counter(tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_resample(rows, target)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert Counter(tuple(r) for r in importance.resample(some, none).collect()) == plain_resample([(1, "a b"), (2, None)], [])


def test_parts_of_a_text_add_up(monkeypatch):
    text = ("Some Words, and some MORE über words. " * 500).encode()
    whole = importance.row_of(text)
    monkeypatch.setattr(importance, "PART", 100)
    parts = importance.row_of(text)
    assert whole[0] == parts[0] and (whole[1] == parts[1]).all() and (whole[2] == parts[2]).all()
    assert Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text.decode())[1]) == dict(zip(whole[1].tolist(), whole[2].tolist(), strict=True))


def edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def variant_rows():
    rng = np.random.default_rng(2)
    base = ["hello", "world", "writing", "étranger", "ÉTAT", "aaaaa", "aaaaaa", "aaaaaaa", "straße", "z" * 300, "×÷×÷×÷"]
    letters = list("aehlorwé")
    rows = []
    for i in range(700):
        w = str(rng.choice(base))
        if rng.random() < 0.6:
            at, kind = rng.integers(0, len(w)), rng.integers(0, 3)
            w = w[:at] + (str(rng.choice(letters)) if kind < 2 else "") + w[at + (kind != 0) :]
        rows.append((i % 90, f"{w}, {w.upper()} {w} 12{w}"))
    return [*rows, (None, "hello world étranger " * 4), (1000, None), (1001, ""), (1002, "hello " * 20_000), (1003, "q" * 50_000)]


@pytest.mark.parametrize("block", [4096, 3])
def test_variants_against_brute_force(spark, monkeypatch, block):
    rows = variant_rows()
    monkeypatch.setattr(variants.near_pairs, "__defaults__", (block,))  # lists over the block are cut, and their parts meet
    found = [tuple(r) for r in variants.group(odd_docs(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain_variants(rows)
    assert len(found) == len(want) and set(found) == want
    assert any(r[1] and r[2] != r[1] for r in found)  # a chain of forms


def test_variants_of_nothing(spark):
    assert variants.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.group(spark.createDataFrame([(1, None), (2, "abc")], "doc_id long, text string")).count() == 0


def test_edits_and_the_overlap_bound():
    words = ["abcde", "abcd", "abce", "abXde", "Xabcde", "abcdeX", "aabcd", "aaaa", "aaaaa", "edcba", "abcdf", "bacde"]
    for a in words:
        for b in words:
            if 0 <= len(a) - len(b) <= 1:
                assert variants.one_edit(a, b) == (a != b and edit(a, b))
    for size in (4, 5, 6):
        index = variants.Index()
        for w in words:
            if len(w) == size:
                index.add(w, 1)
        for a in words:
            if len(a) - size in (0, 1):
                assert {w for w, _ in index.near(a, len(a) - size)} == {w for w in words if len(w) == size and w != a and edit(a, w)}


def plain_topk(rows, every=20, k=20):
    kept = list(dict.fromkeys((i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows))
    out = Counter()
    for q, x in kept:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in kept if (i, y) != (q, x))
            out.update((q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1))
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "q", 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, query_id string, score double")


@pytest.mark.parametrize("sizes", [(8192, 8192), (40, 3)])
def test_topk_against_brute_force(spark, sizes):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(60)] + [(500, [0.0] * 8), (520, [0.0] * 8)] + rows[:3] + [(40, [1.0] * 8), (40, [2.0] * 8)]
    odd = [(600, None), (620, [1.0, None, *[0.0] * 6]), (640, [float("nan")] * 8), (660, [float("inf")] * 8), (680, [1.0] * 5), (None, [1.0] * 8)]
    found = topk.search(vectors(spark, rows + odd), file_size=sizes[0], turn_size=sizes[1])
    assert Counter(tuple(r) for r in found.collect()) == plain_topk(rows)


def test_topk_of_few_and_none(spark):
    assert topk.search(vectors(spark, [])).count() == 0
    assert topk.search(vectors(spark, [(0, [1.0, 2.0])])).count() == 0
    assert [tuple(r) for r in topk.search(vectors(spark, [(0, [1.0, 2.0]), (3, [0.5, -1.0])])).collect()] == [(0, 1, 3, 64 * 32 - 128 * 64)]


def test_blocks_are_pruned_by_their_bounds():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (64, 16))
    x = np.floor(np.concatenate([c + rng.normal(0, 1, (32, 16)) for c in centres])).astype(np.int64)
    blocks = topk.Blocks(x)
    names = np.arange(len(x))
    for q in x[:: 97]:
        at, score, scored = blocks.best(q, 21, -np.inf, names)
        order = np.lexsort((names, -(x @ q)))[:21]
        assert at.tolist() == order.tolist() and score.tolist() == (x @ q)[order].tolist()
        assert scored <= 16  # of 64
        floor = float(score[4])
        some, high, fewer = blocks.best(q, 21, floor, names)
        assert (high >= floor).all() and set(at[score >= floor]) == set(some.tolist()) and fewer <= scored


def test_large_components_stay_exact_or_raise():
    x = np.array([[2**40, 3], [2**40, 2], [-(2**40), 7]], np.int64)
    at, score, _ = topk.Blocks(x).best(np.array([2**20, 1], np.int64), 2, -np.inf, np.arange(3))
    assert at.tolist() == [0, 1] and score.tolist() == [2**60 + 3, 2**60 + 2]
    with pytest.raises(OverflowError):
        topk.Blocks(x).best(np.array([2**30, 1], np.int64), 2, -np.inf, np.arange(3))


@pytest.mark.parametrize("mark", ["_", "*", ".", "-", " ", "_ ", "a_", "a.", "a. ", "a ", "1*-", "é_"])
def test_no_run_of_marks_hangs(mark):
    import time

    text = mark * 10_000
    began = time.process_time()
    for tail in ("!", " !", "a!", ""):
        toxicity.chunks(f"{text}{tail} and so on")
    assert time.process_time() - began < 5


def test_letters_apart_are_read():
    assert {"idiot"} <= toxicity.chunks("you i d i o t there") and {"idiot"} <= toxicity.chunks("an I.D.I.O.T!")
    assert not {c for c in toxicity.chunks("an a b") if c == "ab"}


def some_writing():
    from dunecorpus.llm import secrets

    prose = "my own config file name for the session used by the worker in every run and the path of the user value " * 50
    return secrets.written(np.bincount(np.frombuffer(prose.encode(), np.uint8), minlength=128))


def plain_spans(scores):
    """Maximal scoring spans by their definition: the best span, then those left and right of it."""
    best = max(((sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0), key=lambda x: (x[0], x[1] - x[2]))
    if best[0] <= 0:
        return []
    _, a, b = best
    return plain_spans(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in plain_spans(scores[b:])]


def test_maximal_spans_against_their_definition():
    from dunecorpus.llm import secrets

    rng = np.random.default_rng(8)
    for n in [0, 1, 2, *[int(x) for x in rng.integers(3, 25, 150)]]:
        scores = rng.normal(-0.1, 1, n).tolist()
        assert sorted(secrets.spans(scores)) == plain_spans(scores)
    assert secrets.spans([1.0, -math.inf, 1.0, 2.0]) == [(0, 1), (2, 4)]


def test_long_runs_take_linear_time():
    import time

    from dunecorpus.llm import secrets

    rng, writing = np.random.default_rng(9), some_writing()
    base64 = "".join(rng.choice(list(secrets.ENCODINGS["base64"][:64]), 1 << 20))
    for text, most in ((base64, 2000), ("abcd/" * 200_000, 50), (("_" * 1000 + "a") * 1000, 50), ("/".join(rng.choice(["word", "x9Kq2", "user"], 150_000)), 20_000)):
        began = time.process_time()
        found = secrets.candidates(text, [], writing)
        assert time.process_time() - began < 15 and len(found) <= most  # some seconds on an idle machine; a quadratic search takes an hour
        secrets.longest([(s, e) for s, e, *_ in found])


@pytest.mark.parametrize("alphabet", ["hex", "base36", "base62"])
def test_keys_of_many_groups_are_found_between_names(alphabet):
    from dunecorpus.llm import secrets

    rng, writing, hits = np.random.default_rng(10), some_writing(), 0
    before = "my_own_config_file_name_for_"
    for _ in range(40):
        key = "-".join("".join(rng.choice(list(secrets.ENCODINGS[alphabet]), 4)) for _ in range(10))
        found = secrets.candidates(f"{before}{key}_used_by_the_worker_in_every_run", [], writing)
        hits += any(min(e, len(before) + len(key)) - max(s, len(before)) >= 0.85 * max(e - s, len(key)) for s, e, *_ in found)
    assert hits >= 32
