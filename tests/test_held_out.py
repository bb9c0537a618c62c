"""Held-out texts under a trigram model, against a plain version."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunecorpus.operators import backoff, evaluating, held_out, staging


def plain(train, test):
    count = {3: Counter(tuple(t[i : i + 3]) for t in train for i in range(len(t) - 2))}
    for k in (2, 1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    less = {}
    for k in (2, 3):
        n = [sum(c == i for c in count[k].values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        less[k] = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[0] else 0.5 * i for i in (1, 2, 3)]
    total, types = sum(count[1].values()), len(count[1])
    out = {}
    for g in {tuple(t[i : i + 3]) for t in test for i in range(len(t) - 2)}:
        p, weight = 0.0, 1.0
        for k in (3, 2):
            own = {x[-1]: n for x, n in count[k].items() if x[:-1] == g[3 - k : -1]}
            if own:
                freed = {w: less[k][min(n, 3) - 1] for w, n in own.items()}
                if g[-1] in own:
                    p += weight * (own[g[-1]] - freed[g[-1]]) / sum(own.values())
                weight *= sum(freed.values()) / sum(own.values())
        out[g] = p + weight * (count[1][g[-1:]] + 1) / (total + types + 1)
    return out


def test_held_out_grams_come_by_slices(spark, tmp_path, monkeypatch):
    """Chances as in the plain version; nothing is checkpointed, and one order's counts are left."""
    monkeypatch.setattr(evaluating, "cut", None)
    rng = np.random.default_rng(4)
    rows = [["<s>", "<s>", *map(str, rng.choice([f"w{i}" for i in range(9)], rng.integers(0, 14))), "</s>"] for _ in range(60)]
    train, test = (spark.createDataFrame([(r,) for r in x], "w array<string>") for x in (rows[:45], [*rows[45:], ["<s>", "<s>", "new", "</s>"]]))
    found = {(r["g0"], r["g1"], r["w"]): r["p"] for r in evaluating.backed_off(train, test, "w", 3, str(tmp_path)).collect()}
    wanted = plain(rows[:45], [*rows[45:], ["<s>", "<s>", "new", "</s>"]])
    assert set(found) == set(wanted)
    assert all(math.isclose(found[g], wanted[g], rel_tol=1e-9) for g in wanted)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["counts1", "out2"]


@pytest.mark.parametrize("rows", [0, 1, 100])
def test_slices_hold_every_row_once(spark, tmp_path, rows):
    df = spark.range(rows)
    found = staging.sliced(lambda part: part(df, "id"), str(tmp_path / "x"))
    assert sorted(r["id"] for r in found.collect()) == list(range(rows))
    assert len(list((tmp_path / "x").iterdir())) == staging.SLICES


@pytest.mark.parametrize(("order", "windows"), [(2, 10**6), (4, 60), (6, 10**6), (6, 25), (8, 60)])
def test_places_meet_their_counts_without_a_model(spark, monkeypatch, order, windows):
    """As the stored model scores them, with tokens before that are frequent and ones that aren't; nothing is left behind."""
    monkeypatch.setattr(held_out, "WINDOWS", windows)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(9)]
    rows = [list(map(str, rng.choice(words, rng.integers(0, 14), p=1 / np.arange(1, 10) / sum(1 / np.arange(1, 10))))) for _ in range(90)]
    rows = [(i % 3 == 0, ("a", "b")[i % 2], r) for i, r in enumerate(rows)] + [(True, "a", ["new", "w0"]), (True, "b", None), (False, "a", None), (False, "a", rows[0])]
    df = spark.createDataFrame(rows, "held boolean, g string, w array<string>")
    found = held_out.scored(df.select("g", "held", held_out.marked(F.col("w")).alias("text")), "g", order).collect()
    want = {}
    for r in backoff.score(backoff.train(df.where("not held"), "w", order), df.where("held"), ["g"], "w", order).collect():
        n, s = want.get((r["g"], int(r["found"] > 0)), (0, 0.0))
        want[r["g"], int(r["found"] > 0)] = n + r["times"], s + r["times"] * r["logp"]
    assert {(r["g"], r["found"]): (r["times"], pytest.approx(r["times"] * r["logp"])) for r in found} == want


@pytest.mark.parametrize("held", [True, False])
def test_nothing_to_learn_or_to_score(spark, held):
    df = spark.createDataFrame([(held, "a", ["x", "y"])], "held boolean, g string, w array<string>")
    found = held_out.scored(df.select("g", "held", held_out.marked(F.col("w")).alias("text")), "g", 3).collect()
    assert [(r["found"], r["times"], round(r["logp"], 9)) for r in found] == ([(0, 3, 0.0)] if held else [])
