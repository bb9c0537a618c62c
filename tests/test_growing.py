"""Hashed classifiers, packed files and the growing corpus: plain runs, failures in the middle, runs again."""

import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunecorpus.functions import tokens
from dunecorpus.operators import evaluating, hashed, sparse
from dunecorpus.sources import binary
from dunecorpus.streaming import unified


def plain_fit(rows, steps, rate):
    """Dense softmax regression with the same steps."""
    classes = sorted({y for y, _ in rows})
    x = np.zeros((len(rows), hashed.BUCKETS))
    for i, (_, w) in enumerate(rows):
        tags = [f"UNI:{a}" for a in w] + [f"BI:{a} {b}" for a, b in zip(w, w[1:])] or ["UNI:"]
        for t in tags:
            x[i, zlib.crc32(t.encode()) % hashed.BUCKETS] += 1 / len(tags)
    used = np.flatnonzero(x.any(0))
    x, y = x[:, used], np.eye(len(classes))[[classes.index(c) for c, _ in rows]]
    w, m, v, losses = np.zeros((len(used), len(classes))), 0.0, 0.0, []
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        losses.append(-np.log((p * y).sum(1)).mean())
        g = x.T @ (p - y) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return losses, used, w


def test_training_equals_a_plain_run(spark):
    rng = np.random.default_rng(0)
    rows = [("ab"[i % 2], [f"{'xy'[i % 2]}{rng.integers(6)}" if rng.random() < 0.3 else f"w{rng.integers(20)}" for _ in range(rng.integers(0, 12))]) for i in range(90)]
    df = spark.createDataFrame([*rows, (None, ["x1"])], "label string, w array<string>").repartition(5)
    model = hashed.fit(df, "label", F.col("w"), steps=6, rate=0.5)
    losses, used, w = plain_fit(rows, 6, 0.5)
    assert model.classes == ["a", "b"] and model.losses == pytest.approx(losses, rel=1e-9) and losses[-1] < losses[0]
    assert np.abs(model.weights[used] - w).max() < 1e-6 and not np.delete(model.weights, used, 0).any()


def test_held_out_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", tokens.words(F.coalesce("text", F.lit(""))).alias("w"))
    model = hashed.fit(d.where("doc_id % 5 <> 0"), "lang", F.col("w"))
    found = hashed.predict(d.where("doc_id % 5 = 0"), ["doc_id", "lang"], F.col("w"), model).collect()
    words = [r["n"] for r in d.where("doc_id % 5 = 0").select(F.size("w").alias("n")).collect()]
    assert len(found) == len(words)
    right = np.mean([r["predicted"] == r["lang"] for r in found])
    bayes = {r["doc_id"]: r["predicted"] for r in evaluating.naive_bayes(d.where("doc_id % 5 <> 0"), "doc_id", "lang", "w", d.where("doc_id % 5 = 0")).collect()}
    plain = np.mean([bayes.get(r["doc_id"]) == r["lang"] for r in found])
    assert right > 0.95 and right >= plain - 0.01, (right, plain)


def test_odd_rows_have_a_class(spark):
    df = spark.createDataFrame([(1, "a", ["x"] * 600), (2, "b", None), (3, "b", [])], "id long, label string, w array<string>")
    model = hashed.fit(df, "label", F.col("w"), steps=3)
    assert {r["id"]: r["predicted"] for r in hashed.predict(df, ["id"], F.col("w"), model).collect()} == {1: "a", 2: "b", 3: "b"}
    assert hashed.fit(df.where("id > 9"), "label", F.col("w")).classes == []


@pytest.mark.parametrize("layout", ["uint16", "triplet"])
def test_packed_round_trip(spark, tmp_path, monkeypatch, layout):
    binary.register(spark)
    df = spark.range(5000, numPartitions=7).select(F.expr("cast(id * 13 % 65536 as int) AS value") if layout == "uint16" else F.expr("struct(cast(id as int) AS i, cast(id % 7 - 3 as int) AS j, cast(id / 3 as float) AS x)").alias("s"))
    df = df if layout == "uint16" else df.select("s.*")
    at = str(tmp_path / "out")
    df.write.format("packed").option("layout", layout).mode("overwrite").save(at)
    back = spark.read.format("packed").option("layout", layout).load(at)
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(back.collect()) == sorted(df.collect())
    record = binary.LAYOUTS[layout][0]
    assert sum(os.path.getsize(f"{at}/{n}") for n in binary.files_of(at)) == 5000 * record.itemsize
    df.limit(10).write.format("packed").option("layout", layout).mode("append").save(at)
    assert spark.read.format("packed").option("layout", layout).load(at).count() == 5010
    df.limit(10).write.format("packed").option("layout", layout).mode("overwrite").save(at)
    assert spark.read.format("packed").option("layout", layout).load(at).count() == 10
    assert not os.path.exists(f"{at}/_parts") and sum(n.endswith(".bin") for n in os.listdir(at)) == len(binary.files_of(at))
    df.where("false").write.format("packed").option("layout", layout).mode("overwrite").save(at)
    assert spark.read.format("packed").option("layout", layout).load(at).count() == 0


@pytest.mark.parametrize("bad", ["cast(null as int)", "70000", "-1"])
def test_a_failed_write_leaves_what_was_there(spark, tmp_path, bad):
    binary.register(spark)
    at = str(tmp_path / "out")
    good = spark.range(100, numPartitions=4).select(F.col("id").cast("int").alias("value"))
    good.write.format("packed").option("layout", "uint16").mode("overwrite").save(at)
    before = sorted(os.listdir(at))
    with pytest.raises(Exception, match="packed records|fit"):
        good.withColumn("value", F.when(F.col("value") == 77, F.expr(bad)).otherwise(F.col("value"))).write.format("packed").option("layout", "uint16").mode("overwrite").save(at)
    assert sorted(os.listdir(at)) == before and not os.path.exists(f"{at}/_parts")
    (tmp_path / "out" / "part-00000-lost-7.bin").write_bytes(b"\0" * 10)  # of an attempt that was killed
    assert spark.read.format("packed").option("layout", "uint16").load(at).count() == 100


SCHEMA = "id string, text string, channel string, video_id string"


def deliver(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def test_totals_survive_a_batch_that_runs_again(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "corpus", "state", "checkpoint")}

    def fold():
        return tuple(unified.fold(spark, at["in"], SCHEMA, at["corpus"], at["state"], at["checkpoint"], files=1).first())

    deliver(tmp_path / "in", "a.json", [{"id": "1", "text": "one two", "channel": "c1", "video_id": "v1"}, {"id": "2", "text": "", "channel": "c2"}, {"id": "3", "text": None}, {"id": "", "text": "no id"}, {"text": "none"}, "{broken", ""])
    assert fold() == (2, 2, 2, 1)
    deliver(tmp_path / "in", "b.json", [{"id": "4", "text": "three  four five", "channel": "c1", "video_id": "v2"}, {"id": "1", "text": "again", "channel": "", "video_id": "v1"}])
    deliver(tmp_path / "in", "c.json", [{"id": "5", "text": "six", "channel": "c3", "video_id": "v2"}])
    want = (5, 7, 3, 2)
    assert fold() == want == fold()
    last = max(int(n) for n in os.listdir(f"{at['checkpoint']}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):  # killed after the batch was written, before Spark committed it
        if os.path.exists(f"{at['checkpoint']}/commits/{name}"):
            os.unlink(f"{at['checkpoint']}/commits/{name}")
    deliver(tmp_path / "in", "d.json", [{"id": "6", "text": "seven", "channel": "c3", "video_id": "v3"}])
    assert fold() == (6, 8, 3, 3)
    assert sorted(r["id"] for r in spark.read.parquet(at["corpus"]).collect()) == ["1", "1", "2", "4", "5", "6"]


def test_nothing_to_fold(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert tuple(unified.fold(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "c"), str(tmp_path / "s"), str(tmp_path / "k")).first()) == (0, 0, 0, 0)


def sparse_rows(n=150, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        places = np.sort(rng.choice(200, rng.integers(1, 60), replace=False, p=(w := 1 / np.arange(1, 201)) / w.sum()))
        weights = rng.random(len(places)) + 0.01
        rows.append((i, "ab"[i % 5 == 0], places.tolist(), (weights / np.linalg.norm(weights)).tolist()))
    return rows


SPARSE = "id long, label string, place array<int>, weight array<double>"


def dense(rows):
    x = np.zeros((len(rows), 200))
    for i, (*_, p, w) in enumerate(rows):
        x[i, p] = w
    return x


@pytest.mark.parametrize("block", [8192, 20])
def test_sparse_neighbours_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sparse, "ROWS", block)
    monkeypatch.setattr(sparse, "QUERIES", max(5, block // 3))
    rows = sparse_rows()
    rows += [(200, "b", *rows[0][2:]), (201, "c", [1], [1.0])]
    x = dense(rows)
    df = spark.createDataFrame(rows, SPARSE)
    found = {}
    for r in sparse.nearest(df.where("id % 3 < 2"), df, 4, "label").collect():
        found.setdefault(r["q"], []).append((r["rank"], r["id"], r["score"]))
    for i, (q, label, *_) in enumerate(rows):
        if q % 3 < 2:
            same = [j for j, r in enumerate(rows) if r[1] == label and r[0] != q]
            want = sorted(((-round(float(x[i] @ x[j]), 12), rows[j][0]) for j in same))[:4]
            assert [n for _, n, _ in sorted(found.get(q, []))] == [n for _, n in want]


def test_lists_are_left_unread_where_the_rest_is_short():
    rng = np.random.default_rng(1)
    places = [np.concatenate([[i % 10], 10 + np.sort(rng.choice(390, 80, replace=False))]) for i in range(500)]
    weights = [np.concatenate([[rng.uniform(0.5, 1)], np.full(80, 0.001)]) for _ in places]
    index = sparse.Index(places, weights)
    near, score, read = index.nearest(places[0], weights[0], 5)
    assert read < 80 and {int(i) for i in near[np.argsort(-score)[:5]]} <= set(near.tolist())
    whole = np.array([sum(a * b for p, a in zip(places[0], weights[0], strict=True) for q, b in zip(places[j], weights[j], strict=True) if p == q) for j in near])
    assert np.allclose(whole, score)


def test_synthetic_rows_lie_between_neighbours(spark):
    rows = sparse_rows()
    by = {r[0]: r for r in rows}
    made = sparse.oversample(spark.createDataFrame(rows, SPARSE), "label").collect()
    count = {c: sum(r[1] == c for r in rows) for c in "ab"}
    assert len(made) == abs(count["a"] - count["b"])
    x = dense(rows)
    for r in made:
        small = min(count, key=count.get)
        assert r["label"] == by[r["base"]][1] == by[r["neighbour"]][1] == small and 0 <= r["gap"] < 1
        want = (1 - r["gap"]) * x[r["base"]] + r["gap"] * x[r["neighbour"]]
        got = np.zeros(200)
        got[r["place"]] = r["weight"]
        assert np.allclose(got, want)
    assert sparse.oversample(spark.createDataFrame([(1, "a", [0], [1.0]), (2, "b", [1], [1.0]), (3, "b", [2], [1.0])], SPARSE), "label").collect()[0]["base"] == 1


def test_machines_equal_a_plain_run(spark):
    rows = [(i, "xyz"[i % 3], sorted({i % 3 * 3, int(p)}), [0.5] * len({i % 3 * 3, int(p)})) for i, p in enumerate(np.random.default_rng(2).integers(0, 30, 90))]
    rows.append((500, "x", [], []))
    df = spark.createDataFrame(rows, SPARSE)
    found = sparse.fit(df, "label", 30, steps=5)
    x = np.concatenate([dense(rows)[:, :30], np.ones((len(rows), 1))], 1)
    sign = np.array([[1.0 if r[1] == c else -1.0 for c in "xyz"] for r in rows])
    w, m, v, losses = np.zeros((3, 31)), 0.0, 0.0, []
    for t in range(1, 6):
        slack = np.maximum(0, 1 - sign * (x @ w.T))
        losses.append((10 * (slack**2).sum() + 0.5 * (w[:, :-1] ** 2).sum()) / len(rows))
        g = 10 * (-2 * sign * slack).T @ x / len(rows)
        g[:, :-1] += w[:, :-1] / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert found.losses == pytest.approx(losses) and np.allclose(found.weights, w, atol=1e-8)
    many = sparse.fit(df, "label", 30)
    got = {r["id"]: r["predicted"] for r in sparse.judge(df, ["id"], many).collect()}
    assert np.mean([got[i] == c for i, c, *_ in rows]) > 0.9 and many.losses[-1] < many.losses[0]


def test_machines_leave_no_rows_behind(spark, tmp_path, monkeypatch):
    """The rows that each step reads are stored, not checkpointed, and go with the last step."""
    monkeypatch.setattr(sparse, "cut", None)
    monkeypatch.setattr(sparse, "shared_folder", lambda spark: str(tmp_path))
    rows = spark.createDataFrame([(1, "a", [0], [1.0]), (2, "b", [1], [1.0])], SPARSE)
    assert sparse.fit(rows, "label", 2, steps=2).classes == ["a", "b"]
    assert not list(tmp_path.iterdir())
