"""Exact neighbours of vectors in blocks, analogies, votes and synthetic vectors.

A stated set of queries meets all candidates block by block: both sides are
dealt to blocks of bounded size by a hash, and every two blocks are compared in
a task of their own that gives each query's best few.  Neither side is ever
broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 4096, 512
METRICS = ("cosine", "dot", "euclid", "ranks")
DECIMALS = 12


def _scores(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The larger, the nearer; rows of x against rows of y."""
    if metric == "cosine":
        x, y = (v / np.sqrt((v * v).sum(1, keepdims=True)) for v in (x, y))
    if metric in ("cosine", "dot"):
        return x @ y.T
    if metric == "euclid":
        return -np.stack([np.sqrt(((x - row) ** 2).sum(1)) for row in y], 1)
    x, y = (np.argsort(np.argsort(v, 1, kind="stable"), 1, kind="stable") for v in (x, y))
    return -np.stack([np.abs(x - row).sum(1) for row in y], 1).astype(np.float64)


def _matrix(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, metric: str = "cosine", by: str | None = None) -> DataFrame:
    """(q, id, score, rank): the k nearest of ``candidates`` (id, v) to each of ``queries`` (q, qv), without itself.

    With ``by``, a column of both sides, only within equal values of it.  Null
    vectors take no part, nor do zero ones in cosine; ties of ``DECIMALS``
    decimals go to the smaller id.
    """
    own = ["_group"] if by else []
    group = [F.col(by).alias("_group")] if by else []
    some = (lambda v: F.exists(v, lambda x: x != 0)) if metric == "cosine" else (lambda v: F.lit(True))
    left = candidates.where(F.col("v").isNotNull() & some("v")).select(*group, "id", "v")
    right = queries.where(F.col("qv").isNotNull() & some("qv")).select(*group, "q", "qv")
    n_left, n_right = (max(1, -(-df.count() // size)) for df, size in ((left, CANDIDATES), (right, QUERIES)))

    def dealt(df: DataFrame, key: str, name: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left, right = dealt(left, "id", "_file", n_left, "_turn", n_right), dealt(right, "q", "_turn", n_right, "_file", n_left)

    def best(a, b):
        import pyarrow as pa

        names = ["q", "id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
        ids, asked = a.column("id").to_numpy(), b.column("q").to_numpy()
        score = _scores(metric, _matrix(a.column("v")), _matrix(b.column("qv")))
        out = []
        for i, q in enumerate(asked.tolist()):
            order = np.lexsort((ids, -np.round(score[:, i], DECIMALS)))[: k + 1]
            order = order[ids[order] != q][:k]
            out.append((np.full(len(order), q), ids[order], score[order, i]))
        return pa.table(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    keys = [*own, "_file", "_turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "q long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", DECIMALS)), "id")).cast("bigint")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def unit(v: Column) -> Column:
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: x / length)


def analogies(questions: DataFrame, candidates: DataFrame, k: int, normalised: bool = False) -> DataFrame:
    """(q, id, score, rank): the k vectors nearest to b - a + c, without the three themselves.

    ``questions`` has q, a, b, c (ids); one with an unknown id has no rows.
    ``normalised`` takes vectors of length 1.
    """
    known = candidates.select("id", (unit(F.col("v")) if normalised else F.transform("v", lambda x: x.cast("double"))).alias("v"))
    target = questions
    for name in "abc":
        target = target.join(known.select(F.col("id").alias(name), F.col("v").alias(f"v{name}")), name)
    mixed = F.transform(F.arrays_zip("va", "vb", "vc"), lambda z: z["vb"] - z["va"] + z["vc"])
    # no candidate has the id of a question
    asked = target.select((-1 - F.col("q")).alias("q"), mixed.alias("qv"))
    found = nearest(asked, known, k + 3).withColumn("q", -1 - F.col("q")).join(questions, "q").where("id <> a and id <> b and id <> c")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("rank")).cast("bigint")
    return found.select("q", "id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, label: str, k: int, weighted: bool) -> DataFrame:
    """(q, predicted) by the k nearest's labels: one vote each, or by score over the least of them; ties to the smaller label."""
    some = neighbours.where(F.col("rank") <= k)
    weight = F.col("score") - F.min("score").over(Window.partitionBy("q")) + 1e-6 if weighted else F.lit(1.0)
    votes = some.withColumn("_w", weight).groupBy("q", label).agg(F.round(F.sum("_w"), 9).alias("_w"))
    return votes.groupBy("q").agg(F.max_by(label, F.struct("_w", -F.col(label))).alias("predicted"))


def _drawn(seed: str, group: Column, number: Column, start: int) -> Column:
    """A whole number under 2^24, by seed, group and number."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), group.cast("string"), number.cast("string"))), start, 6), 16, 10).cast("long")


def oversample(df: DataFrame, by: str, k: int = 5, seed: str = "smote") -> DataFrame:
    """(by, number, base, neighbour, gap, v): synthetic vectors that bring each class to the size of the largest.

    A synthetic vector lies between a drawn one of the class (id, v) and one of
    its k nearest there; a class of one is repeated.
    """
    from dunecorpus.operators.selecting import ranked

    sizes = df.groupBy(by).agg(F.count("*").alias("n"))
    needed = sizes.select(by, "n", (F.max("n").over(Window.partitionBy()) - F.col("n")).alias("missing")).where("missing > 0")
    made = needed.select(by, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("missing") - 1)).alias("number"))
    draw = lambda start: _drawn(seed, F.col(by), F.col("number"), start)
    made = made.select(by, "number", (F.lit(1) + draw(1) % F.col("n")).alias("place"), (F.lit(1) + draw(7) % F.greatest(F.least(F.lit(k), F.col("n") - 1), F.lit(1))).alias("rank"), (draw(13) / F.lit(float(1 << 24))).alias("gap"))
    bases = made.join(ranked(df.select(by, "id", "v"), by, "id").select(by, "place", F.col("id").alias("base"), F.col("v").alias("bv")), [by, "place"])
    asked = bases.select(by, F.col("base").alias("q"), F.col("bv").alias("qv")).distinct()
    near = nearest(asked, df.select(by, "id", "v"), k, "euclid", by).select(F.col("q").alias("base"), "rank", F.col("id").alias("neighbour"))
    out = bases.join(near, ["base", "rank"], "left").withColumn("neighbour", F.coalesce("neighbour", "base"))
    out = out.join(df.select(F.col("id").alias("neighbour"), F.col("v").alias("nv")), "neighbour")
    return out.select(by, "number", "base", "neighbour", "gap", F.zip_with("bv", "nv", lambda b, n: b + F.col("gap") * (n - b)).alias("v"))
