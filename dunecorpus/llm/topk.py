"""Exact top-k by inner product: block-at-a-time pruning.

Components become whole numbers.  Equal vectors are held once.  Vectors are put
in the order of (nearest pivot, hash), cut into files of about ``FILE``
vectors and each file into document-range blocks of ``BLOCK``; a block has a
forward index (its vectors, dense) and, by component, its largest and smallest
value.  What a query can reach in a block is at most the sum over components of
its value times that maximum (or minimum, for a negative value).

A query orders a file's blocks by that bound and scores them through their
forward indexes, best first, until the bound falls below the k-th best score.
It starts with its own file, whose k-th score is a floor for all the others: a
block that can't reach it is never scored.  Queries and files meet in parts of
bounded size, and each part gives no more than k + 1 vectors of a query.

Everything is exact: sums under 2^53 go through doubles, larger ones through
64-bit integers, and sums that could pass 64 bits are an error, as is a
component that has no 64-bit whole number.

Edge cases: vectors that are null or hold null or non-finite components take no
part; neither do vectors of another length than the most frequent (of lengths
as frequent, the smallest); zero vectors do; equal rows count once, and rows that
repeat a vec_id with another vector are candidates and queries of their own; fewer
candidates than asked give fewer rows; scores that are equal go to the smaller
vec_id; an empty table gives an empty result; additional columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunecorpus.llm.common import arrow_schema, cut

SCALE = 64
PIVOTS, BLOCK, FILE, TURN = 256, 32, 8192, 8192


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the rows that take part, with whole components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    named = vectors.where("vec_id is not null and embedding is not null").where(~bad)
    return named.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def rows_of(column) -> np.ndarray:
    """An Arrow column of equally long lists as an array."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), -1)


class Blocks:
    """A file's vectors in blocks, with what each component reaches there."""

    def __init__(self, x: np.ndarray, block: int = BLOCK):
        self.most = float(np.abs(x.astype(np.float64)).max(initial=0.0))
        self.starts = np.arange(0, len(x), block)
        self.ends = np.append(self.starts[1:], len(x))
        self.x, self.high, self.low = x, np.maximum.reduceat(x, self.starts), np.minimum.reduceat(x, self.starts)
        self.doubles = (self.x.astype(np.float64), self.high.astype(np.float64), self.low.astype(np.float64))

    def best(self, q: np.ndarray, k: int, floor: float, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, blocks scored): the ``k`` best of at least ``floor``, ties to the smaller name."""
        size = self.most * float(np.abs(q.astype(np.float64)).sum())
        if size >= 2**63:
            raise OverflowError("an inner product doesn't fit 64 bits")
        x, high, low = self.doubles if size < 2**53 else (self.x, self.high, self.low)
        q = q.astype(x.dtype)
        bound = high @ np.maximum(q, 0) + low @ np.minimum(q, 0)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= floor]
        places, scores = np.empty(0, np.int64), np.empty(0, x.dtype)
        at, step = 0, 1
        while at < len(order):
            limit = scores[-1] if len(scores) == k else floor
            now = order[at : at + step]
            now = now[bound[now] >= limit]
            if not len(now):
                break
            rows = np.concatenate([np.arange(self.starts[b], self.ends[b]) for b in now])
            places, scores = np.concatenate([places, rows]), np.concatenate([scores, x[rows] @ q])
            if len(scores) > 4 * k:
                some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                places, scores = places[some], scores[some]
            keep = np.lexsort((names[places], -scores))[:k]
            places, scores = places[keep], scores[keep]
            at, step = at + len(now), step * 2
        some = scores >= floor
        return places[some], scores[some], at


def cells_of(groups: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``groups`` (rep, h, v) with the nearest pivot of each vector."""
    named = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in groups.schema.fields)}, cell int"
    schema = arrow_schema(named)
    long = np.sqrt((pivots.astype(np.float64) ** 2).sum(1))
    toward = (pivots / np.maximum(long, 1.0)[:, None]).T

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                near = (rows_of(batch.column("v")).astype(np.float64) @ toward).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], schema=schema)

    return groups.mapInArrow(run, named)


def placed(cells: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``cells`` with a ``file`` each, and the number of files: ranges of the order (cell, hash) of about ``size`` vectors.

    The counts of the cells (at most ``PIVOTS``) reach the driver.
    """
    counts = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    total = sum(counts.values())
    n_files = max(1, -(-total // size))
    before = np.cumsum([0, *(counts.get(c, 0) for c in range(PIVOTS))])
    start = F.element_at(F.array(*[F.lit(int(b)) for b in before]), F.col("cell") + 1)
    n = F.element_at(F.array(*[F.lit(int(counts.get(c, 0))) for c in range(PIVOTS)]), F.col("cell") + 1)
    share = F.pmod(F.xxhash64("rep", "h", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    file = F.least(F.lit(n_files - 1), F.floor((start + share * n) * n_files / F.lit(float(total)))).cast("int")
    return cells.withColumn("share", share).withColumn("file", file), n_files


def search(vectors: DataFrame, every: int = 20, k: int = 20, file_size: int = FILE, turn_size: int = TURN) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each vec_id divisible by ``every``."""
    part = whole(vectors)
    sizes = part.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes or not sizes[0]["d"]:
        return part.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    part = part.where(F.size("v") == sizes[0]["d"])
    # equal vectors once, with the k + 1 smallest ids (a query leaves itself out); rep and h name a vector
    low = Window.partitionBy("v").orderBy("vec_id")
    groups = part.distinct().withColumn("r", F.row_number().over(low)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    groups = cut(groups.select(F.element_at("ids", 1).alias("rep"), F.xxhash64("v").alias("h"), "v", "ids"))
    chosen = groups.orderBy(F.xxhash64("h", F.lit(3)), "rep").limit(PIVOTS).select("v").toArrow().column("v")
    files, n_files = placed(cells_of(groups.select("rep", "h", "v"), rows_of(chosen)), file_size)
    files = cut(files.select("rep", "h", "v", "cell", "share", "file"))
    asked = part.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("h"), "v").distinct()
    asked = cut(asked.join(groups.select("rep", "h", F.col("v").alias("w")), "h").where("v = w").select("query_id", "rep", "h"))
    queries = cut(files.join(asked.select("rep", "h").distinct(), ["rep", "h"], "left_semi").select("rep", "h", "v", F.col("file").alias("home")))
    n_turns = max(1, -(-queries.count() // turn_size))
    turn = F.pmod(F.xxhash64("rep", "h", F.lit(6)), F.lit(n_turns)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    found_schema = "query long, query_h long, rep long, h long, score long"
    arrow = arrow_schema(found_schema)

    def best(left, right):
        import pyarrow as pa

        none = pa.Table.from_arrays([pa.array([], f.type) for f in arrow], schema=arrow)
        if not left.num_rows or not right.num_rows:
            return none
        left = left.sort_by([("cell", "ascending"), ("share", "ascending"), ("rep", "ascending"), ("h", "ascending")])
        names = left.column("rep").to_numpy()
        blocks, out = Blocks(rows_of(left.column("v"))), []
        floors = right.column("floor").to_pylist()
        for i, q in enumerate(rows_of(right.column("v"))):
            at, score, _ = blocks.best(q, k + 1, -np.inf if floors[i] is None else floors[i], names)
            out.append((np.full(len(at), i), at, score.astype(np.int64)))
        query, at, score = (np.concatenate(c) for c in zip(*out, strict=True))
        ids = [right.column(c).to_numpy()[query] for c in ("rep", "h")] + [names[at], left.column("h").to_numpy()[at]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((*ids, score), arrow, strict=True)], schema=arrow)

    def meet(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
        right = right.select(*[F.col(c).alias(c) for c in ("rep", "h", "v", "floor", *by)])  # columns of its own: both sides come from the same files
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, found_schema)

    # the queries' own files hold at most a file's vectors as queries
    home = cut(meet(files, queries.withColumn("file", F.col("home")).withColumn("floor", F.lit(None).cast("long")), "file"))
    floors = home.groupBy(F.col("query").alias("rep"), F.col("query_h").alias("h")).agg(F.count("*").alias("held"), F.min("score").alias("least"))
    rest = queries.join(floors, ["rep", "h"]).withColumn("floor", F.when(F.col("held") > k, F.col("least"))).withColumn("turn", turn).withColumn("file", each(n_files)).where("file <> home")
    found = home.unionByName(meet(files.withColumn("turn", each(n_turns)), rest, "file", "turn"))

    top = Window.partitionBy("query", "query_h").orderBy(F.desc("score"), "rep", "h")
    found = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r")
    same = (F.col("rep") == F.col("query")) & (F.col("h") == F.col("query_h"))
    listed = found.join(groups.select("rep", "h", "ids"), ["rep", "h"]).select("query", "query_h", "score", same.alias("same"), F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("query", "query_h").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    listed = listed.select(F.col("query").alias("rep"), F.col("query_h").alias("h"), "same", "vec_id", "score")
    mine = asked.join(listed, ["rep", "h"]).where(~(F.col("same") & (F.col("vec_id") == F.col("query_id"))))
    order = Window.partitionBy("query_id", "rep", "h").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
