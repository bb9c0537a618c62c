"""Approximate nearest neighbours by a permutation index.

``PIVOTS`` vectors are drawn as pivots; they are the fitted sample, all rows
are indexed.  A vector is represented by its ``PREFIX`` nearest pivots in order
and posted, with the pivot's place, in the inverted files of these pivots.

The index is cut into blocks of vectors, each with inverted files of its own,
and the queries into blocks too; every two meet in a task.  There a query reads
the files of its own pivots.  With places ``i`` and ``j`` of a shared pivot,
the footrule distance of two prefixes (a pivot that is missing counts as place
``PREFIX``) is a constant less twice the sum of ``PREFIX - max(i, j)``, so a
posting adds that to its vector.  The nearest ``DEPTH`` share of a block by
footrule, and all that tie with the last of them, are ranked again by exact
cosine in double precision; each block gives its best few of each query.

Equal vectors are indexed once, with their smallest ids: no more of them can be
among a query's nearest.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part; neither do vectors of another length than the most frequent (of
lengths as frequent, the smallest); fewer candidates than asked give fewer
rows; cosines that agree to 12 decimals are ties, and go to the smaller vec_id;
rows that repeat a vec_id with another vector are searched as well, and the id
is listed once, by its nearest vector; an empty table gives an empty result;
additional columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunecorpus.llm.common import arrow_schema, cut

PIVOTS, PREFIX, DEPTH = 512, 64, 0.05
FILE_BLOCK, QUERY_BLOCK = 8192, 4096
#: Decimals to which cosines are compared.
DECIMALS = 12


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(~bad & F.exists("v", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists, in double precision; rows scaled by a power of two, so that nothing overflows."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, in order; ties to the smaller pivot."""
    far = -np.round((x / norms(x)[:, None]) @ pivots.T, 12)
    near = np.sort(np.argpartition(far, prefix - 1, 1)[:, :prefix], 1) if prefix < len(pivots) else np.broadcast_to(np.arange(prefix), far.shape)
    order = np.argsort(np.take_along_axis(far, near, 1), 1, kind="stable")
    return np.take_along_axis(near, order, 1).astype(np.int16)


class Files:
    """The inverted files of one block of vectors."""

    def __init__(self, perm: np.ndarray, pivots: int):
        self.n, self.prefix = perm.shape
        order = np.argsort(perm.ravel(), kind="stable")
        self.vector, self.place = order // self.prefix, (order % self.prefix).astype(np.int32)
        self.start = np.searchsorted(perm.ravel()[order], np.arange(pivots + 1))

    def shared(self, perm: np.ndarray) -> np.ndarray:
        """For each vector the sum of PREFIX - max(i, j) over the pivots shared with a query: the nearer, the more."""
        out = np.zeros(self.n, np.int32)
        for i, p in enumerate(perm.tolist()):
            own = slice(self.start[p], self.start[p + 1])
            out[self.vector[own]] += self.prefix - np.maximum(self.place[own], i)
        return out


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each vec_id divisible by ``every``."""
    part = usable(vectors)
    sizes = part.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return part.sparkSession.createDataFrame([], schema)
    part = part.where(F.size("v") == sizes[0]["d"])
    # equal vectors once, with the k + 1 smallest ids (a query leaves itself out)
    low = Window.partitionBy("v").orderBy("vec_id")
    groups = part.distinct().withColumn("r", F.row_number().over(low)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    groups = cut(groups.select(F.element_at("ids", 1).alias("rep"), F.xxhash64("v").alias("h"), "v", "ids"))
    # rep and h name a vector: rep alone may have several
    chosen = groups.orderBy(F.xxhash64("h", F.lit(3)), "rep").limit(PIVOTS).select("v").toArrow().column("v")
    pivots = matrix(chosen)
    pivots = pivots / norms(pivots)[:, None]
    prefix = min(PREFIX, len(pivots))
    of_v = groups.schema["v"].dataType.simpleString()
    named = f"rep long, h long, v {of_v}, perm array<smallint>"
    posted = arrow_schema(named)

    def post(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                perm = permutations(matrix(some.column("v")), pivots, prefix)
                ends = np.arange(0, perm.size + 1, prefix, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.ListArray.from_arrays(ends, perm.ravel())], schema=posted)

    index = groups.select("rep", "h", "v").mapInArrow(post, named)
    asked = part.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("h"), "v").distinct()
    asked = cut(asked.join(groups.select("rep", "h", F.col("v").alias("w")), "h").where("v = w").select("query_id", "rep", "h"))
    queries = groups.join(asked.select("rep", "h").distinct(), ["rep", "h"], "left_semi").select("rep", "h", "v").mapInArrow(post, named)
    n_files = max(1, -(-groups.count() // FILE_BLOCK))
    n_turns = max(1, -(-asked.count() // QUERY_BLOCK))

    def own(n: int) -> Column:
        return F.pmod(F.xxhash64("rep", "h", F.lit(5)), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    files = index.withColumn("file", own(n_files)).withColumn("turn", each(n_turns))
    looks = queries.withColumn("turn", own(n_turns)).withColumn("file", each(n_files))
    found_schema = "query long, query_h long, rep long, h long, score double"
    arrow = arrow_schema(found_schema)

    def best(left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in arrow], schema=arrow)
        reps, hashes, x, y = left.column("rep").to_numpy(), left.column("h").to_numpy(), matrix(left.column("v")), matrix(right.column("v"))
        perms = [t.column("perm").combine_chunks().flatten().to_numpy().reshape(-1, prefix) for t in (left, right)]
        index, long, asking = Files(perms[0], len(pivots)), norms(x), norms(y)
        depth = min(len(x), max(4 * k, int(np.ceil(DEPTH * len(x)))))
        out = []
        for i, perm in enumerate(perms[1]):
            like = index.shared(perm)
            near = np.flatnonzero(like >= np.partition(like, len(x) - depth)[len(x) - depth])
            score = (x[near] * y[i]).sum(1) / (long[near] * asking[i])
            order = np.lexsort((hashes[near], reps[near], -np.round(score, DECIMALS)))[: k + 1]
            out.append((np.full(len(order), i), near[order], score[order]))
        query, near, score = (np.concatenate(c) for c in zip(*out, strict=True))
        ids = [right.column(c).to_numpy()[query] for c in ("rep", "h")] + [reps[near], hashes[near]]
        return pa.Table.from_arrays([pa.array(c) for c in (*ids, score)], schema=arrow)

    found = files.groupBy("file", "turn").cogroup(looks.groupBy("file", "turn")).applyInArrow(best, found_schema)
    nearest = F.desc(F.round("score", DECIMALS))
    top = Window.partitionBy("query", "query_h").orderBy(nearest, "rep", "h")
    found = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r")
    found = cut(found.join(groups.select("rep", "h", "ids"), ["rep", "h"]).select(F.col("query").alias("rep"), F.col("query_h").alias("h"), "score", "ids"))
    listed = asked.join(found, ["rep", "h"]).select("query_id", "h", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    listed = listed.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # of ids with several vectors, the nearest
    order = Window.partitionBy("query_id").orderBy(nearest, "vec_id")
    return listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
