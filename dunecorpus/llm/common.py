"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dunecorpus.operators.staging import cut


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A side of a join is broadcast only up to so many bytes, as counted.
BROADCAST_BYTES = 32 << 20


def small_or_shuffled(df: DataFrame, arrays: dict[str, int] | None = None) -> DataFrame:
    """``df`` to be broadcast if its counted bytes are at most ``BROADCAST_BYTES``; otherwise as it is, and the join shuffles.

    ``df`` has to be materialised.  ``arrays`` names array columns and the
    bytes of an element; every other column counts as 16 bytes.
    """
    fixed = 16 * (len(df.columns) + 1)
    row = sum((F.greatest(F.size(c), F.lit(0)) * size for c, size in (arrays or {}).items()), F.lit(fixed))
    total = df.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` so that ``body`` uses it without computing it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


STEP = 64


def running_sums(lengths: Column) -> Column:
    """Sums of all earlier lengths, for each length; two levels keep it near linear."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")), lambda j: total(F.slice(lengths, j * STEP + 1, F.lit(STEP))))
    before = let(sums, lambda s: F.transform(F.sequence(F.lit(1), F.size(s)), lambda j: total(F.slice(s, F.lit(1), j - 1))))
    places = F.sequence(F.lit(0), F.size(lengths) - 1)
    return let(before, lambda b: F.transform(places, lambda i: F.element_at(b, F.floor(i / STEP).cast("int") + 1) + total(F.slice(lengths, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP))))


def unsigned_mod(key: Column, n: Column | int) -> Column:
    return F.pmod(key, n if isinstance(n, Column) else F.lit(n))


def blocks_of(n: Column, size: int) -> Column:
    """How many blocks a group of ``n`` members is split into."""
    return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")


def block_pairs(members: DataFrame, group: list[str], member: str, n_blocks: str) -> DataFrame:
    """Repeat each member for every pair of blocks that it has to meet.

    A group is split into ``n_blocks`` blocks by a hash of the member; the
    result has ``lo``, ``hi`` (the pair of blocks) and ``side`` (the member's
    own block).  Every two members of a group meet in exactly one pair.
    """
    side = unsigned_mod(F.xxhash64(F.col(member), *[F.col(c) for c in group]), F.col(n_blocks).cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(n_blocks) - 1))
    out = members.withColumn("side", side).withColumn("other", other)
    return out.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).drop("other")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components: ``(v, label)`` with the smallest vertex as label.

    Vertices may be of any type that has an order.  Minimum propagation with
    pointer jumping, cut after each round; ends when no label changes.
    """
    both = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).union(edges.select(F.col(b), F.col(a))).where("v <> u").distinct()
    both = cut(both)
    labels = cut(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")))
    for _ in range(rounds):
        seen = labels.select(F.col("v").alias("u"), F.col("label").alias("near"))
        least = both.join(seen, "u").groupBy("v").agg(F.min("near").alias("near"))
        step = labels.join(least, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = cut(step.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: A slice of an Arrow batch that a Python stage works on at once: so many bytes of text, and rows.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1000


def slices(batches, column: str = "text"):
    """The Arrow batches cut by the bytes of ``column``, so that memory doesn't go by a batch's rows; a longer text is alone."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > at and (total + size > SLICE_BYTES or i - at >= SLICE_ROWS):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += size
        if len(sizes):
            yield batch.slice(at)


def texts(batch, column: str = "text") -> list[str]:
    """The texts of a batch; a null is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def arrow_schema(ddl: str):
    """The Arrow schema of a Python stage's rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def over_texts(docs: DataFrame, keep: list[str], found: str, read: Callable) -> DataFrame:
    """The columns ``keep`` as they are, and those of ``found`` (name and type each) that ``read`` finds in the texts.

    ``read`` takes a list of texts and gives a list or array for each column.
    What is kept stays in Arrow: ids don't pass through floating point.
    """
    import pyarrow as pa

    more = arrow_schema(found)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches):
        for part in slices(batches):
            own = [part.column(name) for name in keep]
            new = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(read(texts(part)), more, strict=True)]
            yield pa.RecordBatch.from_arrays(own + new, [*keep, *more.names])

    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, {found}" if kept else found)


_caches: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]):
    """A Python worker's cache, kept from task to task; a worker has but the last named one."""
    if name not in _caches:
        _caches.clear()
        _caches[name] = make()
    return _caches[name]


class Hashes(dict):
    """word -> 64-bit hash, bounded: emptied when it has ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (in place)."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def ngram_hashes(words: list[str], n: int, cache: Hashes) -> np.ndarray:
    """64-bit hashes of the word n-grams in order; a shorter text is one n-gram."""
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(n, len(ids))
    k = len(ids) - n + 1
    h = ids[:k].copy()
    for j in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[j : j + k]
    return mix(h)
