"""Samples, splits, quotas and exact duplicates.

Every draw orders rows by a hash of a seed and the row's id, so results do not
depend on how rows are dealt out, and a draw can be repeated anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunecorpus.operators.staging import cut


def draw(id_column: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def sample(df: DataFrame, k: int, id_column: str, seed: int = 42) -> DataFrame:
    """k rows, uniformly; a top-k, so no full sort."""
    return df.orderBy(draw(id_column, seed), id_column).limit(k)


#: A group is placed by so many leading hex digits of the draw: the most rows of its histogram are 16 ** PREFIX.
PREFIX = 3


def ranked(df: DataFrame, by: str, id_column: str, seed: int = 42) -> DataFrame:
    """Rows with their place (from 1) and the size of their group, in drawn order.

    A group can hold most rows: its draws are counted by their leading digits,
    the counts are summed up in order, and rows are only sorted among those
    with the same digits, in a task of their own.
    """
    drawn = df.withColumn("_draw", draw(id_column, seed)).withColumn("_slot", F.substring("_draw", 1, PREFIX))
    slots = drawn.groupBy(by, "_slot").agg(F.count("*").alias("_rows"))
    group = Window.partitionBy(by)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.select(F.col(by).alias("_by"), F.col("_slot").alias("_at"), before.alias("_before"), F.sum("_rows").over(group).alias("group_size"))
    inner = F.row_number().over(Window.partitionBy(by, "_slot").orderBy("_draw", id_column))
    placed = drawn.withColumn("_inner", inner).join(slots, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_slot") == F.col("_at")))
    return placed.select(*df.columns, (F.col("_before") + F.col("_inner")).cast("bigint").alias("place"), "group_size")


def quotas(df: DataFrame, by: str, id_column: str, targets: dict[str, int], default: int = 0, seed: int = 42) -> DataFrame:
    """At most targets[group] rows a group."""
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col(by)), F.lit(default)) if targets else F.lit(default)
    return ranked(df, by, id_column, seed).where(F.col("place") <= quota).drop("place", "group_size")


def until_budget(df: DataFrame, by: str, order: str, cost: Column, budget: int, width: int = 4096) -> DataFrame:
    """Rows of each group, in order, while the costs of those before are under the budget, with that sum as ``before``.

    Costs are summed up by ranges of ``width`` values of the order first; only
    ranges that start under the budget have their rows sorted.
    """
    priced = df.withColumn("_cost", cost).withColumn("_range", F.floor(F.col(order) / width))
    sums = priced.groupBy(by, "_range").agg(F.sum("_cost").alias("_sum"))
    run = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(run), F.lit(0)).alias("_start")).where(F.col("_start") < budget)
    inside = Window.partitionBy(by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = priced.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    out = placed.withColumn("before", F.col("_start") + F.coalesce(F.sum("_cost").over(inside), F.lit(0)))
    return out.where(F.col("before") < budget).select(*df.columns, "before")


def first_of(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key: a partial aggregation, so large groups of copies shrink before the shuffle."""
    at = F.struct(*order)
    names = df.columns
    best = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*names), at).alias("r"))
    return best.select("r.*")


def dedup(df: DataFrame, id_column: str, key: Column, order: list[Column]) -> DataFrame:
    """First by id, then by key among those left: a repeated id does not register its key."""
    return first_of(first_of(df, [F.col(id_column)], order), [key], order)


def uniform(seed: int, id_column: str) -> Column:
    """A whole number under 2^28, drawn by seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_column).cast("string"))), 1, 7), 16, 10).cast("long")


def sorted_batches(df: DataFrame, length: str, id_column: str, size: int, seed: int) -> DataFrame:
    """(columns of df, batch): batches of ``size`` rows in order of length, in drawn order within a length.

    Only the histogram of lengths is summed in one task; each length's rows are placed on their own.
    """
    before = Window.orderBy(length).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(length).agg(F.count("*").alias("_rows")).select(length, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    drawn = F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_column).cast("string")))
    place = F.row_number().over(Window.partitionBy(length).orderBy(drawn, id_column))
    at = df.withColumn("_place", place).join(offsets, length)
    return at.select(*df.columns, F.floor((F.col("_before") + F.col("_place") - 1) / size).alias("batch"))


def nearest_to_centroid(df: DataFrame, by: str, id_column: str, vector: str) -> DataFrame:
    """(by, id, distance): the vector of each group nearest (squared) to the group's mean; partial aggregations only."""
    sums = df.select(by, F.posexplode(vector).alias("_i", "_x")).groupBy(by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_c"))
    centre = sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_c"))), lambda s: s["_c"]).alias("_centre"))
    apart = F.aggregate(F.zip_with(vector, "_centre", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x)
    near = df.join(centre, by).select(by, id_column, apart.alias("distance"))
    return near.groupBy(by).agg(F.min_by(id_column, F.struct("distance", id_column)).alias(id_column), F.min("distance").alias("distance"))


def walk_tree(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, parent, category, depth) of all that ``links`` (parent, place, child) reach from ``roots`` (id, place, category), level by level.

    What is met more than once belongs to the parent that a queue would take
    first: the path of places decides.  Each level is one join against what is
    new, so there is no limit on depth, and cycles end.
    """
    key = F.array(F.col("place").cast("long"))
    now = cut(roots.groupBy("id").agg(F.min(F.struct(key.alias("path"), F.lit(None).cast(links.schema["parent"].dataType).alias("parent"), "category")).alias("r")).select("id", "r.*", F.lit(0).alias("depth")))
    seen, depth = now, 0
    while not now.isEmpty():
        depth += 1
        step = links.join(now.select(F.col("id").alias("parent"), "path", "category"), "parent")
        step = step.groupBy(F.col("child").alias("id")).agg(F.min(F.struct(F.concat("path", key).alias("path"), "parent", "category")).alias("r"))
        now = cut(step.join(seen.select("id"), "id", "left_anti").select("id", "r.*", F.lit(depth).alias("depth")))
        seen = seen.unionByName(now)
    return seen.select("id", "parent", "category", "depth")
