"""Votes of several annotators, their agreement, and classification scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(votes: DataFrame, item: str, label: str, annotator: str, raters: int, needed: int) -> DataFrame:
    """(item, label, agreement, status): ties go to the label of the smallest annotator; items without all raters are missing."""
    n = votes.groupBy(item, label).agg(F.count("*").alias("n"), F.min(annotator).alias("first"))
    best = n.groupBy(item).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("top"), F.max("n").alias("most"), F.sum("n").alias("all"))
    full, agreed = F.col("all") == raters, F.col("most") >= needed
    return best.select(item, F.when(full & agreed, F.col("top")).alias("label"), F.round(F.col("most") / F.col("all"), 6).alias("agreement"), F.when(~full, "missing").when(agreed, "agreed").otherwise("disagreement").alias("status"))


def fleiss(votes: DataFrame, item: str, label: str) -> DataFrame:
    """One row: kappa over all items, with as many votes each."""
    n = votes.groupBy(item, label).agg(F.count("*").alias("n"))
    per_item = n.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q"))
    seen = per_item.agg(F.avg((F.col("q") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("p"))
    share = n.groupBy(label).agg(F.sum("n").alias("n"))
    chance = share.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("e"))
    return seen.join(F.broadcast(chance)).select(F.round((F.col("p") - F.col("e")) / (1 - F.col("e")), 6).alias("kappa"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(cells: DataFrame) -> DataFrame:
    """(label, tp, support, predicted, recall, precision, f1) of a confusion table; 0 where undefined."""
    both = cells.select(F.inline(F.array(F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("t"), F.col("n").cast("int").alias("p")))))
    s = both.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    zero = F.lit(0.0)
    s = s.withColumn("recall", F.coalesce(F.try_divide("tp", "support"), zero)).withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), zero))
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), zero))


def cohen(cells: DataFrame) -> DataFrame:
    """One row: observed agreement and kappa of a confusion table."""
    s = class_scores(cells)
    n = F.sum("support")
    po, pe = F.sum("tp") / n, F.sum(F.col("support") * F.col("predicted")) / (n * n)
    return s.agg(F.round(po, 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.round((po - pe) / (1 - pe), 6).alias("kappa"))


def overlay(base: DataFrame, fixes: DataFrame, key: str, label: str, fixed: str) -> DataFrame:
    """Corrections win; the label before is kept for corrected rows only."""
    j = base.join(fixes.select(key, fixed), key, "left")
    return j.withColumn("before", F.when(F.col(fixed).isNotNull(), F.col(label))).withColumn(label, F.coalesce(fixed, label)).drop(fixed)
