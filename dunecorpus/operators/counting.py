"""Frequencies, vocabularies, n-grams and co-occurrence of token columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
#: Neighbouring values of an order that are summed up in one task.
RANGE = 4096


def frequencies(df: DataFrame, tokens: str, by: tuple[str, ...] = (), docs: bool = False) -> DataFrame:
    """(by, token, n): occurrences; with ``docs`` also the rows that hold the token, still in one shuffle."""
    if not docs:
        return df.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))
    every = F.transform(tokens, lambda x: F.struct(x.alias("token"), F.lit(1).alias("n"), F.lit(0).alias("d")))
    once = F.transform(F.array_distinct(tokens), lambda x: F.struct(x.alias("token"), F.lit(0).alias("n"), F.lit(1).alias("d")))
    return df.select(*by, F.inline(F.concat(every, once))).groupBy(*by, "token").agg(F.sum("n").alias("n"), F.sum("d").alias("docs"))


def coverage(freq: DataFrame, shares: dict[str, float], n: str = "n") -> DataFrame:
    """How many of the most frequent types cover each share of all occurrences.

    Works on the histogram of counts, which has at most about sqrt(2 * total)
    rows, so the running sum never sees the vocabulary.
    """
    hist = freq.groupBy(n).agg(F.count("*").alias("types"))
    before = Window.orderBy(F.desc(n)).rowsBetween(Window.unboundedPreceding, -1)
    run = hist.select(n, "types", F.coalesce(F.sum(F.col(n) * F.col("types")).over(before), F.lit(0)).alias("mass"), F.coalesce(F.sum("types").over(before), F.lit(0)).alias("rank"), F.sum(F.col(n) * F.col("types")).over(Window.partitionBy()).alias("total"))
    out = [F.max(F.when(F.col("mass") < share * F.col("total"), F.col("rank") + F.least(F.col("types"), F.ceil((share * F.col("total") - F.col("mass")) / F.col(n))))).alias(k) for k, share in shares.items()]
    return run.agg(*out)


def top(df: DataFrame, k: int, n: str, *ties: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The k rows of largest n (per group, if by is given); ties to the smaller values of ties."""
    order = [F.desc(n), *map(F.asc, ties)]
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def ngrams(df: DataFrame, tokens: str, n: int) -> DataFrame:
    """(order, gram, n) for orders 1 to n, with n-1 begin marks and one end mark.

    Only the longest order is counted over the rows.  Each token ends one gram
    of every order, so shorter ones are sums over the distinct longer ones; the
    begin marks alone are added from the number of rows.
    """
    padded = df.select(F.concat(F.array_repeat(F.lit(BEGIN), n - 1), F.col(tokens), F.array(F.lit(END))).alias("p"))
    size = F.size("p") - (n - 1)
    shifted = [F.slice("p", F.lit(k + 1), size).alias(f"w{k}") for k in range(n)]
    longest = padded.select(F.inline(F.arrays_zip(*shifted))).groupBy(*[f"w{k}" for k in range(n)]).agg(F.count("*").alias("n"))
    out, rows = None, df.agg(F.count("*").alias("rows"))
    for order in range(n, 0, -1):
        names = [f"w{k}" for k in range(n - order, n)]
        now = longest if order == n else longest.groupBy(*names).agg(F.sum("n").alias("n"))
        now = now.select(F.lit(order).alias("order"), F.concat_ws(" ", *names).alias("gram"), "n")
        if order < n:  # grams that end before the first token
            now = now.unionByName(rows.where("rows > 0").select(F.lit(order).alias("order"), F.lit(" ".join([BEGIN] * order)).alias("gram"), (F.col("rows") * (n - order)).alias("n")))
        out = now if out is None else out.unionByName(now)
    return out


def window_pairs(df: DataFrame, tokens: str, reach: int) -> DataFrame:
    """(row columns, centre, context, distance) of tokens at most reach apart, made inside the row: size * 2 * reach pairs at most."""
    keep = [c for c in df.columns if c != tokens]
    t, size = F.col(tokens), F.size(tokens)

    def apart(d: int) -> Column:
        left, right = F.slice(t, F.lit(1), size - d), F.slice(t, F.lit(d + 1), size - d)
        pair = lambda a, b: F.struct(a.alias("centre"), b.alias("context"), F.lit(d).alias("distance"))
        both = F.flatten(F.zip_with(left, right, lambda a, b: F.array(pair(a, b), pair(b, a))))
        return F.when(size > d, both).otherwise(F.array().cast("array<struct<centre:string,context:string,distance:int>>"))

    return df.select(*keep, F.inline(F.concat(*[apart(d) for d in range(1, reach + 1)])))


def contexts(df: DataFrame, tokens: str, reach: int) -> DataFrame:
    """(row columns, i, centre, context): for each token the list of those at most reach places away, without itself."""
    keep = [c for c in df.columns if c != tokens]
    t = F.col(tokens)
    around = F.transform(t, lambda x, i: F.struct(i.alias("i"), x.alias("centre"), F.concat(F.slice(t, F.greatest(i - reach + 1, F.lit(1)), F.least(i, F.lit(reach))), F.slice(t, i + 2, F.lit(reach))).alias("context")))
    return df.select(*keep, F.inline(around))


def stream_blocks(df: DataFrame, order: str, tokens: str, size: int) -> DataFrame:
    """(block, tokens): blocks of ``size`` tokens over all rows' tokens in a row, in order; the tail is dropped.

    Places follow from token counts: rows are dealt to ranges of the order, the
    ranges' sums are added up in one small table, and each row's tokens go to
    the blocks that they fall into.
    """
    lengths = df.select(order, tokens, F.size(tokens).cast("long").alias("_n")).withColumn("_range", F.floor(F.col(order) / RANGE))
    sums = lengths.groupBy("_range").agg(F.sum("_n").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_range", offset.alias("_offset"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lengths.withColumn("_before", before).join(sums, "_range").where("_n > 0").withColumn("_at", F.col("_offset") + F.col("_before"))
    first, last = F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.col("_n") - 1) / size)
    parts = F.transform(F.sequence(first, last), lambda b: F.struct(b.alias("block"), F.greatest(F.col("_at"), b * size).alias("_start"), F.slice(tokens, (F.greatest(F.col("_at"), b * size) - F.col("_at") + 1).cast("int"), (F.least(F.col("_at") + F.col("_n"), (b + 1) * size) - F.greatest(F.col("_at"), b * size)).cast("int")).alias("_part")))
    blocks = placed.select("_total", F.inline(parts)).where((F.col("block") + 1) * size <= F.col("_total"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_part"))), lambda s: s["_part"]))
    return blocks.groupBy("block").agg(joined.alias("tokens"))


def cooccurrence(df: DataFrame, tokens: str, reach: int) -> DataFrame:
    """(centre, context, weight): symmetric sums of 1/distance within a row; a word beside itself counts from both sides.

    Each pair of places is met once, under its smaller word first, and the sums are mirrored.
    """
    t, size = F.col(tokens), F.size(tokens)

    def apart(d: int) -> Column:
        pairs = F.zip_with(F.slice(t, F.lit(1), size - d), F.slice(t, F.lit(d + 1), size - d), lambda a, b: F.struct(F.least(a, b).alias("centre"), F.greatest(a, b).alias("context"), F.lit(1.0 / d).alias("weight")))
        return F.when(size > d, pairs).otherwise(F.array().cast("array<struct<centre:string,context:string,weight:double>>"))

    half = df.select(F.inline(F.concat(*[apart(d) for d in range(1, reach + 1)]))).groupBy("centre", "context").agg(F.sum("weight").alias("weight"))
    same = F.col("centre") == F.col("context")
    one, other = F.struct("centre", "context", F.when(same, 2 * F.col("weight")).otherwise(F.col("weight")).alias("weight")), F.struct(F.col("context").alias("centre"), F.col("centre").alias("context"), "weight")
    return half.select(F.inline(F.when(same, F.array(one)).otherwise(F.array(one, other))))
