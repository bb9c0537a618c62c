"""A linear classifier on hashed bags of words and word pairs, trained by full-batch gradient steps."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunecorpus.operators.staging import cut

#: Buckets, words of a text that count, and buckets whose sums travel as one row.
BUCKETS, WORDS, BLOCK = 200_000, 256, 4096


def bag(words: list[str]) -> tuple[list[int], list[float]]:
    """(buckets, shares) of a text's first words and their pairs; a text without words has the bucket of the empty word."""
    words = words[:WORDS]
    tags = [f"UNI:{w}" for w in words] + [f"BI:{a} {b}" for a, b in zip(words, words[1:], strict=False)] or ["UNI:"]
    found, n = np.unique([zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in tags], return_counts=True)
    return found.tolist(), (n / len(tags)).tolist()


def bags(df: DataFrame, keep: list[str], tokens: Column) -> DataFrame:
    """(keep, bucket, share): the averaged bag of each row; a null list counts as empty."""
    import pyarrow as pa

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    first = F.slice(F.coalesce(tokens, F.array().cast("array<string>")), 1, WORDS).alias("_words")

    def run(batches):
        for batch in batches:
            found = [bag(w) for w in batch.column(batch.num_columns - 1).to_pylist()]
            own = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64()))], names=[*keep, "bucket", "share"])

    return df.select(*keep, first).mapInArrow(run, f"{kept}, bucket array<int>, share array<double>")


def chances(weights: np.ndarray, buckets, starts, shares) -> np.ndarray:
    """Class chances of bags that lie one after the other."""
    z = np.add.reduceat(weights[buckets] * shares[:, None], starts, 0)
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _flat(batch):
    bucket, share = batch.column("bucket"), batch.column("share")
    ends = np.asarray(bucket.offsets)
    return np.asarray(bucket.values)[ends[0] : ends[-1]], (ends[:-1] - ends[0]), np.asarray(share.values)[ends[0] : ends[-1]]


@dataclass
class Hashed:
    classes: list
    weights: np.ndarray
    losses: list[float]


def _gradient(rows: DataFrame, weights: np.ndarray, classes: int) -> tuple[float, np.ndarray]:
    """(loss, gradient), both summed over all rows.

    A tree: each task adds up its rows, blocks of buckets are added up over the
    tasks, and one row a block reaches the driver: ``BUCKETS`` times the classes
    in all, whatever the number of rows.
    """
    import pyarrow as pa

    shipped = rows.sparkSession.sparkContext.broadcast(weights)
    schema = "block int, g array<double>"

    def run(batches):
        total, loss = np.zeros((BUCKETS, classes)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets, starts, shares = _flat(batch)
            y = np.asarray(batch.column("y"))
            p = chances(shipped.value, buckets, starts, shares)
            loss -= float(np.log(p[np.arange(len(y)), y]).sum())
            p[np.arange(len(y)), y] -= 1
            np.add.at(total, buckets, np.repeat(p, np.diff(np.append(starts, len(buckets))), 0) * shares[:, None])
        blocks = [(-1, [loss])] + [(b, total[b * BLOCK : (b + 1) * BLOCK].ravel()) for b in range(-(-BUCKETS // BLOCK)) if total[b * BLOCK : (b + 1) * BLOCK].any()]
        for b, g in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([g], pa.list_(pa.float64()))], names=["block", "g"])

    def add(table):
        g = table.column("g").combine_chunks()
        summed = np.asarray(g.flatten()).reshape(len(g), -1).sum(0)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "g": pa.array([summed], pa.list_(pa.float64()))})

    out, loss = np.zeros((BUCKETS, classes)), 0.0
    for r in rows.mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).toArrow().to_batches():
        for b, g in zip(r.column("block").to_pylist(), r.column("g"), strict=True):
            if b < 0:
                loss = g.values[0].as_py()
            else:
                part = np.asarray(g.values).reshape(-1, classes)
                out[b * BLOCK : b * BLOCK + len(part)] = part
    shipped.unpersist()
    return loss, out


def fit(df: DataFrame, label: str, tokens: Column, steps: int = 25, rate: float = 0.5) -> Hashed:
    """Multinomial logistic regression over the averaged bags by ``steps`` Adam steps on the mean loss, from zero weights.

    Rows without a label are left out; classes are in their order.
    """
    known = df.where(F.col(label).isNotNull())
    classes = sorted(r[0] for r in known.select(label).distinct().collect())  # the model's few classes
    names = F.array(*[F.lit(c) for c in classes])
    if not classes:
        return Hashed([], np.zeros((BUCKETS, 0)), [])
    rows = cut(bags(known.withColumn("y", (F.array_position(names, F.col(label)) - 1).cast("int")), ["y"], tokens))
    n = rows.count()
    w, m, v, losses = np.zeros((BUCKETS, len(classes))), 0.0, 0.0, []
    for t in range(1, steps + 1):
        loss, g = _gradient(rows, w, len(classes))
        losses.append(loss / n)
        g /= n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Hashed(classes, w, losses)


def predict(df: DataFrame, keep: list[str], tokens: Column, model: Hashed) -> DataFrame:
    """(keep, predicted, chance): the likeliest class of each row, ties to the first."""
    import pyarrow as pa

    found = bags(df, keep, tokens)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    kind = pa.string() if isinstance(model.classes[0], str) else pa.int64()
    shipped = df.sparkSession.sparkContext.broadcast((model.weights, model.classes))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                weights, classes = shipped.value
                p = chances(weights, *_flat(batch))
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array([classes[i] for i in best], kind), pa.array(p[np.arange(len(best)), best])], names=[*keep, "predicted", "chance"])

    return found.mapInArrow(run, f"{kept}, predicted {'string' if pa.types.is_string(kind) else 'long'}, chance double")
