"""Importance resampling towards a target distribution of hashed n-grams.

A text's features are its runs of one to ``ORDER`` words; the bucket of a
feature is its CRC-32 modulo ``BUCKETS``.  The document-by-bucket count matrix
is sparse and persisted as compressed sparse rows: a row of the stored table is
a block of documents with the arrays ``start`` (where each document's entries
begin), ``bucket`` and ``n``.  Column sums of the corpus' matrix and of the
target's give two distributions, their ratio a gain for each bucket, and the
matrix times the gains the weights: both passes read blocks only, no text.

Gumbel noise from a hash of doc_id turns weights to scores whose order is a
draw without replacement.  Scores are whole numbers in a range that the gains
bound, so a histogram of scores (its size goes by that range) tells how many
documents are before each score; only the drawn part is shuffled, by score.

Edge cases: a null text counts as empty; a text without words has no features
and weight 0; very long texts are cut at blanks into parts whose counts add up;
rows that repeat stay apart, and equal rows take ranks one after the other; a
row without a doc_id has no noise, thus a null score, and is neither drawn nor
counted among those to draw from; ties of a doc_id with several texts go to the
smaller number of features, then the smaller weight; an empty target or corpus
has only the added one per bucket; an empty table gives an empty result;
additional columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunecorpus.llm.common import arrow_schema, cut, slices
from dunecorpus.operators.staging import remove, shared_folder

BUCKETS, ORDER = 10_000, 2
#: A document is drawn from those of at least so many words; the percentage drawn; the noise's seed.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of a text that are cut into words at once.
PART = 1 << 20
#: Equal rows that one generated array numbers.
RUN = 4096

# ASCII but letters and digits part words, A-Z are lower-cased, bytes of other characters stay
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))

#: A block holds documents up to so many entries (one document has at most an entry a bucket), as readers and writers
#: hold many blocks at a time; bytes of a row group for the same reason.
ENTRIES, GROUP_BYTES = 1 << 12, 16 << 20
BLOCK = "doc_id array<long>, n_words array<long>, start array<int>, bucket array<int>, n array<int>"


def parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in parts of bounded size."""
    text = text.translate(_WORDS)
    at = 0
    while at < len(text):
        to = text.find(b" ", at + PART)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def row_of(text: bytes, buckets: int = BUCKETS, order: int = ORDER) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, buckets in order, counts) of a text's features; a longer run's checksum goes on from that of its first words."""
    crc, n_words, found, before = zlib.crc32, 0, [], []
    for part in parts(text):
        n_words += len(part)
        words = before + part
        spaced = [b" " + w for w in words]
        sums = [crc(w) for w in words]
        hashes = sums[len(before) :]
        for j in range(2, order + 1):
            sums = [crc(w, c) for w, c in zip(spaced[j - 1 :], sums, strict=False)]
            hashes += sums[max(0, len(before) - j + 1) :]  # those that end in this part
        counts = np.bincount(np.array(hashes, np.int64) % buckets, minlength=buckets) if len(hashes) > buckets else None
        found.append(np.unique(np.array(hashes, np.int64) % buckets, return_counts=True) if counts is None else (np.flatnonzero(counts), counts[counts > 0]))
        if len(found) > 1:  # a further part of a long text
            dense = sum(np.bincount(b, n, buckets) for b, n in found).astype(np.int64)
            found = [(np.flatnonzero(dense), dense[dense > 0])]
        before = words[len(words) - order + 1 :] if order > 1 else []
    return n_words, *(found[0] if found else (np.empty(0, np.int64), np.empty(0, np.int64)))


def matrix(rows: DataFrame, folder: str, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """Persist the count matrix of ``rows`` (doc_id, text) as CSR blocks under ``folder`` and read it."""
    import pyarrow as pa

    schema = arrow_schema(BLOCK)

    def block_of(ids, found):
        start = np.cumsum([0, *(len(b) for _, b, _ in found)])
        block = [ids, [w for w, _, _ in found], start, np.concatenate([b for _, b, _ in found]), np.concatenate([n for _, _, n in found])]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(block, schema, strict=True)], schema=schema)

    def run(batches):
        for part in slices(batches):
            ids, found, held = [], [], 0
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc_id)
                found.append(row_of(text or b"", buckets, order))
                held += len(found[-1][1])
                if held >= ENTRIES:
                    yield block_of(ids, found)
                    ids, found, held = [], [], 0
            if ids:
                yield block_of(ids, found)

    rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK).write.option("parquet.block.size", GROUP_BYTES).parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket: each task adds up its blocks, so ``buckets`` numbers of a task are shuffled and as many reach the driver."""
    schema = arrow_schema("n array<long>")

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, n = (np.asarray(batch.column(c).flatten()) for c in ("bucket", "n"))
            np.add.at(total, bucket, n)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total], schema[0].type)], schema=schema)

    sums = blocks.select("bucket", "n").mapInArrow(run, "n array<long>").select(F.posexplode("n").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in sums:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 ln of the target's share over the corpus', one added to each count, rounded down."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the matrix times the gains, over the row's features."""
    shipped = blocks.sparkSession.sparkContext.broadcast(gain)
    found = "doc_id long, n_words long, n_features long, weight long"
    schema = arrow_schema(found)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                start, bucket, n = (np.asarray(batch.column(c)[i].values) for c in ("start", "bucket", "n"))
                ends = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum([n * shipped.value[bucket], n], 1, np.int64)], 1)[:, start]
                total, features = np.diff(ends)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i].values, batch.column("n_words")[i].values, pa.array(features), pa.array(total // np.maximum(features, 1))], schema=schema)

    return blocks.mapInArrow(run, found)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise from doc_id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, weight, score; materialised) with the ``rank`` of the drawn rows.

    The histogram's rows reach the driver: at most as many as there are whole
    numbers between the least and the largest score.
    """
    own = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    hist = sorted(((r["score"], r["count"]) for r in scored.where(own).groupBy("score").count().collect()), reverse=True)
    left = percent * sum(n for _, n in hist) // 100
    out = ["doc_id", "n_features", "weight", "score"]
    before, at = [], 0
    for score, n in hist:
        if at >= left:
            break
        before.append((score, at))
        at += n
    rest = F.lit(None).cast("long").alias("rank")
    if not before:
        return scored.select(*out, rest)
    drawn = own & (F.col("score") >= before[-1][0])
    # rows that are equal count as one on the way; a score's groups are numbered in one task, its rows nowhere gathered
    groups = scored.where(drawn).groupBy(*out).agg(F.count("*").alias("copies"))
    offsets = F.broadcast(scored.sparkSession.createDataFrame(before, "score long, at long"))
    order = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.join(offsets, "score").withColumn("first", F.col("at") + F.sum("copies").over(order) - F.col("copies"))
    runs = groups.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN).cast("int"))))
    upto = F.least(F.col("copies") - 1, F.col("run").cast("long") * RUN + RUN - 1)
    ranked = runs.select(*out, "first", F.explode(F.sequence(F.col("run").cast("long") * RUN, upto)).alias("i")).withColumn("rank", F.col("first") + F.col("i") + 1)
    return ranked.select(*out, F.when(F.col("rank") <= left, F.col("rank")).alias("rank")).unionByName(scored.where(~drawn).select(*out, rest))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, for the distribution of the texts of ``target``."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    blocks = matrix(docs, f"{folder}/corpus")
    goal = column_sums(matrix(target.select(F.lit(0).alias("doc_id"), "text"), f"{folder}/target"))
    found = weights(blocks, gains(column_sums(blocks), goal))
    scored = cut(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"))))
    remove(spark, folder)  # all that follows reads the scores
    return draw(scored)
