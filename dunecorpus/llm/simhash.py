"""SimHash fingerprints and permuted block tables.

A text's terms are its pairs of neighbouring ``\\w+`` words, lower-cased (a
text of one word is one term).  Each term's 64-bit hash votes on the 64 signed
bits with weight 1 + ln(count); a fingerprint has the bits whose votes are
positive.

All pairs within ``RADIUS`` bits: the 64 bits are parted into ``BLOCKS``
blocks.  Fingerprints at most ``RADIUS`` bits apart agree on at least
``BLOCKS - RADIUS`` of them, so a table for each choice of that many blocks,
keyed by their bits, puts every such pair in a bucket together.  Equal
fingerprints meet once.  Large buckets are split into blocks of rows that meet
two by two, and a pair is counted only in the first table that holds it.

Edge cases: a null text counts as empty and has fingerprint 0; equal texts have
equal fingerprints; additional columns are ignored; rows that repeat are
documents of their own, in the order of a hash of their texts where they share a
doc_id; a table of one row has itself as the next document; an empty table
gives no rows.  Very long texts are read whole, one at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunecorpus.llm.common import Hashes, arrow_schema, block_pairs, blocks_of, cut, ngram_hashes, slices, worker_cache
from dunecorpus.operators.staging import shared_folder, stored

WORD = re.compile(r"\w+")
BITS, RADIUS, BLOCKS = 64, 3, 6
BLOCK_ROWS = 192
#: Rows that one range of neighbouring documents holds, about.
RANGE_ROWS, MOST_RANGES = 1200, 20_000


def fingerprint(text: str) -> int:
    terms = ngram_hashes(WORD.findall(text.lower()), 2, worker_cache("words", Hashes))
    if not len(terms):
        return 0
    terms, counts = np.unique(terms, return_counts=True)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(terms), 1 << 15):
        bits = np.unpackbits(terms[at : at + (1 << 15)].view(np.uint8)).reshape(-1, BITS)
        weight = 1 + np.log(counts[at : at + (1 << 15)])
        votes += 2 * (weight @ bits) - weight.sum()
    return int(np.packbits(votes > 0).view(">u8")[0])


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _with_neighbours(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text, ghost): rows by ranges of doc_id, each range with the next document after its last.

    The texts are read and shuffled once; ids alone decide the ranges.  The rows
    of a range's largest id go to the range above as well, as ghosts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id").where("doc_id is not null")
    n = ids.count()
    k = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds = sorted({int(x) for x in ids.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / k for i in range(1, k)], 0.2 / k)}) if k > 1 else []
    # range 0 holds rows without doc_id, then ranges go upwards
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(F.lit(1) + _rank(F.col("doc_id"), bounds)).cast("int")
    tops = docs.select(own.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()  # a row for each range
    if not tops:
        return docs.select(F.lit(0).alias("part"), "doc_id", "text", F.lit(False).alias("ghost"))
    parts = [r["part"] for r in tops]
    ends = [(r["part"], parts[(i + 1) % len(parts)], r["top"]) for i, r in enumerate(tops)]
    small = docs.sparkSession.createDataFrame(ends, "part int, above int, top long")
    placed = docs.withColumn("part", own).join(F.broadcast(small), "part")
    here, there = (F.struct(F.col(c).alias("part"), F.lit(ghost).alias("ghost")) for c, ghost in (("part", False), ("above", True)))
    spots = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(here, there)).otherwise(F.array(here)))
    return placed.select("doc_id", "text", spots.alias("spot")).select("spot.part", "doc_id", "text", "spot.ghost")


def _rank(x, bounds: list[int]):
    """How many bounds are at or below x, by bisection of a literal array."""
    if not bounds:
        return F.lit(0)
    known, low, high = F.lit(bounds).cast("array<long>"), F.lit(0), F.lit(len(bounds))

    def halve(s, _):
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        up = F.coalesce(F.get(known, mid) <= x, F.lit(False)) & (s["low"] < s["high"])
        return F.struct(F.when(up, mid + 1).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(mid).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), F.struct(low.alias("low"), high.alias("high")), halve)["low"]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bits long"


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every document: its fingerprint, its edited text's digest and fingerprint, and the next document's fingerprint.

    The next document is that of the next smaller doc_id, ties by a hash of the
    text; rows without doc_id come last; after the last comes the first.
    """
    placed = _with_neighbours(docs)
    arrow = arrow_schema(SCHEMA)

    def run(batches):
        import pyarrow as pa

        def rows():
            for some in slices(batches):
                yield from zip(*[some.column(c).to_pylist() for c in ("part", "doc_id", "text", "ghost")], strict=True)

        def frame(found: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow.types, strict=True)], schema=arrow)

        out: list[tuple] = []
        before = None  # the row above: (part, doc_id, text, fingerprint)

        def done(row, following: str, next_print: int):
            _, doc_id, text, own = row
            new = edited(text, following)
            other = fingerprint(new)
            return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), f"{own:016x}", f"{other:016x}", likeness(own, other), likeness(own, next_print), own - (1 << 64) if own >> 63 else own)

        for part, doc_id, text, ghost in rows():
            now = (part, doc_id, text, fingerprint(text))
            if before is not None and before[0] == part:
                out.append(done(before, text, now[3]))
            before = None if ghost else now
            if len(out) >= 2000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    order = [F.col("part"), F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    return placed.repartition("part").sortWithinPartitions(*order).select("part", "doc_id", "text", "ghost").mapInArrow(run, SCHEMA)


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits that each table is keyed by, as signed 64-bit masks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    out = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(bits, near): for each fingerprint, how many other documents are within ``radius`` bits."""
    tables = masks(blocks, radius)
    unsigned = np.array(tables, np.int64).view(np.uint64)
    groups = cut(prints.groupBy("bits").agg(F.count("*").alias("copies")))
    keyed = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)]))
    posted = groups.select("bits", "copies", keyed.alias("k")).select("bits", "copies", "k.table", "k.key")
    buckets = cut(posted.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"))
    members = posted.join(buckets.select("table", "key", blocks_of(F.col("n"), BLOCK_ROWS).alias("n_blocks")), ["table", "key"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        table, lo, hi = (int(pdf[c].iloc[0]) for c in ("table", "lo", "hi"))
        bits, side, copies = pdf["bits"].to_numpy().view(np.uint64), pdf["side"].to_numpy(), pdf["copies"].to_numpy()
        differ = bits[:, None] ^ bits[None, :]
        near = np.bitwise_count(differ) <= radius
        np.fill_diagonal(near, False)
        if lo != hi:
            near &= side[:, None] != side[None, :]
        for earlier in unsigned[:table]:
            near &= (differ & earlier) != 0
        total = (near * copies[None, :]).sum(1)
        keep = total > 0
        return pd.DataFrame({"bits": bits[keep].view(np.int64), "near": total[keep]})

    found = block_pairs(members, ["table", "key"], "bits", "n_blocks").groupBy("table", "key", "lo", "hi").applyInPandas(count, "bits long, near long")
    total = cut(found.groupBy("bits").agg(F.sum("near").alias("near")))
    return cut(groups.join(total, "bits", "left").select("bits", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("near")))


def near_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns, and ``n_near``: other documents within ``RADIUS`` bits."""
    # the texts' shuffle, which is over the input's bytes, goes before the pairs are sought
    prints = stored(fingerprints(docs), f"{shared_folder(docs.sparkSession)}/fingerprints-{uuid.uuid4().hex}")
    near = near_counts(prints.select("bits"))
    return prints.join(near.withColumnRenamed("near", "n_near"), "bits").drop("bits")
