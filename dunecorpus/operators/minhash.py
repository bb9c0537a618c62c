"""Near duplicates on character shingles: a banded index of minimum hashes, walked greedily in order.

A text is a duplicate if a band of its signature equals one of a text that was
kept before it; only kept texts enter the index.  The walk is resolved in
rounds without pairs: an undecided text that is the first of all its bands is
kept, and takes all others of these bands out.  Bands of one text, and what is
decided, leave the postings, so each round joins what is left.  The
index is a table of band keys of kept texts, so it can be stored and a later
batch walked against it.  Pairs are not verified; :func:`chance_met` tells how
many of a similarity share a band.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunecorpus.functions import text as cleaning
from dunecorpus.operators.staging import cut

HASHES, THRESHOLD = 128, 0.8


def banding(threshold: float, hashes: int, steps: int = 400) -> tuple[int, int]:
    """(bands, rows) whose chance curve errs least, false and missed pairs weighing the same."""
    s = (np.arange(steps) + 0.5) / steps
    best = None
    for bands in range(1, hashes + 1):
        for rows in range(1, hashes // bands + 1):
            met = 1 - (1 - s**rows) ** bands
            error = float(np.where(s < threshold, met, 1 - met).sum())
            if best is None or error < best[0]:
                best = (error, bands, rows)
    return best[1], best[2]


BANDS, ROWS = banding(THRESHOLD, HASHES)
_rng = np.random.RandomState(1)
# multiply and shift: the upper half of a 64-bit product
_A = _rng.randint(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.randint(0, 1 << 63, HASHES, np.uint64)


def chance_met(similarity: float) -> float:
    """The chance that two texts of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**ROWS) ** BANDS


#: Odd multipliers that place a shingle's four characters in a 64-bit hash.
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def shingle_hashes(t: str) -> np.ndarray:
    """31-bit hashes of the distinct four-character windows; a shorter text is one window."""
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    c = np.concatenate([c, np.zeros(max(0, 4 - len(c)), np.uint64)])
    h = sum((c[i : len(c) - 3 + i] * _MIX[i] for i in range(1, 4)), c[: len(c) - 3] * _MIX[0])
    h ^= h >> np.uint64(31)
    h *= _MIX[1]
    return np.unique(h >> np.uint64(33))


def _signature(t: str) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    if not t:
        return out
    x = shingle_hashes(t)
    for i in range(0, len(x), 256):
        out = np.minimum(out, ((x[i : i + 256, None] * _A + _B) >> np.uint64(32)).min(0))
    return out


def band_keys(s: np.ndarray) -> list[str]:
    return [f"{b}:{s[b * ROWS : b * ROWS + ROWS].tobytes().hex()}" for b in range(BANDS)]


@F.pandas_udf(T.StructType().add("digest", T.StringType()).add("bands", T.ArrayType(T.StringType())))
def _sign(texts: pd.Series) -> pd.DataFrame:
    import xxhash

    rows = []
    for t in texts:
        s = _signature(t or "").astype(np.int64)
        keys = [xxhash.xxh3_128_hexdigest(k) for k in band_keys(s)] if t else []
        rows.append(("".join(f"{v:08x}" for v in s[:8]), keys))
    return pd.DataFrame(rows, columns=["digest", "bands"])


def signatures(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, digest, bands); a null text counts as empty, and an empty one is like no other: it has no bands."""
    return df.select(id_column, _sign(cleaning.shingle_form(F.coalesce(text, F.lit("")))).alias("s")).select(id_column, "s.*")


def walk(signed: DataFrame, id_column: str, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, duplicate) of all rows, in the order of their ids; (band) keys of the kept ones) against an index (band)."""
    rows = cut(signed.select(F.col(id_column).alias("id"), "bands"))
    posted = rows.select("id", F.explode("bands").alias("band"))
    gone = None
    if index is not None:
        gone = cut(posted.join(index.select("band").distinct(), "band", "left_semi").select("id").distinct())
    left = posted if gone is None else posted.join(gone, "id", "left_anti")
    while True:
        firsts = left.groupBy("band").agg(F.min("id").alias("first"), F.count("*").alias("many")).where("many > 1").select("band", "first")
        now = cut(left.join(firsts, "band"))  # bands that still hold several
        if now.isEmpty():
            break
        kept = cut(now.groupBy("id").agg(F.bool_and(F.col("id") == F.col("first")).alias("kept")).where("kept").select(F.col("id").alias("first")))
        out = cut(now.join(kept, "first").where("id <> first").select("id").distinct())
        gone = out if gone is None else gone.unionByName(out)
        left = now.select("id", "band").join(kept.select(F.col("first").alias("id")).unionByName(out), "id", "left_anti")
    marked = rows.select("id").withColumn("duplicate", F.lit(False)) if gone is None else cut(rows.select("id").join(gone.withColumn("_gone", F.lit(True)), "id", "left").select("id", F.col("_gone").isNotNull().alias("duplicate")))
    return marked, posted.join(marked.where("not duplicate").select("id"), "id").select("band")


def duplicates(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, duplicate) of a table walked on its own."""
    return walk(signatures(df, id_column, text), id_column)[0]


def walk_batch(df: DataFrame, id_column: str, text: str, path: str, batch: int) -> DataFrame:
    """(id, duplicate) of a batch against the index stored under ``path``; what is kept joins it as batch number ``batch``.

    A batch that runs again overwrites its own part and doesn't see it.
    """
    spark = df.sparkSession
    stored = spark.read.schema("band string, batch int").parquet(path).where(F.col("batch") < batch) if batch > 0 else None
    found, kept = walk(signatures(df, id_column, text), id_column, stored)
    kept.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return found
