"""N-gram Jaccard join by MinHash banding.

Texts are lower-cased and read as ``\\w+`` words; a text's set holds its word
five-grams (a shorter text is one n-gram).  Texts with the same words in the
same order are copies and meet once, through one representative: the row of
the smallest doc_id, then of the smallest hash of the text.  Representatives
whose MinHash bands agree meet in a band's bucket and are compared on their
full n-gram sets.  Rows and bands are chosen together (:func:`banding`).

Large buckets are split into blocks, and every two blocks meet in a task of
their own, so no bucket is gathered whole.  A pair that shares several buckets
is counted in the first of them only.

Edge cases: a null text counts as empty; texts without any word are copies if
they are equal as strings and have no further links; repeated rows are copies
of each other; rows that repeat a doc_id with another text are documents of
their own, and classes whose smallest doc_id is the same have the same
class_id; rows with a null doc_id are dropped, as nothing can name them;
additional columns are ignored; an empty table gives an empty result.  Very
long texts are read whole and alone (``common.slices``), and share a block
with fewer others (``BLOCK_NGRAMS``).  A pair of exactly the threshold is a
link; the representative of a class is the smallest, so there are no ties.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunecorpus.llm.common import Hashes, arrow_schema, block_pairs, blocks_of, components, cut, ngram_hashes, over_texts, slices, small_or_shuffled, texts, worker_cache

WORD = re.compile(r"\w+")
NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: The most hash functions of a signature: what bounds its cost.
HASHES = 200
BLOCK_DOCS, BLOCK_NGRAMS = 256, 400_000
#: Texts whose signature a worker keeps, for copies; and representatives that a task remembers to have read.
KEPT, REMEMBERED = 20_000, 200_000


def band_count(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands that find a pair of just ``threshold`` with probability ``recall``."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


def banding(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the steepest banding of that recall with at most ``hashes`` hash functions.

    More rows let fewer pairs below the threshold meet, and need more bands.
    """
    rows = 1
    while (rows + 1) * band_count(threshold, recall, rows + 1) <= hashes:
        rows += 1
    return band_count(threshold, recall, rows), rows


def minhash(grams: np.ndarray, turns: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the n-grams; chunks stay in the processor's cache."""
    half = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    out = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(half), 256):
        part = half[at : at + 256, None] ^ turns
        part *= factors
        np.minimum(out, part.min(0), out=out)
    return out


def band_keys(grams: np.ndarray, turns: np.ndarray, factors: np.ndarray, rows: int) -> np.ndarray:
    sig = minhash(grams, turns, factors).reshape(-1, rows).astype(np.uint64)
    h = np.arange(len(sig), dtype=np.uint64) + np.uint64(1)
    for j in range(rows):
        h = h * np.uint64(0x9E3779B97F4A7C15) + sig[:, j]
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def hash_functions(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(what each hash function turns over, its odd factor)."""
    rng = np.random.default_rng(20)
    turns, factors = rng.integers(0, 1 << 32, (2, bands * rows), np.uint32)
    return turns, factors | np.uint32(1)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, h, k1, k2, n_grams, bands): a hash of the text, a 128-bit key of the word sequence, and the band keys."""
    turns, factors = hash_functions(bands, rows)

    def signature(text: str) -> tuple:
        import xxhash

        words = WORD.findall(text.lower())
        key = xxhash.xxh3_128_intdigest("\x1f".join(words) if words else "\x1e" + text)
        grams = np.unique(ngram_hashes(words, n, worker_cache("words", Hashes)))
        return (key >> 64) - (1 << 63), (key & ((1 << 64) - 1)) - (1 << 63), len(grams), band_keys(grams, turns, factors, rows) if len(grams) else np.empty(0, np.int64)

    known: dict[bytes, tuple] = {}

    def read(some: list[str]):
        import pyarrow as pa
        import xxhash

        out = []
        for text in some:
            own = xxhash.xxh3_128_digest(text)
            if own not in known:
                if len(known) >= KEPT:
                    known.clear()
                known[own] = signature(text)
            out.append(known[own])
        k1, k2, sizes, keys = zip(*out, strict=True)
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        return k1, k2, sizes, pa.ListArray.from_arrays(ends, np.concatenate(keys))

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return over_texts(named.withColumn("h", F.xxhash64("text")), ["doc_id", "h"], "k1 long, k2 long, n_grams long, bands array<long>", read)


def shared(owner: np.ndarray, value: np.ndarray, m: int) -> np.ndarray:
    """How many values every two of ``m`` owners share; an owner has a value once.  Works on chunks of bounded width."""
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    del order
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    column = np.cumsum(first) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    out, width = np.zeros((m, m)), 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, width), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        out += x @ x.T
    return out


def classes_of(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each one's connected class, by a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


FOUND = "rep long, h long, root long, root_h long, links long"


def verify_block(table, threshold: float, schema):
    """Count the links within one pair of blocks and name each member's local root."""
    import pyarrow as pa

    key, lo, hi = (table.column(c)[0].as_py() for c in ("bucket", "lo", "hi"))
    rep, h, side, copies = (table.column(c).to_numpy() for c in ("rep", "h", "side", "copies"))
    order = np.lexsort((h, rep))
    again = np.r_[False, (rep[order][1:] == rep[order][:-1]) & (h[order][1:] == h[order][:-1])]
    order = order[~again]  # a row that stands in the table more than once
    rep, h, side, copies = rep[order], h[order], side[order], copies[order]
    m = len(order)

    def flat(column: str, read) -> tuple[np.ndarray, np.ndarray]:
        parts = [read(table.column(column)[i]) for i in order.tolist()]
        return np.repeat(np.arange(m, dtype=np.int32), [len(x) for x in parts]), np.concatenate(parts)

    owner, grams = flat("grams", lambda x: np.frombuffer(x.as_buffer(), np.uint64))
    size = np.bincount(owner, minlength=m).astype(np.float64)
    both = shared(owner, grams, m)
    del owner, grams
    near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(near, False)
    if lo != hi:
        near &= side[:, None] != side[None, :]
    if near.any():  # a pair that an earlier bucket holds is counted there
        owner, bucket = flat("buckets", lambda x: np.asarray(x.as_py(), np.int64))
        early = bucket < key
        near &= shared(owner[early], bucket[early], m) == 0
    root, links = classes_of(near), near @ copies
    keep = links > 0
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (rep[keep], h[keep], rep[root][keep], h[root][keep], links[keep])], schema=schema)


def classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(the rows' signatures, the distinct word sequences): the latter have k1, k2, the representative, the class's, copies and n_links."""
    bands, rows = banding(threshold, recall)
    sig = cut(signatures(docs, n, bands, rows))
    reps = sig.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "h", "n_grams", "bands")).alias("r"), F.count("*").alias("copies"))
    reps = cut(reps.select("k1", "k2", F.col("r.doc_id").alias("rep"), F.col("r.h").alias("h"), "copies", F.col("r.n_grams").alias("n_grams"), F.col("r.bands").alias("bands")))
    met = reps.select(F.explode("bands").alias("bucket")).groupBy("bucket").count().where("count > 1").select("bucket")
    posted = cut(reps.select("rep", "h", "n_grams", F.explode("bands").alias("bucket")).join(met, "bucket"))
    same = [F.bit_xor(F.xxhash64("rep", "h", F.lit(seed))).alias(f"f{seed}") for seed in (1, 2)]
    buckets = posted.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_grams").alias("total"), *same)
    # buckets with just the same members would only repeat each other's pairs
    buckets = buckets.groupBy("n", "f1", "f2").agg(F.min("bucket").alias("bucket"), F.max("total").alias("total"))
    split = F.greatest(blocks_of(F.col("n"), BLOCK_DOCS), blocks_of(F.col("total"), BLOCK_NGRAMS)).alias("n_blocks")
    members = posted.join(buckets.select("bucket", split), "bucket").groupBy("rep", "h").agg(F.collect_list(F.struct("bucket", "n_blocks")).alias("posts"))
    members = cut(members.join(reps.select("rep", "h", "copies"), ["rep", "h"]))
    passed, schema = arrow_schema("rep long, h long, copies long, posts array<struct<bucket:long,n_blocks:int>>, grams binary"), arrow_schema(FOUND)

    def sets(batches):
        import pyarrow as pa

        seen: set[tuple] = set()
        for part in slices(batches):
            ids = list(zip(part.column("rep").to_pylist(), part.column("h").to_pylist(), strict=True))
            new = [i for i, x in enumerate(ids) if x not in seen and not (len(seen) < REMEMBERED and seen.add(x))]
            part = part.take(pa.array(new, pa.int64()))
            grams = [np.unique(ngram_hashes(WORD.findall(t.lower()), n, worker_cache("words", Hashes))).tobytes() for t in texts(part)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in passed.names[:-1]], pa.array(grams, pa.binary())], schema=passed)

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    chosen = named.join(small_or_shuffled(members, {"posts": 32}), ["rep", "h"]).select("rep", "h", "copies", "posts", "text")
    placed = chosen.mapInArrow(sets, "rep long, h long, copies long, posts array<struct<bucket:long,n_blocks:int>>, grams binary")
    placed = placed.select("rep", "h", "copies", F.col("posts.bucket").alias("buckets"), "grams", F.explode("posts").alias("p")).select("rep", "h", "copies", "buckets", "grams", "p.bucket", "p.n_blocks")
    placed = block_pairs(placed, ["bucket", "h"], "rep", "n_blocks")
    found = cut(placed.groupBy("bucket", "lo", "hi").applyInArrow(lambda table: verify_block(table, threshold, schema), FOUND))
    own, root = F.struct("rep", "h"), F.struct(F.col("root").alias("rep"), F.col("root_h").alias("h"))
    degree = found.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    labels = components(found.select(own.alias("a"), root.alias("b")).where("a <> b"))
    linked = degree.join(labels.select("v.rep", "v.h", "label"), ["rep", "h"], "left")
    known = reps.select("k1", "k2", "rep", "h", "copies").join(linked, ["rep", "h"], "left")
    return sig, cut(known.select("k1", "k2", "rep", "h", "copies", F.coalesce("label", own).alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))


def near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: (doc_id, class_id, n_links, copies).

    ``class_id`` is the smallest doc_id of the connected class; ``n_links``
    counts the other documents of similarity ``threshold`` or more, copies
    included; ``copies`` counts the rows with the same words.
    """
    sig, known = classes(docs, n, threshold, recall)
    return sig.select("doc_id", "k1", "k2").join(known, ["k1", "k2"]).select("doc_id", F.col("label.rep").alias("class_id"), "n_links", "copies")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without all but one of each class of near duplicates: the one of the smallest doc_id.

    Of rows that repeat both doc_id and text, the smallest by all columns stays.
    Rows without a doc_id can't be named and all stay.
    """
    sig, known = classes(docs, **options)
    kept = cut(known.where(F.col("label") == F.struct("rep", "h")).select(F.col("rep").alias("kept_id"), F.col("h").alias("kept_h")))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    out = docs.where("doc_id is not null").join(small_or_shuffled(kept), (F.col("doc_id").cast("long") == F.col("kept_id")) & (text == F.col("kept_h")), "left_semi")
    if sig.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():  # only then is a shuffle of the texts needed
        out = out.groupBy(F.col("doc_id").alias("kept_id"), text.alias("kept_h")).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return out.unionByName(docs.where("doc_id is null"))
