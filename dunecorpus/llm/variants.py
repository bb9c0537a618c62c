"""Spelling variant grouping: words one edit apart, each led to its most frequent form.

Words and their counts come from all texts.  Near words are found with a
positional q-gram inverted index in two levels:

* **Routing.**  One edit leaves one of a word's two disjoint halves whole, so
  each word is posted under (length, which half, its letters), and looks up the
  halves that a word of its own length or one letter less would have in common
  with it.  These are two long positional grams a word; a posting list that
  holds over ``BLOCK`` words is cut into blocks that meet the parts of its
  lookups in tasks of their own.
* **Merging.**  Within a list the words are indexed by positional bigrams, edges
  included.  An edit spoils at most two of them, so of the n + 1 bigrams of the
  longer word n - 1 must be shared (the overlap bound), each at its place or, after
  a lost letter, one before.  A candidate must hence stand in one of the three
  shortest lists: these are heap-merged, the others are probed by bisection until
  the bound is met or out of reach.  Candidates above the bound are verified.

Lists are streamed from partitions sorted by list: a task holds one block's
index at a time.  The root of a word follows forms by pointer doubling; counts
at least double along a chain, so few rounds settle it.

Edge cases: a null text holds no words; a row without a doc_id spoils no run;
rows repeat as often as in the input; very long texts and words are read whole;
ties of frequency go to the word that is smaller in code-point order; an empty
table gives an empty result; additional columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunecorpus.llm.common import arrow_schema, cut, slices, small_or_shuffled

#: One in so many (document, word) pairs loses a letter; the shortest word, the fewest occurrences; how much more frequent a form is.
SPOILT, SHORTEST, LEAST, TIMES = 97, 5, 3, 2
#: Words of a posting list that are indexed at once, and distinct words that a task holds while it counts.
BLOCK, HELD = 4096, 400_000

_RUN = re.compile(rf"[a-zÀ-ÿ]{{{SHORTEST},}}")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(doc_id: int | None, text: bytes) -> Counter:
    """The words of a text with their counts, spoilt as the rule says."""
    found = Counter(map(itemgetter(0), _RUN.finditer(text.translate(_LOWER).decode("utf-8", "replace"))))
    if doc_id is None:
        return found
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for w, n in found.items():
        h = zlib.crc32(w.encode(), start)
        if h % SPOILT == 0:
            w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) < SHORTEST:
                continue
        out[w] += n
    return out


def count_words(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n) of all words with at least ``least`` occurrences; each task adds up what it can hold before the shuffle."""
    import pyarrow as pa

    schema = arrow_schema("word string, n long")

    def run(batches):
        held: Counter = Counter()

        def flush():
            every = list(held.items())
            for at in range(0, len(every), 50_000):
                some = every[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], schema=schema)
            held.clear()

        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.update(words_of(doc_id, text or b""))
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Index:
    """Words of one length, by positional bigrams."""

    def __init__(self):
        self.words: list[tuple[str, int]] = []
        self.lists: dict[tuple[str, int], list[int]] = {}

    def add(self, word: str, n: int) -> None:
        me, edged = len(self.words), f"\0{word}\0"
        self.words.append((word, n))
        for i in range(len(word) + 1):
            self.lists.setdefault((edged[i : i + 2], i), []).append(me)

    def near(self, word: str, shift: int) -> list[tuple[str, int]]:
        """The words (with counts) one edit from ``word``, which has ``shift`` letters (0 or 1) more than they."""
        edged, none = f"\0{word}\0", []
        merged = []
        for i in range(len(word) + 1):
            lists = [self.lists.get((edged[i : i + 2], i - d), none) for d in range(shift + 1)]
            merged.append((sum(map(len, lists)), lists))
        merged.sort(key=itemgetter(0))
        found, last = [], -1
        for at in heapq.merge(*[x for _, lists in merged[:3] for x in lists]):
            if at == last:
                continue
            last, spared = at, 2  # bigrams that may lack
            for size, lists in merged:
                if not (size and any(_holds(x, at) for x in lists)):
                    spared -= 1
                    if spared < 0:
                        break
            if spared >= 0 and one_edit(word, self.words[at][0]):
                found.append(self.words[at])
        return found


def _holds(postings: list[int], at: int) -> bool:
    i = bisect_left(postings, at)
    return i < len(postings) and postings[i] == at


def one_edit(long: str, short: str) -> bool:
    """Whether ``short``, as long as ``long`` or a letter less, differs by exactly one edit."""
    shift = len(long) - len(short)
    i = next((i for i, (a, b) in enumerate(zip(long, short, strict=False)) if a != b), len(short))
    return (shift == 1 or i < len(long)) and long[i + 1 :] == short[i + 1 - shift :]


def _keys(length: Column, word: Column) -> list[Column]:
    """The lists of a word's two halves, were it of ``length``; a longer word's halves end at its ends."""
    half = F.floor(length / 2).cast("int")
    return [F.xxhash64(length, F.lit(side), F.substring(word, 1, half) if side == 0 else F.substring(word, F.length(word) - half + 1, half)) for side in (0, 1)]


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every word of ``words`` (word, n; materialised) with each of its near words."""
    own, less = F.length("word"), F.length("word") - 1
    posted = words.select("word", "n", F.explode(F.array(*[F.struct(k.alias("key"), F.lit(s).alias("side")) for s, k in enumerate(_keys(own, F.col("word")))])).alias("x")).select("x.key", "x.side", own.alias("size"), "word", "n")
    sought = [F.struct(k.alias("key"), F.lit(s).alias("side"), size.alias("size")) for size in (own, less) for s, k in enumerate(_keys(size, F.col("word")))]
    looks = words.select("word", "n", F.explode(F.array(*sought)).alias("x")).where(F.col("x.size") >= SHORTEST).select("x.key", "x.side", "x.size", "word", "n")
    large = cut(posted.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    of = F.pmod(F.xxhash64("word", F.lit(11)), blocks.cast("long")).cast("int")
    each = F.explode(F.sequence(F.lit(0), blocks - 1))
    large = small_or_shuffled(large)
    left = posted.join(large, "key", "left").withColumn("block", of).withColumn("part", each).withColumn("look", F.lit(False))
    right = looks.join(large, "key", "left").withColumn("part", of).withColumn("block", each).withColumn("look", F.lit(True))
    cells = left.unionByName(right).select("key", "size", "side", "block", "part", "look", "word", "n")
    place = ["key", "size", "side", "block", "part"]
    cells = cells.repartition(*place).sortWithinPartitions(*place, "look")
    found = "word string, near string, near_n long"
    schema = arrow_schema(found)

    def run(batches):
        import pyarrow as pa

        now, index = None, None
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for *cell, look, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if cell != now:
                    now, index = cell, Index()
                if not look:
                    index.add(word, n)
                    continue
                _, size, side, *_ = cell
                shift, half = len(word) - size, size // 2
                for other, m in index.near(word, shift) if index.words else ():
                    if (word[:half] == other[:half]) == bool(side):
                        continue  # a pair counts in the list of their first halves, if those are equal
                    out.append((word, other, m))
                    if shift:
                        out.append((other, word, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return cells.mapInArrow(run, found)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer doubling over (word, form)."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = cut(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return now


def group(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = cut(count_words(docs))
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= TIMES * F.col("n")
    known = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    found = roots(known.where("form is not null"))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
