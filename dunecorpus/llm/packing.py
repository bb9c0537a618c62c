"""Packing token sequences by minimum bin slack.

A document is its token ids and an end id.  Its whole windows become sequences
of their own; what remains waits in a pool, counted by length.  When the pool
is full, windows are filled one after the other: a bitset holds the sums that
the waiting lengths can reach (bit ``s`` set: some multiset of lengths sums to
``s``), binary-splitting each length's count; the highest set bit not over the
window is the fill of least slack, and going back through the bitsets gives
the count of each length.  The longest waiting piece always takes part, so
none waits forever.

At a partition's end the pool is emptied; windows that it can't fill are cut
into pieces whose lengths are powers of two, which need no padding.  Packing needs no
shuffle: each task packs its own documents, with a pool of bounded size.
Sequence ids hold the partition number, so they are unique, and a task that
runs again gives the same rows.

Edge cases: a null text counts as empty and has the end id alone; a document
without doc_id is packed like any other; repeated rows are packed as often as
they come; additional columns are ignored; an empty table gives no pieces; a
very long text is encoded whole and cut at the windows' ends.  Pieces of equal
length are taken in the order in which they came.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict, deque

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunecorpus.llm.common import arrow_schema, slices, texts, worker_cache

WINDOW, END_ID, POOL = 4096, 2, 1024
#: Words whose ids a worker keeps.
WORDS = 700_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Texts of these characters alone need no Unicode composition, and lower-case and split alike in Python and in the tokenizer.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ɏ]*\Z")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = "0-9²³¹¼-¾"
# Fixed value: the tokenizer's own rule for words, for the characters of _PLAIN.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")


class Tokens:
    """word -> its ids as little-endian 32-bit bytes, filled by the tokenizer; bounded."""

    def __init__(self, path: str, most: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.ids: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)  # whether an id ends a word
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: list[str]) -> bool:
        """Encode new words in one call; each word's ids end at a final one.  False if the tokenizer parts them in another way."""
        ids = self.whole(" ".join(words))
        ends = (4 * (np.flatnonzero(self.final[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return False
        raw = ids.tobytes()
        for word, start, end in zip(words, [0, *ends], ends, strict=False):
            self.ids[word] = raw[start:end]
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        """The texts' ids: word by word where that is sure to be the same, else at once."""
        words: list = [None if "<|" in t or not _PLAIN.match(t) else _WORD.findall(t.lower()) for t in texts]
        parts: list = [None if ws is None else list(map(self.ids.get, ws)) for ws in words]
        lacking = [i for i, p in enumerate(parts) if p is not None and None in p]
        new = {w for i in lacking for w, p in zip(words[i], parts[i], strict=True) if p is None}
        if len(self.ids) + len(new) > self.most:
            self.ids.clear()
            new = set().union(*[words[i] for i in lacking])
        learnt = not new or self.learn(sorted(new))
        for i in lacking:
            parts[i] = map(self.ids.__getitem__, words[i]) if learnt else None
        return [self.whole(t).tobytes() if p is None else b"".join(p) for t, p in zip(texts, parts, strict=True)]


def fill(counts: dict[int, int], window: int, first: int) -> dict[int, int]:
    """How many pieces of each length fill ``window`` with the least slack, ``first`` among them."""
    room = window - first
    mask = (1 << (room + 1)) - 1
    reach, parts, trail = 1, [], []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        times = 1
        while left > 0 and not reach >> room & 1:
            times = min(times, left)
            trail.append(reach)
            parts.append((length, times))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
    total = reach.bit_length() - 1
    chosen: Counter[int] = Counter({first: 1})
    for (length, times), before in zip(reversed(parts), reversed(trail), strict=True):
        if not before >> total & 1:  # this sum needs the part
            chosen[length] += times
            total -= length * times
    return dict(chosen)


class Packer:
    """Packs a stream of documents; ``pieces`` collects finished rows."""

    def __init__(self, window: int, pool: int, sequence: int):
        self.window, self.pool, self.sequence = window, pool, sequence
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.count = 0
        self.pieces: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        for start in range(0, n, self.window):
            part = ids[start * 4 : (start + self.window) * 4]
            if len(part) == self.window * 4:
                self._emit(doc_id, start, part, n, 0)
                self.sequence += 1
            else:
                self.waiting[len(part) // 4].append((doc_id, start, part, n))
                self.count += 1
        while self.count > self.pool:
            self._window()

    def _emit(self, doc_id, start: int, part: bytes, n: int, offset: int) -> None:
        self.pieces.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, self.sequence, offset))

    def _take(self) -> list[tuple]:
        counts = {k: len(v) for k, v in self.waiting.items() if v}
        chosen = fill(counts, self.window, max(counts))
        out = [self.waiting[k].popleft() for k in sorted(chosen, reverse=True) for _ in range(chosen[k])]
        for k in chosen:
            if not self.waiting[k]:
                del self.waiting[k]
        self.count -= len(out)
        return out

    def _window(self) -> None:
        offset = 0
        for doc_id, start, part, n in self._take():
            self._emit(doc_id, start, part, n, offset)
            offset += len(part) // 4
        self.sequence += 1

    def flush(self) -> None:
        """Empty the pool; windows that are not full are cut to lengths of powers of two."""
        while self.count:
            taken = self._take()
            total = sum(len(x[2]) // 4 for x in taken)
            room, offset = self.window if total == self.window else 1 << (total.bit_length() - 1), 0
            for doc_id, start, part, n in taken:
                while part:
                    now = part[: (room - offset) * 4]
                    self._emit(doc_id, start, now, n, offset)
                    part, start, offset, total = part[len(now) :], start + len(now) // 4, offset + len(now) // 4, total - len(now) // 4
                    if offset == room:
                        self.sequence += 1
                        room, offset = 1 << max(0, total.bit_length() - 1), 0


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, pool: int = POOL, words: int = WORDS) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``words`` bounds a worker's memory, not what is encoded.
    """

    schema = arrow_schema(SCHEMA)

    def run(batches):
        import pyarrow as pa

        tokens, packer = worker_cache(f"{tokenizer} {words}", lambda: Tokens(tokenizer, words)), Packer(window, pool, TaskContext.get().partitionId() << 36)
        end = np.array([END_ID], "<u4").tobytes()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*packer.pieces, strict=True)], schema=schema)
            packer.pieces = []
            return out

        for part in slices(batches):
            ids = part.column("doc_id").to_pylist()
            whole = texts(part)
            for at in range(0, len(ids), 128):
                for doc_id, found in zip(ids[at : at + 128], tokens.encode(whole[at : at + 128]), strict=True):
                    packer.add(doc_id, found + end)
                if len(packer.pieces) >= 20_000:
                    yield rows()
        packer.flush()
        if packer.pieces:
            yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
