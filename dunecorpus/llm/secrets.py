"""Secret scans: known shapes, and a randomness test battery.

Known shapes (``BASE_KINDS``) are found by pattern.  The battery judges every
other run of 16 or more letters, digits, ``+ / _ = -`` that isn't all digits,
and its pieces of that length between ``/ _ = -``.  Pieces are single parts and,
for each alphabet, the spans of parts in a row that gain most by being taken for
a uniform draw from it and not for writing: every part has a log likelihood
ratio (writing: the corpus's letters, whatever their case, and the changes
between small letters, capitals and digits that names have), and the maximal
scoring spans of a run follow in one pass, with no bound on their parts or
places.  The battery infers the encoding (the smallest
alphabet that holds the run) and tests the run against a uniform draw from it
(a span of parts that is rejected, once more without what parts them):

* chi-squared of the symbol counts,
* Wald-Wolfowitz runs of symbols below and above the alphabet's middle,
* serial correlation of neighbouring symbols.

Fisher's rule combines the three.  A run that the battery rejects at
``REJECT`` is no random string.  For the others the question is whether
ordinary writing could look as random (pieces within one that is surely random are not tested once
more): the chi-squared that writing of that
length would have follows from how unevenly the corpus uses the alphabet
(:func:`written`, from symbol counts over all texts, within bounds), so
longer runs give smaller p-values.  Benjamini-Hochberg at ``FDR`` over all
candidate runs of an encoding and length band decides which are reported (kind
``random``; of pieces that overlap, the longest); the p-values are counted in log bins, so its threshold comes from
a table of fixed size, and rounding up to a bin's edge keeps it conservative.

Edge cases: a null text counts as empty; rows repeat as often as in the input;
additional columns are ignored; an empty table gives an empty result; very long
texts are read whole.  Of pieces that overlap and are as long, the first is
reported; base spans of one start are in the order of the kinds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunecorpus.llm.common import arrow_schema, cut, over_texts, slices, texts

BASE_KINDS = ("assign", "access", "hex")
REJECT, FDR = 1e-3, 0.01
SHORTEST = 16
#: Pieces inside one that writing looks like with at most this chance are not tested.
SURE = 1e-3
#: What joining a part to the one before costs a span, in log likelihood.
JOIN = 0.3
MARK = "[SECRET]"

# The patterns of the known shapes, from the contract.
_ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PART = re.compile(r"[A-Za-z0-9+]+")
_BETWEEN = re.compile(r"[/_=-]+")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from the narrowest to the widest.
ENCODINGS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "lower": _LOWER, "upper": _UPPER, "letters": _UPPER + _LOWER, "base32": _UPPER + "234567",
    "base36": _LOWER + _DIGITS, "BASE36": _UPPER + _DIGITS, "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_", "mixed": _UPPER + _LOWER + _DIGITS + "+/-_=",
}
_PLACES = {name: {c: i for i, c in enumerate(chars)} for name, chars in ENCODINGS.items()}
#: The least and the most unevenness that writing is taken to have: long names hold more capitals and digits than
#: the texts around them, so a corpus that hardly uses some symbols is taken for no more uneven than this.
EVENEST = 0.05
MOST_UNEVEN = {"decimal": 0.6, "hex": 0.9, "HEX": 0.9, "lower": 0.7, "upper": 0.7, "letters": 1.9, "base32": 1.2, "base36": 1.4, "BASE36": 1.4, "base62": 2.4, "base64": 2.6, "base64url": 2.6, "mixed": 2.6}


def encoding_of(run: str) -> str:
    """The smallest alphabet that holds the run."""
    held = set(run)
    return next((name for name, places in _PLACES.items() if held <= places.keys()), "mixed")


@dataclass
class Writing:
    """How the corpus is written: its unevenness in each alphabet, and the log share of each letter, whatever its case."""

    uneven: dict[str, float]
    letters: np.ndarray


def symbol_counts(docs: DataFrame) -> np.ndarray:
    """How often each ASCII symbol stands in the corpus; each slice of texts gives one row, and 128 sums reach the driver."""

    def count(batches):
        import pyarrow as pa

        for part in slices(batches):
            found = np.zeros(128, np.int64)
            for t in texts(part):
                found += np.bincount(np.frombuffer(t.encode("ascii", "ignore"), np.uint8), minlength=128)
            yield pa.RecordBatch.from_arrays([pa.array([found.tolist()], pa.list_(pa.int64()))], names=["n"])

    out = np.zeros(128, np.int64)
    for r in docs.select("text").mapInArrow(count, "n array<long>").select(F.posexplode("n").alias("symbol", "n")).groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        out[r["symbol"]] = r["n"]
    return out


def written(counts: np.ndarray) -> Writing:
    """From the corpus's symbol counts; unevenness is K * sum of squared symbol shares - 1 (0 if all are as frequent), within bounds."""
    uneven = {}
    for name, chars in ENCODINGS.items():
        own = np.array([counts[ord(c)] + 1.0 for c in chars])
        uneven[name] = min(MOST_UNEVEN[name], max(EVENEST, float(len(chars) * ((own / own.sum()) ** 2).sum() - 1)))
    # no letter of writing is taken for rarer than one in a thousand, or the few texts of a small corpus would be its alphabet
    letters = np.array([counts[ord(a)] + counts[ord(b)] for a, b in zip(_LOWER, _UPPER, strict=True)], np.float64) + 1
    letters = np.maximum(letters / letters.sum(), 1e-3)
    return Writing(uneven, np.log(letters / letters.sum()))


def unevenness(docs: DataFrame) -> dict[str, float]:
    """The corpus's unevenness in each alphabet."""
    return written(symbol_counts(docs)).uneven


# classes of symbols: small letter, capital, digit, plus; chances of a class to begin a part, and to follow another in writing
_CLASSES = np.full(128, 3)
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58] = 0, 1, 2
_BEGIN = np.log([0.7, 0.2, 0.09, 0.01])
_FOLLOW = np.log([[0.93, 0.03, 0.03, 0.01], [0.5, 0.44, 0.05, 0.01], [0.08, 0.06, 0.85, 0.01], [0.3, 0.3, 0.3, 0.1]])
_WITHIN = {name: np.isin(np.arange(128), [ord(c) for c in chars]) for name, chars in ENCODINGS.items()}


def gains(run: str, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray):
    """For each alphabet that holds a part: (name, each part's log likelihood ratio of a uniform draw against writing)."""
    x = np.frombuffer(run.encode("ascii"), np.uint8)
    kind = _CLASSES[x]
    logs = np.concatenate([letters, letters, np.full(10, -math.log(10)), [0.0]])[np.select([kind == 0, kind == 1, kind == 2], [x - 97, x.astype(int) - 65 + 26, x.astype(int) - 48 + 52], 62)]
    logs[1:] += _FOLLOW[kind[:-1], kind[1:]]
    logs[starts] += _BEGIN[kind[starts]]
    after = starts[starts > 0]
    logs[after] -= _FOLLOW[kind[after - 1], kind[after]]
    inside = (kind < 3) | (x == ord("+"))
    sums = np.concatenate([[0.0], np.cumsum(np.where(inside, logs, 0.0))])
    size, writing = ends - starts, sums[ends] - sums[starts]
    for name, within in _WITHIN.items():
        if name == "decimal":
            continue
        out = np.concatenate([[0], np.cumsum(inside & ~within[x])])
        fits = out[ends] == out[starts]
        if fits.any():
            yield name, np.where(fits, -size * math.log(len(ENCODINGS[name])) - writing, -np.inf)


def spans(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring spans (first, after the last), in linear time; a score of minus infinity parts them."""
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int, float, float, int]] = []  # first, after the last, sum before, sum to the end, nearest earlier span of a smaller sum before
    total = 0.0

    def end():
        out.extend(h[:2] for h in held)
        held.clear()

    for i, s in enumerate(scores):
        if s == -math.inf:
            end()
            total = 0.0
            continue
        if s <= 0:
            total += s
            continue
        first, before, total = i, total, total + s
        at = len(held) - 1
        while True:
            while at >= 0 and held[at][2] >= before:
                at = held[at][4]
            if at < 0:
                end()  # no later span reaches back past this one
                held.append((first, i + 1, before, total, -1))
                break
            if held[at][3] >= total:
                held.append((first, i + 1, before, total, at))
                break
            first, _, before, _, earlier = held[at]
            del held[at:]
            at = earlier
    end()
    return out


def known_shapes(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans, by start and then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, dof: float) -> float:
    """Upper tail by the Wilson-Hilferty cube root."""
    if x <= 0:
        return 1.0
    return _normal_tail(((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof)))


def battery(run: str, uneven: dict[str, float]) -> tuple[str, float, float]:
    """(encoding, p of the battery against a uniform draw, p that writing looks so even)."""
    name = encoding_of(run)
    places = _PLACES[name]
    x = np.array([places[c] for c in run], np.float64)
    n, k = len(x), len(places)
    chi = float(((np.bincount(x.astype(int), minlength=k) - n / k) ** 2).sum() * k / n)
    p_chi = _chi2_tail(chi, k - 1)
    high = x >= k / 2
    n1, n2 = int(high.sum()), int(n - high.sum())
    if n1 and n2:
        mean = 2 * n1 * n2 / n + 1
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = 2 * _normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var))
    else:
        p_runs = 2 * 0.5**n
    spread = x.var()
    corr = float(((x[1:] - x.mean()) * (x[:-1] - x.mean())).mean() / spread) if spread else 1.0
    p_corr = 2 * _normal_tail(abs(corr + 1 / n) * math.sqrt(n))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_corr))
    mean, var = k - 1 + n * uneven[name], 2 * (k - 1) + 4 * n * uneven[name]
    return name, _chi2_tail(fisher, 6), _normal_tail((mean - chi) / math.sqrt(var))


def band(n: int) -> int:
    return min(12, int(4 * math.log2(n / 16)))


def pieces(run: str, letters: np.ndarray) -> list[tuple[int, int, bool]]:
    """(start, stop, whether it is a scoring span of several parts) of the whole run and its pieces to test, the longest first."""
    parts = [m.span() for m in _PART.finditer(run)]
    out = dict.fromkeys([(0, len(run)), *parts], False)
    if len(parts) > 1:
        starts, ends = np.array(parts).T
        for _, gain in gains(run, starts, ends, letters):
            out.update({(parts[a][0], parts[b - 1][1]): True for a, b in spans((gain - JOIN).tolist()) if b - a > 1})
    return sorted(((s, e, grouped) for (s, e), grouped in out.items() if e - s >= SHORTEST), key=lambda s: (s[0] - s[1], s[0]))


def candidates(text: str, base: list[tuple[int, int, str]], writing: Writing) -> list[tuple[int, int, str, int, int]]:
    """(start, end, encoding, length band, log bin of p) of the tested runs and pieces; the bin is -1 if the battery rejects it."""
    out = []
    reach = list(accumulate((e for _, e, _ in base), max))
    starts = [s for s, _, _ in base]
    for m in _RUN.finditer(text):
        random: list[tuple[int, int]] = []  # no one within another
        for at, to, grouped in pieces(m[0], writing.letters):
            run, start, stop = m[0][at:to], m.start() + at, m.start() + to
            before, i = bisect_right(starts, start), bisect_right(random, (start, len(text)))
            if run.isdigit() or (before and reach[before - 1] >= stop) or (i and random[i - 1][1] >= stop):  # within a known span, or one that looks random
                continue
            name, p_uniform, p_writing = battery(run, writing.uneven)
            bare = _BETWEEN.sub("", run)
            if grouped and p_uniform < REJECT and SHORTEST <= len(bare) < len(run) and not bare.isdigit():  # written in groups
                run = bare
                name, p_uniform, p_writing = battery(run, writing.uneven)
            if p_uniform >= REJECT:
                if p_writing <= SURE:
                    random.insert(i, (start, stop))
                out.append((start, stop, name, band(len(run)), min(60, int(-4 * math.log10(max(p_writing, 1e-15))))))
            else:
                out.append((start, stop, name, band(len(run)), -1))
    return out


def longest(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans that overlap, the longest, then the first."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        i = bisect_right(out, (s, e))
        if (i == 0 or out[i - 1][1] <= s) and (i == len(out) or e <= out[i][0]):
            out.insert(i, (s, e))
    return out


SPAN = "array<struct<start:int,stop:int,kind:string>>"
CANDIDATE = "array<struct<start:int,stop:int,encoding:string,band:int,bin:int>>"


def scan(docs: DataFrame, writing: Writing) -> DataFrame:
    """(doc_id, base, runs): spans of known shapes and tested runs, one row per document."""

    def read(some: list[str]):
        base = [known_shapes(t) for t in some]
        runs = [candidates(t, b, writing) for t, b in zip(some, base, strict=True)]
        return (
            [[{"start": s, "stop": e, "kind": k} for s, e, k in b] for b in base],
            [[{"start": s, "stop": e, "encoding": n, "band": g, "bin": p} for s, e, n, g, p in r] for r in runs],
        )

    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], f"base {SPAN}, runs {CANDIDATE}", read)


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[tuple[str, int], int]:
    """The smallest log bin that Benjamini-Hochberg accepts, by encoding and length band."""
    counts = scanned.select(F.explode("runs").alias("r")).groupBy("r.encoding", "r.band", "r.bin").count().collect()  # at most 13 * 13 * 62 rows
    by: dict[tuple[str, int], dict[int, int]] = {}
    for r in counts:
        by.setdefault((r["encoding"], r["band"]), {})[r["bin"]] = r["count"]
    out = {}
    for key, bins in by.items():
        total, passed = sum(bins.values()), 0
        for b in sorted((b for b in bins if b >= 0), reverse=True):
            passed += bins[b]
            if 10 ** (-b / 4) <= fdr * passed / total:
                out[key] = b
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found): arrays of structs (start, stop, kind), each ordered by start."""
    import pyarrow as pa

    scanned = cut(scan(docs, written(symbol_counts(docs))))
    limits = thresholds(scanned)
    schema = f"doc_id long, base {SPAN}, found {SPAN}"
    kind = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = []
            for runs in batch.column("runs").to_pylist():
                passed = longest([(r["start"], r["stop"]) for r in runs if r["bin"] >= limits.get((r["encoding"], r["band"]), 99)])
                found.append([{"start": s, "stop": e, "kind": "random"} for s, e in passed])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(found, kind[2].type)], schema=kind)

    return scanned.mapInArrow(run, schema)


def span_rank(kinds: tuple[str, ...]):
    """SQL array used to order kinds as listed."""
    return F.array(*[F.lit(k) for k in kinds])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`find_secrets`."""

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    order = span_rank((*BASE_KINDS, "random"))
    ranked = F.array_sort(F.transform(F.concat("base", "found"), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(ranked).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced by ``MARK`` and ``n_chars``, where there is such a column, counted anew.

    The first two passes gather symbol counts and the battery's p-values for the
    false-discovery threshold; the last rewrites the texts with it, so no text is shuffled.
    """
    writing = written(symbol_counts(docs))
    limits = thresholds(cut(scan(docs, writing).select("runs")))

    def clean(text):
        if not isinstance(text, str):
            return text
        base = known_shapes(text)
        spans = [(s, e) for s, e, _ in base] + longest([(s, e) for s, e, n, g, p in candidates(text, base, writing) if p >= limits.get((n, g), 99)])
        if not spans:
            return text
        out, at = [], 0
        for s, e in sorted(spans):
            if s >= at:
                out += [text[at:s], MARK]
            at = max(at, e)
        return "".join(out) + text[at:]

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            new = [clean(t) for t in part.column("text").to_pylist()]
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            if "n_chars" in columns:
                own = columns["n_chars"]
                columns["n_chars"] = pa.array([n if t == old else len(t) for t, old, n in zip(new, part.column("text").to_pylist(), own.to_pylist(), strict=True)], own.type)
            columns["text"] = pa.array(new, columns["text"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
