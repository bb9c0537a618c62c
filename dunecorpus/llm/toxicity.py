"""Toxicity: a subsequence string-kernel SVM on Nyström landmarks.

The kernel compares two words by their common letter subsequences of two and
three letters, each weighted by ``DECAY`` for every letter that it spans, so
inserted letters and gaps cost a little and do not hide an insult.  Word edges
count as letters.  The kernel is normalised to 1 for equal words.

Training: whole texts of a bounded sample of labelled rows; a labelled sentence
bag is a document's words.  Each toxic document's witness is the word that
speaks most for its label; the machine is trained on witnesses against words of
clean documents, witnesses are chosen anew by its score, and it is trained
again.  Landmarks are the words most typical of either label.  A squared-hinge
machine is solved by Newton's method on the landmark features.

Scoring: the decision on landmarks is linear in the kernel's subsequence
features, so it folds into one weight for each subsequence; a word's decision
is a table lookup, whatever the number of landmarks.  A document's decision is
that of its worst word over the whole text, turned to a probability by a
logistic curve fitted on the sample.

Edge cases: a null text counts as empty; an empty text has the decision of no
evidence; words over ``LONGEST`` letters are read in overlapping windows; rows
repeat as often as in the input; a doc_id labelled more than once counts as
toxic if any of its labels is 1; without labels of both kinds every score is
the share of toxic labels (0.25 without any); additional columns are ignored; an
empty table gives an empty result.  Very long texts are read whole.  A score of
just 0.5 is toxic; words of equal evidence are taken in alphabetical order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunecorpus.llm.common import cut, over_texts, slices, texts

DECAY, SPAN, LONGEST = 0.7, 7, 40
#: The sample's bound: so many labelled documents of either kind, by hash of doc_id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
LANDMARKS, MACHINE_WORDS = 320, 9000
FOLDS = 5
SYMBOLS = 64

# a chain of single letters or digits; every repeat is possessive and a chain is consumed whole, so any text takes linear time
_spaced = re.compile(r"(?<!\S)[^\W_](?![^\W_])(?:[\s.*_-]++[^\W_](?![^\W_])){2,}+")
_inner = re.compile(r"[\W_]+")


@dataclass
class Machine:
    table3: np.ndarray | None
    table2: np.ndarray | None
    bias: float
    slope: float
    offset: float
    nothing: float


def symbols(joined: str) -> np.ndarray:
    """a-z, digits and the word edges have their own symbol; other letters share the rest."""
    o = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    out = 39 + o % 25
    for first, last, to in ((97, 122, 1), (48, 57, 27)):
        own = (o >= first) & (o <= last)
        out[own] = o[own] - first + to
    return out


EDGES = (37, 38)


def units(chunk: str) -> list[str]:
    """The words to judge in a run of non-blanks: its parts, and the parts joined."""
    if chunk.isalnum() and len(chunk) <= LONGEST:
        return [chunk]
    parts = [p for p in _inner.split(chunk) if p]
    if len(parts) > 1:
        parts.append("".join(parts))
    out = []
    for p in parts:
        out += [p] if len(p) <= LONGEST else [p[i : i + LONGEST] for i in range(0, len(p) - LONGEST // 2, LONGEST // 2)]
    return out


def chunks(text: str) -> set[str]:
    low = text.lower()
    found = set(low.split())
    for m in _spaced.finditer(low):  # letters written apart
        found.add(_inner.sub("", m[0]))
    return found


def coded(words: list[str]):
    """Groups of equally long words: (their places, symbols as an array)."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, at in by.items():
        out = np.empty((len(at), n + 2), np.int32)
        out[:, 0], out[:, -1] = EDGES
        out[:, 1:-1] = symbols("".join([words[i] for i in at])).reshape(len(at), n)
        yield np.array(at), out


def subsequences(x: np.ndarray):
    """For each way to choose two or three places within SPAN: (order, feature numbers, weight)."""
    n = x.shape[1]
    for i in range(n):
        for j in range(i + 1, min(n, i + SPAN)):
            yield 2, x[:, i] * SYMBOLS + x[:, j], DECAY ** (j - i - 1)
            for k in range(j + 1, min(n, i + SPAN)):
                yield 3, (x[:, i] * SYMBOLS + x[:, j]) * SYMBOLS + x[:, k], DECAY ** (k - i - 2)


def features(word: str) -> tuple[np.ndarray, np.ndarray]:
    """A word's subsequence features (order-2 features after the order-3 ones), of length 1."""
    x = next(coded([word]))[1]
    got = [(int(c[0]) + (SYMBOLS**3 if order == 2 else 0), w) for order, c, w in subsequences(x)]
    code, inverse = np.unique([c for c, _ in got], return_inverse=True)
    value = np.bincount(inverse, [w for _, w in got])
    return code, value / np.sqrt((value**2).sum())


def decide(words: list[str], table3: np.ndarray, table2: np.ndarray) -> np.ndarray:
    """The kernel machine's value, without bias, of each word."""
    out = np.zeros(len(words), np.float64)
    for at, x in coded(words):
        for lo in range(0, len(at), 4096):
            part = x[lo : lo + 4096]
            dot, cols, ws = np.zeros(len(part)), [], []
            for order, code, w in subsequences(part):
                dot += w * (table3 if order == 3 else table2)[code]
                cols.append(code + (SYMBOLS**3 if order == 2 else 0))
                ws.append(w)
            code, w = np.stack(cols, 1), np.array(ws)
            order_ = np.argsort(code, 1, kind="stable")
            code, w = np.take_along_axis(code, order_, 1), w[order_]
            new = np.ones(code.shape, bool)
            new[:, 1:] = code[:, 1:] != code[:, :-1]
            group = np.cumsum(new.ravel()) - 1
            square = np.bincount(group, w.ravel()) ** 2
            owner = np.repeat(np.arange(len(code)), new.sum(1))
            out[at[lo : lo + 4096]] = dot / np.sqrt(np.bincount(owner, square, len(code)))
    return out


def _newton(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Squared-hinge SVM in the primal; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        xa, ca = x[active], cost[active]
        w = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(ridge), (xa * ca[:, None]).T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and offset of P(1 | f) by damped Newton steps on smoothed labels."""
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y == 1, up, down)
    a = np.zeros(2)
    x = np.stack([f, np.ones_like(f)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        a = a - np.clip(np.linalg.solve(h, x.T @ (p - t)), -2, 2)
    return max(float(a[0]), 1e-3), float(a[1])


def fit(texts: list[str], toxic: list[int]) -> Machine:
    """Train on whole texts with their labels; deterministic."""
    y = np.array(toxic)
    base = (y.sum() + 0.25) / (len(y) + 1)
    flat = Machine(None, None, 0.0, 0.0, float(np.log(base / (1 - base))), 0.0)
    if len(set(toxic)) < 2:
        return flat
    bags = [sorted({u for c in chunks(t) for u in units(c) if len(u) > 1}) for t in texts]
    seen: dict[str, list[int]] = {}
    done = set()
    for text, bag, label in zip(texts, bags, toxic, strict=True):
        if text in done:  # copies say nothing new
            continue
        done.add(text)
        for u in bag:
            seen.setdefault(u, [0, 0])[label] += 1
    words = sorted(seen)
    clean, bad = np.array([seen[u] for u in words], np.float64).T
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    share = (clean + bad) / (n1 + n0)
    z = (bad / n1 - clean / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-9)
    evidence = dict(zip(words, z.tolist(), strict=True))
    toxic_bags = [b for b, label in zip(bags, toxic, strict=True) if label and b]
    witness = [w for w in (max(b, key=lambda u: (evidence[u], u)) for b in toxic_bags) if evidence[w] > 2.5]
    if not witness:
        return flat
    order = np.argsort(-z, kind="stable")
    typical = [words[i] for i in order[: LANDMARKS // 2] if z[i] > 2.5]
    common = [words[i] for i in np.argsort(-clean, kind="stable")]
    marks = typical + [u for u in common if u not in set(typical)][: LANDMARKS - len(typical)]
    negatives = [u for u in common if seen[u][0] > 0]
    rare = negatives[MACHINE_WORDS // 2 :]
    negatives = negatives[: MACHINE_WORDS // 2] + rare[:: max(1, len(rare) // (MACHINE_WORDS // 2))]

    place: dict[int, int] = {}
    landmark = [features(u) for u in marks]
    for code, _ in landmark:
        for c in code.tolist():
            place.setdefault(c, len(place))

    def dense(some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), len(place)), np.float32)
        for i, u in enumerate(some):
            code, value = features(u)
            for c, v in zip(code.tolist(), value.tolist(), strict=True):
                if c in place:
                    out[i, place[c]] = v
        return out

    z_dense = dense(marks)
    value, vector = np.linalg.eigh((z_dense @ z_dense.T).astype(np.float64))
    keep = value > 1e-4 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])

    def mapped(some: list[str]) -> np.ndarray:
        parts = [dense(some[i : i + 500]) @ z_dense.T for i in range(0, len(some), 500)]
        x = np.concatenate(parts).astype(np.float64) @ white
        return np.concatenate([x, np.ones((len(x), 1))], 1)

    x0 = mapped(negatives)
    cost0 = np.full(len(negatives), 20.0 * 1000 / len(negatives))
    table = np.zeros(SYMBOLS**3 + SYMBOLS**2)
    codes = np.array(list(place), np.int64)
    bias = 0.0
    for _ in range(2):
        chosen, times = np.unique(witness, return_counts=True)
        x1 = mapped(list(chosen))
        w = _newton(np.concatenate([x1, x0]), np.r_[np.ones(len(chosen)), -np.ones(len(negatives))], np.r_[20.0 * 1000 * times / times.sum(), cost0])
        table[codes] = z_dense.T.astype(np.float64) @ (white @ w[:-1])
        bias = float(w[-1])
        score = dict(zip(words, decide(words, table[: SYMBOLS**3], table[SYMBOLS**3 :]).tolist(), strict=True))
        witness = [w_ for w_ in (max(b, key=lambda u: (score[u], u)) for b in toxic_bags) if evidence[w_] > 2.5] or witness
    floor = min(-1.0, float(np.quantile([score[u] + bias for u in negatives], 0.05)))
    f = np.array([max((score[u] + bias for u in b), default=floor) for b in bags])
    slope, offset = _logistic(f, y)
    return Machine(table[: SYMBOLS**3].astype(np.float32), table[SYMBOLS**3 :].astype(np.float32), bias, slope, offset, floor)


def score_texts(texts: list[str], machine: Machine, cache: dict[str, float]) -> list[float]:
    """Probabilities; ``cache`` holds the decisions of runs of non-blanks."""
    if machine.table3 is None:
        p = float(1 / (1 + np.exp(-machine.offset)))
        return [p] * len(texts)
    out = []
    for at in range(0, len(texts), 256):
        if len(cache) > 250_000:
            cache.clear()
        found = [chunks(t) for t in texts[at : at + 256]]
        new = sorted(set().union(*found).difference(cache))
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            cut_up = [units(c) for c in part]
            words = sorted({u for us in cut_up for u in us if len(u) > 1})
            value = dict(zip(words, decide(words, machine.table3, machine.table2).tolist(), strict=True))
            for c, us in zip(part, cut_up, strict=True):
                cache[c] = max((value[u] + machine.bias for u in us if len(u) > 1), default=machine.nothing)
        for f in found:
            d = max(map(cache.__getitem__, f), default=machine.nothing)
            out.append(float(1 / (1 + np.exp(-np.clip(machine.slope * d + machine.offset, -40, 40)))))
    return out


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The bounded training sample, outside the held-out fold, in a fixed order."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0).withColumn("h", F.xxhash64("doc_id"))
    picked = known.where("toxic = 1").orderBy("h", "doc_id").limit(SAMPLE_TOXIC).unionAll(known.where("toxic = 0").orderBy("h", "doc_id").limit(SAMPLE_CLEAN))
    picked = cut(picked.select(F.col("doc_id").alias("id"), "toxic", "h"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids are broadcast
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "h", "toxic").agg(F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["h"], r["id"]))
    return [r["text"] for r in rows], [int(r["toxic"]) for r in rows]


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    return fit(*sample(docs, labels))


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)
    cache: dict[str, float] = {}
    return over_texts(docs, ["doc_id"], "score double", lambda some: [score_texts(some, shipped.value, cache)])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5, with their columns, in one pass over the texts."""
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        import pyarrow as pa

        cache: dict[str, float] = {}
        for part in slices(batches):
            yield part.filter(pa.array([p < 0.5 for p in score_texts(texts(part), machine.value, cache)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
