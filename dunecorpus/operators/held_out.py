"""Held-out texts under the back-off model of the others, without a table of its grams.

The chances are those of :mod:`dunecorpus.operators.backoff`.  A place to predict
has a window: its token and those before it.  Windows of texts to learn from and
of held-out ones meet by the token before the place (a frequent one: by the two
before it), where all counts that a place needs are found by sorting whole
windows.  Tokens travel as hashes, of which it is checked that no two
tokens share one.  Counts leave as they are, since the discounts need all of them.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunecorpus.operators.backoff import FALLBACK
from dunecorpus.operators.counting import BEGIN, END
from dunecorpus.operators.staging import SLICES, cut, free, remove, shared_folder, stored

#: Windows that meet in one task on average; a token that comes before more places is met with the one before it.
WINDOWS = 500_000
#: Bytes of text cut into windows at once.
TEXT_BYTES = 1 << 22
#: Windows that are on disk at a time on average, where they take more than ``SLICES`` slices.
SLICE_WINDOWS = 1 << 26
#: Seeds of hashes of 48 bits; those after them have 64.
SHORT = 3
#: What is kept of an order at a place: count of the gram, and of its history the total and the numbers of counts 1, 2 and more.
KEPT = 5


def marked(tokens: Column) -> Column:
    """The token list between marks as one text; a null list counts as empty, tokens hold no blanks."""
    return F.array_join(F.concat(F.array(F.lit(BEGIN)), F.coalesce(tokens, F.array().cast("array<string>")), F.array(F.lit(END))), " ")


def _coded(column, seed: int):
    """For parts of a text column: (rows from, to, hashes of the distinct tokens, tokens, codes, starts of texts)."""
    import numpy as np
    import pandas as pd
    import pyarrow.compute as pc

    lengths = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + TEXT_BYTES)))
        parts = pc.split_pattern(column.slice(at, end - at), " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        found = parts.flatten().dictionary_encode()
        tokens = found.dictionary
        hashes = pd.util.hash_array(np.array(tokens.to_pylist(), object), hash_key=f"{seed:016d}", categorize=False).astype(np.uint64)
        hashes >>= np.uint64(16 if seed < SHORT else 0)
        yield at, end, hashes, tokens, found.indices.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)[:-1]])
        at = end


def _spread(x):
    """Numbers below 2^32 from 64-bit ones."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def vocabulary(texts: DataFrame, seed: int) -> DataFrame:
    """(token, word, n): tokens with their hashes, and how often they come."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for _, _, hashes, tokens, codes, _ in _coded(batch.column(0), seed):
                n = np.bincount(codes, minlength=len(hashes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), tokens.cast(pa.string()), pa.array(n)], names=["token", "word", "n"])

    return texts.select("text").mapInArrow(run, "token long, word string, n long").groupBy("token", "word").agg(F.sum("n").alias("n"))


def _planes(x):
    """The bytes of numbers, all first ones first: they compress better so."""
    import numpy as np

    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _joined(raw: bytes, kind: str, many: int, at: int):
    """The numbers of :func:`_planes`."""
    import numpy as np

    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, wide * many, at).reshape(wide, many).T).view(kind).ravel()


def _windows(texts: DataFrame, by: str, order: int, seed: int, heavy: list[int], slices: int, buckets: int, piece: int) -> DataFrame:
    """(bucket, held, by, data): windows of the slice ``piece``, those of one bucket, kind and part of a text column packed together."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        frequent = np.array(heavy, np.uint64)
        kind = pa.schema([("bucket", pa.int64()), ("held", pa.bool_()), ("group", pa.string()), ("data", pa.binary())])
        for batch in batches:
            groups, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, end, hashes, _, codes, starts in _coded(batch.column(2), seed):
                labels = [(h, g if h else None) for h, g in zip(held[at:end], groups[at:end], strict=True)]
                own = {x: i for i, x in enumerate(dict.fromkeys(labels))}
                names = list(own)
                row = np.zeros(len(codes), np.int64)
                row[starts[1:]] = 1
                row = np.cumsum(row)
                depth = np.arange(len(codes)) - starts[row]
                label = np.array([own[x] for x in labels])[row]
                before = hashes[codes[np.maximum(np.arange(len(codes)) - 1, 0)]]
                second = np.where(depth > 1, hashes[codes[np.maximum(np.arange(len(codes)) - 2, 0)]], np.uint64(0))
                near = _spread(before)
                deep = _spread(before ^ _spread(second))
                bucket = np.where(np.isin(before, frequent), deep, near // np.uint64(slices)) % np.uint64(buckets)
                here = np.flatnonzero((depth > 0) & (near % np.uint64(slices) == piece))
                sort = bucket[here].astype(np.int64) * len(names) + label[here]
                here, sort = here[np.argsort(sort, kind="stable")], np.sort(sort)
                cuts = np.flatnonzero(np.diff(sort)) + 1
                out = []
                for part, key in zip(np.split(here, cuts), sort[np.concatenate([[0], cuts])] if len(here) else [], strict=False):
                    # 0 stands for what would lie before a text
                    window = np.stack([np.where(depth[part] >= j, codes[np.maximum(part - j, 0)] + 1, 0) for j in range(order)])
                    used = np.zeros(len(hashes) + 1, bool)
                    used[window] = True
                    used[0] = True
                    new = np.cumsum(used) - 1
                    values = hashes[np.flatnonzero(used)[1:] - 1]
                    small = new[window].astype(np.uint16 if len(values) < 1 << 16 else np.uint32)
                    raw = np.array([small.itemsize, len(values), window.shape[1]], np.int64).tobytes() + _planes(values) + _planes(small)
                    held_out, group = names[int(key) % len(names)]
                    out.append((int(key) // len(names), held_out, group, np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

    return texts.select(by, "held", "text").mapInArrow(run, "bucket long, held boolean, group string, data binary")


#: kind 0: a place to predict (group, x its token, y the one before if that is frequent, v what is kept of orders 2 and more);
#: 1: counts of counts (x the order, v); 2: different tokens before x, in part; 3: of x after the frequent y, in part.
MET = "kind int, group string, x long, y long, v array<long>"


def _meet(windows: DataFrame, order: int, heavy: list[int]) -> DataFrame:
    """The rows of ``MET`` of all windows, bucket by bucket."""

    def run(table):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        parts, train, groups = [], [], []
        names = {}
        for held, group, data in zip(table.column("held").to_pylist(), table.column("group").to_pylist(), table.column("data").to_pylist(), strict=True):
            raw = pa.decompress(data[8:], decompressed_size=int(np.frombuffer(data[:8], np.int64)[0]), codec="zstd", asbytes=True)
            wide, many, n = map(int, np.frombuffer(raw[:24], np.int64))
            values = np.concatenate([np.zeros(1, np.uint64), _joined(raw, "u8", many, 24)])
            parts.append(values[_joined(raw, f"u{wide}", order * n, 24 + 8 * many).reshape(order, n)])
            train.append(np.full(n, not held))
            groups.append(np.full(n, names.setdefault(group, len(names)), np.int32))
        h, train, groups = np.concatenate(parts, axis=1), np.concatenate(train), np.concatenate(groups)
        del parts
        ids, values = pd.factorize(np.concatenate([np.zeros(1, np.uint64), h.ravel()]))
        ids, frequent = ids[1:].reshape(h.shape), np.isin(values, np.array(heavy, np.uint64))
        del h
        bits = max(1, len(values).bit_length())

        def sorted_by(columns):
            keys = []
            for i in range(0, len(columns), 62 // bits):
                key = np.zeros(ids.shape[1], np.int64)
                for c in columns[i : i + 62 // bits]:
                    key = (key << bits) | ids[c]
                keys.append(key)
            return np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")

        ids = ids[:, first := sorted_by([1, 0, *range(2, order)])]
        train, groups = train[first], groups[first]
        by_history = sorted_by(range(1, order))

        def changes(c, at=slice(None)):
            x = ids[c][at]
            return np.concatenate([[True], x[1:] != x[:-1]])

        runs = {2: np.flatnonzero(changes(1) | changes(0))}
        new = np.zeros(ids.shape[1], bool)
        new[runs[2]] = True
        for k in range(3, order + 1):
            new |= changes(k - 1)
            runs[k] = np.flatnonzero(new)
        seen = {k: np.add.reduceat(train.astype(np.int64), at) for k, at in runs.items()}
        places = np.flatnonzero(~train)
        v = np.zeros((len(places), KEPT * (order - 1)), np.int64)
        out = []
        fresh = np.zeros(ids.shape[1], bool)
        often = frequent[ids[1]]
        for k in range(2, order + 1):
            at = runs[k]
            run_of = np.searchsorted(at, places, side="right") - 1
            if k < order:  # different tokens before; what begins a text counts occurrences
                longer = runs[k + 1][seen[k + 1] > 0]
                a = np.bincount(np.searchsorted(at, longer, side="right") - 1, minlength=len(at))
                a = np.where(ids[k][at] == 0, seen[k], a)
            else:
                a = seen[k]
            a = np.where(ids[k - 1][at] == 0, 0, a)
            fresh |= changes(k - 1, by_history)
            history = np.empty(ids.shape[1], np.int64)
            history[by_history] = np.cumsum(fresh) - 1
            kept = (a > 0) & ~often[at] if k == 2 else a > 0
            of, c, size = history[at[kept]], a[kept], int(history.max()) + 1
            stats = [np.bincount(of, weights=c, minlength=size), *[np.bincount(of[m], minlength=size) for m in (c == 1, c == 2, c > 2)]]
            out.append((1, None, k, None, [int((c == i).sum()) for i in range(1, 5)]))
            fits = (ids[k - 1][places] != 0) & (~often[places] if k == 2 else True)
            v[:, KEPT * (k - 2)] = np.where(fits, a[run_of], 0)
            for i, s in enumerate(stats, 1):
                v[:, KEPT * (k - 2) + i] = np.where(fits, s[history[places]], 0)
            if k == 2:
                x, n = np.unique(values[ids[0][at[kept]]], return_counts=True)
                part = at[(a > 0) & often[at]]
                split = values[ids[0][part]], values[ids[1][part]], a[(a > 0) & often[at]]

        def rows(kind, x, y=None, n=None, group=None):
            flat = np.ascontiguousarray(n).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (flat.shape[1] if flat.ndim > 1 else 1)), pa.array(flat.ravel()))
            nulls = lambda t: pa.nulls(len(x), t)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), nulls(pa.string()) if group is None else group, pa.array(x.view(np.int64)), nulls(pa.int64()) if y is None else y, lists], schema=schema)

        schema = pa.schema([("kind", pa.int32()), ("group", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("v", pa.list_(pa.int64()))])
        label = pa.array(list(names), pa.string()).take(pa.array(groups[places]))
        y = pa.array(values[ids[1][places]].view(np.int64), mask=~often[places])
        made = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)]
        made += [rows(0, values[ids[0][places]], y, v, label), rows(2, x, None, n), rows(3, split[0], pa.array(split[1].view(np.int64)), split[2])]
        return pa.Table.from_batches(made)

    return windows.groupBy("bucket").applyInArrow(run, MET)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """What counts of one, two, and three or more give up, as in :func:`backoff.discounts`."""
    if not all(n):
        return FALLBACK
    y = n[0] / (n[0] + 2 * n[1])
    out = tuple(i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3))
    return out if all(0 <= d <= i for i, d in enumerate(out, 1)) else FALLBACK


def _own(a: Column, total: Column, d: tuple[float, float, float]) -> Column:
    return F.when(a > 0, (a - F.when(a == 1, d[0]).when(a == 2, d[1]).otherwise(d[2])) / total).otherwise(0.0)


def _back(total: Column, few: list[Column], d: tuple[float, float, float]) -> Column:
    return F.when(total > 0, (few[0] * d[0] + few[1] * d[1] + few[2] * d[2]) / total).otherwise(1.0)


def scored(texts: DataFrame, by: str, order: int) -> DataFrame:
    """(by, found, times, logp): how many places of the held-out texts have a known token (found 1) or not (0), and their mean log chance.

    ``texts`` has (by, held, text), the text as :func:`marked` makes it; the model
    is that of the others, of ``order`` 2 at least.  Windows come by slices of the
    token before them, so a part of their shuffle is on disk at a time.
    """
    spark = texts.sparkSession
    at = f"{shared_folder(spark)}/held-{uuid.uuid4().hex}"
    for seed in range(8):
        words = stored(vocabulary(texts, seed), f"{at}/words{seed}")
        if words.groupBy("token").agg(F.count("*").alias("words")).where("words > 1 or token = 0").isEmpty():
            break
    else:
        raise RuntimeError("no hash tells all tokens apart")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = sorted(r["token"] % (1 << 64) for r in words.where(F.col("n") > WINDOWS).select("token").toLocalIterator())
    slices = max(SLICES, math.ceil(total / SLICE_WINDOWS))
    buckets = max(1, math.ceil(total / WINDOWS / slices))
    places, afters, befores = [], [], []
    counts: dict[int, list[int]] = {k: [0] * 4 for k in range(1, order + 1)}

    def few(df: DataFrame, k: int) -> None:
        found = df.agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first()
        counts[k] = [a + b for a, b in zip(counts[k], found, strict=True)]

    for i in range(slices):
        _meet(_windows(texts, by, order, seed, heavy, slices, buckets, i), order, heavy).write.partitionBy("kind").option("compression", "zstd").parquet(f"{at}/met{i}")
        free(spark)
        met = spark.read.schema(MET).parquet(f"{at}/met{i}")
        for r in met.where("kind = 1").groupBy("x").agg(*[F.sum(F.col("v")[j]).alias(f"n{j}") for j in range(4)]).collect():  # one row an order
            counts[r["x"]] = [a + r[f"n{j}"] for j, a in enumerate(counts[r["x"]])]
        afters.append(stored(met.where("kind = 3").groupBy("x", "y").agg(F.sum(F.col("v")[0]).alias("n")), f"{at}/after{i}"))
        few(afters[-1], 2)
        before = met.where("kind = 2").select("x", F.col("v")[0].alias("n")).unionByName(afters[-1].select("x", F.lit(1).cast("long").alias("n")))
        befores.append(stored(before.groupBy("x").agg(F.sum("n").alias("n")), f"{at}/before{i}"))
        for kind in (1, 2, 3):
            remove(spark, f"{at}/met{i}/kind={kind}")
        places.append(spark.read.schema(MET).parquet(f"{at}/met{i}").select("group", "x", "y", "v"))

    def every(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    single = stored(every(befores).groupBy("x").agg(F.sum("n").alias("n")), f"{at}/single")
    few(single, 1)
    gives = {k: _discounts(n) for k, n in counts.items()}
    n = F.col("n")
    one = single.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("types"), F.coalesce(F.sum(F.when(n == 1, gives[1][0]).when(n == 2, gives[1][1]).otherwise(gives[1][2])), F.lit(0.0)).alias("freed")).first()
    unknown = (one["freed"] / one["total"] if one["total"] else 1.0) / (one["types"] + 1)

    p, weight = F.lit(0.0), F.lit(1.0)
    for k in range(3, order + 1):
        a, sums, *numbers = (F.col("v")[KEPT * (k - 2) + j] for j in range(KEPT))
        back = _back(sums, numbers, gives[k])
        p, weight = _own(a, sums, gives[k]) + back * p, back * weight
    a, sums, *numbers = (F.col("v")[j] for j in range(KEPT))
    # a chance is p + weight * (own + back * chance of the token alone)
    each = every(places).select(F.col("group").alias(by), "x", "y", p.alias("p"), weight.alias("weight"), _own(a, sums, gives[2]).alias("own"), _back(sums, numbers, gives[2]).alias("back"))
    flat = ["p", "weight"]
    rare = each.where("y is null").select(by, "x", (F.col("p") + F.col("weight") * F.col("own")).alias("p"), (F.col("weight") * F.col("back")).alias("weight"))
    if heavy:
        after = every(afters)
        histories = after.groupBy("y").agg(F.sum("n").alias("total"), *[F.count_if(m).alias(f"m{j}") for j, m in enumerate((n == 1, n == 2, n > 2))])
        often = each.where("y is not null").select(by, "x", "y", *flat).join(F.broadcast(histories), "y", "left").join(after, ["x", "y"], "left")  # one row a frequent token is broadcast
        own, back = _own(F.coalesce("n", F.lit(0)), F.col("total"), gives[2]), _back(F.coalesce("total", F.lit(0)), [F.col(f"m{j}") for j in range(3)], gives[2])
        rare = rare.unionByName(often.select(by, "x", (F.col("p") + F.col("weight") * own).alias("p"), (F.col("weight") * back).alias("weight")))
    alone = F.when(n.isNull(), F.lit(unknown)).otherwise(_own(n, F.lit(float(max(1, one["total"]))), gives[1]) + F.lit(unknown))
    known = rare.join(single, "x", "left").select(by, n.isNotNull().cast("int").alias("found"), F.log10(F.col("p") + F.col("weight") * alone).alias("logp"))
    out = cut(known.groupBy(by, "found").agg(F.count("*").alias("times"), F.avg("logp").alias("logp")))
    remove(spark, at)
    return out
