"""The training-data operators against brute force, round trips and held-out labels, and on odd tables."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunecorpus.llm import ann, licenses, mixing, ngram_join, packing, pii, queries, secrets, simhash, toxicity, url_reputation

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# additional columns whose names clash with the operators' own
ODD_SCHEMA = SCHEMA + ", score double, rep long, bits long, spans string, start int, part int, rate double"
LABELS = "doc_id long, quality int, toxic int"
WORDS = "the quick brown fox jumps over lazy dogs while seven wizards mix potions under pale moon light near old stone bridges".split()


def sentence(seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "x" * 70_000), (5, "plain text here"), (5, "plain text here"), (None, "no id at all"), (6, "!!! ??? ..."), (7, "12345 " * 3000), (8, "émigré Ünïcode ＡＢＣ 日本語 😂"), (9, "plain text here")]
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), 0.5, 1, 2, "z", 3, 4, 0.1) for i, t in rows], ODD_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def no_labels(spark):
    return spark.createDataFrame([], LABELS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_odd_tables(spark):
    docs = odd_docs(spark)
    n = docs.count()
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0), (2, 1, 0), (None, 1, 1)], LABELS)
    assert pii.digest(pii.find_personal_data(docs)).count() == n
    assert mixing.document_rates(docs, labels).count() == n
    assert toxicity.toxicity(docs, labels).count() == n
    assert licenses.scan(docs).count() == n
    assert secrets.digest(secrets.find_secrets(docs)).count() == n
    assert simhash.near_fingerprints(docs).count() == n
    assert ngram_join.near_duplicates(docs).count() == n - 1
    tokens = packing.pack(docs, queries.tokenizer_path())
    assert tokens.select("doc_id").distinct().count() == 10
    for out in (secrets.redact(docs), toxicity.drop_toxic(docs, labels), mixing.thin(docs, labels), ngram_join.keep_one(docs)):
        assert out.columns == docs.columns
        assert out.where("doc_id is null").count() == 1


BIG = (2**60 + 1, 2**60 + 3)


def test_ids_stay_whole(spark):
    texts = [sentence(1), None, sentence(2), sentence(3), "password: abcdefghijklmnopq " + sentence(4)]
    docs = spark.createDataFrame(list(zip([BIG[0], None, BIG[1], 5, 6], texts, ["a"] * 5, ["b"] * 5, [BIG[1], None, 1, 2, 3], strict=True)), SCHEMA).coalesce(1)
    labels = spark.createDataFrame([(BIG[0], 1, 0), (BIG[1], 0, 0), (5, 1, 1)], LABELS)
    ids = sorted([*BIG, 5, 6])
    tables = [
        pii.digest(pii.find_personal_data(docs)), mixing.document_rates(docs, labels), toxicity.toxicity(docs, labels), licenses.scan(docs), ngram_join.near_duplicates(docs),
        secrets.digest(secrets.find_secrets(docs)), packing.pack(docs, queries.tokenizer_path()), simhash.near_fingerprints(docs),
    ]
    for i, out in enumerate(tables):
        assert sorted({r["doc_id"] for r in out.select("doc_id").collect()} - {None}) == ids, i
    for out in (toxicity.drop_toxic(docs, labels), ngram_join.keep_one(docs), secrets.redact(docs)):
        assert sorted({r["doc_id"] for r in out.collect()} - {None}) == ids
        assert {r["n_chars"] for r in out.collect() if r["doc_id"] == BIG[0]} == {BIG[1]}
    kept = mixing.thin(docs, labels).collect()
    assert {r["doc_id"] for r in kept} <= {*ids, None} and len(kept) > 1
    pages = spark.createDataFrame([(BIG[0], "http://a.b/c"), (None, None), (BIG[1], "http://a.b/d")], "page_id long, url string")
    assert {r["page_id"] for r in url_reputation.judge(pages, spark.createDataFrame([(BIG[0], 1)], "page_id long, bad int")).collect()} == {*BIG, None}
    vectors = spark.createDataFrame([(2**60, [1.0, 2.0]), (None, [1.0, 1.0]), (BIG[0], [1.0, 2.1]), (BIG[1], [1.0, 3.0])], "vec_id long, embedding array<double>")
    out = ann.search(vectors, every=2**60).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"])] == [(2**60, BIG[0]), (2**60, BIG[1])]


def test_empty_tables(spark):
    docs, labels = empty(spark), no_labels(spark)
    assert pii.digest(pii.find_personal_data(docs)).count() == 0
    assert mixing.document_rates(docs, labels).count() == 0
    assert toxicity.toxicity(docs, labels).count() == 0
    assert licenses.scan(docs).count() == 0
    assert secrets.digest(secrets.find_secrets(docs)).count() == 0
    assert simhash.near_fingerprints(docs).count() == 0
    assert ngram_join.near_duplicates(docs).count() == 0
    assert packing.pack(docs, queries.tokenizer_path()).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert url_reputation.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).count() == 0


# personal data


def base_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub(r"\D", "", m[0])][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_pii_base_spans(spark, docs):
    tricky = [
        "a@b.com_x@c.de a.b@c @d.com x@y.z.", "😂 mail me: jo.é@mail.com or jo+x@mail.co.uk", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111x",
        "+1 (366) 555-9807 +12 +49 30 1234567890123456 +1--- ---2345678", "joe [at] mail [dot] com, call 555-123-4567", "1" * 5000 + " 4" * 3000, "@" * 500 + "a@" * 200 + "b.c" * 100,
    ]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    got = by_id(pii.digest(pii.find_personal_data(table)), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for r in table.collect():
        base = base_pii(r["text"])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        row = got[r["doc_id"]]
        assert row[:5] == (*[sum(k == kind for k, _, _ in base) for kind in pii.KINDS], hashlib.sha256(joined.encode()).hexdigest()), r["doc_id"]
        assert set(filter(None, joined.split(","))) <= set(row[5].split(","))


def test_pii_method_adds_and_refuses(spark):
    plain = [(i, f"{sentence(i)} mail: jo{i}@mail.com, phone +1 (366) 555-{1000 + i} and {sentence(i + 500, 6)}") for i in range(60)]
    told = [(100, "please contact jane [at] mail [dot] com today"), (101, "call my phone 366-555-9807 now"), (102, "write to bob (at) site (dot) org please")]
    decoys = [(200, "part x366-555-9807y of the serial"), (201, "see foo[at]bar[dot]zzqq9 x"), (202, "version 1.2.3 of 2024-05-06, 12 300 000 items, ratio 3.141592653589793"), (203, "order 1234 5678 9012 345 pieces")]
    docs = spark.createDataFrame([*plain, *told, *decoys], "doc_id long, text string")
    got = by_id(pii.digest(pii.find_personal_data(docs)), "n_email", "n_phone", "spans")
    assert all(got[i][:2] == (1, 1) for i, _ in plain)
    for i, text in told:
        assert got[i][:2] == (0, 0) and got[i][2], text
        kind, start, stop = got[i][2].split(":")
        assert text[int(start) : int(stop)] in ("jane [at] mail [dot] com", "366-555-9807", "bob (at) site (dot) org")
    for i, text in decoys:
        assert got[i][2] == "", (text, got[i])


def test_em_separates_good_labelers():
    patterns = [((1, 1, 1, 1), 50), ((1, 1, 0, 1), 40), ((0, 0, 0, 0), 80), ((0, 1, 0, 0), 20), ((0, 0, 0, 1), 30)]
    _, rates, post = pii.expectation_maximisation(patterns)
    assert post[0] > 0.95 and post[2] < 0.05 and rates[0][0] > 0.8 > 0.2 > rates[0][1]
    w = pii.train_classifier(patterns, post)
    assert sum(w) > 0 > w[-1]


# mixing


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 3000)
    n = rng.integers(1, 400, 3000)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    want = (0.6, 0.3, 0.1)
    r = np.array([x["r"] for x in members.select(mixing.fit_rates(members, want, 0.5).alias("r")).collect()])
    got = (n * r) @ p
    assert (r >= 0).all()
    assert np.abs(got / n.sum() - 0.5 * np.array(want)).max() < 0.02


def test_mixing_meets_small_targets(spark):
    rng = np.random.default_rng(8)
    hard = np.eye(3)[rng.choice(3, 3000, p=[0.74, 0.145, 0.115])]
    for p in (0.98 * hard + 0.02 * rng.dirichlet([1, 1, 1], 3000), hard):
        n = rng.integers(1, 400, 3000)
        members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
        r = np.array([x["r"] for x in members.select(mixing.fit_rates(members, mixing.TARGETS, 0.7).alias("r")).collect()])
        assert (r >= 0).all()
        assert (n * r) @ p == pytest.approx(0.7 * n.sum() * np.array(mixing.TARGETS), rel=1e-3)


def test_mixing_raises_scarce_domains(spark):
    rng = np.random.default_rng(9)
    want = np.array([0.6, 0.3, 0.1])
    p = np.eye(3)[rng.choice(3, 4000, p=[0.957, 0.039, 0.004])]
    n = rng.integers(1, 400, 4000)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    fit = mixing.fitted(members, tuple(want))
    rate, wanted, reached = fit.rate, fit.wanted, fit.reached
    r = np.array([x["r"] for x in members.select(rate.alias("r")).collect()])
    assert wanted / wanted.sum() == pytest.approx(want)
    assert (n * r) @ p == pytest.approx(wanted, rel=1e-3) and reached == pytest.approx(wanted, rel=1e-3)


def test_mixing_reports_totals(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = mixing.document_rates(docs, labels).toPandas()
    for d, share in zip(mixing.DOMAINS, mixing.TARGETS, strict=True):
        assert out[f"wanted_{d}"].iloc[0] == pytest.approx(share / mixing.TARGETS[0] * out.wanted_good.iloc[0])
        assert (out.n_tokens * out[f"p_{d}"] * out.rate).sum() == pytest.approx(out[f"reached_{d}"].iloc[0], rel=1e-6) == pytest.approx(out[f"wanted_{d}"].iloc[0], rel=1e-3)


@pytest.mark.parametrize("volume", [None, 0.3])
def test_mixing_keeps_target_totals(spark, monkeypatch, volume):
    rng = np.random.default_rng(10)
    want = np.array([0.6, 0.3, 0.1])
    p = rng.dirichlet([3, 0.4, 0.2], 20_000)
    members = spark.createDataFrame([(i, 100, [float(x) for x in b]) for i, b in enumerate(p)], "doc_id long, n_tokens long, p array<double>")
    docs = members.select("doc_id", F.lit("x").alias("text"))
    monkeypatch.setattr(mixing, "posteriors", lambda docs, labels: members)
    kept = [r["doc_id"] for r in mixing.thin(docs, None, tuple(want), volume).collect()]
    fit = mixing.fitted(members, tuple(want), volume, once=True)
    wanted, reached = fit.wanted, fit.reached
    assert fit.shares == pytest.approx(want)  # no retreat unless asked for
    assert reached == pytest.approx(wanted, rel=1e-3) and wanted / wanted.sum() == pytest.approx(want, rel=1e-3)
    assert 100 * p[kept].sum(0) == pytest.approx(wanted, rel=0.05)


def test_mixing_keeps_the_least_volume(spark):
    rng = np.random.default_rng(11)
    hard = np.eye(3)[rng.choice(3, 5000, p=[0.9, 0.099, 0.001])]
    p, n = 0.99 * hard + 0.01 / 3, np.full(5000, 50)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    volumes = []
    for least in (0.0, 0.7):
        fit = mixing.fitted(members, (0.8, 0.1, 0.1), None, once=True, least=least)
        rate, wanted, reached = fit.rate, fit.wanted, fit.reached
        assert (fit.shares == pytest.approx(np.array([0.8, 0.1, 0.1]))) == (least == 0)
        r = np.array([x["r"] for x in members.select(rate.alias("r")).collect()])
        assert (r >= 0).all() and (r <= 1 + 1e-9).all() and (n * r) @ p == pytest.approx(reached, rel=1e-3)
        volumes.append(reached.sum() / n.sum())
    assert volumes[0] < 0.1 and volumes[1] > 0.68


def test_mixing_learns_from_every_label(spark):
    """Each document has a word of its own, which only its own label can tell of."""
    n = 4000
    docs = spark.createDataFrame([(i, f"own{i}x") for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    p = {r["doc_id"]: r["p"] for r in mixing.posteriors(docs, labels).collect()}
    assert np.mean([p[i][1 - i % 2] > 0.6 for i in range(n)]) > 0.9


def test_mixing_volume_is_that_of_all_rows(spark):
    """Sure posteriors: the scarcest domain tells how much can be kept; half of it lies in one row."""
    rows = [(10, [1.0, 0.0, 0.0])] * 30_000 + [(10, [0.0, 1.0, 0.0])] * 30_000 + [(5, [0.0, 0.0, 1.0])] * 4000 + [(20_000, [0.0, 0.0, 1.0])]
    members = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    fit = mixing.fitted(members, (0.45, 0.45, 0.1), None, once=True)
    assert fit.wanted == pytest.approx([180_000, 180_000, 40_000], rel=3e-3) and fit.reached == pytest.approx(fit.wanted, rel=1e-3)
    assert mixing.most_volume(lambda m: 100 * np.maximum(np.array([0.2, 0.3, 0.5]) @ np.maximum(np.eye(3) @ m, 0)[None].squeeze(), 0), np.array([40.0, 40.0, 20.0])) == pytest.approx(0.5, rel=1e-3)


def plain_nonnegative(a, t):
    """Nonnegative least squares by active sets (Lawson and Hanson): the totals nearest to t."""
    free, r = np.zeros(a.shape[1], bool), np.zeros(a.shape[1])
    for _ in range(1000):
        push = a.T @ (t - a @ r)
        if free.all() or push[~free].max() <= 1e-9 * np.abs(a.T @ t).max():
            break
        free[np.flatnonzero(~free)[push[~free].argmax()]] = True
        while True:
            z = np.zeros_like(r)
            z[free] = np.linalg.lstsq(a[:, free], t, rcond=None)[0]
            if (z[free] > 0).all():
                break
            low = free & (z <= 0)
            r = r + (r[low] / (r[low] - z[low])).min() * (z - r)
            free &= r > 1e-15
        r = z
    return a @ r


@pytest.mark.parametrize("seed", range(4))
def test_mixing_against_nonnegative_least_squares(spark, seed):
    """200 documents; targets within reach, and targets that no rates meet."""
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([[3, 0.4, 0.2], [0.3, 0.3, 0.3], [20, 4, 3], [9, 8, 1]][seed], 200)
    n = rng.integers(1, 300, 200)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    for want in ((0.6, 0.3, 0.1), (0.02, 0.08, 0.9), (0.96, 0.035, 0.005)):
        fit = mixing.fitted(members, want, 0.5)
        r = np.array([x["r"] for x in members.select(fit.rate.alias("r")).collect()])
        assert (r >= 0).all() and (n * r) @ p == pytest.approx(fit.reached, rel=1e-9)
        whiten = np.linalg.cholesky(np.linalg.inv((p * n[:, None]).T @ p)).T
        a, t = whiten @ (p.T * n), whiten @ (0.5 * n.sum() * np.array(want))
        best = plain_nonnegative(a, t)
        assert np.linalg.norm(whiten @ fit.reached - t) <= np.linalg.norm(best - t) + 2e-3 * np.linalg.norm(t)


def test_mixing_rates_shift_shares(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = mixing.document_rates(docs, labels).join(labels, "doc_id").toPandas()
    assert out[(out.quality == 1) & (out.toxic == 0)].rate.mean() > 1.3 * out[out.quality == 0].rate.mean()


# toxicity


def test_kernel_tolerates_gaps():
    like = lambda a, b: float((lambda x, y: sum(v * dict(zip(*y, strict=True)).get(c, 0) for c, v in zip(*x, strict=True)))(toxicity.features(a), toxicity.features(b)))
    assert like("idiot", "idiot") == pytest.approx(1)
    assert like("idiot", "idxiot") > like("idiot", "ration") + 0.2
    assert "idiot" in toxicity.units("i.d.i.o.t") and "stupid" in toxicity.chunks("you s t u p i d man")


def test_long_joined_runs_are_read():
    run = "you.are.an.i.d.i.o.t.and.the.whole.town.has.known.it.for.years"
    assert any("idiot" in u for u in toxicity.units(run)) and all(len(u) <= toxicity.LONGEST for u in toxicity.units(run))
    joined = "".join(run.split("."))
    for at in range(200):  # wherever the windows are cut
        assert any("idiot" in u for u in toxicity.units("." .join("ab" * at) + "." + run)), at
    assert set(joined) <= set("".join(toxicity.units(run)))


def test_table_lookup_equals_kernel():
    rng = np.random.default_rng(1)
    table = rng.normal(size=toxicity.SYMBOLS**3 + toxicity.SYMBOLS**2)
    words = ["idiot", "xx", "aaaa", "moron", "éléphant"]
    got = toxicity.decide(words, table[: toxicity.SYMBOLS**3], table[toxicity.SYMBOLS**3 :])
    for w, value in zip(words, got, strict=True):
        code, x = toxicity.features(w)
        assert value == pytest.approx(float((table[code] * x).sum()))


def test_toxicity_held_out(spark):
    clean = [sentence(i) for i in range(300)]
    rows = [(i, t if i % 5 else t.replace("fox", "scumbag loser"), None, None, 0) for i, t in enumerate(clean)] + [(1000, "you l.o.s.e.r scumxbag", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int("loser" in t)) for i, t, *_ in rows if i < 1000], LABELS)
    out = by_id(toxicity.toxicity(docs, labels), "held_out", "predicted")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (h, _) in out.items())
    held = [(i, p) for i, (h, p) in out.items() if h and i < 1000]
    assert np.mean([p == int("loser" in rows[i][1]) for i, p in held]) > 0.97
    assert out[1000][1] == 1


def test_toxicity_on_held_out_labels():
    import pyarrow.parquet as pq

    texts = dict(zip(*pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet", columns=["doc_id", "toxic"]).to_pylist()
    known = [(texts[r["doc_id"]] or "", r["toxic"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in labels if r["doc_id"] in texts and r["toxic"] is not None]
    machine = toxicity.fit(*map(list, zip(*[(t, y) for t, y, held in known if not held], strict=True)))
    held = [(t, y) for t, y, h in known if h]
    p = np.array(toxicity.score_texts([t for t, _ in held], machine, {})) >= 0.5
    y = np.array([y for _, y in held]) == 1
    assert (p & y).sum() / p.sum() > 0.7 and (p & y).sum() / y.sum() > 0.85, ((p & y).sum(), p.sum(), y.sum())


# nearest neighbours


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "FILE_BLOCK", 3000)  # so that vectors are spread over several blocks
    monkeypatch.setattr(ann, "QUERY_BLOCK", 50)
    rng = np.random.default_rng(7)
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = given.vec_id.to_numpy(), np.stack(given.embedding).astype(np.float32)
    ids, x = np.r_[ids, ids.max() + 1 + np.arange(9000)], np.r_[x, rng.normal(size=(9000, x.shape[1])).astype(np.float32)]
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = ann.search(table).toPandas()
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    hits, total, place = 0, 0, {v: i for i, v in enumerate(ids)}
    for q in np.flatnonzero(ids % 50 == 0):
        like = (x @ x[q]) / (norm * norm[q])
        like[q] = -9
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert list(own["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(own.score, [like[place[v]] for v in own.vec_id], atol=1e-12)
        hits += len(set(own.vec_id) & set(ids[np.argsort(-like, kind="stable")[:5]]))
        total += 5
    assert ann.DEPTH <= 0.05 and hits / total >= 0.9, hits / total


def test_neighbours_of_equal_cosine(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=8)
    rows = [(i, (v * (1 + 0.37 * i)).tolist()) for i in range(80)] + [(100 + i, rng.normal(size=8).tolist()) for i in range(300)] + [(1000, [1e200] * 8), (1001, [-0.0] * 7 + [1e-300]), (1050, [0.0] * 7 + [1e-300])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().sort_values(["query_id", "rank"])
    assert list(out[out.query_id == 0].vec_id) == [1, 2, 3, 4, 5] and list(out[out.query_id == 50].vec_id) == [0, 1, 2, 3, 4]
    assert np.allclose(out[out.query_id == 0].score, 1) and out.score.notna().all()
    assert list(out[out.query_id == 1050].vec_id)[0] == 1001


def test_neighbours_of_repeated_ids_and_more_columns(spark):
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "b"), (0, [0.0, 1.0], "c"), (1, [1.0, 0.1], "d"), (1, [1.0, 0.2], "e"), (2, [0.1, 1.0], "f")]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string").withColumn("score", F.lit(1)).withColumn("h", F.lit(2))).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]


def test_files_rank_by_footrule():
    rng = np.random.default_rng(1)
    pivots, prefix = 20, 6
    perm = np.stack([rng.permutation(pivots)[:prefix] for _ in range(200)]).astype(np.int16)
    query = rng.permutation(pivots)[:prefix]

    def footrule(a, b):
        places = [{p: i for i, p in enumerate(x)} for x in (a.tolist(), b.tolist())]
        return sum(abs(places[0].get(p, prefix) - places[1].get(p, prefix)) for p in range(pivots))

    want = [footrule(query, p) for p in perm]
    got = prefix * (prefix + 1) - 2 * ann.Files(perm, pivots).shared(query)
    assert got.tolist() == want


def test_neighbours_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(50, [1.0, 2.0, 3.0]), (51, [3.0, 2.0, 1.0]), (100, [-1.0, 0.5, 0.0]), (150, None), (200, [0.0, 0.0, 0.0]), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]), (54, [float("inf"), 1.0, 1.0]), (55, [1.0])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = {q: [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] for q in {r["query_id"] for r in out}}
    assert set(got) == {0, 50, 100}
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4]
    few = ann.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 1)]


# urls


def test_url_rules_and_parts(spark):
    urls = {1: "http://A.Example.COM/en/70?x", 2: "https://example.com/en/8#y", 3: "x.net/de/1", 4: None, 5: "http://b.net/de/1", 6: "http://example.net/de/8", 7: "http://m.org", 8: "http://notexample.com/en/7", 9: "ftp://h?p/en/"}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert out == {
        1: ("a.example.com", "/en/70", "example.com/en/7", "allow"), 2: ("example.com", "/en/8", "com/en/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("b.net", "/de/1", "net/de/", "block"),
        6: ("example.net", "/de/8", "example.net/de/8", "block"), 7: ("m.org", "", None, "allow"), 8: ("notexample.com", "/en/7", "com/en/", "block"), 9: ("h", "", None, "allow"),
    }


def test_rules_are_the_contracts(spark):
    """The contract's rules, spelled out here: neither the operator nor the SQL made from its rules can vouch for them."""
    urls = {1: "http://a.com/en/1", 2: "http://example.com/en/7", 3: "http://b.net/de/1", 4: "http://example.net/de/7", 5: "http://w.example.net/de/81", 6: "http://c.org/es/"}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    bad = spark.createDataFrame([(i, 1) for i in urls], "page_id long, bad int")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_reputation.judge(pages, bad).collect()} == {
        1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("net/de/", "allow"), 5: ("example.net/de/8", "block"), 6: ("org/es/", "block"),
    }


def test_reputation_shrinks(spark):
    hosts = ["bad.spam.test"] * 40 + ["one.spam.test"] + ["good.fine.test"] * 40 + ["new.fine.test"] + ["bad.spam.test:8080"]
    pages = spark.createDataFrame([(i, f"http://{h}/x/{i}", "z", 1.5) for i, h in enumerate([*hosts, *hosts[:1]])], "page_id long, url string, host string, a double")
    outcomes = spark.createDataFrame([(i, int(i <= 40)) for i in range(81)] + [(None, 1), (3, None)], "page_id long, bad int")
    out = {r["host"]: (r["verdict"], r["host_rate"]) for r in url_reputation.judge(pages, outcomes).collect()}
    assert url_reputation.judge(pages, outcomes).count() == len(hosts) + 1  # a repeated row and clashing columns
    assert out["bad.spam.test"][0] == "block" and out["good.fine.test"][0] == "allow"
    assert out["new.fine.test"][1] < 0.5 < out["one.spam.test"][1] < out["bad.spam.test"][1] + 0.2
    assert all(v == "allow" for v, _ in ((r["verdict"], 0) for r in url_reputation.judge(pages, outcomes, limit=1.0).collect()))
    unknown = {r["verdict"] for r in url_reputation.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert unknown == {"allow"}


def test_posterior_tail_like_drawn_rates(spark):
    rng = np.random.default_rng(2)
    shapes = [(a, b) for a in (2.5, 8.0, 40.0) for b in (3.0, 20.0, 90.0)]
    table = spark.createDataFrame(shapes, "a double, b double")
    for limit in (0.1, 0.3, 0.6):
        got = {(r["a"], r["b"]): r["over"] for r in table.select("a", "b", url_reputation.surely_over(F.col("a"), F.col("b"), limit).alias("over")).collect()}
        for a, b in shapes:
            chance = (rng.beta(a, b, 200_000) > limit).mean()
            if abs(chance - url_reputation.SURE) > 0.008:
                assert got[a, b] == (chance > url_reputation.SURE), (a, b, limit, chance)


def test_registered_domains(spark):
    want = {"a.b.example.com": ("example.com", "com"), "x.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "example.com:8080": ("example.com", "com"), "w.example.org.": ("example.org", "org"), "10.0.0.7:80": ("10.0.0.7",) * 2, "localhost": ("localhost",) * 2, "": ("",) * 2}
    domain, suffix = url_reputation.levels(F.col("h"))
    got = {r["h"]: (r["d"], r["s"]) for r in spark.createDataFrame([(h,) for h in want], "h string").select("h", domain.alias("d"), suffix.alias("s")).collect()}
    assert got == want


# licences


def test_licenses_against_brute_force(spark, docs):
    extra = [(10**6, "UNDER the MIT license; under the mit license! cc-by-nc cc by nc cc"), (10**6 + 1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (10**6 + 2, "é the général public licence of the software")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = by_id(licenses.scan(table), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    for r in table.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
        at = [(i, x) for p, x in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert got[r["doc_id"]][:5] == (len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))), r["doc_id"]
    assert got[10**6 + 1][5] == "mit" and got[10**6 + 2][5] == ""


def test_licenses_of_several_notices(spark):
    notices = [*combinations(licenses.TEMPLATES, 2), *[pair[::-1] for pair in combinations(licenses.TEMPLATES, 2)], *combinations(licenses.TEMPLATES, 3), licenses.TEMPLATES]
    plain = [(10**6 + i, sentence(i)) for i in range(200)]
    table = spark.createDataFrame([(i, f" {sentence(i, 5)} ".join(words for _, words, _ in some)) for i, some in enumerate(notices)] + plain, "doc_id long, text string")
    got = by_id(licenses.scan(table), "labels")
    for i, some in enumerate(notices):
        assert {label for label, _, _ in some} <= set(got[i][0].split(",")), some
    assert all(got[i] == ("",) for i, _ in plain)


def test_key_phrases_have_to_stand_in_the_notice(spark):
    label, notice, key = licenses.TEMPLATES[-1]
    broken = notice.replace(key, "other words stand")
    texts = [f"{key} of {sentence(1, 30)} {broken}", f"so {broken}", f"so {notice}", f"{sentence(2, 9)} {notice} {key}", notice.replace("subject to", "subject only to")]
    table = spark.createDataFrame(list(enumerate(texts)) + [(100 + i, sentence(i)) for i in range(100)], "doc_id long, text string")
    got = by_id(licenses.scan(table), "labels")
    assert [got[i][0] for i in range(5)] == ["", "", label, label, label]


def test_inserted_words_cost_no_votes(spark):
    """Up to ``SLACK`` words put into a notice, outside its key phrase, shift the rest; votes meet at the phrase all the same."""
    texts = []
    for i, (_, words, key) in enumerate(licenses.TEMPLATES):
        w = words.split()
        first = len(words[: words.index(key)].split())
        last = first + len(key.split())
        at = first // 2 if first else last + (len(w) - last) // 2
        texts.append(" ".join([*w[:at], *["so", "much"][: 2 if 0 < at < len(w) else 0], *w[at:]]))
    table = spark.createDataFrame([*enumerate(texts), *[(100 + i, sentence(i)) for i in range(200)]], "doc_id long, text string")
    got = by_id(licenses.scan(table), "labels", "score")
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i][0].split(",") and got[i][1] == pytest.approx(1.0), (texts[i], got[i])


def test_common_words_make_up_for_no_rare_ones(spark):
    """Words that every file holds weigh next to nothing: the template's rare words have to be there."""
    notice = next(words for label, words, _ in licenses.TEMPLATES if label == "bsd")
    kept = "redistribution and use in source and binary forms"
    rows = [(i, f"{kept} {sentence(i)}") for i in range(300)] + [(1000, notice), (1001, kept)]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")), "labels")
    assert got[1000] == ("bsd",) and got[1001] == ("",) and got[5] == ("",)


def test_places_are_kept_beside_a_key_phrase_only(spark):
    """A text without a key phrase can have no notice, so its words count for frequencies and no array of places is made."""
    texts = ["Source code, software and more SOURCE", "the Licensed software: MIT License", "this wor\u212a has the mit license"]
    got = {r["doc_id"]: r for r in licenses.read(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    vocabulary = licenses.anchors()
    assert set(got[0]["kinds"]) == {"source", "code", "software"} and got[0]["held"] == []
    assert [(h["at"], vocabulary[h["word"] - 1]) for h in got[1]["held"]] == [(1, "licensed"), (2, "software"), (3, "mit"), (4, "license")]
    assert [(h["at"], vocabulary[h["word"] - 1]) for h in got[2]["held"]] == [(4, "mit"), (5, "license")]  # a Kelvin sign is no k


# n-gram join


def test_near_duplicates_against_brute_force(spark):
    base = [sentence(i, 60) for i in range(6)]
    texts = []
    rng = np.random.default_rng(3)
    for b in base:
        texts += [b, b.upper(), b + " extra"]
        for _ in range(12):
            w = b.split()
            for _ in range(int(rng.integers(1, 4))):
                w[int(rng.integers(len(w)))] = f"w{int(rng.integers(999))}"
            texts.append(" ".join(w))
    texts += ["one two", "one two", "one three", "", "", "..."]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    sets = []
    for t in texts:
        w = re.findall(r"\w+", t.lower())
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {("#", t)})
    links = {(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    root = list(range(len(texts)))
    for i, j in sorted(links):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    got = by_id(ngram_join.near_duplicates(docs), "class_id", "n_links")
    degree = [sum(i in pair for pair in links) for i in range(len(texts))]
    assert got == {i: (root[i], degree[i]) for i in range(len(texts))}
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs).collect()}
    assert kept == set(root)


def test_banding_is_the_steepest_within_its_cost():
    bands, rows = ngram_join.banding(0.8, 0.9999)
    assert bands * rows <= ngram_join.HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert ngram_join.band_count(0.8, 0.9999, rows + 1) * (rows + 1) > ngram_join.HASHES


def test_ids_that_repeat_with_other_texts(spark):
    near = sentence(1, 50)
    rows = [(1, near), (1, sentence(2, 50)), (2, near + " more"), (2, sentence(3, 50)), (2, sentence(3, 50)), (3, near + " again"), (4, sentence(2, 50))]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (2, 1, 2), (2, 2, 1), (2, 2, 1), (3, 1, 2), (4, 1, 1)]
    assert sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()) == sorted([(1, near), (1, sentence(2, 50)), (2, sentence(3, 50))])


def test_one_group_of_thousands_of_near_copies(spark):
    base = sentence(1, 120).split()
    texts = [" ".join([*base[: i % 110], f"x{i}", *base[i % 110 + 1 :]]) for i in range(3000)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA).repartition(8)
    got = by_id(ngram_join.near_duplicates(docs), "class_id", "n_links")
    grams = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for t in texts)]
    for i in range(0, 3000, 500):
        assert got[i] == (0, sum(j != i and len(grams[i] & g) >= 0.8 * len(grams[i] | g) for j, g in enumerate(grams))), i
    assert {c for c, _ in got.values()} == {0}


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    base = sentence(1, 80).split()
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(5, 75)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for t in texts]
    degree = [sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = by_id(ngram_join.near_duplicates(docs), "class_id", "n_links")
    assert got == {i: (0, degree[i]) for i in range(len(texts))}


# secrets


def test_secrets_base_spans(spark):
    texts = ["password: secret: abcdefghijklmn", 'API_KEY = "abcd.efgh+ijkl" token=short', "AKIA" + "A1" * 7 + " AKIA123 AKIAAKIA" + "Z" * 20, "😂 deadbeefdeadbeef0 DEADBEEFDEADBEEF", "x" * 50, "key xK9fQ2mZ7pLw3VbN8tRy5HcJ1sDg6AeU0oXiqWE4 end"]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = by_id(secrets.digest(secrets.find_secrets(docs)), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for i, t in enumerate(texts):
        out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))
        assert got[i][:4] == (*[sum(x[3] == k for x in out) for k in secrets.BASE_KINDS], hashlib.sha256(joined.encode()).hexdigest())
    assert "random:4:" in got[5][4] and got[4][4] == ""
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(docs).collect()}
    assert clean[3] == ("😂 [SECRET] DEADBEEFDEADBEEF", len(clean[3][0])) and clean[4] == ("x" * 50, 0)


def test_glued_and_alphabetic_keys_are_found(spark):
    rng = np.random.default_rng(6)
    chars = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    texts, held = [], []
    for i in range(240):
        before = ("/api/v1/users/session/verify/", "AWS_SECRET_ACCESS_KEY=", "see ")[i % 3]
        key = "".join(rng.choice(chars[:52] if i % 3 == 2 else chars, 48))
        texts.append(f"{sentence(i)} {before}{key} {sentence(i + 1000)}")
        held.append((len(sentence(i)) + 1 + len(before), len(sentence(i)) + 1 + len(before) + len(key)))
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = by_id(secrets.find_secrets(docs), "found")
    clean = by_id(secrets.redact(docs), "text")
    share = [[], [], []]
    for i, (start, stop) in enumerate(held):
        spans = [(s["start"], s["stop"]) for s in got[i][0]]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        share[i % 3].append(sum(max(0, min(e, stop) - max(s, start)) for s, e in spans) >= 0.8 * (stop - start))
        assert (secrets.MARK in clean[i][0]) == bool(spans)
    assert all(np.mean(s) > 0.9 for s in share), [np.mean(s) for s in share]


def test_battery_tells_random_from_writing():
    rng = np.random.default_rng(0)
    random = ["".join(rng.choice(list("0123456789abcdefghijklmnopqrstuvwxyz"), 40)) for _ in range(50)]
    even = dict.fromkeys(secrets.ENCODINGS, 1.0)
    assert np.mean([secrets.battery(r, even)[1] > secrets.REJECT for r in random]) > 0.9
    assert secrets.battery("a1" * 20, even)[1] < secrets.REJECT


def test_unevenness_of_the_corpus(spark):
    even = "abcdefghijklmnopqrstuvwxyz"
    got = secrets.unevenness(spark.createDataFrame([(t,) for t in [even * 9 + "eeeeé", None, even.upper() + "A" * 99]], "text string").repartition(3))
    lower = np.full(26, 10.0)
    lower[4] += 4
    assert got["lower"] == pytest.approx(max(secrets.EVENEST, 26 * ((lower / lower.sum()) ** 2).sum() - 1))
    assert got["upper"] == secrets.MOST_UNEVEN["upper"] and all(secrets.EVENEST <= v <= secrets.MOST_UNEVEN[k] for k, v in got.items())


def test_false_discoveries_and_power_by_length(spark):
    """Planted random strings of three lengths among long words of writing: what is reported, and what wrongly."""
    rng = np.random.default_rng(12)
    chars = np.array(list(secrets.ENCODINGS["base62"]))
    names = "session connection entity resource presentation international interest another statement retention sensor notation tenant instance assessment sentence".split()
    texts, planted = [], []
    for i in range(400):
        written = "".join(w.capitalize() for w in rng.choice(names, 5)) + str(rng.integers(100))  # a long name made of words
        key = "".join(rng.choice(chars, (24, 40, 64)[i % 3])) if i % 4 == 0 else ""
        texts.append(f"{sentence(i, 30)} {written} {sentence(i + 900, 5)} {key}")
        planted.append(key)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(secrets.find_secrets(table), "found")
    hits, wrong, found = {24: [], 40: [], 64: []}, 0, 0
    for i, (text, key) in enumerate(zip(texts, planted, strict=True)):
        spans = [text[s["start"] : s["stop"]] for s in got[i][0]]
        found += len(spans)
        wrong += sum(s not in key for s in spans)
        if key:
            hits[len(key)].append(any(s in key and len(s) >= 0.8 * len(key) for s in spans))
    assert wrong <= max(2, 0.05 * found), (wrong, found)
    assert np.mean(hits[64]) > 0.9 and np.mean(hits[40]) > 0.8, {k: np.mean(v) for k, v in hits.items()}


# packing


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    extra = ["Don't STOP we'll é x²³ ¼½ 'tis ''s 12345", "ΑΒΣ <|endoftext|> hi", "İstanbul ǅ ß ẞ", "a\x85b \x1cc", "word " * 9000, ""]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    out = packing.pack(table, queries.tokenizer_path()).toPandas()
    for r in table.collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        own = out[out.doc_id == r["doc_id"]].sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert list(own.start) == [0, *own.length.cumsum()[:-1]]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    padding = 0
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        total = s.length.sum()
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and total <= 4096
        padding += 0 if total & (total - 1) == 0 else 4096 - total
    assert padding <= 0.01 * out.length.sum()


def test_fill_has_least_slack():
    rng = np.random.default_rng(2)
    for _ in range(60):
        window = int(rng.integers(20, 60))
        lengths = rng.integers(1, window, 8).tolist()
        counts = {x: lengths.count(x) for x in lengths}
        first = max(lengths)
        rest = list(lengths)
        rest.remove(first)
        best = max(first + sum(c) for k in range(len(rest) + 1) for c in combinations(rest, k) if first + sum(c) <= window)
        chosen = packing.fill(counts, window, first)
        assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items())


# fingerprints


def test_fingerprints_are_stored_compressed(spark, tmp_path, monkeypatch):
    """The fingerprints are Parquet in the shared folder, not a checkpoint."""
    monkeypatch.setattr(simhash, "shared_folder", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(i, f"some words {i}", None, None, 0) for i in range(3)], SCHEMA)
    assert simhash.near_fingerprints(docs).count() == 3
    at = next(tmp_path.iterdir())
    assert at.name.startswith("fingerprints-") and spark.read.parquet(str(at)).count() == 3


def test_simhash_neighbours_and_near_counts(spark):
    texts = [sentence(i, 60) for i in range(30)] + [sentence(0, 60)] * 3 + [sentence(1, 60) + " end", "", "word"]
    docs = spark.createDataFrame([(i * 7, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = by_id(simhash.near_fingerprints(docs), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")
    prints = [simhash.fingerprint(t) for t in texts]
    for i, t in enumerate(texts):
        following = (i - 1) % len(texts)
        new = simhash.edited(t, texts[following])
        other = simhash.fingerprint(new)
        near = sum(j != i and (prints[i] ^ prints[j]).bit_count() <= 3 for j in range(len(texts)))
        assert got[i * 7] == (len(t), hashlib.sha256(new.encode()).hexdigest(), f"{prints[i]:016x}", f"{other:016x}", simhash.likeness(prints[i], other), simhash.likeness(prints[i], prints[following]), near)


def test_neighbours_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 7)
    texts = [sentence(i, 12) for i in range(100)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = by_id(simhash.fingerprints(docs), "edited_sha256")
    assert got == {i: (hashlib.sha256(simhash.edited(t, texts[i - 1]).encode()).hexdigest(),) for i, t in enumerate(texts)}


def test_tables_hold_every_near_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    prints = sorted({centre ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 5)))) for _ in range(150)})
    out = simhash.near_counts(spark.createDataFrame([(p,) for p in prints], "bits long"))
    assert {r["bits"]: r["near"] for r in out.collect()} == {p: sum(q != p and (p ^ q).bit_count() <= 3 for q in prints) for p in prints}


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns, name
        assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
        before = after
    assert before.count() > 0.5 * docs.count()
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
