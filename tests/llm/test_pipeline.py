"""Each stage of the pipeline, and run(), against plain single-machine versions on planted documents."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from dunecorpus.llm import mixing, queries, toxicity
from tests.llm.test_operators import LABELS, SCHEMA, sentence

SECRET = "AKIA" + "Q7" * 9


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with insults, near copies, secrets, nulls and a repeated row, and labels of most."""
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = []
    for i in range(320):
        text = sentence(i, 45)
        if i % 8 == 1:
            text = text.replace("fox", "scumbag").replace("moon", "loser") + " scumbag loser"
        if i % 20 == 3:
            text = sentence(i - 1, 45) + " tail"  # like the one before
        if i % 16 == 5:
            text += f" key {SECRET} end"
        rows.append((i, text))
    rows += [(1000, None), (1001, ""), (None, "nobody's " + sentence(999, 30)), (1002, sentence(50, 45)), (40, sentence(40, 45))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    labels = [(i, int(i % 7 > 0), int("scumbag" in (t or ""))) for i, t in rows if i is not None and i % 11]
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def steps(spark, folder):
    """What each stage got and gave, as rows."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder).checkpoint()
        out[name] = (docs.collect(), after.collect(), docs, after)
        docs = after
    return out


def key(rows):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows), key=str)


def test_toxic_documents_go(spark, folder, steps):
    before, after, docs, _ = steps["toxicity"]
    machine = toxicity.fit(*toxicity.sample(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    scores = toxicity.score_texts([r["text"] or "" for r in before], machine, {})
    assert key(after) == key([r for r, p in zip(before, scores, strict=True) if p < 0.5])
    assert not any("scumbag" in (r["text"] or "") for r in after) and len(after) > 0.8 * len(before) - 45


def test_one_of_each_class_stays(steps):
    before, after, _, _ = steps["near_duplicates"]
    rows = sorted((r for r in before if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    grams = []
    for r in rows:
        w = re.findall(r"\w+", (r["text"] or "").lower())
        k = min(5, len(w))
        grams.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {(r["text"] or "",)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    want = [rows[i] for i in sorted(set(root))] + [r for r in before if r["doc_id"] is None]
    assert key(after) == key(want) and len(want) < len(before)


def test_secrets_are_masked_and_all_stay(steps):
    before, after, _, _ = steps["secrets"]
    want = []
    for r in before:
        text = r["text"] and r["text"].replace(SECRET, "[SECRET]")
        want.append({**r.asDict(), "text": text, "n_chars": r["n_chars"] if text == r["text"] else len(text)})
    assert key(after) == key(want) and any(SECRET in (r["text"] or "") for r in before)


def test_mixing_keeps_by_rate_and_draw(spark, folder, steps):
    before, after, docs, _ = steps["mixing"]
    members = mixing.posteriors(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("doc_id is not null").collect()
    p, n = np.array([r["p"] for r in members]), np.array([r["n_tokens"] for r in members], float)
    kept = {r["doc_id"] for r in after}
    assert key(after) == key([r for r in before if r["doc_id"] in kept])
    assert sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)
    stay = np.array([r["doc_id"] in kept for r in members])
    assert n[stay].sum() > (corpus_pipeline.LEAST - 0.08) * n.sum()
    # the shares lie between those asked for and those before
    shares, given = n[stay] @ p[stay] / n[stay].sum(), n @ p / n.sum()
    assert all(min(a, b) - 0.05 <= x <= max(a, b) + 0.05 for x, a, b in zip(shares, corpus_pipeline.TARGETS, given, strict=True))


def test_packing_holds_every_token(steps):
    from tokenizers import Tokenizer

    before, after, _, _ = steps["packing"]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((str(r["doc_id"]), zlib.crc32(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in before)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in after if r["length"] == r["doc_tokens"]) == [w for w in want if w in {(str(r["doc_id"]), r["ids_crc32"]) for r in after}]
    total = {}
    for r in after:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    tokens = {}
    for r in before:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert total == tokens


def test_run_is_the_stages_in_a_row(spark, folder, steps):
    got = corpus_pipeline.run(spark, folder)
    tokens = lambda rows: sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in rows)
    a, b = {}, {}
    for rows, out in ((got.collect(), a), (steps["packing"][1], b)):
        for i, _, n, _ in tokens(rows):
            out[i] = out.get(i, 0) + n
    assert a == b and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_take_empty_tables(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_texts_go_to_python_in_small_batches(spark, folder):
    """An executor has a batch several times over; a longer text goes alone and whole."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    docs = spark.range(0, 41, 1, 1).select(F.expr("repeat('x', if(id = 7, 9000000, 1000000))").alias("text"))
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, spark.createDataFrame([], SCHEMA), folder)
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 41 and sum(r["size"] for r in got) > 49e6, name
        assert max(r["size"] for r in got) < corpus_pipeline.BATCH_BYTES + 9_100_000, name
        assert max(r["n"] for r in got) <= 5, name


def test_packing_with_few_kept_words_gives_the_same_pieces(spark, steps):
    from dunecorpus.llm import packing

    docs = steps["mixing"][3]
    few, many = (sorted(map(tuple, packing.pack(docs, queries.tokenizer_path(), words=n).collect()), key=str) for n in (5, packing.WORDS))
    assert few == many and few
    tokens = packing.Tokens(queries.tokenizer_path(), 5)
    for i in range(40):
        tokens.encode([f"a{i} b{i} c"])
        assert len(tokens.ids) <= 5
