"""Queries without SQL against plain single-machine versions on the same rows."""

import re
import unicodedata

import pytest
import regex

from dunecorpus.functions import chars as C
from dunecorpus.functions import text
from dunecorpus.operators import minhash
from dunecorpus.plans import registry
from dunecorpus.plans.corpus import corpus

SF = "/root/testdata/sf0.001"


def own(pattern: str):
    """A pattern of ours for the regex module: code points by number become characters."""
    return regex.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))


EMOJI, ZWJ = f"[{C.EMOJI}]", "\u200d"
PHRASE, WORDS = re.compile(r"(.{12,}?)\1{2,}", re.S), re.compile(r"(\S+)(?:\s+\1\b){4,}")


def nfkc(t):
    return unicodedata.normalize("NFKC", t)


def invisible(t):
    t = own(f"[{C.ZERO_WIDTH}]").sub("", t)
    return own(rf"(?<!{EMOJI}){ZWJ}|{ZWJ}(?!{EMOJI})").sub("", t)


def phrases(t):
    return PHRASE.sub(r"\1\1", t)


def words(t):
    return WORDS.sub(r"\1 \1", t)


def punctuation(t):
    return regex.sub(r"([!?؟,،])\1{2,}", r"\1\1", regex.sub(r"\.{2,}", "...", t))


def spaces(t):
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", t)).strip()


def sub(pattern, to):
    return lambda t: own(pattern).sub(to, t)


SHARED = [sub(r"(\p{L})\1{2,}", r"\1\1"), punctuation, sub(f"({C.GRAPHEME})({C.GRAPHEME})(?:{C.GRAPHEME})+", r"\1\2"), spaces]
COMMENT = [nfkc, invisible, sub(f"[{C.TACHKIL}]", ""), sub(text.MENTION, " [MENTION] "), sub(text.URL, " [URL] "), sub(text.TIMESTAMP, " "), phrases, words, *SHARED]
FORUM = [nfkc, sub(text.WIDGET, ""), sub(text.QUOTE, ""), sub(text.BBCODE, ""), sub(C.TATWEEL + "+", ""), sub(f"[{C.TACHKIL}]", ""), sub(text.URL, " [URL] "), *SHARED]


def letters_left(t, placeholders):
    t = re.sub(r"\[MENTION\]|\[URL\]", "", t) if placeholders else t
    return len(own(rf"[^\p{{L}}\p{{N}}_{C.ARABIC_BASIC}]").sub("", own(EMOJI).sub("", t)))


@pytest.fixture(scope="module")
def rows(spark):
    return corpus(spark, SF).collect()


@pytest.mark.parametrize("name, rule", [("c1_nfkc", nfkc), ("c7_repeated_phrases", phrases), ("c8_repeated_words", words)])
def test_rules(spark, rows, name, rule):
    import hashlib

    got = {r["doc_id"]: (r["digest"], r["n_chars"]) for r in registry.queries()[name](spark, SF).collect()}
    for r in rows:
        want = None if r["text"] is None else rule(r["text"])
        assert got[r["doc_id"]] == ((None, None) if want is None else (hashlib.md5(want.encode()).hexdigest(), len(want))), r["doc_id"]


@pytest.mark.parametrize("name, rules", [("c_comment_pipeline", COMMENT), ("c_forum_pipeline", FORUM)])
def test_pipelines(spark, rows, name, rules):
    want: dict = {}
    for r in rows:
        t = r["text"]
        if t is not None:
            for rule in rules:
                t = rule(t)
        docs, dropped, chars = want.get(r["source"], (0, 0, None))
        if t is not None and letters_left(t, rules is COMMENT) >= 2:
            want[r["source"]] = (docs + 1, dropped, (chars or 0) + len(t))
        else:
            want[r["source"]] = (docs, dropped + 1, chars)
    assert {r["source"]: (r["docs"], r["dropped"], r["n_chars"]) for r in registry.queries()[name](spark, SF).collect()} == want


def test_digests(spark, rows):
    got = {r["doc_id"]: r["digest"] for r in registry.queries()["d2_minhash"](spark, SF).collect()}
    for r in rows:
        if r["doc_id"] >= 0:
            form = " ".join((r["text"] or "").strip().lower().split())
            assert got[r["doc_id"]] == "".join(f"{v:08x}" for v in minhash._signature(form)[:8])


def test_each_file_is_taken_once(spark, rows):
    log = registry.queries()["i1_incremental"](spark, SF).collect()
    assert sorted(r["batch"] for r in log) == [0, 1] and sum(r["collected"] for r in log) == sum(r["doc_id"] >= 0 for r in rows)
    assert all(r["collected"] == r["retained"] + r["dropped"] for r in log)


def test_clusters_hold_every_vector(spark):
    out = registry.queries()["m7_kmeans"](spark, SF).collect()
    assert sum(r["n"] for r in out) == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_machines_beat_the_toss(spark):
    out = {r["machine"]: r["accuracy"] for r in registry.queries()["m6_machines"](spark, SF).collect()}
    assert set(out) == {"linear", "radial", "forest"} and all(0.3 <= a <= 1 for a in out.values())


def test_hidden_states_name_every_turn(spark):
    out = registry.queries()["m3_hidden_states"](spark, SF).collect()
    assert len({r["id"] for r in out}) == len(out) and {r["predicted"] for r in out} <= {"user", "assistant", "system"}


def test_subword_measures(spark, rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    texts = {r["doc_id"]: (r["lang"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["lang"]: r["fertility"] for r in registry.queries()["a39_subword_fertility"](spark, SF).collect()}
    for lang in {x for x, _ in texts.values()} | {"ALL"}:
        some = [t for x, t in texts.values() if lang in (x, "ALL")]
        pieces = sum(len(e.ids) for e in own.encode_batch(some, add_special_tokens=False))
        assert got[lang] == pytest.approx(pieces / sum(len(t.split()) for t in some), abs=2e-6)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wrong = sorted(i for i, (_, t) in texts.items() if model.decode(model.encode(t)) != t)
    row = registry.queries()["a41_round_trips"](spark, SF).first()
    assert (row["texts"], row["mismatches"], row["samples"]) == (len(texts), len(wrong), wrong[:5])
