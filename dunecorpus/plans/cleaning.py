"""C1 to C21 and the scalar functions P1 to P30, each over the whole corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dunecorpus.functions import chars as C
from dunecorpus.functions import ids, script, text, tokens
from dunecorpus.plans.corpus import WITH, corpus, quoted, table
from dunecorpus.plans.registry import add, query

# RE2 knows no (?U); these are the same classes in its words.
STRIP = r"^[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+$"
BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+"


def r(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(to)}, 'g')"


def chain(expr: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        expr = r(expr, pattern, to)
    return expr


# RE2's \b knows ASCII alone: the neighbours are matched and put back, twice because they may be shared.
TIME = r"(^|[^\p{L}\p{N}_])\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?($|[^\p{L}\p{N}_])"
TIMES = ((TIME, r"\1 \2"),) * 2
PUNCT = ((r"\.{2,}", "..."), *((f"({p}){p}{{2,}}", r"\1\1") for p in C.PUNCTUATION))
SPACES = ((r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (STRIP, ""))
LEFT = ((text.PLACEHOLDERS, ""), (f"[{C.EMOJI}]", ""), (rf"[^\p{{L}}\p{{N}}_{C.ARABIC_BASIC}]", ""))
CHARS = "regexp_extract_all(text, '(?s).')"
GRAPHEMES = f"({C.GRAPHEME})({C.GRAPHEME})(?:{C.GRAPHEME})+"


#: RE2 has no look-around: what is kept has a private character meanwhile.
BBCODE = r"\[/?[a-zA-Z]+(?:=[^\]]*)?\s*\]"
KEPT_JOINER = "\\1\ue000\\2"


def rule(name: str, f, sql: str | None) -> None:
    """One cleaning rule: per document the digest and length of what it leaves."""

    def run(spark, sf_dir):
        t = corpus(spark, sf_dir).select("doc_id", f(F.col("text")).alias("t"))
        return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))

    add(name, run, sql and f"{WITH} SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n_chars FROM (SELECT doc_id, {sql} AS t FROM corpus)")


rule("c1_nfkc", text.nfkc, None)
rule("c2_strip_invisible", text.strip_invisible, f"replace({chain('text', (f'[{C.ZERO_WIDTH}]', ''), *((f'([{C.EMOJI}]){C.ZWJ}([{C.EMOJI}])', KEPT_JOINER),) * 2, (C.ZWJ, ''))}, chr(57344), chr(8205))")
rule("c3_strip_tachkil", text.strip_tachkil, r("text", f"[{C.TACHKIL}]", ""))
rule("c4_mentions", text.replace_mentions, r("text", text.MENTION, " [MENTION] "))
rule("c5_urls", text.replace_urls, r("text", text.URL, " [URL] "))
rule("c6_timestamps", text.strip_timestamps, chain("text", *TIMES))
rule("c7_repeated_phrases", text.collapse_phrases, None)
rule("c8_repeated_words", text.collapse_words, None)
rule("c10_punctuation", text.normalize_punctuation, chain("text", *PUNCT))
rule("c11_emoji_runs", text.collapse_emoji, r("text", GRAPHEMES, r"\1\2"))
rule("c12_whitespace", text.normalize_whitespace, chain("text", *SPACES))
rule("c13_near_empty", text.drop_near_empty, f"CASE WHEN length({chain('text', *LEFT)}) >= {text.MIN_LETTERS} THEN text END")
rule("c14_widget", text.strip_widget, r("text", text.WIDGET, ""))
rule("c15_quote", text.strip_quote, r("text", "اقتباس:\\s*\\nالمشاركة الأصلية كتبت بواسطة\\s+\\S+", ""))
rule("c16_bbcode", text.strip_bbcode, f"replace(replace({r('replace(replace(text, ' + quoted('[URL]') + ', chr(57344)), ' + quoted('[/URL]') + ', chr(57345))', BBCODE, '')}, chr(57344), '[URL]'), chr(57345), '[/URL]')")
rule("c17_tatweel", text.strip_tatweel, r("text", C.TATWEEL + "+", ""))
rule("c18_for_classification", text.clean_for_classification, chain("text", (r"\[MENTION\](?:\s*-\S{1,10})?", ""), (r"\[URL\]", ""), (r"[ \t]+", " "), (STRIP, "")))
rule("c19_noise", text.strip_noise, chain("text", (r"https?://\S+", " "), (r"@[\p{L}\p{N}_]+", " ")))
rule("c19_noise_marked", lambda t: text.strip_noise(t, "mark"), chain("text", (r"https?://\S+", "[URL]"), (r"@[\p{L}\p{N}_]+", "[MENTION]")))
rule("c20_shingle_form", text.shingle_form, r(f"lower({r('text', STRIP, '')})", BLANKS, " "))
rule("c21_dedup_key", lambda t: F.regexp_replace(F.lower(t), r"(?U)\s+", " "), r("lower(text)", BLANKS, " "))
rule("c21_dedup_key_spaces", lambda t: F.regexp_replace(F.lower(t), r"[ \t]+", " "), r("lower(text)", r"[ \t]+", " "))
rule("p14_prompt", lambda t: F.substring(t, 1, 500), "substring(text, 1, 500)")
rule("p27_bytes", lambda t: F.hex(F.encode(t, "utf-8")), "hex(encode(text))")


@query(f"{WITH}, c AS (SELECT doc_id, unnest({CHARS}) AS x, generate_subscripts({CHARS}, 1) AS i FROM corpus), p AS (SELECT doc_id, i, x, lag(x) OVER w = x AND lag(x, 2) OVER w = x AND regexp_full_match(x, '\\p{{L}}') AS out FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)), k AS (SELECT doc_id, string_agg(x, '' ORDER BY i) AS t FROM p WHERE out IS NOT TRUE GROUP BY doc_id) SELECT doc_id, md5(coalesce(t, '')) AS digest, CAST(length(coalesce(t, '')) AS BIGINT) AS n_chars FROM corpus LEFT JOIN k USING (doc_id)")
def c9_elongation(spark, sf_dir):
    t = corpus(spark, sf_dir).select("doc_id", text.collapse_elongation("text").alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


NATIVE = (text.strip_tachkil, text.replace_mentions, text.replace_urls, text.strip_timestamps, text.normalize_punctuation, text.normalize_whitespace)
NATIVE_SQL = chain("text", (f"[{C.TACHKIL}]", ""), (text.MENTION, " [MENTION] "), (text.URL, " [URL] "), *TIMES, *PUNCT, *SPACES)
SCRIPT_SQL = f"CASE WHEN regexp_matches(t, '[{C.ARABIC_FULL_BOM}]') AND regexp_matches(t, '[{C.LATIN_WIDE}]') THEN 'mixed' WHEN regexp_matches(t, '[{C.ARABIC_FULL_BOM}]') THEN 'arabic' WHEN regexp_matches(t, '[{C.LATIN_WIDE}]') THEN 'latin' ELSE 'other' END"


def toks(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {quoted(BLANKS)}), lambda x: x <> '')"


@query(
    f"""{WITH}, c AS (SELECT source, {NATIVE_SQL} AS t FROM corpus), k AS (SELECT source, t, length({chain('t', *LEFT)}) >= 2 AS kept FROM c)
SELECT source, CASE WHEN kept THEN {SCRIPT_SQL} END AS script, CAST(sum(kept::int) AS BIGINT) AS docs, CAST(sum((NOT kept)::int) AS BIGINT) AS dropped,
CAST(coalesce(sum(CASE WHEN kept THEN len({toks('t')}) END), 0) AS BIGINT) AS tokens, round(avg(CASE WHEN kept THEN len({toks('t')}) END), 6) AS mean_tokens FROM k GROUP BY ALL"""
)
def q0_clean_profile(spark, sf_dir):
    """Clean, drop near-empty texts, profile by source and script: the flagship query."""
    t = corpus(spark, sf_dir).select("source", "text")
    for f in NATIVE:
        t = t.withColumn("text", f("text"))
    t = t.select("source", F.explode(F.array(text.drop_near_empty("text"))).alias("t"))
    t = t.select("source", F.when(F.col("t").isNotNull(), script.script_of(F.col("t"))).alias("script"), F.when(F.col("t").isNotNull(), F.size(tokens.whitespace_tokens(F.col("t")))).alias("n"))
    return t.groupBy("source", "script").agg(F.count("n").alias("docs"), F.count_if(F.col("n").isNull()).alias("dropped"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("tokens"), F.round(F.avg("n"), 6).alias("mean_tokens"))


def clean_profile(name: str, rules) -> None:
    def run(spark, sf_dir):
        kept = text.clean(corpus(spark, sf_dir), rules=rules, keep_null=True)
        return kept.groupBy("source").agg(F.count("text").alias("docs"), F.count_if(F.col("text").isNull()).alias("dropped"), F.sum(F.length("text")).alias("n_chars"))

    add(name, run)


clean_profile("c_comment_pipeline", text.COMMENT_RULES)
clean_profile("c_forum_pipeline", text.FORUM_RULES)


def scalars(name: str, columns: dict, sql: str) -> None:
    """Scalar functions of the text, one column each; sql selects from tk(doc_id, text, w) with w the whitespace tokens."""

    def run(spark, sf_dir):
        return corpus(spark, sf_dir).select("doc_id", *[f(F.col("text")).alias(k) for k, f in columns.items()])

    add(name, run, f"{WITH}, tk AS (SELECT doc_id, text, text AS t, {toks('text')} AS w FROM corpus) SELECT doc_id, {sql} FROM tk")


def kind_sql(x: str, arabic: str = C.ARABIC_FULL, latin: str = C.LATIN_WIDE) -> str:
    return f"CASE WHEN regexp_matches({x}, '[{arabic}]') AND regexp_matches({x}, '[{latin}]') THEN 'mixed' WHEN regexp_matches({x}, '[{arabic}]') THEN 'arabic' WHEN regexp_matches({x}, '[{latin}]') THEN 'latin' ELSE 'digits_symbols' END"


def n_kind(kind: str, **classes) -> str:
    return f"len(list_filter(w, lambda x: {kind_sql('x', **classes)} = '{kind}'))"


def found(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {quoted(pattern)}))"


W = tokens.whitespace_tokens
BASIC = {"arabic": C.ARABIC_BASIC, "latin": C.LATIN_BASIC}
scalars("p1_counts", {"char_count": lambda t: F.length(t).cast("bigint"), "token_count": lambda t: F.size(W(t)).cast("bigint")}, "CAST(length(text) AS BIGINT) AS char_count, CAST(len(w) AS BIGINT) AS token_count")
scalars("p3_script", {"script": script.script_of}, f"{SCRIPT_SQL} AS script")
scalars("p5_document_class", {"bucket": lambda t: script.classify_document(W(t))}, f"CASE WHEN {n_kind('arabic')} + {n_kind('latin')} + {n_kind('mixed')} = 0 THEN NULL WHEN {n_kind('latin')} = 0 THEN 'arabic' WHEN {n_kind('arabic')} = 0 AND {n_kind('mixed')} = 0 THEN 'latin' ELSE 'mixed' END AS bucket")
_A, _L = found("text", f"[{C.ARABIC_THREE}]"), found("text", "[A-Za-z]")
scalars("p6_ratio_bucket", {"bucket": script.ratio_bucket}, f"CASE WHEN {_A} + {_L} = 0 THEN 'no_letters' WHEN {_A} / ({_A} + {_L}) >= 0.85 THEN 'arabic' WHEN {_A} / ({_A} + {_L}) <= 0.15 THEN 'latin' ELSE 'mixed' END AS bucket")
_D = {k: f"{n_kind(k, **BASIC)} / len(w)" for k in ("arabic", "latin", "mixed")}
scalars("p7_dominance", {"dominance": lambda t: script.dominance(W(t))}, f"CASE WHEN len(w) = 0 THEN 'Empty' WHEN {_D['arabic']} >= 0.7 THEN 'Arabic' WHEN {_D['latin']} >= 0.7 THEN 'Latin' WHEN {_D['arabic']} + {_D['latin']} + {_D['mixed']} >= 0.7 THEN 'Code-Switched' ELSE 'Symbols' END AS dominance")
WORDS_SQL = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: NOT regexp_full_match(x, '\p{Nd}+') AND x NOT IN ('url', 'mention'))"
scalars("p8_words", {"words": lambda t: F.md5(F.concat_ws(" ", tokens.words(t)))}, f"md5(array_to_string({WORDS_SQL}, ' ')) AS words")
scalars("p9_words_and_marks", {"tokens": lambda t: F.md5(F.concat_ws(" ", tokens.words_and_marks(t)))}, r"md5(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), ' ')) AS tokens")
scalars("p12_lexicon_hits", {"hits": lambda t: sum((F.lower(t).contains(w).cast("bigint") for w in ("the", "wach", "bezzaf", "und", "les")), F.lit(0).cast("bigint"))}, "CAST(" + " + ".join(f"contains(lower(text), '{w}')::int" for w in ("the", "wach", "bezzaf", "und", "les")) + " AS BIGINT) AS hits")
scalars("p13_keywords", {"matched": lambda t: t.rlike("(?i)password|licen[sc]e|السلام")}, "regexp_matches(text, '(?i)password|licen[sc]e|السلام') AS matched")
scalars("p15_label", {"label": lambda t: ids.parsed_label(F.concat(F.lit("Why: x\nLabel: "), F.substring(t, 1, 3), F.lit("\n")), ["the", "wac", "is", "la"])}, r"CASE WHEN lower(regexp_extract('Why: x' || chr(10) || 'Label: ' || substring(text, 1, 3) || chr(10), '(?im)^\s*label:\s*([^\s]+)', 1)) IN ('the', 'wac', 'is', 'la') THEN lower(regexp_extract('Why: x' || chr(10) || 'Label: ' || substring(text, 1, 3) || chr(10), '(?im)^\s*label:\s*([^\s]+)', 1)) ELSE 'parse_error' END AS label")
scalars("p16_first_words", {"head": lambda t: F.md5(F.concat_ws(" ", F.slice(W(t), 1, 100)))}, "md5(array_to_string(w[1:100], ' ')) AS head")
scalars("p19_sha1_id", {"id": lambda t: ids.external_id("fr", t)}, "'ext_fr_' || substring(sha1(text), 1, 16) AS id")


@query("SELECT doc_id, 'doc_' || source || '_' || doc_id AS id FROM documents")
def p2_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", F.lit("doc"), "source", "doc_id").alias("id"))


@query()
def p20_hash_buckets(spark, sf_dir):
    """Counts of hashed words and word pairs, as a bag of 200,000 buckets."""
    w = corpus(spark, sf_dir).select(tokens.words(F.col("text")).alias("w"))
    b = w.select(F.explode(F.concat(F.transform("w", lambda x: ids.hash_bucket("UNI:", x)), F.transform(tokens.neighbours(F.col("w")), lambda x: ids.hash_bucket("BI:", x)))).alias("bucket"))
    return b.groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"{WITH}, x AS (SELECT unnest({toks('text')}) AS x FROM corpus) SELECT {kind_sql('x')} AS kind, count(*) AS n FROM x GROUP BY ALL")
def p4_token_kinds(spark, sf_dir):
    t = corpus(spark, sf_dir).select(F.explode(W(F.col("text"))).alias("x"))
    return t.groupBy(script.classify_token(F.col("x")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"{WITH}, x AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM corpus WHERE regexp_matches(text, '[a-zA-Z]') AND {found('text', f'[{C.ARABIC_BASIC}]')} < 3) SELECT word, count(*) AS n FROM x GROUP BY ALL")
def p10_latin_words(spark, sf_dir):
    t = corpus(spark, sf_dir).where(F.col("text").rlike("[a-zA-Z]") & (F.regexp_count("text", F.lit(f"[{C.ARABIC_BASIC}]")) < 3))
    return t.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"{WITH}, x AS (SELECT unnest(regexp_extract_all(text, '[{C.ARABIC_BASIC}]+')) AS word FROM corpus WHERE regexp_matches(text, '[{C.ARABIC_BASIC}]') AND NOT regexp_matches(text, '[a-zA-Z]')) SELECT word, count(*) AS n FROM x GROUP BY ALL")
def p11_arabic_words(spark, sf_dir):
    t = corpus(spark, sf_dir).where(F.col("text").rlike(f"[{C.ARABIC_BASIC}]") & ~F.col("text").rlike("[a-zA-Z]"))
    return t.select(F.explode(F.regexp_extract_all("text", F.lit(f"[{C.ARABIC_BASIC}]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT doc_id FROM corpus WHERE len({toks('text')}) BETWEEN 3 AND 140")
def p17_word_range(spark, sf_dir):
    return corpus(spark, sf_dir).where(F.size(W(F.col("text"))).between(3, 140)).select("doc_id")


SENTENCES_SQL = f"list_filter(string_split(regexp_replace(text, '([.!?\\n])[\\s\\x{{0B}}]+', '\\1' || chr(57344), 'g'), chr(57344)), lambda x: x <> '')"


@query(f"{WITH}, s AS (SELECT doc_id, {SENTENCES_SQL} AS s FROM corpus), n AS (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM s) SELECT doc_id, CAST(i AS BIGINT) AS i, CASE WHEN i % 3 = 0 THEN array_to_string(s[i + 1:i + 3], ' ') ELSE s[i + 1] END AS span FROM n")
def p18_sentence_spans(spark, sf_dir):
    """Spans of one and of up to three sentences, in turn."""
    s = corpus(spark, sf_dir).select("doc_id", F.filter(F.split("text", r"(?<=[.!?\n])\s+"), lambda x: x != "").alias("s"))
    spans = F.transform("s", lambda one, i: F.struct(i.cast("bigint").alias("i"), F.when(i % 3 == 0, F.concat_ws(" ", F.slice("s", i + 1, 3))).otherwise(one).alias("span")))
    return s.select("doc_id", F.inline(spans))


URL_SQL = {k: f"regexp_extract(url, {quoted(p)}, 1)" for k, p in {"host": "^[a-zA-Z]+://([^/?#]*)", "path": "^[a-zA-Z]+://[^/?#]*([^?#]*)", "v": "[?&]v=([^&#]+)", "page": "[?&]page=([^&#]+)"}.items()}


@query(f"SELECT page_id, {URL_SQL['host']} AS host, {URL_SQL['path']} AS path, {URL_SQL['page']} AS page FROM pages")
def p21_url_parts(spark, sf_dir):
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("^[a-zA-Z]+://([^/?#]*)").alias("host"), part("^[a-zA-Z]+://[^/?#]*([^?#]*)").alias("path"), part("[?&]page=([^&#]+)").alias("page"))


@query("SELECT page_id, regexp_extract('id=' || page_id || '; lang=' || regexp_extract(url, '/([a-z]{2})/', 1), 'lang=([^;]*)', 1) AS lang FROM pages")
def p24_cookies(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("id="), F.col("page_id"), F.lit("; lang="), F.regexp_extract("url", "/([a-z]{2})/", 1)).alias("h"))
    return u.select("page_id", F.filter(ids.cookies(F.col("h")), lambda c: c["name"] == "lang")[0]["value"].alias("lang"))


# name: (Java pattern, RE2 pattern or None)
PREVALENCE = {"url": (text.URL, text.URL), "mention": (text.MENTION, text.MENTION), "zero_width": (f"[{C.ZERO_WIDTH}]",) * 2, "timestamp": ("(?U)" + text.TIMESTAMP, TIME), "emoji_run": (f"[{C.EMOJI}]{{3,}}",) * 2, "punct_run": (r"[!?.]{3,}",) * 2, "bbcode": (r"\[/?[a-zA-Z]+(?:=[^\]]*)?\]",) * 2, "entity": (r"&[a-z]+;",) * 2, "presentation": (r"[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}]",) * 2, "glued_mention": (r"@[\p{L}\p{N}_.]++\S", r"@[\p{L}\p{N}_.]+[^\p{L}\p{N}_.\s]")}


@query(f"{WITH} SELECT source, " + ", ".join(f"round(100.0 * avg(regexp_matches(text, {quoted(p[1])})::int), 6) AS {k}" for k, p in PREVALENCE.items()) + " FROM corpus GROUP BY source")
def p29_prevalence(spark, sf_dir):
    """The share of texts, in percent, that each noise pattern is found in."""
    return corpus(spark, sf_dir).groupBy("source").agg(*[F.round(F.avg(F.col("text").rlike(p[0]).cast("int")) * 100, 6).alias(k) for k, p in PREVALENCE.items()])


@query(f"{WITH}, h AS (SELECT doc_id, unnest([{', '.join(quoted(k) for k in PREVALENCE)}]) AS pattern, unnest([{', '.join(f'regexp_matches(text, {quoted(p[1])})' for p in PREVALENCE.values())}]) AS hit FROM corpus), r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY pattern) AS hits FROM h WHERE hit) SELECT pattern, hits, doc_id FROM r WHERE place <= 3")
def a50_examples(spark, sf_dir):
    """How many texts each noise pattern is found in, and the first three of them."""
    hit = [F.struct(F.lit(k).alias("pattern"), F.col("text").rlike(p[0]).alias("hit")) for k, p in PREVALENCE.items()]
    h = corpus(spark, sf_dir).select("doc_id", F.inline(F.array(*hit))).where("hit")
    first = h.withColumn("place", F.row_number().over(Window.partitionBy("pattern").orderBy("doc_id"))).where("place <= 3")
    return first.join(h.groupBy("pattern").agg(F.count("*").alias("hits")), "pattern").select("pattern", "hits", "doc_id")
