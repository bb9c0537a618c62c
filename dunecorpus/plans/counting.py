"""A1 to A25, W1 to W18 and the n-gram models, over the corpus or the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dunecorpus.functions import chars as C
from dunecorpus.functions import script, tokens
from dunecorpus.operators import counting as ops
from dunecorpus.operators import selecting
from dunecorpus.plans.cleaning import WORDS_SQL, kind_sql, toks
from dunecorpus.plans.corpus import WITH, corpus, table
from dunecorpus.plans.registry import query

WORDS = f"{WITH}, words AS (SELECT doc_id, source, unnest({WORDS_SQL}) AS token FROM corpus)"
FREQ = f"{WORDS}, freq AS (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM words GROUP BY token)"
W = tokens.whitespace_tokens


def words(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "source", tokens.words(F.col("text")).alias("w"))


def frequencies(spark, sf_dir):
    """Tokens are counted as they come; numbers and placeholders are left out of the distinct ones."""
    raw = corpus(spark, sf_dir).select(F.regexp_extract_all(F.lower("text"), F.lit(C.WORD + "++"), F.lit(0)).alias("w"))
    return ops.frequencies(raw, "w").where(~F.col("token").rlike(r"^\p{Nd}+$") & ~F.col("token").isin("url", "mention"))


def token_count(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "source", "text", F.size(W(F.col("text"))).alias("tokens"), F.length("text").alias("chars"))


TC = f"{WITH}, tc AS (SELECT doc_id, source, text, len({toks('text')}) AS tokens, length(text) AS chars FROM corpus)"


@query("SELECT count(*) AS collected, count(*) FILTER (event_type <> 'error') AS retained, count(*) FILTER (event_type = 'error') AS dropped, count(DISTINCT user_id) AS files FROM events")
def a1_run_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("collected"), F.count_if(F.col("event_type") != "error").alias("retained"), F.count_if(F.col("event_type") == "error").alias("dropped"), F.count_distinct("user_id").alias("files"))


@query("SELECT event_type, count(*) AS collected, count(*) FILTER (value > 5) AS retained, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a2_breakdown(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("collected"), F.count_if(F.col("value") > 5).alias("retained"), F.count_distinct("user_id").alias("users"))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS run, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT run, event_type, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY run) AS BIGINT) AS running FROM d")
def a3_cumulative_log(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("run"), "event_type").agg(F.count("*").alias("n"))
    return d.withColumn("running", F.sum("n").over(Window.partitionBy("event_type").orderBy("run")))


@query(f"{TC} SELECT count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT source) AS channels, round(sum(tokens) / count(*), 6) AS mean_tokens FROM tc")
def a4_unified_stats(spark, sf_dir):
    t = token_count(spark, sf_dir)
    return t.agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.count_distinct("source").alias("channels"), F.round(F.try_divide(F.sum("tokens"), F.count("*")), 6).alias("mean_tokens"))


@query(f"{TC} SELECT source, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / count(*), 6) AS mean_tokens FROM tc GROUP BY source")
def a5_release_table(spark, sf_dir):
    return token_count(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.round(F.try_divide(F.sum("tokens"), F.count("*")), 6).alias("mean_tokens"))


@query(f"{FREQ} SELECT token, n FROM freq")
def a6_word_frequency(spark, sf_dir):
    return frequencies(spark, sf_dir)


@query(f"{FREQ} SELECT * FROM freq")
def a6_document_frequency(spark, sf_dir):
    return ops.frequencies(words(spark, sf_dir), "w", docs=True)


@query(f"{WORDS} SELECT token, count(*) FILTER (source = 'fixture') AS own, count(*) FILTER (source <> 'fixture') AS rest FROM words GROUP BY token")
def j6_source_union(spark, sf_dir):
    """Counts of two vocabularies side by side, 0 where a word is missing."""
    f = words(spark, sf_dir).select((F.col("source") == "fixture").alias("own"), F.explode("w").alias("token"))
    return f.groupBy("token").agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("rest"))


@query(f"{WITH}, l AS (SELECT {WORDS_SQL} AS w FROM corpus), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM l) SELECT gram, count(*) AS n FROM b GROUP BY gram")
def a7_bigrams(spark, sf_dir):
    return words(spark, sf_dir).select(F.explode(tokens.neighbours(F.col("w"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"{FREQ} SELECT count(*) AS types, round(avg((n = 1)::int), 6) AS hapax, round(avg((n <= 5)::int), 6) AS rare, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, round(quantile_cont(n, 0.5), 6) AS median, max(n)::bigint AS largest FROM freq")
def a8_hapax(spark, sf_dir):
    n = F.col("n")
    return frequencies(spark, sf_dir).agg(F.count("*").alias("types"), F.round(F.avg((n == 1).cast("int")), 6).alias("hapax"), F.round(F.avg((n <= 5).cast("int")), 6).alias("rare"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("std"), F.round(F.percentile(n, 0.5), 6).alias("median"), F.max(n).alias("largest"))


@query(f"{FREQ}, r AS (SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, sum(n) OVER (ORDER BY n DESC, token) AS run, sum(n) OVER () AS total FROM freq) SELECT CAST(min(rank) FILTER (run >= 0.5 * total) AS BIGINT) AS n50, CAST(min(rank) FILTER (run >= 0.9 * total) AS BIGINT) AS n90 FROM r")
def a9_coverage(spark, sf_dir):
    return ops.coverage(frequencies(spark, sf_dir), {"n50": 0.5, "n90": 0.9})


@query(f"{FREQ} SELECT {kind_sql('token')} AS kind, count(*) AS types, CAST(sum(n) AS BIGINT) AS occurrences FROM freq GROUP BY ALL")
def a10_script_composition(spark, sf_dir):
    return frequencies(spark, sf_dir).groupBy(script.classify_token(F.col("token")).alias("kind")).agg(F.count("*").alias("types"), F.sum("n").alias("occurrences"))


@query(f"{WORDS}, s AS (SELECT token, bool_or(source = 'fixture') AS a, bool_or(source <> 'fixture') AS b FROM words GROUP BY token) SELECT CASE WHEN a AND b THEN 'shared' WHEN a THEN 'own' ELSE 'rest' END AS side, count(*) AS types FROM s GROUP BY ALL")
def a11_source_overlap(spark, sf_dir):
    s = j6_source_union(spark, sf_dir)
    return s.groupBy(F.when((F.col("own") > 0) & (F.col("rest") > 0), "shared").when(F.col("own") > 0, "own").otherwise("rest").alias("side")).agg(F.count("*").alias("types"))


_Q = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query(f"{TC} SELECT count(*) AS docs, round(avg(tokens), 6) AS mean, round(stddev_samp(tokens), 6) AS std, min(tokens)::bigint AS least, max(tokens)::bigint AS most, " + ", ".join(f"round(quantile_cont(tokens, {q}), 6) AS p{int(q * 100)}" for q in _Q) + " FROM tc")
def a12_summary(spark, sf_dir):
    t = F.col("tokens")
    return token_count(spark, sf_dir).agg(F.count("*").alias("docs"), F.round(F.avg(t), 6).alias("mean"), F.round(F.stddev_samp(t), 6).alias("std"), F.min(t).cast("bigint").alias("least"), F.max(t).cast("bigint").alias("most"), *[F.round(F.percentile(t, q), 6).alias(f"p{int(q * 100)}") for q in _Q])


@query(f"{WITH}, k AS (SELECT {kind_sql('x')} AS kind FROM (SELECT unnest({toks('text')}) AS x FROM corpus)) SELECT kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY kind")
def a13_token_scripts(spark, sf_dir):
    k = corpus(spark, sf_dir).select(F.explode(W(F.col("text"))).alias("x")).groupBy(script.classify_token(F.col("x")).alias("kind")).agg(F.count("*").alias("n"))
    return k.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


@query(f"{FREQ}, k AS (SELECT {kind_sql('token')} AS kind, token, n FROM freq), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, token) AS rank FROM k) SELECT * FROM r WHERE rank <= 15")
def a14_top_per_script(spark, sf_dir):
    f = frequencies(spark, sf_dir).select(script.classify_token(F.col("token")).alias("kind"), "token", "n")
    return ops.top(f, 15, "n", "token", by=("kind",))


_KINDS = ("arabic", "latin", "mixed", "no_letters")
_RA, _RL = f"len(regexp_extract_all(text, '[{C.ARABIC_THREE}]'))", "len(regexp_extract_all(text, '[A-Za-z]'))"
_RATIO = f"CASE WHEN {_RA} + {_RL} = 0 THEN 'no_letters' WHEN {_RA} / ({_RA} + {_RL}) >= 0.85 THEN 'arabic' WHEN {_RA} / ({_RA} + {_RL}) <= 0.15 THEN 'latin' ELSE 'mixed' END"


@query(f"{WITH}, b AS (SELECT source, {_RATIO} AS k FROM corpus) SELECT source, " + ", ".join(f"round(avg((k = '{k}')::int), 6) AS {k}" for k in _KINDS) + " FROM b GROUP BY source")
def a15_crosstab(spark, sf_dir):
    b = corpus(spark, sf_dir).select("source", script.ratio_bucket(F.col("text")).alias("k"))
    return b.groupBy("source").agg(*[F.round(F.avg((F.col("k") == k).cast("int")), 6).alias(k) for k in _KINDS])


@query(f"{TC} SELECT source, count(*) AS n, round(avg(chars), 6) AS chars, round(avg(tokens), 6) AS tokens, round(avg((NOT contains(lower(text), 'the'))::int), 6) AS zero_hits FROM tc GROUP BY source")
def a16_sample_profile(spark, sf_dir):
    miss = ~F.lower("text").contains("the")
    return token_count(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("chars"), 6).alias("chars"), F.round(F.avg("tokens"), 6).alias("tokens"), F.round(F.avg(miss.cast("int")), 6).alias("zero_hits"))


@query("SELECT coalesce(source, 'TOTAL') AS channel, count(*) AS n, count(*) FILTER (n_chars > 500) AS truncated, count(*) FILTER (n_chars IS NULL) AS unknown, CAST(coalesce(sum(greatest(n_chars - 500, 0)), 0) AS BIGINT) AS missing FROM documents GROUP BY ROLLUP (source)")
def a17_truncation_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.rollup("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("truncated"), F.count_if(F.col("n_chars").isNull()).alias("unknown"), F.coalesce(F.sum(F.greatest(F.col("n_chars") - 500, F.lit(0))), F.lit(0)).alias("missing")).select(F.coalesce("source", F.lit("TOTAL")).alias("channel"), "n", "truncated", "unknown", "missing")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS posts, count(DISTINCT user_id) AS threads, count(DISTINCT event_type) AS boards FROM events GROUP BY ALL")
def a18_daily_count(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("posts"), F.count_distinct("user_id").alias("threads"), F.count_distinct("event_type").alias("boards"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def a19_tag_distribution(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT lang, quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def a20_label_distribution(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(d, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT bool_and(quality IS NOT DISTINCT FROM toxic) AS same, count(*) FILTER (quality IS DISTINCT FROM toxic) AS differing FROM labels")
def a21_parallel_labels(spark, sf_dir):
    same = F.col("quality").eqNullSafe(F.col("toxic"))
    return table(spark, sf_dir, "labels").agg(F.bool_and(same).alias("same"), F.count_if(~same).alias("differing"))


@query("WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY text) SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_groups, count(*) AS texts, CAST(sum(n) AS BIGINT) AS docs FROM g")
def a22_duplicate_profile(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_groups"), F.count("*").alias("texts"), F.sum("n").alias("docs"))


@query(f"{TC}, o AS (SELECT chars, row_number() OVER (ORDER BY chars) AS i, count(*) OVER () AS n FROM tc) SELECT CAST(min(chars) AS BIGINT) AS least, CAST(max(chars) AS BIGINT) AS most, CAST(max(chars) FILTER (i = n // 2 + 1) AS BIGINT) AS median, round_even(avg(chars), 2) AS mean FROM o")
def a23_length_stats(spark, sf_dir):
    """Upper median: the histogram of lengths is bounded by the longest text, so ranks come from its running sum."""
    hist = token_count(spark, sf_dir).groupBy("chars").agg(F.count("*").alias("n"))
    run = hist.select("chars", "n", F.sum("n").over(Window.orderBy("chars").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    half = F.floor(F.col("total") / 2)
    return run.agg(F.min("chars").cast("bigint").alias("least"), F.max("chars").cast("bigint").alias("most"), F.min(F.when(F.col("upto") > half, F.col("chars"))).cast("bigint").alias("median"), F.bround(F.sum(F.col("chars") * F.col("n")) / F.sum("n"), 2).alias("mean"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 15")
def a24_top_sources(spark, sf_dir):
    return ops.top(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")), 15, "n", "source")


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{k}') AS {k}" for k in ("en", "fr", "de", "es")) + " FROM documents GROUP BY source")
def a25_lang_crosstab(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1)))
    return d.fillna(0)


@query(f"{FREQ} SELECT token, n, CAST(3 + row_number() OVER (ORDER BY n DESC, token) AS BIGINT) AS id FROM freq ORDER BY n DESC, token LIMIT 1000")
def w2_vocabulary(spark, sf_dir):
    """The 1,000 most frequent words with ids after four reserved ones."""
    top = ops.top(frequencies(spark, sf_dir).select("token", "n"), 1000, "n", "token")
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 3).cast("bigint"))


@query(f"{TC} SELECT doc_id, tokens::bigint AS tokens FROM tc ORDER BY tokens DESC, doc_id LIMIT 100")
def w3_longest(spark, sf_dir):
    return ops.top(token_count(spark, sf_dir).select("doc_id", F.col("tokens").cast("bigint").alias("tokens")), 100, "tokens", "doc_id")


@query(f"{TC}, r AS (SELECT tokens, row_number() OVER (ORDER BY tokens DESC, doc_id) <= 100 AS selected FROM tc) SELECT selected, count(*) AS n, round(avg(tokens), 6) AS mean, min(tokens)::bigint AS least, max(tokens)::bigint AS most FROM r GROUP BY selected")
def w4_selection_stats(spark, sf_dir):
    t = token_count(spark, sf_dir).select("doc_id", "tokens")
    chosen = ops.top(t, 100, "tokens", "doc_id").select("doc_id", F.lit(True).alias("selected"))
    return t.join(F.broadcast(chosen), "doc_id", "left").groupBy(F.coalesce("selected", F.lit(False)).alias("selected")).agg(F.count("*").alias("n"), F.round(F.avg("tokens"), 6).alias("mean"), F.min("tokens").cast("bigint").alias("least"), F.max("tokens").cast("bigint").alias("most"))


_CONV = r"SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations"
POSITIONS = f"WITH c AS ({_CONV}), p AS (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM c)"


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit(C.WORD + "+"), F.lit(0)).alias("w"))


@query(f"{POSITIONS} SELECT a.x AS centre, b.x AS context, count(*) AS n FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.turn = b.turn AND abs(a.i - b.i) BETWEEN 1 AND 8 GROUP BY ALL")
def w7_skip_gram_pairs(spark, sf_dir):
    """(centre, context) pairs within eight places."""
    return ops.window_pairs(turns(spark, sf_dir).select("w"), "w", 8).groupBy("centre", "context").agg(F.count("*").alias("n"))


@query(f"{POSITIONS} SELECT a.conv_id, a.turn, CAST(a.i - 1 AS INT) AS i, a.x AS centre, md5(coalesce(string_agg(b.x, ' ' ORDER BY b.i), '')) AS context FROM p a LEFT JOIN p b ON a.conv_id = b.conv_id AND a.turn = b.turn AND abs(a.i - b.i) BETWEEN 1 AND 8 GROUP BY ALL")
def w6_context_windows(spark, sf_dir):
    """Each token with the list of those within eight places."""
    return ops.contexts(turns(spark, sf_dir), "w", 8).withColumn("context", F.md5(F.array_join("context", " ")))


@query(f"{WITH}, t AS (SELECT doc_id, unnest({WORDS_SQL}) AS x, generate_subscripts({WORDS_SQL}, 1) AS i FROM corpus), n AS (SELECT x, row_number() OVER (ORDER BY doc_id, i) - 1 AS place, count(*) OVER () AS total FROM t) SELECT CAST(place // 129 AS BIGINT) AS block, md5(string_agg(x, ' ' ORDER BY place)) AS digest FROM n WHERE (place // 129 + 1) * 129 <= total GROUP BY place // 129")
def w10_stream_blocks(spark, sf_dir):
    """Blocks of 129 tokens over one stream, without the tail."""
    return ops.stream_blocks(words(spark, sf_dir), "doc_id", "w", 129).select("block", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"{POSITIONS} SELECT a.x AS centre, b.x AS context, round(sum(1.0 / abs(a.i - b.i)), 5) AS weight FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.turn = b.turn AND abs(a.i - b.i) BETWEEN 1 AND 10 GROUP BY ALL")
def w8_cooccurrence(spark, sf_dir):
    return ops.cooccurrence(turns(spark, sf_dir), "w", 10).withColumn("weight", F.round("weight", 5))


@query(f"{WITH}, s AS (SELECT list_concat(['<s>', '<s>'], list_concat({WORDS_SQL}, ['</s>'])) AS p FROM corpus), g AS (" + " UNION ALL ".join(f"SELECT {k} AS \"order\", unnest(list_transform(range(1, len(p) - {k} + 2), lambda i: array_to_string(p[i:i + {k} - 1], ' '))) AS gram FROM s" for k in (1, 2, 3)) + ") SELECT \"order\", gram, count(*) AS n FROM g GROUP BY ALL")
def m20_ngram_counts(spark, sf_dir):
    """Counts of one to three words with begin and end marks."""
    return ops.ngrams(words(spark, sf_dir), "w", 3)


@query(f"{POSITIONS}, c2 AS (SELECT conv_id, turn, (i - 1) // 64 AS chunk, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM p GROUP BY ALL) SELECT conv_id, turn, CAST(chunk AS BIGINT) AS chunk, n, md5(t) AS digest FROM c2")
def w12_chunks(spark, sf_dir):
    """Chunks of at most 64 tokens."""
    t = turns(spark, sf_dir).where(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 64)), lambda k: F.struct(k.alias("chunk"), F.slice("w", (k * 64 + 1).cast("int"), 64).alias("x")))
    return t.select("conv_id", "turn", F.inline(cut)).select("conv_id", "turn", F.col("chunk").cast("bigint").alias("chunk"), F.size("x").cast("bigint").alias("n"), F.md5(F.array_join("x", " ")).alias("digest"))


@query(f"{TC}, r AS (SELECT source, doc_id, tokens, coalesce(sum(tokens + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tc) SELECT source, doc_id, CAST(before AS BIGINT) AS before FROM r WHERE before < 5000")
def w13_token_budget(spark, sf_dir):
    """Documents of each source until 5,000 tokens with their two marks are reached."""
    t = token_count(spark, sf_dir).select("source", "doc_id", "tokens")
    return selecting.until_budget(t, "source", "doc_id", F.col("tokens") + 2, 5000).select("source", "doc_id", "before")
