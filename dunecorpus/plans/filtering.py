"""Row filters (F), vocabulary and pair joins (J), orders and windows (W), and two samplers (U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dunecorpus.functions import script
from dunecorpus.operators import counting, selecting
from dunecorpus.plans.cleaning import SCRIPT_SQL
from dunecorpus.plans.corpus import WITH, corpus, table
from dunecorpus.plans.labelling import VOTES, votes
from dunecorpus.plans.registry import query

MIN_COUNT, CONFIDENCE, BATCH, SPAN, CAP = 2, 0.85, 64, 16, 3
_TOKENS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')"


def _words():
    return F.expr(r"filter(split(coalesce(text, ''), '[ \t\n\r]+'), x -> x <> '')")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def f3_not_processed(spark, sf_dir):
    """Items that the state does not list yet."""
    done = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(done, "doc_id", "left_anti")


@query(f"{WITH}, s AS (SELECT doc_id, source, {SCRIPT_SQL} AS script FROM (SELECT doc_id, source, text AS t FROM corpus)) SELECT * FROM s WHERE (script = 'arabic' AND source = 'fixture') OR (script = 'latin' AND source IN ('web', 'fixture'))")
def f4_class_whitelist(spark, sf_dir):
    """Classes that each script group admits."""
    kind = F.col("script")
    s = corpus(spark, sf_dir).select("doc_id", "source", script.script_of(F.col("text")).alias("script"))
    return s.where(((kind == "arabic") & (F.col("source") == "fixture")) | ((kind == "latin") & F.col("source").isin("web", "fixture")))


@query("SELECT doc_id, n_chars FROM documents WHERE source <> '' AND text IS NOT NULL AND doc_id IS NOT NULL")
def f5_null_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source <> '' and text is not null and doc_id is not null").select("doc_id", "n_chars")


@query(f"{VOTES} SELECT doc_id, a, label FROM votes WHERE label <> 'MIX'")
def f6_drop_unsure(spark, sf_dir):
    return votes(spark, sf_dir).where("label <> 'MIX'")


@query(f"{WITH} SELECT doc_id, len({_TOKENS}) AS n FROM corpus WHERE len({_TOKENS}) >= 2")
def f7_min_tokens(spark, sf_dir):
    """Texts that can give pairs."""
    return corpus(spark, sf_dir).select("doc_id", F.size(_words()).cast("long").alias("n")).where("n >= 2")


@query(f"{WITH}, w AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM corpus), f AS (SELECT token, count(*) AS n FROM w GROUP BY token HAVING count(*) >= {MIN_COUNT}) SELECT doc_id, count(*) AS kept FROM w JOIN f USING (token) GROUP BY doc_id")
def f8_min_occurrence(spark, sf_dir):
    """Tokens that occur often enough, counted before the join, so no window holds a frequent word's rows."""
    per = corpus(spark, sf_dir).select("doc_id", F.explode(_words()).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    often = per.groupBy("token").agg(F.sum("n").alias("all")).where(F.col("all") >= MIN_COUNT).select("token")
    return per.join(often, "token").groupBy("doc_id").agg(F.sum("n").alias("kept"))


@query(f"SELECT doc_id, lang, score FROM (SELECT doc_id, lang, round((doc_id * 37 % 100) / 100.0, 2) AS score FROM documents) WHERE NOT coalesce(lang IN ('en', 'fr') AND score >= {CONFIDENCE}, false)")
def f9_confidence(spark, sf_dir):
    """Rows that a language model is sure are of an unwanted language go; the score is an input column."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.round(F.col("doc_id") * 37 % 100 / 100, 2).alias("score"))
    return d.where(~F.coalesce(F.col("lang").isin("en", "fr") & (F.col("score") >= CONFIDENCE), F.lit(False)))


@query("SELECT event_id, event_type FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events)")
def f10_same_day(spark, sf_dir):
    """Rows of one date, as a range of the timestamp, which reaches the scan; the last day in the table by default."""
    e = table(spark, sf_dir, "events")
    day = e.agg(F.date_trunc("day", F.max("ts")).alias("day")).first()["day"]
    return e.where((F.col("ts") >= F.lit(day)) & (F.col("ts") < F.lit(day) + F.expr("interval 1 day"))).select("event_id", "event_type")


@query("SELECT doc_id, source, list_position(['fr', 'en'], lang) AS place FROM documents WHERE lang IN ('fr', 'en')")
def f12_wanted(spark, sf_dir):
    """Targets of the wanted labels; ``place`` keeps the order of asking; a null label never matches."""
    asked = spark.createDataFrame([("fr", 1), ("en", 2)], "lang string, place int")
    return table(spark, sf_dir, "documents").join(F.broadcast(asked), "lang").select("doc_id", "source", "place")


@query("SELECT doc_id, lang, quality, toxic FROM labels JOIN documents USING (doc_id)")
def j1_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "quality", "toxic")


_VOCAB = "w AS (SELECT doc_id, unnest(" + _TOKENS + ") AS token FROM corpus), f AS (SELECT token, count(*) AS n FROM w GROUP BY token), v AS (SELECT token, 1 + row_number() OVER (ORDER BY n DESC, token) AS id FROM f WHERE n >= 2 QUALIFY id <= 501)"


@query(f"{WITH}, {_VOCAB} SELECT doc_id, CAST(sum(coalesce(id, 1)) AS BIGINT) AS id_sum, count(*) AS n, count(*) FILTER (id IS NULL) AS unknown FROM w LEFT JOIN v USING (token) GROUP BY doc_id")
def j7_vocabulary_ids(spark, sf_dir):
    """Tokens as ids of a 500-word vocabulary, so it may be broadcast; others are 1 (or left out: n - unknown)."""
    per = corpus(spark, sf_dir).select("doc_id", F.explode(_words()).alias("token"))
    f = per.groupBy("token").agg(F.count("*").alias("n")).where("n >= 2")
    best = counting.top(f, 500, "n", "token")
    ids = best.withColumn("id", 1 + F.row_number().over(Window.orderBy(F.desc("n"), "token"))).select("token", "id")
    got = per.join(F.broadcast(ids), "token", "left")
    return got.groupBy("doc_id").agg(F.sum(F.coalesce("id", F.lit(1))).alias("id_sum"), F.count("*").alias("n"), F.count(F.when(F.col("id").isNull(), 1)).alias("unknown"))


@query("SELECT x.n_regionkey AS category, x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey")
def j9_analogies(spark, sf_dir):
    """Ordered pairs within a category: n(n-1) questions, the wanted output."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    x, y = n.alias("x"), n.alias("y")
    return x.join(y, (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") != F.col("y.n_nationkey"))).select(F.col("x.n_regionkey").alias("category"), F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"))


@query(f"{WITH}, o AS (SELECT doc_id, len({_TOKENS}) AS n FROM corpus) SELECT doc_id, n, (row_number() OVER (ORDER BY n, md5('5-' || doc_id), doc_id) - 1) // {BATCH} AS batch FROM o")
def w5_length_batches(spark, sf_dir):
    """Batches of like length, random within a length; places come from the histogram of lengths, not from one global sort."""
    d = corpus(spark, sf_dir).select("doc_id", F.size(_words()).cast("long").alias("n"))
    return selecting.sorted_batches(d, "n", "doc_id", BATCH, 5)


@query(f"{WITH}, t AS (SELECT doc_id, {_TOKENS} AS t FROM corpus), s AS (SELECT doc_id, t, 1 + CAST(concat('0x', substr(md5('11-' || doc_id), 1, 7)) AS BIGINT) % (len(t) - {SPAN} + 1) AS start FROM t WHERE len(t) >= {SPAN}) SELECT doc_id, start, md5(array_to_string(t[start:start + {SPAN - 1}], ' ')) AS digest FROM s")
def w11_random_window(spark, sf_dir):
    """A window at a uniform start of each long enough stream."""
    t = corpus(spark, sf_dir).select("doc_id", _words().alias("t")).where(F.size("t") >= SPAN)
    start = 1 + selecting.uniform(11, "doc_id") % (F.size("t") - SPAN + 1)
    return t.withColumn("start", start).select("doc_id", "start", F.md5(F.array_join(F.slice("t", F.col("start").cast("int"), SPAN), " ")).alias("digest"))


@query("WITH v AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) SELECT vec_id, list(r ORDER BY i) AS ranks FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) - 1 AS r FROM v) GROUP BY vec_id")
def w14_dimension_ranks(spark, sf_dir):
    """Places of a vector's components when sorted: a sort of a sort, within the row."""
    placed = F.array_sort(F.transform("embedding", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    back = F.array_sort(F.transform(placed, lambda s, r: F.struct(s["i"].alias("i"), r.cast("long").alias("r"))))
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.transform(back, lambda s: s["r"]).alias("ranks"))


@query("WITH v AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM v GROUP BY ALL), d AS (SELECT label, vec_id, sum((x - c) * (x - c)) AS d FROM v JOIN c USING (label, i) GROUP BY ALL) SELECT label, arg_min(vec_id, d) AS vec_id, round(min(d), 6) AS distance FROM d GROUP BY label")
def w16_nearest_to_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null").select("vec_id", "label", "embedding")
    return selecting.nearest_to_centroid(e, "label", "vec_id", "embedding").select("label", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT * FROM r WHERE place <= {CAP} - user_id % 2")
def w18_newest(spark, sf_dir):
    """The newest rows of each walk, up to what its cap leaves after earlier runs (here, a row for every other user)."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    r = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(newest).alias("place"))
    return r.where((F.col("place") <= CAP) & (F.col("place") <= CAP - F.col("user_id") % 2)).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("WITH o AS (SELECT doc_id, lang, text, md5('6-' || doc_id) AS d FROM documents WHERE text IS NOT NULL), a AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY d, doc_id) AS r FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY r) AS c FROM a WHERE r <= 40), e AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY r) AS place FROM b WHERE c = 1) SELECT * FROM e WHERE place <= 20")
def u6_oversample_trim(spark, sf_dir):
    """Twice the wanted rows of each class are drawn, copies go, and the first of the rest stay."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", "text", F.md5(F.concat(F.lit("6-"), F.col("doc_id").cast("string"))).alias("d"))
    drawn = d.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("d", "doc_id"))).where("r <= 40")
    once = drawn.groupBy("lang", "text").agg(F.min(F.struct("r", "doc_id")).alias("s")).select("lang", "s.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("r"))
    return once.select("doc_id", "lang", place.cast("long").alias("place")).where("place <= 20")
