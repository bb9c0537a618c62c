"""M and the vector queries: profiles, language models, neighbours, agreement of rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dunecorpus.operators import modelling as ops
from dunecorpus.operators import models, vectors
from dunecorpus.operators.staging import cut
from dunecorpus.plans import counting
from dunecorpus.plans.cleaning import WORDS_SQL
from dunecorpus.plans.corpus import WITH, table
from dunecorpus.plans.registry import query


def _grams(rel: str, key: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {key}, c, unnest(list_transform(range(1, greatest(1, length(w) - {n} + 2)), lambda i: substring(w, i, {n}))) AS gram FROM w" for n in range(1, 6))
    return f"w AS (SELECT {key}, '_' || unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) || '_' AS w, 1 AS c FROM {rel}), g AS ({parts}), n AS (SELECT {key}, gram, CAST(sum(c) AS BIGINT) AS n FROM g GROUP BY ALL), prof AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, gram) AS rank FROM n) WHERE rank <= 300)"


@query(f"WITH {_grams('documents', 'lang')} SELECT lang, gram, n, rank FROM prof")
def m2_profiles(spark, sf_dir):
    """Each language's 300 most frequent character grams."""
    return ops.profiles(table(spark, sf_dir, "documents"), "lang", "text")


_CT = f"WITH {_grams('documents', 'lang')}, cls AS MATERIALIZED (SELECT lang, gram, rank FROM prof), {_grams('benchmark', 'item_id').replace('w AS', 'w2 AS', 1).replace('FROM w ', 'FROM w2 ').replace('FROM w)', 'FROM w2)').replace('g AS (', 'g2 AS (').replace('FROM g ', 'FROM g2 ').replace('n AS (SELECT item_id, gram', 'n2 AS (SELECT item_id, gram').replace('FROM n)', 'FROM n2)').replace('prof AS', 'dp AS MATERIALIZED')}, worst AS (SELECT lang, max(rank) AS worst FROM cls GROUP BY lang), d AS (SELECT item_id, worst.lang, sum(coalesce(abs(cls.rank - dp.rank), worst + 1)) AS distance FROM dp CROSS JOIN worst LEFT JOIN cls ON cls.lang = worst.lang AND cls.gram = dp.gram GROUP BY ALL)"


@query(f"{_CT}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, lang) AS place FROM d) SELECT item_id, lang, CAST(distance AS BIGINT) AS distance FROM r WHERE place = 1")
def m2_identify(spark, sf_dir):
    """The language whose profile is least out of place."""
    cls = ops.profiles(table(spark, sf_dir, "documents"), "lang", "text")
    d = ops.out_of_place(ops.profiles(table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id", cls, "lang")
    return d.groupBy("item_id").agg(F.min(F.struct("distance", "lang")).alias("m")).select("item_id", "m.lang", "m.distance")


@query(f"{WITH} SELECT doc_id, CASE WHEN source = 'fixture' THEN NULL WHEN lang IN ('fr', 'en') THEN lang ELSE 'else' END AS label FROM corpus LEFT JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)")
def m14_language_rule(spark, sf_dir):
    from dunecorpus.plans.corpus import corpus

    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return corpus(spark, sf_dir).join(d, "doc_id", "left").select("doc_id", F.when(F.col("source") == "fixture", F.lit(None)).when(F.col("lang").isin("fr", "en"), F.col("lang")).otherwise("else").alias("label"))


_H = ("the of", "und die", "<s> <s>", "zzz qqq", "la la")
_LM = f"{WITH}, s AS (SELECT list_concat(['<s>', '<s>'], list_concat({WORDS_SQL}, ['</s>'])) AS p FROM corpus), g AS (" + " UNION ALL ".join(f"SELECT {k} AS o, unnest(list_transform(range(1, len(p) - {k} + 2), lambda i: p[i:i + {k} - 1])) AS w FROM s" for k in (1, 2, 3)) + "), c AS (SELECT o, w, count(*) AS n FROM g GROUP BY ALL), h AS (SELECT unnest([" + ", ".join(f"'{h}'" for h in _H) + "]) AS h), t AS (SELECT h, w[3] AS next, n, 3 AS \"order\" FROM c JOIN h ON o = 3 AND w[1] || ' ' || w[2] = h), b AS (SELECT h, w[2] AS next, n, 2 AS \"order\" FROM c JOIN h ON o = 2 AND w[1] = split_part(h, ' ', 2) WHERE h NOT IN (SELECT h FROM t)), u AS (SELECT h, w[1] AS next, n, 1 AS \"order\" FROM c JOIN h ON o = 1 WHERE w[1] NOT IN ('<s>', '</s>') AND h NOT IN (SELECT h FROM t) AND h NOT IN (SELECT h FROM b))"


@query(f"{_LM}, a AS (SELECT * FROM t UNION ALL SELECT * FROM b UNION ALL SELECT * FROM u) SELECT h, next, \"order\", round(n / sum(n) OVER (PARTITION BY h), 6) AS p FROM a")
def m21_backoff(spark, sf_dir):
    """The next word's distribution after stated histories."""
    h = spark.createDataFrame([(x,) for x in _H], "h string")
    a = ops.backoff(counting.m20_ngram_counts(spark, sf_dir), h)
    return a.select("h", "next", "order", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("h")), 6).alias("p"))


_MASKED = ("la", "the", "der")


@query(f"{_LM}, a AS (SELECT * FROM t UNION ALL SELECT * FROM b UNION ALL SELECT * FROM u), p AS (SELECT h, next, n FROM a WHERE next NOT IN {_MASKED}), r AS (SELECT h, next, n / sum(n) OVER (PARTITION BY h) AS p, row_number() OVER (PARTITION BY h ORDER BY n DESC, next) AS rank FROM p) SELECT h, next, round(p, 6) AS p, rank FROM r WHERE rank <= 3")
def m28_next_words(spark, sf_dir):
    """The three likeliest next words without the masked ones, whose share goes to the others."""
    h = spark.createDataFrame([(x,) for x in _H], "h string")
    a = ops.backoff(counting.m20_ngram_counts(spark, sf_dir), h).where(~F.col("next").isin(*_MASKED))
    whole = a.groupBy("h").agg(F.sum("n").alias("whole"))
    rank = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("n"), "next")).cast("bigint")
    best = a.withColumn("rank", rank).where("rank <= 3").join(whole, "h")
    return best.select("h", "next", F.round(F.col("n") / F.col("whole"), 6).alias("p"), "rank")


_CHARS = "c AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?s).') AS c FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM c)"


@query(f"WITH {_CHARS}, n AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT gram, count(*) AS df, sum(tf) AS freq FROM n GROUP BY gram HAVING count(*) >= 2 ORDER BY freq DESC, gram LIMIT 3000), w AS (SELECT doc_id, gram, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM n JOIN f USING (gram)) SELECT doc_id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w")
def m5_tf_idf(spark, sf_dir):
    """Weights of the 3000 most frequent character trigrams of whole lower-cased texts, of length 1 a document."""
    return models.char_tf_idf(table(spark, sf_dir, "documents"), "doc_id", "text", 3, 3000).select("doc_id", "gram", F.round("weight", 6).alias("weight"))


_V = "SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS v FROM embeddings"
_NN = f"WITH e AS ({_V}), s AS (SELECT q.vec_id AS q, e.vec_id AS id, e.label, q.label AS qlabel, list_cosine_similarity(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s)"


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"{_NN} SELECT q, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def j10_nearest(spark, sf_dir):
    """The stated queries' ten nearest of all vectors."""
    return vectors.nearest(*_sides(spark, sf_dir), 10).select("q", "id", "rank", F.round("score", 6).alias("score"))


_METRIC = {"cosine": "list_cosine_similarity(a.v, b.v)", "dot": "list_inner_product(a.v, b.v)", "euclid": "-list_distance(a.v, b.v)", "ranks": "-list_sum(list_transform(list_zip(a.r, b.r), lambda z: abs(z[1] - z[2])))::DOUBLE"}
_KNN = (
    f"WITH e AS MATERIALIZED (SELECT vec_id, label, v, list_grade_up(list_grade_up(v)) AS r FROM ({_V})), s AS (SELECT a.vec_id AS q, b.vec_id AS id, b.label, unnest([{', '.join(repr(m) for m in _METRIC)}]) AS metric, unnest([{', '.join(_METRIC.values())}]) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY q, metric ORDER BY round(score, 12) DESC, id) AS rank FROM s), k AS (SELECT r.*, k FROM r, (SELECT unnest([5, 10]) AS k) WHERE rank <= k), "
    "w AS (SELECT *, unnest([true, false]) AS weighted, unnest([score - min(score) OVER (PARTITION BY q, metric, k) + 1e-6, 1.0]) AS w FROM k), v AS (SELECT q, metric, k, weighted, label, round(sum(w), 9) AS w FROM w GROUP BY ALL) "
    "SELECT metric, k, weighted, count(*) AS asked, count(*) FILTER (p.predicted = embeddings.label) AS hits FROM (SELECT q, metric, k, weighted, arg_max(label, (w, -label)) AS predicted FROM v GROUP BY ALL) p JOIN embeddings ON vec_id = q GROUP BY ALL"
)


@query(_KNN)
def m11_knn_vote(spark, sf_dir):
    """Four metrics, five and ten neighbours, weighted or not."""
    lab = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q, e = _sides(spark, sf_dir)
    out = None
    for metric in vectors.METRICS:
        near = cut(vectors.nearest(q, e, 10, metric).join(lab.withColumnRenamed("vec_id", "id"), "id"))
        for k in (5, 10):
            for weighted in (True, False):
                p = vectors.vote(near, "label", k, weighted).join(lab.withColumnRenamed("vec_id", "q"), "q")
                row = p.agg(F.count("*").alias("asked"), F.count_if(F.col("predicted") == F.col("label")).alias("hits")).select(F.lit(metric).alias("metric"), F.lit(k).alias("k"), F.lit(weighted).alias("weighted"), "asked", "hits")
                out = row if out is None else out.unionByName(row)
    return out


def _analogy_sql(vector: str) -> str:
    return f"WITH e AS MATERIALIZED (SELECT vec_id, {vector} AS v FROM ({_V})), t AS (SELECT c.vec_id AS q, a.vec_id AS a, b.vec_id AS b, list_transform(list_zip(a.v, b.v, c.v), lambda z: z[2] - z[1] + z[3]) AS v FROM e c JOIN e a ON a.vec_id = c.vec_id + 1 JOIN e b ON b.vec_id = c.vec_id + 2 WHERE c.vec_id % 100 = 0), s AS (SELECT q, vec_id AS id, list_cosine_similarity(t.v, e.v) AS score FROM t JOIN e ON vec_id NOT IN (q, a, b)) SELECT q, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"


def _analogies(spark, sf_dir, normalised):
    q = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), (F.col("vec_id") + 1).alias("a"), (F.col("vec_id") + 2).alias("b"), F.col("vec_id").alias("c"))
    return vectors.analogies(q, _sides(spark, sf_dir)[1], 5, normalised).select("q", "id", "rank", F.round("score", 6).alias("score"))


@query(_analogy_sql("v"))
def m25_analogies(spark, sf_dir):
    """B - a + c on raw vectors, the three themselves excluded."""
    return _analogies(spark, sf_dir, False)


@query(_analogy_sql("list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))"))
def m25_analogies_unit(spark, sf_dir):
    """The same on vectors of length 1."""
    return _analogies(spark, sf_dir, True)


_HEX = lambda start: f"CAST(concat('0x', substr(md5(concat('smote-', label, '-', number)), {start}, 6)) AS BIGINT)"
_SMOTE = (
    f"WITH e AS MATERIALIZED (SELECT vec_id, label, v, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS place FROM ({_V})), c AS (SELECT label, count(*) AS n, max(count(*)) OVER () - count(*) AS missing FROM e GROUP BY label), m AS (SELECT label, n, unnest(range(missing)) AS number FROM c), "
    f"d AS (SELECT label, number, 1 + {_HEX(1)} % n AS place, 1 + {_HEX(7)} % greatest(least(5, n - 1), 1) AS rank, {_HEX(13)} / 16777216.0 AS gap FROM m), "
    "k AS (SELECT a.vec_id AS base, b.vec_id AS neighbour, b.v AS nv, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 12), b.vec_id) AS rank FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) "
    "SELECT d.label, number, e.vec_id AS base, neighbour, round(gap, 6) AS gap, round(list_sum(list_transform(list_zip(e.v, nv), lambda z: z[1] + gap * (z[2] - z[1]))), 5) AS total FROM d JOIN e ON e.label = d.label AND e.place = d.place JOIN k ON k.base = e.vec_id AND k.rank = d.rank"
)


@query(_SMOTE)
def u16_oversample(spark, sf_dir):
    """U16: synthetic vectors between neighbours of the smaller classes."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = vectors.oversample(e, "label")
    return out.select("label", "number", "base", "neighbour", F.round("gap", 6).alias("gap"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("WITH p AS (SELECT a.vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dot, a.vec_id % 200 + 1 AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT round(sum(least(1, (x / 100) ** 0.75) * (dot + 0.1 + 0.2 - ln(x)) ** 2), 4) AS loss, count(*) AS pairs FROM p")
def m24_vector_objective(spark, sf_dir):
    """The weighted squared error of log counts by word vectors and biases."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("context"))
    p = e.join(other, "vec_id").select("embedding", "context", (F.col("vec_id") % 200 + 1).alias("x"))
    loss = models.log_count_error(ops.dot(F.col("embedding"), F.col("context")), F.lit(0.1), F.lit(0.2), F.col("x"))
    return p.agg(F.round(F.sum(loss), 4).alias("loss"), F.count("*").alias("pairs"))


@query("WITH d AS (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM d GROUP BY ALL) SELECT label, CAST(i - 1 AS BIGINT) AS dim, round(m, 6) AS mean FROM c")
def m26_mean_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return d.groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("WITH x AS (SELECT doc_id, length(text) AS a, len(regexp_split_to_array(text, '\\s+')) AS b FROM documents), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x) SELECT round(corr(ra, rb), 6) AS rho FROM r")
def a46_spearman(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.length("text").alias("a"), F.size(F.split("text", r"\s+")).alias("b"))
    return ops.average_rank(ops.average_rank(x, "a", "ra"), "b", "rb").agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


@query("WITH x AS (SELECT lang, length(text) AS a, n_chars % 97 AS b, doc_id % 13 = 0 AS missing FROM documents), k AS (SELECT * FROM x WHERE NOT missing AND a IS NOT NULL AND b IS NOT NULL), r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY lang ORDER BY b) + (count(*) OVER (PARTITION BY lang, b) - 1) / 2 AS rb FROM k), c AS (SELECT lang, round(corr(ra, rb), 6) AS rho, count(*) AS pairs FROM r GROUP BY lang) SELECT lang, rho, coalesce(pairs, 0) AS pairs, skipped FROM (SELECT lang, count(*) FILTER (missing OR a IS NULL OR b IS NULL) AS skipped FROM x GROUP BY lang) LEFT JOIN c USING (lang)")
def a46_spearman_by_category(spark, sf_dir):
    """Rank correlation of each category's pairs, and how many pairs lack a value."""
    x = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("a"), (F.col("n_chars") % 97).alias("b"), (F.col("doc_id") % 13 == 0).alias("missing"))
    x = x.select("lang", F.when(~F.col("missing"), F.col("a")).alias("a"), F.when(~F.col("missing"), F.col("b")).alias("b"))
    return ops.rank_correlation(x, "lang", "a", "b").select("lang", F.round("rho", 6).alias("rho"), "pairs", "skipped")


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS s FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY lang)), b AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY source)), e AS (SELECT a.s * b.s / (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS x FROM a, b) SELECT round((i.s - x) / ((a.s + b.s) / 2 - x), 6) AS ari FROM i, a, b, e")
def a47_rand_index(spark, sf_dir):
    return ops.rand_index(table(spark, sf_dir, "documents"), "lang", "source")


@query(f"{counting.FREQ}, h AS (SELECT n, count(*) AS types FROM freq GROUP BY n) SELECT round(regr_slope(ln(types), ln(n)), 6) AS slope, round(regr_intercept(ln(types), ln(n)), 6) AS intercept FROM h")
def a48_power_law(spark, sf_dir):
    h = counting.frequencies(spark, sf_dir).groupBy("n").agg(F.count("*").alias("types"))
    return h.agg(F.round(F.regr_slope(F.ln("types"), F.ln("n")), 6).alias("slope"), F.round(F.regr_intercept(F.ln("types"), F.ln("n")), 6).alias("intercept"))


@query()
def m7_kmeans(spark, sf_dir):
    """Clusters of vectors (k-means||), with sizes and the label most have."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    c = KMeans(k=10, seed=42, maxIter=10).fit(e).transform(e).groupBy("prediction", "label").agg(F.count("*").alias("n"))
    return c.groupBy("prediction").agg(F.sum("n").alias("n"), F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
