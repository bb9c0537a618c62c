"""Classifiers over conversations, vectors and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from dunecorpus.functions import chars as C
from dunecorpus.operators import models
from dunecorpus.operators import modelling as profiles
from dunecorpus.operators.staging import cut
from dunecorpus.plans.cleaning import SCRIPT_SQL
from dunecorpus.plans.corpus import LITERALS, quoted, table
from dunecorpus.plans.modelling import _CT
from dunecorpus.plans.registry import query

ROLES = ["assistant", "system", "user"]
_TURNS = "t AS MATERIALIZED (SELECT conv_id * 1000 + turn AS id, role, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM conversations)"


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.regexp_extract_all(F.lower("text"), F.lit(C.WORD + "++"), F.lit(0)).alias("w"))


_GATED = "x AS (SELECT item_id, text AS t FROM benchmark UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {quoted(t)})" for i, t in enumerate(LITERALS)) + ") v(item_id, t))"


@query(f"{_CT}, l AS (SELECT item_id, arg_min(lang, (distance, lang)) AS lang FROM d GROUP BY item_id), {_GATED}, s AS (SELECT item_id, {SCRIPT_SQL} AS script FROM x) SELECT item_id, CASE script WHEN 'mixed' THEN 'code_switch' WHEN 'other' THEN 'other' WHEN 'arabic' THEN 'ar' ELSE lang END AS label FROM s LEFT JOIN l USING (item_id)")
def m1_script_gate(spark, sf_dir):
    """M1: the script decides first; Latin texts go to the profile model, Arabic ones have one class."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(LITERALS)], "item_id long, text string")
    every = items.unionByName(own)
    known = profiles.profiles(table(spark, sf_dir, "documents"), "lang", "text")
    apart = profiles.out_of_place(profiles.profiles(items, "item_id", "text"), "item_id", known, "lang")
    latin = apart.groupBy("item_id").agg(F.min(F.struct("distance", "lang")).alias("m")).select("item_id", F.col("m.lang").alias("label"))
    return models.gate(every, "item_id", F.col("text"), {"latin": latin, "arabic": every.select("item_id", F.lit("ar").alias("label"))})


@query()
def m3_hidden_states(spark, sf_dir):
    """M3: the role of each turn by a sticky hidden Markov model, trained on the even conversations."""
    t = turns(spark, sf_dir)
    model = models.train_hidden(t.where(F.floor(F.col("id") / 1000) % 2 == 0), "role", "w")
    return models.decode_hidden(t, "id", "w", model).join(t.select("id", "role"), "id")


@query()
def m6_machines(spark, sf_dir):
    """M6: linear machine, kernel machine (random Fourier features of the radial kernel) and random forest on vectors; accuracy on a fifth held out, of even against odd labels."""
    from pyspark.ml.classification import LinearSVC, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = e.select("vec_id", "label", "v", models.fourier_features(F.col("v"), e.first()["v"], 128, 1.0, 42).alias("kernel"), (F.col("vec_id") % 5 == 0).alias("held"))
    rows = cut(rows.select("label", "held", array_to_vector("v").alias("linear"), array_to_vector("kernel").alias("radial")))
    out = []
    for name, column, learner in (("linear", "linear", LinearSVC(maxIter=10)), ("radial", "radial", LinearSVC(maxIter=10)), ("forest", "linear", RandomForestClassifier(numTrees=30, seed=42))):
        fitted = learner.copy().setFeaturesCol(column).setLabelCol("label").fit(rows.where("not held"))
        out.append(fitted.transform(rows.where("held")).agg(F.lit(name).alias("machine"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")))
    return out[0].unionByName(out[1]).unionByName(out[2])


_VECTOR_OF = "CAST(concat('0x', substr(md5(token), 1, 7)) AS BIGINT) % (SELECT count(*) FROM embeddings)"
_CLUSTERS = f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT label AS cluster, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v) GROUP BY ALL), c AS (SELECT cluster, list(m ORDER BY i) AS centre FROM m GROUP BY cluster), near AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (round(list_distance(v, centre), 12), cluster)) AS cluster FROM v, c GROUP BY vec_id), k AS MATERIALIZED (SELECT token, cluster FROM (SELECT DISTINCT unnest(w) AS token FROM t) JOIN near ON vec_id = {_VECTOR_OF})"


@query(f"WITH {_TURNS}, {_CLUSTERS}, o AS (SELECT role, unnest(list_distinct(w)) AS token FROM t), s AS (SELECT cluster, " + ", ".join(f"avg((role = '{x}')::INT) AS s{i}" for i, x in enumerate(ROLES)) + " FROM o JOIN k USING (token) GROUP BY cluster), h AS (SELECT id, " + ", ".join(f"round(sum(s{i}), 9) AS s{i}" for i in range(3)) + " FROM (SELECT id, unnest(w) AS token FROM t) JOIN k USING (token) JOIN s USING (cluster) GROUP BY id) SELECT id, coalesce(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 'assistant' WHEN s1 >= s2 THEN 'system' WHEN s2 IS NOT NULL THEN 'user' END, 'parse_error') AS predicted FROM t LEFT JOIN h USING (id)")
def m8_cluster_vote(spark, sf_dir):
    """M8: words vote with the class shares of their vector's cluster; a word's vector is dealt to it by its hash."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    near = models.nearest_cluster(e, "vec_id", "v", means)
    t = turns(spark, sf_dir)
    dealt = F.conv(F.substring(F.md5("token"), 1, 7), 16, 10).cast("long") % F.lit(e.count())
    clusters = t.select(F.explode("w").alias("token")).distinct().withColumn("vec_id", dealt).join(near, "vec_id").select("token", "cluster")
    return models.cluster_vote(t, "id", "role", "w", clusters, ROLES)


@query("WITH e AS (SELECT vec_id, vec_id % 7 AS cluster, CASE WHEN vec_id % 3 > 0 THEN label END AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT cluster, i, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL), c AS (SELECT cluster, list(m ORDER BY i) AS centre FROM m GROUP BY cluster), p AS (SELECT cluster, arg_min(label, (list_distance(v, centre), vec_id)) AS found, arg_min(vec_id, (list_distance(v, centre), vec_id)) AS prototype FROM e JOIN c USING (cluster) GROUP BY cluster) SELECT e.vec_id, q.label FROM e JOIN p USING (cluster) JOIN e q ON q.vec_id = p.prototype WHERE q.label IS NOT NULL")
def m9_prototype_labels(spark, sf_dir):
    """M9: members take the label of their cluster's prototype; a cluster whose prototype has none is left out."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("cluster"), F.when(F.col("vec_id") % 3 > 0, F.col("label")).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return models.propagate(e, "cluster", "vec_id", "label", "v")


@query(f"WITH {_TURNS}, x AS MATERIALIZED (SELECT id, role, unnest(w) AS token FROM t), s AS MATERIALIZED (SELECT token, " + ", ".join(f"(count(*) FILTER (role = '{x}') + 0.5) / (count(*) + 1.5) AS s{i}" for i, x in enumerate(ROLES)) + " FROM x GROUP BY token), b AS (SELECT unnest(w[:-2]) AS token, unnest(w[2:]) AS next FROM t WHERE len(w) > 1), v AS MATERIALIZED (SELECT b.token, " + ", ".join(f"avg(s{i}) AS v{i}" for i in range(3)) + " FROM b JOIN s ON s.token = b.next GROUP BY b.token), h AS (SELECT id, " + ", ".join(f"round(sum(v{i}), 9) AS s{i}" for i in range(3)) + " FROM x JOIN v USING (token) GROUP BY id) SELECT id, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 'assistant' WHEN s1 >= s2 THEN 'system' ELSE 'user' END AS predicted FROM h")
def m12_next_word_vote(spark, sf_dir):
    """The next words that each word lets expect vote with their class shares."""
    return models.next_word_vote(turns(spark, sf_dir), "id", "role", "w", ROLES)
