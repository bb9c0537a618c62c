"""Samples, splits, set operations and exact duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dunecorpus.functions import text, tokens
from dunecorpus.operators import selecting as ops
from dunecorpus.operators.staging import cut
from dunecorpus.plans.cleaning import BLANKS, STRIP, WORDS_SQL, r
from dunecorpus.plans.corpus import WITH, corpus, table
from dunecorpus.plans import counting
from dunecorpus.plans.registry import query

DRAW = "md5('42:' || doc_id)"
RANKED = f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {DRAW}, doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents)"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source")


@query(f"SELECT doc_id FROM documents ORDER BY {DRAW}, doc_id LIMIT 100")
def u3_reservoir(spark, sf_dir):
    return ops.sample(docs(spark, sf_dir), 100, "doc_id").select("doc_id")


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY substring({DRAW}, 1, 2) ORDER BY {DRAW}, doc_id) AS BIGINT) AS place, substring({DRAW}, 1, 2) AS block FROM documents")
def u2_shuffle(spark, sf_dir):
    """A permutation: 256 hash blocks, each in hash order."""
    d = docs(spark, sf_dir).select("doc_id", ops.draw("doc_id").alias("h")).withColumn("block", F.substring("h", 1, 2))
    return d.select("doc_id", "block", F.row_number().over(Window.partitionBy("block").orderBy("h", "doc_id")).cast("bigint").alias("place"))


_T = {"src0": 5, "src1": 7, "src2": 40}


@query(f"{RANKED} SELECT doc_id, source FROM r WHERE place <= CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _T.items()) + " ELSE 3 END")
def u4_stratified(spark, sf_dir):
    """At most a class's quota of each."""
    return ops.quotas(docs(spark, sf_dir), "source", "doc_id", _T, 3)


@query(f"WITH need AS (SELECT source, greatest(0, 20 - count(l.doc_id)) AS need FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {DRAW}, doc_id) AS place FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT doc_id, source FROM r JOIN need USING (source) WHERE place <= need")
def u5_pool_extension(spark, sf_dir):
    have = table(spark, sf_dir, "labels").select("doc_id").distinct()
    d = docs(spark, sf_dir)
    need = d.join(have.withColumn("had", F.lit(1)), "doc_id", "left").groupBy("source").agg(F.greatest(F.lit(0), 20 - F.count("had")).alias("need"))
    fresh = ops.ranked(d.join(have, "doc_id", "left_anti"), "source", "doc_id")
    return fresh.join(need, "source").where("place <= need").select("doc_id", "source")


@query(f"{RANKED} SELECT doc_id, source FROM r WHERE place <= round_even(n * 0.2, 0)")
def u7_fifth_per_channel(spark, sf_dir):
    return ops.ranked(docs(spark, sf_dir), "source", "doc_id").where(F.col("place") <= F.bround(F.col("group_size") * 0.2)).select("doc_id", "source")


@query(f"{RANKED} SELECT doc_id, CASE WHEN place <= n // 2 THEN 'dev' ELSE 'test' END AS split FROM r")
def u8_dev_test(spark, sf_dir):
    d = ops.ranked(docs(spark, sf_dir), "source", "doc_id")
    return d.select("doc_id", F.when(F.col("place") <= F.floor(F.col("group_size") / 2), "dev").otherwise("test").alias("split"))


@query(f"{RANKED} SELECT doc_id, CASE WHEN place <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS split FROM r")
def u9_stratified_split(spark, sf_dir):
    d = ops.ranked(docs(spark, sf_dir), "source", "doc_id")
    return d.select("doc_id", F.when(F.col("place") <= F.greatest(F.lit(1.0), F.bround(F.col("group_size") * 0.2)), "test").otherwise("train").alias("split"))


@query(f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {DRAW}, doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, CASE WHEN place <= 10 THEN -1 ELSE least(4, (place - 11) // greatest(1, (n - 10) // 5)) END AS shard FROM r")
def u10_shards(spark, sf_dir):
    """Ten documents of each source are everyone's (-1); the rest goes to five shards, what remains to the last."""
    d = ops.ranked(docs(spark, sf_dir), "source", "doc_id")
    width = F.greatest(F.lit(1), F.floor((F.col("group_size") - 10) / 5))
    return d.select("doc_id", F.when(F.col("place") <= 10, F.lit(-1)).otherwise(F.least(F.lit(4), F.floor((F.col("place") - 11) / width))).cast("bigint").alias("shard"))


_KEY = r(f"lower({r('text', STRIP, '')})", BLANKS, " ")


@query(f"WITH a AS (SELECT doc_id, text, 1 AS pool FROM documents UNION ALL SELECT item_id, text, 0 FROM benchmark), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pool) AS p FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY pool, doc_id) AS q FROM i WHERE p = 1) SELECT doc_id, pool FROM k WHERE q = 1")
def d5_merge_dedup(spark, sf_dir):
    """The existing pool wins, by id and then by normalised text."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit(0).alias("pool"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(1).alias("pool")).unionByName(b)
    keyed = d.select("doc_id", "pool", F.sha2(text.shingle_form("text"), 256).alias("key"))
    return ops.dedup(keyed, "doc_id", F.col("key"), [F.col("pool"), F.col("doc_id")]).select("doc_id", "pool")


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {_KEY}")
def d6_exact_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.shingle_form("text"), 256).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("key")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def u14_last_write_wins(spark, sf_dir):
    """The last event of each key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return ops.first_of(e, [F.col("user_id"), F.col("event_type")], [-F.col("event_id")])


@query("(SELECT doc_id AS id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL (SELECT item_id FROM benchmark EXCEPT SELECT doc_id FROM labels)")
def u15_set_operations(spark, sf_dir):
    """U1 and U15."""
    ids = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("id"))
    both = ids("documents", "doc_id").intersect(ids("labels", "doc_id"))
    return both.unionByName(ids("benchmark", "item_id").subtract(ids("labels", "doc_id")))


@query(f"{counting.FREQ} SELECT token, round(least(1, sqrt(1e-3 * sum(n) OVER () / n)), 6) AS keep, CAST(round(n ** 0.75 / sum(n ** 0.75) OVER () * 10000000) AS BIGINT) AS slots FROM freq")
def u17_subsampling(spark, sf_dir):
    """Chance to keep a frequent word, and its slots among negatives."""
    f = cut(counting.frequencies(spark, sf_dir))  # used twice: counted once
    s = f.agg(F.sum("n").alias("total"), F.sum(F.pow("n", F.lit(0.75))).alias("mass"))
    return f.join(F.broadcast(s)).select("token", F.round(F.least(F.lit(1.0), F.sqrt(F.col("total") * 1e-3 / F.col("n"))), 6).alias("keep"), F.round(F.pow("n", F.lit(0.75)) / F.col("mass") * 10000000).cast("bigint").alias("slots"))


_SHINGLES = f"WITH t AS (SELECT doc_id, {r('lower(' + r('text', STRIP, '') + ')', BLANKS, ' ')} AS t FROM documents), c AS (SELECT doc_id, t, regexp_extract_all(t, '(?s).') AS c FROM t)"


@query(f"{_SHINGLES} SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 WHEN len(c) <= 4 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3]))) END AS BIGINT) AS shingles FROM c")
def d1_shingle_counts(spark, sf_dir):
    """Distinct four-character shingles of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.shingle_form("text").alias("t"))
    return d.select("doc_id", F.size(tokens.shingles(F.col("t"))).cast("bigint").alias("shingles"))


@query()
def d2_minhash(spark, sf_dir):
    """The digest of the first eight of 128 minimum hashes."""
    from dunecorpus.operators import minhash

    return minhash.signatures(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "digest")


@query()
def d4_near_duplicates(spark, sf_dir):
    """Which documents a greedy walk in the order of their ids drops; tests hold it against a plain walk."""
    from dunecorpus.operators import minhash

    return minhash.duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def i3_persisted_index(spark, sf_dir):
    """Three batches walked against the stored index drop what one walk over all drops."""
    from dunecorpus.operators import minhash
    from dunecorpus.plans.connecting import scratch

    at, d = scratch(spark, "bands"), table(spark, sf_dir, "documents")
    third = d.agg(F.max("doc_id")).first()[0] // 3 + 1
    parts = [cut(minhash.walk_batch(d.where(F.floor(F.col("doc_id") / third) == b), "doc_id", "text", at, b)) for b in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
