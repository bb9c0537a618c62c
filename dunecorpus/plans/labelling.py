"""F and J relations, annotators' votes (A26 to A38) and statistics on labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dunecorpus.operators import agreement as ops
from dunecorpus.operators import counting
from dunecorpus.operators import selecting
from dunecorpus.plans.corpus import table
from dunecorpus.plans.registry import query

CLASSES = ("NEG", "NEU", "POS", "MIX")
_PICK = "(doc_id * 7 + a * a * (doc_id % 3) + coalesce(quality, 0)) % 4"
VOTES = f"WITH votes AS (SELECT doc_id, a, ['NEG', 'NEU', 'POS', 'MIX'][CAST({_PICK} AS INT) + 1] AS label FROM labels, (SELECT unnest(range(5)) AS a) WHERE NOT (doc_id % 11 = 0 AND a = 4))"


def votes(spark, sf_dir):
    """Five annotators' votes, derived from the labels; some items lack the fifth."""
    v = table(spark, sf_dir, "labels").select("doc_id", "quality", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("a"))
    v = v.where(~((F.col("doc_id") % 11 == 0) & (F.col("a") == 4)))
    return v.select("doc_id", "a", F.get(F.array(*map(F.lit, CLASSES)), F.expr(_PICK).cast("int")).alias("label"))


_N = ", n AS (SELECT doc_id, label, count(*) AS n, min(a) AS first FROM votes GROUP BY ALL)"
_MAJ = f"{VOTES}{_N}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank, sum(n) OVER (PARTITION BY doc_id) AS m FROM n), maj AS (SELECT doc_id, CASE WHEN m = 5 AND n >= 3 THEN label END AS label, round(n / m, 6) AS agreement, CASE WHEN m <> 5 THEN 'missing' WHEN n >= 3 THEN 'agreed' ELSE 'disagreement' END AS status FROM r WHERE rank = 1)"


@query(f"{_MAJ} SELECT * FROM maj")
def a26_majority(spark, sf_dir):
    """Items with five votes take the label of three or more."""
    return ops.majority(votes(spark, sf_dir), "doc_id", "label", "a", 5, 3)


@query(f"{_MAJ} SELECT lang, label, count(*) AS n, round(avg(agreement), 6) AS agreement FROM maj JOIN documents USING (doc_id) GROUP BY ALL")
def a30_group_agreement(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return a26_majority(spark, sf_dir).join(d, "doc_id").groupBy("lang", "label").agg(F.count("*").alias("n"), F.round(F.avg("agreement"), 6).alias("agreement"))


@query(f"{VOTES}, d AS (SELECT doc_id, label, CASE label WHEN 'NEG' THEN 4 WHEN 'POS' THEN 3 WHEN 'NEU' THEN 2 END AS prio FROM votes WHERE label <> 'MIX'), n AS (SELECT doc_id, label, prio, count(*) AS n FROM d GROUP BY ALL) SELECT doc_id, (SELECT label FROM n WHERE n.doc_id = l.doc_id ORDER BY n DESC, prio DESC LIMIT 1) AS label FROM labels l")
def a27_fixed_ties(spark, sf_dir):
    """Majority with a fixed order of ties; one class never counts; null if nothing is left."""
    v = votes(spark, sf_dir).where(F.col("label") != "MIX").groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    prio = F.when(F.col("label") == "NEG", 4).when(F.col("label") == "POS", 3).otherwise(2)
    top = v.groupBy("doc_id").agg(F.max_by("label", F.struct("n", prio)).alias("label"))
    return table(spark, sf_dir, "labels").select("doc_id").join(top, "doc_id", "left")


@query(f"{VOTES}{_N}, i AS (SELECT doc_id, (sum(n * n) - sum(n)) / (sum(n) * (sum(n) - 1)) AS p FROM n GROUP BY doc_id), c AS (SELECT label, sum(n) AS n FROM n GROUP BY label), e AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS e FROM c) SELECT round(((SELECT avg(p) FROM i) - e) / (1 - e), 6) AS kappa FROM e")
def a28_fleiss(spark, sf_dir):
    return ops.fleiss(votes(spark, sf_dir), "doc_id", "label")


_PAIR = f"{VOTES}, cells AS (SELECT x.label AS truth, y.label AS predicted, count(*) AS n FROM votes x JOIN votes y ON x.doc_id = y.doc_id AND x.a = 0 AND y.a = 1 GROUP BY ALL)"
_SCORES = f"{_PAIR}, t AS (SELECT truth AS label, sum(n) AS support, coalesce(sum(n) FILTER (truth = predicted), 0) AS tp FROM cells GROUP BY 1), p AS (SELECT predicted AS label, sum(n) AS predicted FROM cells GROUP BY 1), s AS (SELECT label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, CASE WHEN coalesce(support, 0) = 0 THEN 0.0 ELSE tp / support END AS recall, CASE WHEN coalesce(predicted, 0) = 0 OR tp IS NULL THEN 0.0 ELSE tp / predicted END AS precision FROM t FULL JOIN p USING (label)), f AS (SELECT *, CASE WHEN recall + precision = 0 THEN 0.0 ELSE 2 * recall * precision / (recall + precision) END AS f1 FROM s)"


def _cells(spark, sf_dir):
    v = votes(spark, sf_dir).where("a < 2").groupBy("doc_id").pivot("a", [0, 1]).agg(F.first("label"))
    return ops.confusion(v, "0", "1")


@query(f"{_PAIR} SELECT * FROM cells")
def a29_confusion(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(f"{_SCORES} SELECT label, tp::bigint AS tp, support::bigint AS support, predicted::bigint AS predicted, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM f")
def a36_class_scores(spark, sf_dir):
    s = ops.class_scores(_cells(spark, sf_dir))
    return s.select("label", "tp", "support", "predicted", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query(f"{_SCORES} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round((sum(tp) / sum(support) - sum(support * predicted) / (sum(support) * sum(support))) / (1 - sum(support * predicted) / (sum(support) * sum(support))), 6) AS kappa FROM f")
def a29_cohen(spark, sf_dir):
    """Accuracy, macro F1 and Cohen's kappa of two annotators."""
    return ops.cohen(_cells(spark, sf_dir))


@query(f"{VOTES} SELECT x.a AS a, y.a AS b, count(*) AS n, round(avg((x.label = y.label)::int), 6) AS agreement FROM votes x JOIN votes y ON x.doc_id = y.doc_id AND x.a < y.a GROUP BY ALL")
def j11_pairwise_agreement(spark, sf_dir):
    """Pairs are made inside the item's row of five votes: one shuffle, no self join."""
    v = votes(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "label"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x: F.transform(F.filter("v", lambda y: y["a"] > x["a"]), lambda y: F.struct(x["a"].alias("a"), y["a"].alias("b"), (x["label"] == y["label"]).cast("int").alias("same")))))
    return v.select(F.inline(pairs)).groupBy(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).agg(F.count("*").alias("n"), F.round(F.avg("same"), 6).alias("agreement"))


@query(f"{VOTES}, s AS (SELECT a, " + ", ".join(f"avg((label = '{k}')::int) AS {k}" for k in CLASSES) + " FROM votes GROUP BY a), m AS (SELECT " + ", ".join(f"avg({k}) AS m_{k}" for k in CLASSES) + " FROM s) SELECT " + ", ".join(f"round(max(abs({k} - m_{k})), 6) AS {k}" for k in CLASSES) + " FROM s, m")
def a31_share_deviation(spark, sf_dir):
    s = votes(spark, sf_dir).groupBy("a").agg(*[F.avg((F.col("label") == k).cast("int")).alias(k) for k in CLASSES])
    every = Window.partitionBy()
    return s.select(*[F.abs(F.col(k) - F.avg(k).over(every)).alias(k) for k in CLASSES]).agg(*[F.round(F.max(k), 6).alias(k) for k in CLASSES])


@query(f"{VOTES} SELECT lang, " + ", ".join(f"round(avg((label = '{k}')::int), 6) AS {k}" for k in CLASSES) + " FROM votes JOIN documents USING (doc_id) GROUP BY lang")
def a32_label_crosstab(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return votes(spark, sf_dir).join(d, "doc_id").groupBy("lang").agg(*[F.round(F.avg((F.col("label") == k).cast("int")), 6).alias(k) for k in CLASSES])


@query(f"{VOTES}, c AS (SELECT lang, label, count(*) AS n FROM votes JOIN documents USING (doc_id) GROUP BY ALL), e AS (SELECT n, sum(n) OVER (PARTITION BY lang) * sum(n) OVER (PARTITION BY label) / sum(n) OVER () AS x FROM c), z AS (SELECT count(*) AS cells FROM c) SELECT round(sum(n * n / x) - sum(n), 5) AS statistic FROM e")
def a33_chi_squared(spark, sf_dir):
    """Independence of label and language; absent cells add nothing to sum(n*n/x) - N."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    c = votes(spark, sf_dir).join(d, "doc_id").groupBy("lang", "label").agg(F.count("*").alias("n"))
    x = F.sum("n").over(Window.partitionBy("lang")) * F.sum("n").over(Window.partitionBy("label")) / F.sum("n").over(Window.partitionBy())
    return c.select("n", x.alias("x")).agg(F.round(F.sum(F.col("n") * F.col("n") / F.col("x")) - F.sum("n"), 5).alias("statistic"))


_LW = r"WITH w AS (SELECT DISTINCT doc_id, toxic, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL), n AS (SELECT toxic, token, count(*) AS n FROM w GROUP BY ALL)"


def _label_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    return table(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", "toxic").join(d, "doc_id").select("toxic", F.explode("w").alias("token")).groupBy("toxic", "token").agg(F.count("*").alias("n"))


@query(f"{_LW} SELECT * FROM n")
def a43_word_label_tally(spark, sf_dir):
    return _label_words(spark, sf_dir)


@query(f"{_LW}, c AS (SELECT token, sum(n) AS all_n, max(n) AS top FROM n GROUP BY token) SELECT round(sum(top) / sum(all_n), 6) AS purity FROM c")
def a44_weighted_purity(spark, sf_dir):
    c = _label_words(spark, sf_dir).groupBy("token").agg(F.sum("n").alias("all_n"), F.max("n").alias("top"))
    return c.agg(F.round(F.sum("top") / F.sum("all_n"), 6).alias("purity"))


@query(f"{_LW}, t AS (SELECT toxic, sum(n) AS total FROM n GROUP BY toxic), a AS (SELECT token, sum(n) AS all_n FROM n GROUP BY token), l AS (SELECT toxic, token, n, round((n / total) / (all_n / (SELECT sum(total) FROM t)), 6) AS lift FROM n JOIN t USING (toxic) JOIN a USING (token) WHERE n >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY lift DESC, token) AS rank FROM l) SELECT * FROM r WHERE rank <= 10")
def a34_lift(spark, sf_dir):
    n = _label_words(spark, sf_dir)
    t = n.groupBy("toxic").agg(F.sum("n").alias("total")).withColumn("mass", F.sum("total").over(Window.partitionBy()))
    l = n.withColumn("all_n", F.sum("n").over(Window.partitionBy("token"))).where("n >= 3").join(F.broadcast(t), "toxic")  # noqa: E741 - one row a label
    l = l.select("toxic", "token", "n", F.round((F.col("n") / F.col("total")) / (F.col("all_n") / F.col("mass")), 6).alias("lift"))  # noqa: E741
    return counting.top(l, 10, "lift", "token", by=("toxic",))


@query(f"{_LW}, r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY n DESC, token) AS rank FROM n) SELECT * FROM r WHERE rank <= 20")
def a35_top_per_class(spark, sf_dir):
    return counting.top(_label_words(spark, sf_dir), 20, "n", "token", by=("toxic",))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def f1_exclude_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, CASE WHEN l.id IS NULL THEN 'train' ELSE 'heldout' END AS split FROM documents d LEFT JOIN (SELECT DISTINCT doc_id AS id FROM labels WHERE doc_id % 5 = 0) l ON d.doc_id = l.id WHERE trim(replace(text, chr(10), ' ')) <> ''")
def f2_heldout(spark, sf_dir):
    held = table(spark, sf_dir, "labels").where("doc_id % 5 = 0").select("doc_id", F.lit("heldout").alias("split")).distinct()
    d = table(spark, sf_dir, "documents").where(F.trim(F.replace("text", F.lit("\n"), F.lit(" "))) != "")
    return d.select("doc_id").join(held, "doc_id", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@query("SELECT doc_id, coalesce(CAST(toxic AS VARCHAR), '?') AS label FROM documents LEFT JOIN labels USING (doc_id)")
def j2_default_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic").cast("string"), F.lit("?")).alias("label"))


@query(f"{_MAJ}, fix AS (SELECT doc_id, 'POS' AS fixed FROM maj WHERE status = 'disagreement' AND doc_id % 2 = 0) SELECT doc_id, coalesce(fixed, label) AS label, agreement, status, CASE WHEN fixed IS NOT NULL THEN label END AS before FROM maj LEFT JOIN fix USING (doc_id)")
def j4_overlay(spark, sf_dir):
    """Reviewed disagreements take the correction."""
    m = a26_majority(spark, sf_dir)
    fix = m.where("status = 'disagreement' and doc_id % 2 = 0").select("doc_id", F.lit("POS").alias("fixed"))
    return ops.overlay(m, fix, "doc_id", "label", "fixed")


@query("SELECT a.conv_id, a.turn, a.role, b.role AS parent_role, CAST(length(b.text) AS BIGINT) AS parent_chars FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1")
def j13_reply_parent(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    parent = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"), F.length("text").cast("bigint").alias("parent_chars"))
    return c.select("conv_id", "turn", "role").join(parent, ["conv_id", "turn"], "left")


@query("WITH RECURSIVE t AS (SELECT item_id AS id, 0 AS depth FROM benchmark WHERE item_id = 0 UNION ALL SELECT b.item_id, t.depth + 1 FROM t JOIN benchmark b ON b.item_id > 0 AND (b.item_id - 1) // 2 = t.id) SELECT id, CAST(depth AS BIGINT) AS depth FROM t")
def j12_tree_walk(spark, sf_dir):
    """Parents to children level by level."""
    b = table(spark, sf_dir, "benchmark").select("item_id")
    links = b.where("item_id > 0").select(F.expr("(item_id - 1) div 2").alias("parent"), F.col("item_id").alias("place"), F.col("item_id").alias("child"))
    roots = b.where("item_id = 0").select(F.col("item_id").alias("id"), F.lit(0).alias("place"), F.lit("all").alias("category"))
    return selecting.walk_tree(links, roots).select("id", F.col("depth").cast("long").alias("depth"))


@query("WITH f AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events) SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM f WHERE bad GROUP BY ALL) GROUP BY user_id")
def i5_consecutive_failures(spark, sf_dir):
    bad = (F.col("event_type") == "error").alias("bad")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", bad)
    at = ("ts", "event_id")
    f = e.withColumn("island", F.row_number().over(Window.partitionBy("user_id").orderBy(*at)) - F.row_number().over(Window.partitionBy("user_id", "bad").orderBy(*at)))
    return f.where("bad").groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))
