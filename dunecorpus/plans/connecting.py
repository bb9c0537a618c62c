"""Pages (H), and sources, sinks and incremental reading (S, I) by round trips through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dunecorpus.functions import html, ids
from dunecorpus.operators.staging import shared_folder
from dunecorpus.plans.cleaning import r
from dunecorpus.plans.corpus import quoted, table
from dunecorpus.plans.registry import query
from dunecorpus.sources import readers
from dunecorpus.streaming.ingest import ingest

_LINK = quoted(html.LINK)


def scratch(spark, name: str) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, {_LINK}, 1)) AS href, unnest(regexp_extract_all(html, {_LINK}, 2)) AS title FROM pages) SELECT page_id, href, min(title) AS title, count(*) AS n FROM l WHERE trim(title) <> '' GROUP BY ALL")
def s11_page_links(spark, sf_dir):
    """Every titled link of the pages, by simple markup."""
    p = table(spark, sf_dir, "pages").select("page_id", F.inline(html.links(F.col("html"))).alias("href", "title"))
    return p.groupBy("page_id", "href").agg(F.min("title").alias("title"), F.count("*").alias("n"))


@query(f"SELECT page_id, regexp_extract(html, '{html.TITLE}', 1) AS title, md5(trim({r(r(r('html', html.HIDDEN, ' '), html.TAG, ' '), chr(91) + ' \\t\\r\\n]+', ' ')})) AS digest FROM pages")
def s11_page_text(spark, sf_dir):
    """Title and visible text of the pages."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.title(h).alias("title"), F.md5(html.visible(h)).alias("digest"))


@query("SELECT doc_id FROM documents WHERE doc_id < 130")
def s4_first_records(spark, sf_dir):
    """Records across files in order until there are enough."""
    at = scratch(spark, "limit")
    d = table(spark, sf_dir, "documents").select("doc_id")
    for part in range(4):
        d.where((F.col("doc_id") >= 50 * part) & (F.col("doc_id") < 50 * (part + 1))).coalesce(1).sortWithinPartitions("doc_id").write.json(f"{at}/{part}")
    return readers.first_records(spark, f"{at}/*/*.json", "doc_id long", 130)


@query("SELECT length(text) AS value FROM documents WHERE text IS NOT NULL")
def s5_number_of_lines(spark, sf_dir):
    """One field of JSON lines without parsing them."""
    at = scratch(spark, "lengths")
    table(spark, sf_dir, "documents").where("text is not null").select("text", F.length("text").alias("token_count")).write.json(at)
    return readers.numbers_of_lines(spark, at, "token_count")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 2 = 1")
def s14_atomic_replace(spark, sf_dir):
    """A second version takes the place of the first as a whole."""
    at, d = f"{scratch(spark, 'atomic')}/table", table(spark, sf_dir, "documents").select("doc_id", "source")
    readers.replace_whole(d, at)
    readers.replace_whole(d.where("doc_id % 2 = 1"), at)
    return spark.read.parquet(at)


@query("SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total, 8::BIGINT AS shards, true AS dealt FROM documents")
def s17_packed_shards(spark, sf_dir):
    """All records are in just one of eight shards, and no shard is far from its share."""
    at = scratch(spark, "shards")
    readers.packed_shards(table(spark, sf_dir, "documents").select("doc_id"), at, 8, "doc_id")
    per = spark.read.parquet(at).groupBy("shard").agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))
    return per.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("shards"), (F.max("n") < 2 * F.avg("n")).alias("dealt"))


_README = "# Data\n- documents: 12\n## Statistics\n* **documents**: 1,234\n* tokens : 5.5\n## Other\n- documents: 9\n"


@query(f"SELECT replace(replace({quoted(_README)}, '1,234', count(*)::VARCHAR), '5.5', '77') AS page FROM documents")
def s18_page_numbers(spark, sf_dir):
    """Numbers of one section of a page are brought up to date."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return n.select(readers.with_numbers(F.lit(_README), "Statistics", {"documents": F.col("n"), "tokens": F.lit(77)}).alias("page"))


@query("WITH p AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN length(text) END AS bytes, doc_id FROM documents) SELECT path, bytes, CASE WHEN bytes IS NULL THEN 'gone' WHEN doc_id % 3 <> 0 THEN 'upload' WHEN doc_id % 4 = 0 THEN 'upload again' ELSE 'may be deleted' END AS action, '2024-05-01' AS day FROM p")
def s20_archive_plan(spark, sf_dir):
    """What a verified archive would let go, as a dry run."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("path"), F.length("text").alias("bytes"))
    archived = d.where("doc_id % 3 = 0").select("path", (F.col("bytes") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("bytes"))
    return readers.archive_plan(d, d.where("doc_id % 2 = 0").select("path", "bytes"), archived, "2024-05-01")


@query("SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL")
def s1_json_round_trip(spark, sf_dir):
    """Append by day, read tolerantly and recursively."""
    at = scratch(spark, "json")
    readers.append_json(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), at, "source")
    d = readers.json_lines(spark, f"{at}/*", "doc_id long, text string")
    return d.select("doc_id", "text", F.regexp_extract("_metadata.file_path", "source=([^/]+)/", 1).alias("source"), "_corrupt").where("_corrupt is null").drop("_corrupt")


@query("SELECT md5(trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'))) AS digest FROM documents WHERE trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) <> ''")
def s15_text_lines(spark, sf_dir):
    at = scratch(spark, "text")
    readers.text_lines(table(spark, sf_dir, "documents"), "text", at)
    return spark.read.text(at).select(F.md5("value").alias("digest"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def s16_csv_table(spark, sf_dir):
    at = scratch(spark, "csv")
    readers.csv_table(table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")), at)
    return spark.read.option("header", True).schema("source string, lang string, n long").csv(at)


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, CASE WHEN n < 1000 THEN 'n<1K' WHEN n < 10000 THEN '1K<n<10K' WHEN n < 100000 THEN '10K<n<100K' ELSE '100K<n<1M' END AS band FROM n")
def s19_size_band(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", ids.size_band(F.col("n")).alias("band"))


@query("SELECT doc_id AS id, source AS channel, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def s21_registry_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("channel"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return d.unionByName(p, allowMissingColumns=True)


@query()
def i1_incremental(spark, sf_dir):
    """Two runs over a growing folder take each file once."""
    src, out, state = (scratch(spark, x) for x in ("in", "out", "state"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    for half in (0, 1):
        d.where(F.col("doc_id") % 2 == half).write.mode("append").json(src)
        log = ingest(spark, src, "doc_id long, text string", out, state)
    return log
