"""Relations that queries share, in both languages: documents with literal rows that hold Arabic script."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Literal texts that exercise the script-sensitive operators.
LITERALS = (
    "السَّلَام عَلَيْكُم",
    "Wach rakoum 3andi 1500 دج و [URL] [MENTION] هههه",
    "@someuser https://example.com/x شكراااا 12:30 !!!! ...... ?؟؟؟؟",
    "\U0001f602\U0001f602\U0001f602",
    "مرحبا wach kayen bezzaf كاين",
    "12345 !!",
    "www.site.dz/x   two  spaces\n\n\n\nlines @a.b_c",
    "واش راك خويا،،،، لاباس",
    "éè déjà vu naïve 99",
    "موضوع جديد\nأكبر تواجد بالمنتدى كان 512 عضو\nبتاريخ 2014",
    "اقتباس:\nالمشاركة الأصلية كتبت بواسطة حَمزة\nهذا رد على الكلام",
    "[b]bold[/b] [URL] [url=http://a.dz]here[/url] [QUOTE=x y ]said[/QUOTE] [/URL]",
    "عـــيد مبـــارك الساعة ١٢:٣٠ ثم 7:45:10 8:00 9:15 و a10:20 99:99:99:99",
    "zero\u200bwidth a\u200db \U0001f469\u200d\U0001f680 \U0001f468\u200d\U0001f469\u200d\U0001f467 \u200eend\ufeff \u200d",
    "[URL] [MENTION] a \u2776 \U0001f602",
)
SOURCE = "fixture"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1 - i, t, SOURCE) for i, t in enumerate(LITERALS)], "doc_id long, text string, source string")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source").unionByName(own)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CORPUS = "corpus AS (SELECT doc_id, text, source FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {quoted(t)}, '{SOURCE}')" for i, t in enumerate(LITERALS)) + ") v(doc_id, text, source))"
WITH = f"WITH {CORPUS}"
