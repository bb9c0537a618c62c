"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet into the shared folder and reads it as the next
one's documents; a stage's folder goes once the next one's is written.

Edge cases, in every stage: a null text counts as empty; ids and other columns
stay as they are, null or not; rows without a doc_id can't be named and stay,
unless they are toxic; additional columns are kept to the last stage but one;
very long texts are read whole; an empty table gives an empty result.  Repeated
rows stay (toxicity, secrets), become one (near duplicates), stay or go
together (mixing) or are packed as often as they come.  Ties: a score of just
0.5 is toxic; of a class the smallest doc_id stays; of overlapping secrets the
text from the first's start to the last's end is masked.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dunecorpus.llm import mixing, ngram_join, packing, secrets, toxicity
from dunecorpus.llm.common import read_table
from dunecorpus.llm.queries import tokenizer_path
from dunecorpus.operators.staging import remove, shared_folder

#: Token shares of good, poor and rude documents after mixing.  Toxic documents are gone by then, so rude ones
#: mostly hold less than this; they give what they hold.
TARGETS = (0.92, 0.05, 0.03)
#: The part of the tokens that mixing keeps in any case.
LEAST = 0.8
#: Bytes of texts that go to Python at once (Spark's own limit is 64 MB); a longer text goes alone.  An executor
#: has such a batch several times: as it fills, in the buffer it is sent from, and in the worker that reads it.
BATCH_BYTES = 4 << 20
#: Words whose ids a packing worker keeps; most of a larger stock are rare and don't come again.
PACKING_WORDS = 250_000


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` with Arrow batches of at most ``BATCH_BYTES``; the setting stays, as the stage's rows are made when they are written."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return ngram_join.keep_one(docs)


@in_small_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mark; all documents stay."""
    return secrets.redact(docs)


@in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at the rates that meet the domains' target shares, ``TARGETS``, as far as ``LEAST`` of all tokens stay."""
    return mixing.thin(docs, read_table(spark, sf_dir, "labels"), TARGETS, least=LEAST)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), words=PACKING_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL: the classifiers and the tokenizer can't be expressed in it; tests/llm/test_pipeline.py holds each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # the next stage is written whole: nothing reads this one any more
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
