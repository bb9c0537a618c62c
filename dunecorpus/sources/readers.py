"""Files in and out: tolerant JSON lines, labelled text, treebanks, incremental ingestion."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def json_lines(spark: SparkSession, path, schema: str, tolerant: bool = True) -> DataFrame:
    """Records of JSON lines; malformed ones come with the line in ``_corrupt`` when tolerant, else they fail the job."""
    reader = spark.read.schema(f"{schema}, {CORRUPT} string" if tolerant else schema)
    return reader.option("mode", "PERMISSIVE" if tolerant else "FAILFAST").option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", True).json(path)


def labelled_csv(spark: SparkSession, path) -> DataFrame:
    """(label, text): all after the first comma is text, commas and all."""
    return spark.read.text(path).select(F.regexp_extract("value", "^([^,]*),", 1).alias("label"), F.regexp_extract("value", "^[^,]*,(.*)$", 1).alias("text")).where("label <> ''")


def key_labels(spark: SparkSession, path) -> DataFrame:
    """(key, label): split at the line's last tab; lines without a key are headers."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^# sent_id = (.*)\t", 1).alias("key"), F.regexp_extract("value", r"\t([^\t]*)$", 1).alias("label")).where("key <> ''")


def treebank(spark: SparkSession, path) -> DataFrame:
    """(sent_id, text, forms, tags, langs) of CoNLL-U blocks; multiword and empty rows are skipped."""
    lines = F.split(F.trim("value"), "\n")
    meta = lambda k: F.regexp_extract("value", rf"(?m)^# {k} = (.*)$", 1)
    rows = F.filter(F.transform(F.filter(lines, lambda x: ~x.startswith("#") & (x != "")), lambda x: F.split(x, "\t")), lambda r: F.get(r, F.lit(0)).rlike("^[0-9]+$"))
    b = spark.read.text(path, lineSep="\n\n").where(F.trim("value") != "").select(meta("sent_id").alias("sent_id"), meta("text").alias("text"), rows.alias("r"))
    return b.select("sent_id", "text", F.transform("r", lambda r: F.get(r, F.lit(1))).alias("forms"), F.transform("r", lambda r: F.get(r, F.lit(3))).alias("tags"), F.transform("r", lambda r: F.regexp_extract(F.get(r, F.lit(9)), "lang=([a-zA-Z_]+)", 1)).alias("langs"))


def first_records(spark: SparkSession, path, schema: str, n: int) -> DataFrame:
    """The first ``n`` records across the files in the order of their paths: later files aren't read once there are enough."""
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path")
    out, left = None, n
    for row in files.toLocalIterator():
        if left <= 0:
            break
        parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
        lines = spark.read.text(row["path"]).where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
        some = lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT).limit(left)
        left -= some.count()
        out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], schema) if out is None else out


def numbers_of_lines(spark: SparkSession, path, name: str) -> DataFrame:
    """(value) of one numeric field, cut out of the lines without parsing them: its last place in a line counts."""
    found = F.regexp_extract("value", rf'(?s)^.*"{name}":\s*(-?[0-9]+)', 1)
    return spark.read.text(path).select(F.when(found != "", found.cast("long")).alias("value")).where("value is not null")


def settings(spark: SparkSession, path: str) -> dict:
    """A small configuration or state file, JSON or the plain subset of YAML (keys, nested keys, lists of scalars)."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return json.loads(text) if text.lstrip().startswith(("{", "[")) else _plain_yaml(text)


def _scalar(text: str):
    text = text.strip().strip("\"'") if text.strip()[:1] in "\"'" else text.split(" #")[0].strip()
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text, int(text) if re.fullmatch(r"-?\d+", text) else text)


def _plain_yaml(text: str) -> dict:
    root: dict = {}
    open_: list[tuple[int, dict, str | None]] = [(-1, root, None)]
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip()) + (1 if bare.startswith("- ") else 0)
        while depth <= open_[-1][0]:
            open_.pop()
        _, holder, key = open_[-1]
        if bare.startswith("- "):
            if not isinstance(holder.get(key), list):
                holder[key] = []
            holder[key].append(_scalar(bare[2:]))
            continue
        if key is not None:  # a nested key: what was empty so far is a mapping
            if not isinstance(holder.get(key), dict):
                holder[key] = {}
            holder = holder[key]
        name, _, value = bare.partition(":")
        holder[name.strip()] = _scalar(value)
        open_.append((depth, holder, name.strip()))
    return root


def replace_whole(df: DataFrame, path: str) -> None:
    """Parquet that readers see whole, old or new: written beside the old one and renamed into its place."""
    fs, at = _files(df.sparkSession, path)
    new, old = (at.suffix(f".{x}-{uuid.uuid4().hex}") for x in ("new", "old"))
    df.write.parquet(new.toString())
    if fs.exists(at):
        fs.rename(at, old)
    if not fs.rename(new, at):
        raise OSError(f"{path} could not be replaced")
    if fs.exists(old):
        fs.delete(old, True)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def packed_shards(df: DataFrame, path: str, shards: int, key: str, seed: int = 42) -> None:
    """Records dealt to shards at random (by a hash of key and seed) and, within one, in random order; one folder each."""
    drawn = df.withColumn("shard", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(shards)).cast("int"))
    drawn.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.col(key), F.lit(seed + 1))).write.mode("overwrite").partitionBy("shard").parquet(path)


def with_numbers(page: Column, heading: str, numbers: dict[str, Column]) -> Column:
    """A markdown page whose lines ``name: number`` under ``heading`` carry new numbers; other sections stay."""
    parts = F.split(page, r"(?m)(?=^#)")

    def filled(section: Column) -> Column:
        for name, value in numbers.items():
            section = F.regexp_replace(section, F.lit(rf"(?m)^(\W*{name}\W*:\W*)[0-9][0-9,.]*"), F.concat(F.lit("$1"), value.cast("string")))
        return section

    return F.array_join(F.transform(parts, lambda s: F.when(s.rlike(rf"\A#+ *{heading}\b"), filled(s)).otherwise(s)), "")


def archive_plan(processed: DataFrame, present: DataFrame, archived: DataFrame, day: str) -> DataFrame:
    """(path, bytes, action, day): a dry run's audit log.

    Files that were processed and still exist may go once the archive holds
    them with the same size; nothing is deleted here.
    """
    known = processed.select("path").distinct().join(present, "path", "left")
    held = archived.select("path", F.col("bytes").alias("held"))
    action = F.when(F.col("bytes").isNull(), "gone").when(F.col("held").isNull(), "upload").when(F.col("held") != F.col("bytes"), "upload again").otherwise("may be deleted")
    return known.join(held, "path", "left").select("path", "bytes", action.alias("action"), F.lit(day).alias("day"))


def append_json(df: DataFrame, path: str, day: str) -> None:
    df.write.mode("append").partitionBy(day).json(path)


def text_lines(df: DataFrame, column: str, path: str) -> None:
    """One document a line: line breaks become blanks, empty ones go."""
    df.select(F.trim(F.regexp_replace(column, r"[\r\n]+", " ")).alias("value")).where("value <> ''").write.mode("overwrite").text(path)


def csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
