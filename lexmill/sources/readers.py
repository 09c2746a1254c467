"""Tolerant readers of the files extraction projects have."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import strip


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is there; a fault of the file system is raised, not taken for absence."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(target))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of a JSON-lines file. Blank and invalid lines and lines that aren't objects are
    skipped; a field of another type is null; a missing path gives an empty table. Fields declared as
    strings keep nested values as JSON text. ``__line`` is the line's position within its file part."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("__line", T.LongType())]))
    lines = spark.read.text(path).withColumn("__line", F.monotonically_increasing_id())
    trimmed = lines.select("__line", F.trim("value").alias("value")).where(F.col("value").startswith("{"))
    # an object can't be told from a broken one by its fields alone, so the parser reports it
    parsed = trimmed.select("__line", F.from_json("value", T.StructType([*schema.fields, T.StructField("__bad", T.StringType())]), {"columnNameOfCorruptRecord": "__bad"}).alias("r"), F.try_parse_json("value").alias("v"))
    return parsed.where(F.col("v").isNotNull()).select("r.*", "__line").drop("__bad")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with header, quoted line ends and doubled quotes, by explicit schema."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)


def read_url_list(spark: SparkSession, path: str, column: str = "url") -> DataFrame:
    """(url): one column of a CSV file, or its first where it lacks the column; blanks dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    name = column if column in df.columns else df.columns[0]
    return df.select(strip(F.col(f"`{name}`")).alias("url")).where(F.col("url") != "")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, position) of a list file, one id a line, blank lines dropped; an empty list is an error."""
    lines = spark.read.text(path).withColumn("position", F.monotonically_increasing_id())
    ids = lines.select(strip(F.col("value")).alias("doc_id"), "position").where(F.col("doc_id") != "")
    if ids.isEmpty():
        raise ValueError(f"no ids in {path}")
    return ids


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, text) of a folder of text files; undecodable bytes become replacement characters, files
    without a byte give no row."""
    return spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("text"))


def resolve_text_paths(rows: DataFrame, files: DataFrame, raw: str = "merged_text_path") -> DataFrame:
    """``rows`` with the file each raw path means: the path itself, else the file of that name. One
    listing and two equality joins instead of a probe per row; the full path wins."""
    clean = F.replace(strip(F.coalesce(F.col(raw), F.lit(""))), F.lit("\\"), F.lit("/"))
    keyed = rows.withColumn("__raw", clean).withColumn("__name", F.element_at(F.split("__raw", "/"), -1))
    full = files.select(F.regexp_replace("path", "^file:", "").alias("__full"), F.col("path").alias("__p1"), F.col("text").alias("__t1"))
    base = files.groupBy(F.col("name").alias("__name")).agg(F.min("path").alias("__p2"), F.min_by("text", "path").alias("__t2"))
    joined = keyed.join(full, keyed["__raw"] == full["__full"], "left").join(base, "__name", "left")
    return joined.withColumns({"text_path": F.coalesce("__p1", "__p2"), "text": F.coalesce("__t1", "__t2")}).drop("__raw", "__name", "__full", "__p1", "__p2", "__t1", "__t2")


def read_predictions(spark: SparkSession, run_folder: str, schema: T.StructType) -> DataFrame:
    """All models' prediction files of a run (one folder a model) as one table; an alias that a row
    doesn't carry comes from its folder's name."""
    path = os.path.join(run_folder, "*", "predictions.jsonl")
    df = read_jsonl(spark, path, schema)
    if "model_alias" in df.columns or not exists(spark, path):
        return df
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/predictions\.jsonl(?:/[^/]*)?$", 1)
    lines = spark.read.text(path).select(F.trim("value").alias("value"), folder.alias("model_alias"))
    return lines.where(F.col("value").startswith("{")).select("model_alias", F.from_json("value", schema).alias("r")).select("model_alias", "r.*")
