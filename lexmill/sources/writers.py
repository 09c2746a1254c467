"""Sinks: JSON lines, CSV, text stores, partitioned Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import safe_slug
from lexmill.operators.corpus import is_good
from lexmill.runtime import file_system


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a row; null fields are written, not left out."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header and quoted values; nested columns as JSON. An empty table writes its header."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "map", "array<struct")) else F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Parquet by run and model; only the partitions that are written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "model_alias").parquet(path)


def text_store(df: DataFrame, good_only: bool = True) -> DataFrame:
    """(text_file, text and the index columns) of a text store, one file name a document."""
    rows = df.where(is_good(F.col("word_count"), F.col("text_len")) & F.col("text").isNotNull()) if good_only else df.where(F.col("text").isNotNull())
    number = F.col("capture_id").cast("string")
    number = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    name = F.concat_ws("_", number, F.coalesce("domain", F.lit("")), F.concat(safe_slug(F.col("title")), F.lit(".txt")))
    return rows.select(name.alias("text_file"), "text", "capture_id", "source", "url_original", "url_canonical", "url_final", "domain", "title", "word_count", "text_len", "error", F.coalesce(F.to_json("flags"), F.lit("{}")).alias("flags_json"))


def write_texts(df: DataFrame, folder: str) -> None:
    """A file of UTF-8 text per row of (name, text) in a folder that all executors share. A file is
    written whole and anew, so a task that is repeated leaves the same; null and empty texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        done = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name and text:
                    with fs.open_output_stream(f"{root}/{name}") as out:
                        out.write(text.encode("utf-8"))
                    done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], type=pa.int64())], names=["n"])

    df.select("name", "text").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def export_text_store(df: DataFrame, folder: str, good_only: bool = True) -> None:
    """A text store: a file per document below ``texts`` and their list as CSV below ``index``."""
    store = text_store(df, good_only)
    write_texts(store.select(F.col("text_file").alias("name"), "text"), f"{folder}/texts")
    write_csv(store.drop("text"), f"{folder}/index")


def write_errors(df: DataFrame, path: str) -> None:
    """Rows of failures appended to a CSV folder, each part with its header."""
    df.write.mode("append").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A stage's report, as small as its buckets, as one JSON file in a folder."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_ids(df: DataFrame, path: str, column: str = "doc_id") -> None:
    """Ids, one a line."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
