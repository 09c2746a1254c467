"""Queries of the text operators, by problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import encoding_repair, main_body, mixing, repeated_lines, residue, shared_spans, split_overlap, survivor, tokens, truncation
from lexmill.runtime import read, spread


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return repeated_lines.repeated_lines(read(spark, root, "captures"))


def p1_clean(spark: SparkSession, root: str) -> DataFrame:
    captures = read(spark, root, "captures").select("capture_id", "domain", "text")
    return repeated_lines.remove_lines(captures, repeated_lines.repeated_lines(captures))


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    return repeated_lines.repeated_line_report(read(spark, root, "captures"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return main_body.outside_body(read(spark, root, "captures"))


def p2_causes(spark: SparkSession, root: str) -> DataFrame:
    return main_body.cut_lines(read(spark, root, "captures")).groupBy("by").agg(F.count(F.lit(1)).alias("n"))


def p2_body(spark: SparkSession, root: str) -> DataFrame:
    return main_body.main_body(read(spark, root, "captures").select("capture_id", "url_canonical", "extraction_method", "text"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return encoding_repair.wrongly_decoded(read(spark, root, "captures")).select("capture_id", "field")


def p3_restored(spark: SparkSession, root: str) -> DataFrame:
    return encoding_repair.restore(read(spark, root, "captures").select("capture_id", "title", "text"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return survivor.page_groups(read(spark, root, "captures"))


def p4_choices(spark: SparkSession, root: str) -> DataFrame:
    return survivor.choices(read(spark, root, "captures"), read(spark, root, "method_trust")).drop("__page")


def p4_records(spark: SparkSession, root: str) -> DataFrame:
    return survivor.survivors(read(spark, root, "captures"), read(spark, root, "method_trust"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncated(read(spark, root, "dataset_base"), read(spark, root, "predictions"))


def p5_causes(spark: SparkSession, root: str) -> DataFrame:
    rows = truncation.cut_rows(read(spark, root, "dataset_base"), read(spark, root, "predictions"))
    return rows.groupBy("source_table", "by").agg(F.count(F.lit(1)).alias("n"))


def p5_limits(spark: SparkSession, root: str) -> DataFrame:
    return truncation.limits(read(spark, root, "dataset_base"), read(spark, root, "predictions"))


def p5_rates(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncation_rates(read(spark, root, "dataset_base"), read(spark, root, "predictions"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue(read(spark, root, "captures")).select("capture_id", "field")


def p6_clean(spark: SparkSession, root: str) -> DataFrame:
    captures = read(spark, root, "captures").select("capture_id", "title", "text", "error")
    return residue.exclude(captures, residue.residue(captures))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return split_overlap.overlaps(read(spark, root, "golden"), read(spark, root, "dataset_base"))


def p7_members(spark: SparkSession, root: str) -> DataFrame:
    return split_overlap.memberships(read(spark, root, "golden"), read(spark, root, "dataset_base"))


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    return split_overlap.overlap_report(read(spark, root, "golden"), read(spark, root, "dataset_base"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode_corpus(spread(read(spark, root, "documents").select("doc_id", "text")))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(read(spark, root, "documents"), read(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(read(spark, root, "documents"), read(spark, root, "mix_targets"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return shared_spans.shared_pairs(read(spark, root, "documents"))


def p10_share(spark: SparkSession, root: str) -> DataFrame:
    return shared_spans.shared_share(read(spark, root, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_causes": p2_causes,
    "p2_body": p2_body,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_choices": p4_choices,
    "p4_records": p4_records,
    "p5_found": p5_found,
    "p5_causes": p5_causes,
    "p5_limits": p5_limits,
    "p5_rates": p5_rates,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p7_found": p7_found,
    "p7_members": p7_members,
    "p7_report": p7_report,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_share": p10_share,
}
