"""Stratified samples and splits: deterministic, exact in size, without a driver loop over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """The order in which rows are drawn: a hash of their key and the seed."""
    return F.sha1(F.concat(key.cast("string"), F.lit(f":{seed}")))


def length_bins(df: DataFrame, column: str = "text_len", bins: int = 4) -> DataFrame:
    """``df`` with __bin, the quantile bin (0 first) of ``column``: edges interpolated, equal edges
    merged, right ends included, nulls in bin 0."""
    probabilities = ", ".join(str(i / bins) for i in range(bins + 1))
    edges = df.select(F.expr(f"array_distinct(percentile(`{column}`, array({probabilities})))")).first()[0] or []
    below = [F.when(F.col(column) > F.lit(e), 1).otherwise(0) for e in edges[1:]]
    number = sum(below[1:], below[0]) if below else F.lit(0)
    return df.withColumn("__bin", F.least(F.coalesce(number, F.lit(0)), F.lit(max(len(edges) - 2, 0))))


def strata(df: DataFrame) -> DataFrame:
    """``df`` with __stratum: industry, year and text length quartile, nulls as ''."""
    b = length_bins(df)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return b.withColumn("__stratum", F.concat(text("industry"), F.lit("__"), text("year"), F.lit("__len"), F.col("__bin").cast("string"))).drop("__bin")


def allocate(sizes: DataFrame, target: int) -> DataFrame:
    """(__stratum, size, n): ``target`` divided in proportion to the sizes by largest remainders, ties
    by name, no stratum above its size; what is left goes to the largest strata with room. ``sizes``
    has (__stratum, size) and is as small as the number of strata."""
    if target <= 0:
        return sizes.select("__stratum", "size", F.lit(0).cast("bigint").alias("n"))
    whole = Window.partitionBy(F.lit(0))
    exact = F.col("size") / F.sum("size").over(whole) * F.lit(float(target))
    base = sizes.withColumn("exact", exact).withColumn("base", F.floor("exact").cast("bigint"))
    open_ = base.withColumn("room", F.col("size") > F.col("base")).withColumn("left", F.lit(target) - F.sum("base").over(whole))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("room"), F.desc(F.col("exact") - F.col("base")), "__stratum"))
    plus = open_.withColumn("n", F.col("base") + F.when(F.col("room") & (rank <= F.col("left")), 1).otherwise(0))
    spare = plus.withColumn("left", F.lit(target) - F.sum("n").over(whole)).withColumn("free", F.greatest(F.col("size") - F.col("n"), F.lit(0)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "__stratum").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("free").over(order), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("free"), F.col("left") - before))
    return spare.select("__stratum", "size", (F.col("n") + take).cast("bigint").alias("n"))


def take_least(df: DataFrame, key: str, seed: int, plan: DataFrame | None, name: str, n: int | None = None) -> DataFrame:
    """``df`` with ``name``: whether the row is among the first of its stratum in the order of draw, as
    many as ``plan`` (__stratum, n) says, or among the first ``n`` of all.

    Rows are counted by the first digits of their hash, so that it is known which of 4096 cells lie wholly
    inside and in which one the limit falls; rows are only ranked within a cell. A stratum that has a
    third of all rows is so spread over the cluster.
    """
    rows = df.withColumn("__draw", draw(F.col(key), seed)).withColumn("__cell", F.substring("__draw", 1, 3))
    keys = ["__stratum"] if plan is not None else []
    cells = rows.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__size"))
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__cell")
    sized = cells.withColumn("__upto", F.sum("__size").over(upto))
    sized = sized.join(plan.select("__stratum", F.col("n").alias("__n")), "__stratum") if plan is not None else sized.withColumn("__n", F.lit(n))
    at = sized.select(*keys, "__cell", (F.col("__n") - (F.col("__upto") - F.col("__size"))).alias("__left"), "__size")
    joined = rows.join(at, [*keys, "__cell"])
    # the rank within a cell only counts in the one where the limit falls
    rank = F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy("__draw", key))
    chosen = F.when(F.col("__left") >= F.col("__size"), True).when(F.col("__left") <= 0, False).otherwise(rank <= F.col("__left"))
    return joined.withColumn(name, chosen).drop("__draw", "__cell", "__left", "__size")


def _ranked(df: DataFrame, target: int, key: str, seed: int, name: str) -> DataFrame:
    """``df`` with ``name``: whether the row is among its stratum's allocated number."""
    sizes = df.groupBy("__stratum").agg(F.count(F.lit(1)).alias("size"))
    return take_least(df, key, seed, allocate(sizes, target).select("__stratum", "n"), name)


def top_up(sample: DataFrame, pool: DataFrame, target: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """``sample`` filled up to ``target`` rows with the first drawn of the rows of ``pool`` that it lacks."""
    missing = max(0, target - sample.count())
    left = pool.join(sample.select(key), key, "left_anti")
    more = take_least(left, key, seed, None, "__in", missing).where("__in").drop("__in")
    return sample.unionByName(more, allowMissingColumns=True)


def golden_order(golden: DataFrame) -> DataFrame:
    """(doc_id, split, position): documents by split, train before dev before test before any other, and
    by doc_id, numbered from 1 over all; repeated rows count once."""
    from lexmill.operators.corpus import numbered

    named = golden.select("doc_id", F.lower(F.trim(F.coalesce("split", F.lit("")))).alias("split")).distinct()
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).when(F.col("split") == "test", 2).otherwise(3)
    return numbered(named.withColumn("__rank", rank), ["__rank", "doc_id", "split"], "position").drop("__rank")


def stratified_sample(df: DataFrame, target: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """``target`` rows of ``df`` in proportion to its strata (or all, if it has fewer)."""
    return _ranked(strata(df), target, key, seed, "__in").where("__in").drop("__in")


def assign_splits(sample: DataFrame, train: int, dev: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """``sample`` (with __stratum) with ``split``: train and dev drawn in proportion, the rest test."""
    first = _ranked(sample, train, key, seed, "__train")
    rest = _ranked(first.where(~F.col("__train")), dev, key, seed, "__dev")
    picked = rest.withColumn("split", F.when(F.col("__dev"), "dev").otherwise("test")).drop("__dev", "__train")
    return first.where("__train").withColumn("split", F.lit("train")).drop("__train").unionByName(picked)


def golden_scaffold(split: DataFrame, guideline_version: str = "maturity_v1.0") -> DataFrame:
    """The rows annotators fill in: no annotator, pending, an empty payload."""
    from lexmill.functions.payload import empty

    return split.withColumns(
        {
            "annotator_id": F.lit(""),
            "qa_status": F.lit("pending"),
            "guideline_version": F.lit(guideline_version),
            "gold_fields_payload": F.to_json(empty(), {"ignoreNullFields": "false"}),
        }
    )


def qa_sample(golden: DataFrame, fraction: float = 0.2, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """The share of the golden rows to be reviewed, at least one."""
    n = max(1, round(golden.count() * fraction))
    return take_least(golden, key, seed, None, "__in", n).where("__in").drop("__in")
