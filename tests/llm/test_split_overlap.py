from pyspark.sql import functions as F

from lexmill.llm import split_overlap

WORDS = [f"word{i}" for i in range(4000)]


def doc(i, start, n=200, swap=()):
    words = WORDS[start : start + n]
    for k in swap:
        words[k] = f"other{i}x{k}"
    return " ".join(words)


def test_split_overlap(spark):
    texts = {
        "A": doc(0, 0), "B": doc(1, 0).upper().replace(" ", "  "), "C": doc(2, 0, swap=(20, 90, 160)), "D": doc(3, 600), "E": doc(4, 100), "F": "", "G": None,
        "H": doc(7, 600, swap=range(0, 200, 6)), "I": "just a few words here", "J": "just a few words here",
    }
    base = spark.createDataFrame(list(texts.items()), "doc_id string, text string").withColumn("industry", F.lit("x"))
    splits = {"A": "train", "B": " DEV", "C": "test", "D": "Train", "E": "dev", "F": "train", "G": "test", "H": "test", "I": "train", "J": "dev"}
    golden = spark.createDataFrame([*splits.items(), ("A", "train"), ("Z", "dev"), ("D", None)], "doc_id string, split string")
    pairs = {tuple(r) for r in split_overlap.overlaps(golden, base).collect()}
    assert pairs == {("A", "B"), ("A", "C"), ("I", "J")}
    report = {(r["split"], r["n_pairs"]) for r in split_overlap.overlap_report(golden, base).collect()}
    assert report == {("dev", 2), ("test", 1)}
    assert split_overlap.overlaps(golden.where("false"), base).collect() == []
    assert split_overlap.overlaps(golden, base.where("false")).collect() == []


def test_split_overlap_copies(spark):
    rows = [(f"T{i:03d}", doc(0, 0)) for i in range(60)] + [(f"V{i:03d}", doc(0, 0)) for i in range(40)]
    base = spark.createDataFrame(rows, "doc_id string, text string")
    golden = base.select("doc_id", F.when(F.col("doc_id").startswith("T"), "train").otherwise("dev").alias("split"))
    assert split_overlap.overlaps(golden, base).count() == 2400
