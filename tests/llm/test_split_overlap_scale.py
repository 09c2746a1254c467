import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import split_overlap
from tests.llm.test_split_overlap_brute import corpus


def brute(texts, splits, threshold, floor):
    terms, classes = {}, defaultdict(list)
    for k, t in texts.items():
        w = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        terms[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
        classes[terms[k]].append(k)
    df, sides, n = Counter(x for c in classes for x in c), defaultdict(set), len(classes)
    for c, members in classes.items():
        for x in c:
            sides[x] |= {splits[m] == "train" for m in members}
    square = lambda x: math.log(1 + n / max(df[x] if len(sides[x]) > 1 else 1, n / floor)) ** 2
    norm = {k: math.sqrt(sum(map(square, terms[k]))) for k in texts}
    pairs = ((a, b) for a in texts for b in texts if splits[a] == "train" != splits[b])
    return {tuple(sorted(p)) for p in pairs if sum(map(square, terms[p[0]] & terms[p[1]])) / norm[p[0]] / norm[p[1]] >= threshold}


@pytest.mark.parametrize("floor", [5, 20, 4000])
@pytest.mark.parametrize("room", [0, 64 << 20])
def test_every_way_of_joining_gives_the_same(spark, monkeypatch, floor, room):
    """With and without tables that may be broadcast, with few and with many frequent terms, and with lists that are split."""
    monkeypatch.setattr(split_overlap, "BROADCAST_BYTES", room)
    monkeypatch.setattr(split_overlap, "SALT", 3)
    texts = corpus(3)
    texts |= {f"E{i:02d}": texts["D001"].upper() for i in range(7)}
    splits = {k: "train" if k < "D040" or k in ("E00", "E02") else ("dev", "test")[i % 2] for i, k in enumerate(texts)}
    base = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(5)
    golden = spark.createDataFrame(list(splits.items()), "doc_id string, split string")
    want = brute(texts, splits, 0.6, floor)
    got = [tuple(r) for r in split_overlap.overlaps(golden, base, 0.6, floor).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 25


def test_cosine_does_not_fall_as_the_tables_grow(spark):
    """The same near pair among 60 and among 600 other texts, with a floor that both sizes exceed."""
    pair = {"X": " ".join(f"w{i}" for i in range(100)), "Y": " ".join(f"w{i}" if i % 25 else f"y{i}" for i in range(100))}
    found = []
    for size in (60, 600):
        texts = pair | {f"D{i:03d}": " ".join(f"d{i}x{j}" for j in range(60)) for i in range(size)}
        base = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
        golden = base.select("doc_id", F.when(F.col("doc_id") == "X", "train").otherwise("dev").alias("split"))
        rows = base.join(golden, "doc_id").select(
            F.hash("doc_id").cast("bigint").alias("cls"), (F.col("split") == "train").alias("in_train"), (F.col("split") != "train").alias("in_eval"), split_overlap._shingles(split_overlap.terms_of(F.col("text"))).alias("terms")
        )
        found += [r["cosine"] for r in split_overlap._near_classes(rows, size + 2, 0.6, 20).collect()]
    assert len(found) == 2 and found[0] == pytest.approx(found[1], abs=0.02)


def test_repeated_rows_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [("A", long, 1, "x"), ("A", long, 2, "y"), ("B", long.upper(), 3, None), ("C", None, 4, None), ("D", "", 5, None), (None, long, 6, None)]
    base = spark.createDataFrame(rows, "doc_id string, text string, cls int, split string").withColumn("industry", F.lit(None).cast("string"))
    golden = spark.createDataFrame([("A", "train", "t"), ("A", "TRAIN ", "t"), ("B", "dev", None), ("C", "dev", ""), (None, "dev", "")], "doc_id string, split string, text string")
    assert [tuple(r) for r in split_overlap.overlaps(golden, base).collect()] == [("A", "B")]
    report = [tuple(r) for r in split_overlap.overlap_report(golden, base).collect()]
    assert report == [("dev", "", 2, 1, 1)]


def test_memberships_are_one_row_a_document(spark):
    long = [f"w{i}" for i in range(120)]
    rows = [(f"T{i}", " ".join(long)) for i in range(40)] + [(f"V{i}", " ".join(long)) for i in range(30)] + [("N", " ".join(long[:115] + ["a"] * 5)), ("O", " ".join(f"o{i}" for i in range(50))), ("E", "")]
    base = spark.createDataFrame(rows, "doc_id string, text string")
    golden = base.select("doc_id", F.when(F.col("doc_id").startswith("T"), "train").otherwise("dev").alias("split"))
    got = {r["doc_id"]: (r["n_copies"], r["n_links"]) for r in split_overlap.memberships(golden, base).collect()}
    assert len(got) == 72 and got["T3"] == got["V3"] == (70, 1) and got["N"] == (1, 1) and got["O"] == (1, 0)
