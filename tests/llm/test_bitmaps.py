import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import repeated_lines as R

entry = st.tuples(st.integers(0, (1 << R.LOW_BITS) - 1), st.sampled_from([1, 2, 7, 255, 256, 70_000, (1 << R.LINE_BITS) - 1])).map(lambda x: x[0] << R.LINE_BITS | x[1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(entry, min_size=1, max_size=40), min_size=1, max_size=4))
def test_containers_round_trip_and_unite(lists):
    packed = [R._single(x[0]) if len(x) == 1 else R.pack(np.array(x)) for x in lists]
    for x, c in zip(lists, packed):
        assert R.unpack(c).tolist() == sorted(set(x)) and R.cardinality(c) == len({e >> R.LINE_BITS for e in x})
        assert c == R.pack(np.array(x))
    every = {e for x in lists for e in x}
    both = R.union(packed)
    assert R.unpack(both).tolist() == sorted(every) and R.cardinality(both) == len({e >> R.LINE_BITS for e in every})


@pytest.mark.parametrize("n, kind", [(1, R.ARRAY), (2048, R.ARRAY), (2049, R.BITS), (1 << R.LOW_BITS, R.BITS)])
def test_dense_containers_are_bit_sets(n, kind):
    entries = np.arange(n, dtype=np.int64) << R.LINE_BITS | 3
    c = R.pack(entries)
    assert c[0] == kind and R.cardinality(c) == n and R.unpack(c).tolist() == entries.tolist()
    assert len(c) <= 5 + R._SET + 2 * n


def test_spellings_are_united_over_dense_containers(spark):
    """A line that all 40,000 documents of a source have in two spellings, beside lines of their own, clashing columns and null rows."""
    df = spark.range(40_000).select(
        (F.col("id") * 3).alias("capture_id"), F.lit("a.example").alias("domain"), F.concat(F.when(F.col("id") % 2 == 0, "Share THIS!").otherwise("share this 12"), F.lit("\n"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("\n\nshare this")).alias("text"),
        F.lit(1).alias("__card"), F.lit("x").alias("line_no"),
    )
    found = R.repeated_lines(df)
    assert found.columns == ["capture_id", "line_no"]
    assert {tuple(r) for r in found.groupBy("line_no").count().collect()} == {(1, 40_000), (4, 40_000)}
    boxes = R.line_containers(df).where("__card > 5000").collect()
    assert len(boxes) == 4 and sum(b["__card"] for b in boxes) == 40_000 and all(b["__bitmap"][0] == R.BITS for b in boxes)
    assert [tuple(r) for r in R.repeated_line_report(df).collect()] == [("a.example", 40_000, 1, 80_000)]
