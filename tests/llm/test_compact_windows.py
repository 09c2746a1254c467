import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import shared_spans
from tests.llm.test_lines_spans import brute_pairs, brute_share, passages, span_rows


def cartesian(keys, low, high, least, out):
    """Nodes of the Cartesian tree over keys[low:high] whose subtree has at least ``least`` tokens."""
    if high - low >= least:
        at = min(range(low, high), key=lambda i: keys[i])
        out.append((at, low, high - 1))
        cartesian(keys, low, at, least, out)
        cartesian(keys, at + 1, high, least, out)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=90), max_size=4))
def test_windows_are_the_wide_nodes_of_the_cartesian_tree(texts):
    span, gram = 12, 5
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
    d, pos, h, left, right = shared_spans.compact_windows(codes, starts, lengths, span, gram)
    got = sorted(zip(d.tolist(), pos.tolist(), left.tolist(), right.tolist()))
    for k, t in enumerate(texts):
        tokens = [t[i : i + gram] for i in range(len(t) - gram + 1)]
        keys, wide = [], span - gram + 1
        for i, x in enumerate(tokens):
            one = np.frombuffer(x.encode("utf-32-le"), np.uint32)
            _, _, v, _, _ = shared_spans.compact_windows(one, np.zeros(1, np.int64), np.array([gram], np.int64), gram, gram)
            keys.append((int(v[0]) % (1 << 64) >> shared_spans.POSITION, i))
        nodes = cartesian(keys, 0, len(tokens), wide, [])
        # a passage that holds the token reaches no farther from it than its own width
        want = sorted((k, at, max(low, at - wide + 1), min(high, at + wide - 1) + gram - 1) for at, low, high in nodes)
        assert [g for g in got if g[0] == k] == want


@pytest.mark.parametrize("room", [0, 64 << 20])
def test_pairs_and_shares_whatever_is_broadcast(spark, monkeypatch, room):
    monkeypatch.setattr(shared_spans, "BROADCAST_BYTES", room)
    rows = span_rows() + [(40 + i, "z" * i + passages(1, 200) + "q" * i) for i in range(6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, cls string").withColumns({c: F.lit(1) for c in ("h", "pos", "snip", "doc", "k")})
    got = [tuple(r) for r in shared_spans.shared_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    assert {r["doc_id"]: r["n_shared"] for r in shared_spans.shared_share(df).collect()} == brute_share(rows)
    assert shared_spans.shared_share(df.where("false")).collect() == []
