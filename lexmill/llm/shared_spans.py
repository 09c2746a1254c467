"""Passages of at least a given length that stand verbatim in more than one document.

Every document is a sequence of tokens, its character q-grams. A hash orders them; the Cartesian tree
of that order has one node per token, whose subtree is the widest run of tokens of which it is the
least. The nodes whose subtree is as wide as a passage are the document's compact windows (least
token, left end, right end): together they cover every passage-long run exactly once, and two equal
passages have the same least token at the same place. So windows are joined on the token's hash, a
pair is kept if the windows, laid over one another at the token, still are a passage wide, and what
is left is compared character by character. The tree's nodes of that width are found with vector
operations, without its many narrower ones: a token is such a node if and only if it is the least of some
passage-wide run, and the runs of which it is reach from one end of its subtree to the other (or as far
from it as a passage is wide).

One hash is enough here, as equal passages agree in every hash; the token is long, so that few
unequal passages meet. Repeated texts are joined once, as a class, and spread to the documents last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.runtime import cut, spread

SPAN = 200  # characters of a passage
GRAM = 100  # characters of a token
CHUNK = 1 << 19  # characters handled at once; positions in a chunk take POSITION bits
POSITION = 21
BROADCAST_BYTES = 64 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]))
    return up, down


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def compact_windows(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(document, token position, token hash, left, right) of every compact window of the documents
    that lie one after another in ``codes``; positions count from the document's start, left and
    right are the first and last character of the widest run of which the token is the least."""
    n = len(codes)
    empty = np.zeros(0, np.int64)
    if n < span:
        return empty, empty, empty, empty, empty
    size = 1 << max(10, int(n).bit_length())
    if size not in _tables:
        _tables[size] = _powers(size)
    up, down = _tables[size]
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        # characters are spread over 64 bits first: sums of small codes would collide
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        grams = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    key = (grams >> np.uint64(POSITION) << np.uint64(POSITION)) | np.arange(len(grams), dtype=np.uint64)
    width = span - gram + 1
    low, reach = key, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    at = (low & np.uint64((1 << POSITION) - 1)).astype(np.int64)  # arg-minimum of the run starting at each place
    doc = np.repeat(np.arange(len(starts)), lengths)[: len(at)]
    whole = np.arange(len(at)) + span <= (starts + lengths)[doc]
    places = np.flatnonzero(whole)
    if not len(places):
        return empty, empty, empty, empty, empty
    least, owner = at[places], doc[places]
    new = np.ones(len(places), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    d, token = owner[first], least[first]
    base = starts[d]
    return d, token - base, grams[token].view(np.int64), places[first] - base, places[last] + span - 1 - base


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of passage length or more in runs of about CHUNK characters. A longer text is cut into
    overlapping parts; its part number and offset are kept by the caller through ``starts``."""
    rows, parts, total = [], [], 0
    for i, t in enumerate(texts):
        if t is None or len(t) < SPAN:
            continue
        for at in range(0, max(1, len(t) - SPAN + 1), CHUNK):
            part = t[at : at + CHUNK + SPAN - 1]
            rows.append((i, at))
            parts.append(part)
            total += len(part)
            if total >= CHUNK:
                yield _pack(rows, parts)
                rows, parts, total = [], [], 0
    if parts:
        yield _pack(rows, parts)


def _pack(rows, parts):
    lengths = np.array([len(p) for p in parts], np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return rows, codes, np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, n = batch.column(0).to_numpy(), batch.num_rows
        for a in range(0, n, 256):
            for rows, codes, starts, lengths in _chunks(batch.column(1).slice(a, 256).to_pylist()):
                d, pos, h, left, right = compact_windows(codes, starts, lengths)
                which = np.array([r[0] for r in rows], np.int64)[d] + a
                offset = np.array([r[1] for r in rows], np.int64)[d]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cls[which]),
                        pa.array(h),
                        pa.array((pos + offset).astype(np.int32)),
                        pa.array((pos - left).astype(np.int16)),
                        pa.array((right - pos).astype(np.int32)),
                    ],
                    names=["cls", "h", "pos", "before", "after"],
                )


def _reach(a: str, i: int, b: str, j: int) -> tuple[int, int]:
    """How far the texts agree before and from places i and j, up to a passage either way."""

    def common(x: str, y: str) -> int:
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            return n
        low, high = 0, n  # x[:low] == y[:low], x[:high] != y[:high]
        while high - low > 1:
            mid = (low + high) // 2
            if x[low:mid] == y[low:mid]:
                low = mid
            else:
                high = mid
        return low

    ahead = common(a[i : i + SPAN], b[j : j + SPAN])
    behind = common(a[max(0, i - SPAN) : i][::-1], b[max(0, j - SPAN) : j][::-1])
    return behind, ahead


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` hinted for broadcast if its rows, of about ``row_bytes`` each, fit in BROADCAST_BYTES; a
    larger one is joined by shuffling."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def busy_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The compact windows whose token stands in another text too, with the passages around them (cls,
    h, pos, before, after, from, snip), and the documents of each text (cls, doc). Both are written to
    the checkpoint folder, as the queries use them more than once.

    Equal texts are a class, named by its least document, and have windows once. Texts aren't shuffled
    as long as the windows in question may be broadcast to them.
    """
    long = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.length("text") >= SPAN)
    keyed = long.select("doc", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("k")).distinct()
    members = cut(keyed.select("doc", F.min("doc").over(Window.partitionBy("k")).alias("cls")))
    copies = _small(members.where(F.col("doc") != F.col("cls")).select(F.col("doc").alias("cls")), 16)
    found = spread(long).select(F.col("doc").alias("cls"), "text").mapInArrow(_windows, "cls bigint, h bigint, pos int, before smallint, after int")
    windows = found.join(copies, "cls", "left_anti")
    busy = cut(windows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).where(F.col("n") > 1).drop("n"))
    placed = long.select(F.col("doc").alias("cls"), "text").join(_small(busy, 48), "cls").withColumn("from", F.greatest(F.col("pos") - F.lit(SPAN), F.lit(0)))
    around = placed.select("cls", "h", "pos", "before", "after", "from", F.expr(f"substring(text, from + 1, pos - from + {SPAN})").alias("snip"))
    # a document that is there twice gives its windows twice
    return cut(around.dropDuplicates(["cls", "h", "pos"])), members


def shared_anchors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Verified places of shared passages between distinct texts, and the documents of each text.

    The first result has (a, b, pos_a, pos_b, behind, ahead): the texts a < b agree on the characters
    [pos - behind, pos + ahead) at either place, at least a passage long in sum. The second has
    (cls, doc).
    """
    around, members = busy_windows(docs, doc_id, text)
    a = around.select("h", *[F.col(c).alias(f"{c}_a") for c in ("cls", "pos", "before", "after", "from", "snip")])
    b = around.select("h", *[F.col(c).alias(f"{c}_b") for c in ("cls", "pos", "before", "after", "from", "snip")])
    overlap = F.least("before_a", "before_b") + F.least("after_a", "after_b") + 1
    joined = a.join(b, "h").where((F.col("cls_a") < F.col("cls_b")) & (overlap >= SPAN))
    pairs = joined.select("cls_a", "cls_b", "pos_a", "pos_b", "from_a", "from_b", "snip_a", "snip_b")
    return pairs.mapInArrow(_verify, "a bigint, b bigint, pos_a int, pos_b int, behind int, ahead int"), members


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = batch.to_pydict()
        keep: list[tuple[int, ...]] = []
        for a, b, i, j, f, g, x, y in zip(*(c[k] for k in ("cls_a", "cls_b", "pos_a", "pos_b", "from_a", "from_b", "snip_a", "snip_b"))):
            behind, ahead = _reach(x, i - f, y, j - g)
            if behind + ahead >= SPAN:
                keep.append((a, b, i, j, behind, ahead))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        columns = list(zip(*keep)) if keep else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, type=k) for v, k in zip(columns, kinds)], names=["a", "b", "pos_a", "pos_b", "behind", "ahead"]
        )


def shared_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: every two documents with a passage of SPAN or more characters in
    common, exactly as stored. Null and shorter texts are in none; equal texts are a pair."""
    anchors, members = shared_anchors(docs, doc_id, text)
    links = anchors.select("a", "b").distinct()
    m = members
    left = m.select(F.col("cls").alias("a"), F.col("doc").alias("x"))
    right = m.select(F.col("cls").alias("b"), F.col("doc").alias("y"))
    across = links.join(left, "a").join(right, "b").select("x", "y")
    many = m.join(m.where(F.col("doc") != F.col("cls")).select("cls").distinct(), "cls", "left_semi")
    within = many.select("cls", F.col("doc").alias("x")).join(many.select("cls", F.col("doc").alias("y")), "cls")
    within = within.where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias(f"{doc_id}_a"), F.greatest("x", "y").alias(f"{doc_id}_b"))


def _span_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, start, key): every passage inside a window, by the digest of its characters."""
    for batch in batches:
        cls, starts, keys = [], [], []
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for c, pos, before, after, from_, snip in zip(*columns):
            first, last = max(pos - before, from_), min(pos + after + 1, from_ + len(snip)) - SPAN
            for s in range(first, last + 1):
                starts.append(s)
                keys.append(xxhash.xxh3_128_digest(snip[s - from_ : s - from_ + SPAN].encode("utf-8", "surrogatepass")))
            cls.append(np.full(max(0, last + 1 - first), c, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *cls])), pa.array(starts, type=pa.int32()), pa.array(keys, type=pa.binary())], names=["cls", "start", "key"])


def shared_share(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_shared, share): how many of each document's characters lie in passages that
    stand in another document too. All documents; null and empty texts have 0 of 0 and share 0.

    No pairs are made: the passages inside the windows in question are grouped by a 128-bit digest, and
    those of two texts and more count for each of their places.
    """
    around, members = busy_windows(docs, doc_id, text)
    spans = around.select("cls", "pos", "before", "after", "from", "snip").mapInArrow(_span_keys, "cls bigint, start int, key binary")
    shared = spans.groupBy("key").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where(F.col("x") != F.col("y")).select("key")
    hit = spans.join(shared, "key").select("cls", F.col("start").alias("s"), (F.col("start") + SPAN).alias("e")).distinct()
    before = Window.partitionBy("cls").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("s"), F.coalesce(F.max("e").over(before), F.lit(0)))
    covered = hit.withColumn("new", F.greatest(F.col("e") - fresh, F.lit(0))).groupBy("cls").agg(F.sum("new").alias("covered"))
    sized = members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cls"))).join(covered, "cls", "left")
    sized = sized.select(F.col("doc").alias("__doc"), "covered", (F.col("n") > 1).alias("whole"))
    n = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    joined = docs.select(doc_id, n.alias("n_chars")).join(sized, docs[doc_id] == sized["__doc"], "left")
    shared_chars = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.coalesce(F.col("covered"), F.lit(0))).cast("bigint")
    out = joined.select(doc_id, "n_chars", shared_chars.alias("n_shared"))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("n_shared") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))
