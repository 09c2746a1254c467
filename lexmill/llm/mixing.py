"""Sources mixed to target shares of the whole size in tokens, small ones repeated up to a cap.

With T tokens in a source, the whole may be as large as the least of T * max_repeats / share over the
sources; then every source reaches its share and none needs more copies than its cap. A document's
expected copies are the same within its source; their whole part is certain, and the fractions are
rounded by the pivotal method: two fractional documents meet, and token mass moves from one to the
other, in a direction drawn so that no expectation changes, until one of them is integral. Mass in
tokens is kept exactly, so a source's total is off by less than one document at the end.

The documents of a source are dealt to buckets by a hash; each bucket leaves at most one fractional
document, and these residuals meet in a tree of FAN buckets a level, so no task sees a whole source.
All draws come from hashes of the ids and a seed: a lost task gives the same result again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.tokens import count_tokens
from lexmill.runtime import cut, spread

BUCKET = 20_000  # documents of a bucket, about
FAN = 64  # buckets whose residuals meet
MOST_SOURCES = 10_000  # rows of the targets table; more are refused


def _draw(seed: int, a: int, b: int) -> float:
    return xxhash.xxh64_intdigest(b"%d:%d:%d" % (seed, a, b)) / 2.0**64


def pivot(i: tuple, j: tuple, seed: int) -> tuple[tuple, tuple]:
    """One meeting of two fractional documents (id, tokens, fraction): the same two after the move,
    at least one of them integral."""
    (a, wa, pa_), (b, wb, pb) = i, j
    up = min((1 - pa_) * wa, pb * wb)  # mass that can move to the first
    down = min(pa_ * wa, (1 - pb) * wb)  # and from it
    move = up if _draw(seed, a, b) * (up + down) < down else -down
    x, y = pa_ + move / wa, pb - move / wb
    snap = lambda p: 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
    return (a, wa, snap(x)), (b, wb, snap(y))


def _settle(seed: int):
    """Rows (source, bucket, doc_id, n_tokens, whole, fraction, open) in order of source and bucket;
    each bucket's fractions are settled but for one, which stays open."""
    names = ["source", "bucket", "doc_id", "n_tokens", "whole", "fraction", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, None, []

        def flush():
            rows = list(zip(*out)) if out else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(rows, kinds)], names=names)

        for batch in batches:
            for source, bucket, doc, n, whole, fraction in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if (source, bucket) != key:
                    if held:
                        out.append((*key, held[0], held[1], held[3], held[2], True))
                    key, held = (source, bucket), None
                if fraction <= 0.0 or fraction >= 1.0:
                    out.append((source, bucket, doc, n, whole + int(fraction), 0.0, False))
                elif held is None:
                    held = (doc, n, fraction, whole)
                else:
                    x, y = pivot(held[:3], (doc, n, fraction), seed)
                    rest = []
                    for (d, w, p), base in ((x, held[3]), (y, whole)):
                        if 0.0 < p < 1.0:
                            rest.append((d, w, p, base))
                        else:
                            out.append((source, bucket, d, w, base + int(p), 0.0, False))
                    held = rest[0] if rest else None
            if out:
                yield flush()
        if held:
            out.append((*key, held[0], held[1], held[3], held[2], True))
        yield flush()

    return run


_ROW = "source string, bucket bigint, doc_id bigint, n_tokens int, whole int, fraction double, open boolean"


def _plan(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Expected copies of each document, by source. Sources without tokens can't be mixed; the
    shares of the others keep their proportions."""
    present = {s: t for s, t in targets.items() if totals.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    if not present:
        return {}
    whole = min(totals[s] * repeats / share for s, (share, repeats) in present.items())
    return {s: min(share * whole / totals[s], float(repeats)) for s, (share, repeats) in present.items()}


def _targets(mix: DataFrame) -> dict[str, tuple[float, int]]:
    rows = mix.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many sources in the targets table")
    found: dict[str, tuple[float, int]] = {}
    for s, share, repeats in rows:
        if s in found:
            raise ValueError(f"source {s!r} has two targets")
        found[s] = (float(share or 0), int(repeats or 0))
    return found


def mix(docs: DataFrame, targets: DataFrame, seed: int = 42, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document of the sources in ``targets`` goes
    into the mix; all of them, also those with 0 copies. Documents of other or null sources are left
    out; null and empty texts have 0 tokens and 0 copies. An empty table gives no rows."""
    wanted = _targets(targets)
    if not wanted:
        return docs.select("doc_id", "source", F.lit(0).alias("n_tokens"), F.lit(0).alias("copies")).where(F.lit(False))
    few = docs.select("doc_id", "source", "text").where(F.col("source").isin(*wanted))
    sized = cut(count_tokens(spread(few), ["doc_id", "source"], path=path))
    stats = {r["source"]: (r["tokens"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    copies = _plan({s: int(t or 0) for s, (t, _) in stats.items()}, wanted)
    pairs = [F.lit(x) for item in copies.items() for x in item]
    expected = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    largest = max((n for _, n in stats.values()), default=1)
    buckets = max(1, math.ceil(largest / BUCKET))
    rows = sized.select(
        "source",
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)).alias("bucket"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "n_tokens",
        F.when(F.col("n_tokens") > 0, F.floor(expected)).otherwise(0).cast("int").alias("whole"),
        F.when(F.col("n_tokens") > 0, expected - F.floor(expected)).otherwise(0.0).alias("fraction"),
    )
    done = None
    while True:
        ordered = rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        settled = cut(ordered.mapInArrow(_settle(seed), _ROW))
        closed = settled.where(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        rest = settled.where("open").select("source", F.floor(F.col("bucket") / FAN).alias("bucket"), "doc_id", "n_tokens", "whole", "fraction")
        if buckets == 1:
            # the one fraction that a source is left with is drawn, as every other was
            drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("last")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("fraction")
            last = rest.select("source", "bucket", "doc_id", "n_tokens", (F.col("whole") + drawn.cast("int")).alias("whole"), F.lit(0.0).alias("fraction"), F.lit(False).alias("open"))
            return done.unionByName(last).select("doc_id", "source", "n_tokens", F.col("whole").alias("copies"))
        rows, buckets = rest, math.ceil(buckets / FAN)


def shares(docs: DataFrame, targets: DataFrame, seed: int = 42, path: str | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, mixed_docs, mixed_copies, mixed_tokens,
    actual_share) of every source in ``targets``; one without documents has zeros."""
    mixed = mix(docs, targets, seed, path).groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("n_tokens").cast("bigint").alias("tokens"),
        F.count_if(F.col("copies") > 0).alias("mixed_docs"),
        F.sum("copies").cast("bigint").alias("mixed_copies"),
        F.sum(F.col("copies").cast("bigint") * F.col("n_tokens")).alias("mixed_tokens"),
    )
    known = targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").join(mixed, "source", "left")
    numbers = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("docs", "tokens", "mixed_docs", "mixed_copies", "mixed_tokens")}
    known = known.withColumns(numbers)
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # over the rows of the targets table, few
    actual = F.when(whole > 0, F.round(F.col("mixed_tokens") / whole, 6)).otherwise(F.lit(0.0))
    return known.withColumn("actual_share", actual)
