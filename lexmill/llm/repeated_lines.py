"""Lines repeated across the documents of one source, found and removed by compressed bitmaps.

A line's documents are a two-level compressed bitmap: the high bits of the document id name a
container, the low 15 bits are its members. A container is a sorted array of two-byte members or, where
that takes less, a bit set of 4096 bytes; behind it stand, member by member, the line's numbers in the
document, in as few bytes as the greatest needs. Each spelling of a line (other case, digits, spacing or
punctuation) has a bitmap of its own; the bitmaps of spellings with the same letters are united, and
the cardinality of the union, exact, is held against the threshold. The lines to delete are read off
the containers of frequent lines. A line that stands in a third of all documents is spread over many
containers, each bounded by 2^15 documents.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOW_BITS = 15  # members of a container
LINE_BITS = 24  # of a line number while entries are collected: a text of 2 GB, the most a value can hold, rarely has more lines
ARRAY, BITS = 0, 1
_SET = (1 << LOW_BITS) // 8  # bytes of a bit set
_WIDTHS = {1: np.uint8, 2: np.dtype("<u2"), 4: np.dtype("<u4")}


def _width(most: int) -> int:
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def pack(entries: np.ndarray) -> bytes:
    """The container of the entries ``low << LINE_BITS | line_no``, in any order."""
    entries = np.unique(entries)
    lows, counts = np.unique(entries >> LINE_BITS, return_counts=True)
    lines = entries & ((1 << LINE_BITS) - 1)
    cw, lw = _width(int(counts.max())), _width(int(lines.max()))
    if 2 * len(lows) > _SET:
        bits = np.zeros(1 << LOW_BITS, np.uint8)
        bits[lows] = 1
        members = struct.pack("<BBB", BITS, cw, lw) + np.packbits(bits, bitorder="little").tobytes()
    else:
        members = struct.pack("<BBBH", ARRAY, cw, lw, len(lows)) + lows.astype("<u2").tobytes()
    return members + counts.astype(_WIDTHS[cw]).tobytes() + lines.astype(_WIDTHS[lw]).tobytes()


def _single(entry: int) -> bytes:
    """pack of one entry, as most containers are."""
    line = entry & ((1 << LINE_BITS) - 1)
    lw = _width(line)
    return struct.pack("<BBBHHB", ARRAY, 1, lw, 1, entry >> LINE_BITS, 1) + line.to_bytes(lw, "little")


def members(container: bytes) -> tuple[np.ndarray, int]:
    """The members of a container in rising order, and where the numbers of their lines begin."""
    if container[0] == BITS:
        bits = np.unpackbits(np.frombuffer(container, np.uint8, _SET, 3), bitorder="little")
        return np.flatnonzero(bits), 3 + _SET
    n = int.from_bytes(container[3:5], "little")
    return np.frombuffer(container, "<u2", n, 5).astype(np.int64), 5 + 2 * n


def cardinality(container: bytes) -> int:
    if container[0] == BITS:
        return int.from_bytes(container[3 : 3 + _SET], "little").bit_count()
    return int.from_bytes(container[3:5], "little")


def unpack(container: bytes) -> np.ndarray:
    """The entries of a container in rising order."""
    lows, at = members(container)
    cw, lw = container[1], container[2]
    counts = np.frombuffer(container, _WIDTHS[cw], len(lows), at)
    lines = np.frombuffer(container, _WIDTHS[lw], -1, at + cw * len(lows))
    return np.repeat(lows, counts) << LINE_BITS | lines


def union(containers: list[bytes]) -> bytes:
    return containers[0] if len(containers) == 1 else pack(np.concatenate([unpack(c) for c in containers]))


def _considered(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """The documents with a source and with text other than white space."""
    return docs.select(F.col(doc_id).alias("__doc"), F.col(source).alias("__source"), F.col(text).alias("__text")).where(
        F.col("__source").isNotNull() & (F.col("__source") != "") & F.col("__text").rlike(r"(?U)\S")
    )


def _pack_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        done = [_single(int(flat[i])) if j - i == 1 else pack(flat[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(done, type=pa.binary())], names=["__source", "__k1", "__k2", "__high", "__bitmap"])


def _unite_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [union(c) for c in batch.column(4).to_pylist()]
        sizes = pa.array([cardinality(c) for c in done], type=pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(done, type=pa.binary()), sizes], names=["__source", "__k1", "__k2", "__high", "__bitmap", "__card"])


def line_containers(docs: DataFrame, doc_id: str = "capture_id", text: str = "text", source: str = "domain") -> DataFrame:
    """(source, key, high, bitmap, card): per source and letter key the containers of the line's bitmap,
    united over its spellings, with their numbers of distinct documents.

    The key is two hashes, 96 bits, of the line's letters in lower case; lines without letters have
    none. Null sources, null and blank texts give nothing.
    """
    d = _considered(docs, doc_id, text, source)
    # everything but letters and line ends goes in one pass over the text, then the text is split
    letters = F.split(F.lower(F.regexp_replace("__text", r"[^\p{L}\n]+", "")), "\n", -1)
    spellings = F.transform(F.split("__text", "\n", -1), lambda x: F.xxhash64(x))
    lines = d.select("__source", "__doc", F.posexplode(F.arrays_zip(letters.alias("line"), spellings.alias("spelling"))).alias("__no", "__x"))
    lines = lines.select("__source", "__doc", "__no", F.col("__x.line").alias("__line"), F.col("__x.spelling").alias("__spelling")).where(F.col("__line") != "")
    low = F.col("__doc").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    packed = F.shiftleft(low, LINE_BITS).bitwiseOR((F.col("__no") + 1).cast("long"))
    each = lines.select(
        "__source", F.xxhash64("__line").alias("__k1"), F.hash("__line").alias("__k2"), F.shiftright("__doc", LOW_BITS).alias("__high"), packed.alias("__entry"), "__spelling"
    )
    key = "__source string, __k1 bigint, __k2 int, __high bigint"
    spelt = each.groupBy("__source", "__k1", "__k2", "__high", "__spelling").agg(F.collect_list("__entry").alias("__entries")).drop("__spelling")
    bitmaps = spelt.mapInArrow(_pack_lists, f"{key}, __bitmap binary")
    united = bitmaps.groupBy("__source", "__k1", "__k2", "__high").agg(F.collect_list("__bitmap").alias("__bitmaps"))
    return united.mapInArrow(_unite_lists, f"{key}, __bitmap binary, __card int")


def repeated_lines(
    docs: DataFrame, doc_id: str = "capture_id", text: str = "text", source: str = "domain", least: int = 5, share: float = 0.05
) -> DataFrame:
    """(doc_id, line_no): every occurrence of a line that stands in at least ``least`` of its
    source's considered documents and in at least ``share`` of them.

    Lines are the pieces between newlines, counted from 1; two are the same if their letters agree
    in lower case. A line twice in a document counts once and is reported twice. doc_id must be a
    whole number, unique per document. Empty tables, null or blank texts and sources give no rows.
    """
    boxes = line_containers(docs, doc_id, text, source)
    sizes = _considered(docs, doc_id, text, source).groupBy("__source").agg(F.count(F.lit(1)).alias("__docs"))
    whole = Window.partitionBy("__source", "__k1", "__k2")
    frequent = boxes.withColumn("__all", F.sum("__card").over(whole)).where(F.col("__all") >= least)
    hit = frequent.join(sizes, "__source").where(F.col("__all") >= F.col("__docs") * F.lit(share))

    def read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = [unpack(c) for c in batch.column(1).to_pylist()]
            high = np.repeat(batch.column(0).to_numpy(), [len(e) for e in entries])
            e = np.concatenate([np.zeros(0, np.int64), *entries])
            yield pa.RecordBatch.from_arrays([pa.array(high << LOW_BITS | e >> LINE_BITS), pa.array((e & ((1 << LINE_BITS) - 1)).astype(np.int32))], names=[doc_id, "line_no"])

    return hit.select("__high", "__bitmap").mapInArrow(read_off, f"`{doc_id}` bigint, line_no int")


def remove_lines(docs: DataFrame, found: DataFrame, doc_id: str = "capture_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines named in ``found`` (doc_id, line_no) cut from ``text``; documents that
    have none are unchanged, nulls stay null, a text all of whose lines go becomes empty."""
    gone = found.groupBy(F.col(doc_id).alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(gone, docs[doc_id] == F.col("__id"), "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.array_contains(F.col("__gone"), (i + 1).cast("int")))
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__id", "__gone")


def repeated_line_report(docs: DataFrame, doc_id: str = "capture_id", text: str = "text", source: str = "domain") -> DataFrame:
    """Per source: considered documents, distinct repeated lines and their occurrences."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = pa.array([len(unpack(c)) for c in batch.column(4).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], times], names=["__source", "__k1", "__k2", "__card", "__times"])

    boxes = line_containers(docs, doc_id, text, source).select("__source", "__k1", "__k2", "__card", "__bitmap")
    boxes = boxes.mapInArrow(measured, "__source string, __k1 bigint, __k2 int, __card int, __times bigint")
    sizes = _considered(docs, doc_id, text, source).groupBy("__source").agg(F.count(F.lit(1)).alias("__docs"))
    per_line = boxes.groupBy("__source", "__k1", "__k2").agg(F.sum("__card").alias("__all"), F.sum("__times").alias("__times"))
    hit = per_line.join(sizes, "__source", "right").withColumn(
        "__hit", (F.col("__all") >= 5) & (F.col("__all") >= F.col("__docs") * F.lit(0.05))
    )
    return hit.groupBy(F.col("__source").alias(source)).agg(
        F.max("__docs").alias("documents"),
        F.count_if(F.col("__hit")).alias("repeated_lines"),
        F.coalesce(F.sum(F.when(F.col("__hit"), F.col("__times"))), F.lit(0)).alias("occurrences"),
    )
