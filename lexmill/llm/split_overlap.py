"""Same or nearly the same records in the training split and in an evaluation split.

Records are vectors of weighted terms, five words in a row, compared by cosine. Which change counts
as near comes from the problem's statement (a small part of the words, some sentences dropped, added
or moved): one changed word touches five terms, so the cosine of such pairs starts at about 0.74,
that of texts which only share a passage ends at about 0.4, and the threshold stands between.

A term weighs log(1 + n / df) of the n classes of texts, and terms of less than one class in FLOOR
weigh alike: without that floor the changed terms of a pair would weigh more with every growth of the
tables, and its cosine would fall. It also bounds what has to be known of the whole corpus, the
frequent terms: at most FLOOR times the mean number of terms of a text, whatever the number of texts.
So vectors, norms and prefixes are made where the texts are, and no term travels there and back.

Equal texts, after typesetting is undone, form a class with one vector, so copies are never joined
with one another. The join is an inverted list over the terms: each vector lists its rarest terms
only, until the norm of the residual is below the threshold (a pair that shares none of them can't
reach it). What a pair has in common beyond its lists is bounded by the residuals of both and by the
most a term can weigh in the other vector; pairs that could still reach the threshold get their exact
dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.runtime import cut, spread

WORDS = 5
THRESHOLD = 0.6
FLOOR = 4000  # a term of fewer than one class in so many is rare
BROADCAST_BYTES = 64 << 20  # a table of more bytes is joined by shuffling
BINS, LEVELS = 8, 13  # of the order of terms: rare ones by hash, the others by powers of two of their frequency
HOT = BINS + 5  # level from which a term's list is split, one class in 125 and more
SALT = 16


def terms_of(text: Column) -> Column:
    """Words of a text with typesetting undone: lower case, ligatures spelt out, soft hyphens and
    invisible characters dropped, thousands joined. Null has none."""
    t = F.lower(F.translate(F.coalesce(text, F.lit("")), "\u00ad\u200b\u200c\u200d\u2060\ufeff", ""))
    spelt = t
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        spelt = F.replace(spelt, F.lit(ligature), F.lit(letters))
    t = F.when(t.rlike("[ﬀ-ﬄ]"), spelt).otherwise(t)
    t = F.regexp_replace(t, "(?<=\\d)[,.\u00a0\u202f ' ](?=\\d{3}(?!\\d))", "")
    return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Distinct hashes of the runs of WORDS words; a shorter text is one run. The words are bound to a
    variable, so that their expression is evaluated once a text and not once a run."""

    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - WORDS, F.lit(0))
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(hashes))

    return F.transform(F.array(words), runs)[0]


def sides(golden: DataFrame) -> DataFrame:
    """(doc_id, in_train, in_eval, splits): in which splits a document is, spelling undone. Rows whose
    split is null or none of train, dev and test say nothing."""
    split = F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))
    named = golden.select("doc_id", split.alias("split")).where(F.col("split").isin("train", "dev", "test") & F.col("doc_id").isNotNull())
    return named.groupBy("doc_id").agg(
        F.max(F.col("split") == "train").alias("in_train"),
        F.max(F.col("split") != "train").alias("in_eval"),
        F.array_sort(F.collect_set(F.when(F.col("split") != "train", F.col("split")))).alias("splits"),
    )


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` hinted for broadcast if its rows, of about ``row_bytes`` each, fit in BROADCAST_BYTES; a
    larger one is joined by shuffling."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def overlaps(golden: DataFrame, dataset_base: DataFrame, threshold: float = THRESHOLD, floor: int = FLOOR) -> DataFrame:
    """(doc_id_a, doc_id_b), a before b: every two different documents, one in train and one in dev
    or test, whose texts are the same or near. Null, empty and blank texts are near nothing; repeated
    golden rows and documents count once; empty tables give no rows."""
    members, links = class_links(golden, dataset_base, threshold, floor)
    train = members.where("in_train").select(F.col("cls").alias("t"), F.col("doc_id").alias("x"))
    evaluation = members.where("in_eval").select(F.col("cls").alias("e"), F.col("doc_id").alias("y"))
    out = links.join(train, "t").join(evaluation, "e").where(F.col("x") != F.col("y"))
    return out.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def class_links(golden: DataFrame, dataset_base: DataFrame, threshold: float = THRESHOLD, floor: int = FLOOR) -> tuple[DataFrame, DataFrame]:
    """The classes of equal texts with their documents (cls, doc_id, in_train, in_eval), and the links
    (t, e) between a class with a training and one with an evaluation document. Copies aren't
    expanded into pairs here, so this stays small whatever the size of a group of copies."""
    side = cut(sides(golden).select("doc_id", "in_train", "in_eval"))
    docs = spread(dataset_base.select("doc_id", "text")).join(_small(side, 64), "doc_id")
    # the terms are made once; persisted, not checkpointed: a lost part is made again from the table
    made = docs.select("doc_id", "in_train", "in_eval", _shingles(terms_of(F.col("text"))).alias("terms")).persist()
    keyed = made.where(F.size("terms") > 0).withColumn("cls", F.xxhash64(F.xxhash64("terms"), F.hash("terms"), F.size("terms")))
    rows = keyed.select("cls", "doc_id", "in_train", "in_eval")
    members = cut(rows.distinct())
    # most classes are one row; only those of several need to agree on sides and on whose terms stand for all
    several = cut(
        rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("in_train").alias("any_train"), F.max("in_eval").alias("any_eval"), F.min("doc_id").alias("first"))
        .where("n > 1").drop("n")
    )
    hinted = _small(several, 64)
    single = keyed.join(hinted, "cls", "left_anti").select("cls", "in_train", "in_eval", "terms")
    first = keyed.drop("in_train", "in_eval").join(hinted, "cls").where(F.col("doc_id") == F.col("first")).dropDuplicates(["cls"])
    classes = single.unionByName(first.select("cls", F.col("any_train").alias("in_train"), F.col("any_eval").alias("in_eval"), "terms"))
    n = members.select("cls").distinct().count()
    near = cut(_near_classes(classes, n, threshold, floor).select("t", "e"))
    made.unpersist()
    same = several.where(F.col("any_train") & F.col("any_eval")).select(F.col("cls").alias("t"), F.col("cls").alias("e"))
    return members, near.unionByName(same)


def memberships(golden: DataFrame, dataset_base: DataFrame, threshold: float = THRESHOLD, floor: int = FLOOR) -> DataFrame:
    """(doc_id, cls, n_copies, n_links): each document of a split with words, its class of equal texts,
    how many documents that has, and to how many other classes it is linked. One row a document: groups
    of copies aren't expanded into pairs."""
    members, links = class_links(golden, dataset_base, threshold, floor)
    near = links.where(F.col("t") != F.col("e"))
    ends = near.select(F.col("t").alias("cls"), F.col("e").alias("other")).unionByName(near.select(F.col("e").alias("cls"), F.col("t").alias("other")))
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n_copies"))
    counted = sizes.join(ends.distinct().groupBy("cls").agg(F.count(F.lit(1)).alias("n_links")), "cls", "left")
    return members.select("doc_id", "cls").join(counted, "cls").select("doc_id", "cls", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def frequent_terms(classes: DataFrame, n: int, floor: int = FLOOR) -> DataFrame:
    """(term, df): terms of two classes and more, of both sides, and of at least one class in ``floor``.
    Counts are exact and combined before the shuffle."""
    each = classes.select("in_train", "in_eval", F.explode("terms").alias("term"))
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("in_train").alias("t_any"), F.max("in_eval").alias("e_any"))
    return counts.where((F.col("df") > 1) & (F.col("df") * floor >= n) & F.col("t_any") & F.col("e_any")).select("term", F.col("df").cast("int"))


_VECTOR = "cls bigint, in_train boolean, in_eval boolean, whole double, n int, rest double, level int, steps array<float>, terms array<bigint>, dfs array<int>"


def vectors_of(classes: DataFrame, n: int, threshold: float, floor: int = FLOOR) -> DataFrame:
    """A vector a class: its terms in the common order, the square of its norm (whole), how many terms
    it lists (n), the mass of those it doesn't (rest), the level of its last listed term, and the mass
    from each level on (steps). Frequent terms are looked up in a table that is broadcast; if it is
    larger than that allows, they are joined by a shuffle."""
    table = cut(frequent_terms(classes, n, floor))
    small = table.count() * 12 <= BROADCAST_BYTES
    if small:
        arrow = table.toArrow()
        keys = arrow.column("term").to_numpy()
        order = np.argsort(keys)
        shared = table.sparkSession.sparkContext.broadcast((keys[order], arrow.column("df").to_numpy()[order]))
        given = classes.withColumn("dfs", F.lit(None).cast("array<int>"))
    else:
        shared = None
        each = classes.select("cls", "in_train", "in_eval", F.explode("terms").alias("term")).join(table, "term", "left")
        given = each.groupBy("cls", "in_train", "in_eval").agg(F.collect_list(F.struct("term", F.coalesce("df", F.lit(0)).alias("df"))).alias("x"))
        given = given.select("cls", "in_train", "in_eval", F.col("x.term").alias("terms"), F.col("x.df").alias("dfs"))
    least = threshold * threshold - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                yield _vectors(whole.slice(at, 1000), shared.value if shared else None, n, floor, least)

    return given.select("cls", "in_train", "in_eval", "terms", "dfs").mapInArrow(run, _VECTOR)


def _squares(df: np.ndarray, n: int, floor: int) -> np.ndarray:
    """Squares of the weights of terms of so many classes, 0 for a rare one."""
    return np.log1p(n / np.maximum(df, max(n / floor, 1.0))) ** 2


def _vectors(batch: pa.RecordBatch, table: tuple[np.ndarray, np.ndarray] | None, n: int, floor: int, least: float) -> pa.RecordBatch:
    lists = batch.column(3)
    lengths = np.diff(lists.offsets.to_numpy())
    terms = lists.flatten().to_numpy()
    if table is None:
        df = batch.column(4).flatten().to_numpy()
    elif len(table[0]):
        at = np.minimum(np.searchsorted(table[0], terms), len(table[0]) - 1)
        df = np.where(table[0][at] == terms, table[1][at], 0).astype(np.int32)
    else:
        df = np.zeros(len(terms), np.int32)
    # the order all vectors have in common: rare terms by hash, then the others by frequency
    power = np.clip(np.floor(np.log2(np.maximum(df * (floor / max(n, 1)), 1.0))), 0, LEVELS - 1).astype(np.int64)
    level = np.where(df == 0, (terms.view(np.uint64) >> np.uint64(61)).astype(np.int64), BINS + power)
    row = np.repeat(np.arange(batch.num_rows), lengths)
    order = np.lexsort((terms, level, row))
    terms, df, level = terms[order], df[order], level[order]
    square = _squares(df, n, floor)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    sums = np.concatenate([[0.0], np.cumsum(square)])
    whole = sums[start + lengths] - sums[start]
    before = whole[row] - (sums[:-1] - sums[start][row])  # mass from a term on
    listed = np.bincount(row, weights=before >= whole[row] * least, minlength=batch.num_rows).astype(np.int64)
    rest = np.maximum(whole - (sums[start + listed] - sums[start]), 0.0)
    k = BINS + LEVELS
    mass = np.bincount(row * k + level, weights=square, minlength=batch.num_rows * k).reshape(-1, k)
    steps = np.cumsum(mass[:, ::-1], axis=1)[:, ::-1].astype(np.float32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    columns = [
        batch.column(0), batch.column(1), batch.column(2), pa.array(whole), pa.array(listed.astype(np.int32)), pa.array(rest), pa.array(level[start + listed - 1].astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k), pa.array(steps.ravel())),
        pa.ListArray.from_arrays(offsets, pa.array(terms)), pa.ListArray.from_arrays(offsets, pa.array(df.astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["cls", "in_train", "in_eval", "whole", "n", "rest", "level", "steps", "terms", "dfs"])


def _near_classes(classes: DataFrame, n: int, threshold: float, floor: int) -> DataFrame:
    """(t, e, cosine) of distinct classes, t with a training and e with an evaluation document, whose
    cosine is at least the threshold. ``classes`` has (cls, in_train, in_eval, terms), ``n`` rows."""
    vectors = vectors_of(classes, n, threshold, floor).persist()
    listed = vectors.select("cls", "in_train", "in_eval", F.explode(F.slice(F.arrays_zip("terms", "dfs"), F.lit(1), F.col("n"))).alias("x"))
    listed = listed.select("cls", "in_train", "in_eval", F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    # the lists of frequent terms are split over SALT keys, so that none is a hot one
    hot = F.col("df") * float(floor) >= F.lit(float(n) * 2 ** (HOT - BINS))
    left = listed.where("in_train").select("term", F.when(hot, F.pmod("cls", F.lit(SALT))).otherwise(0).cast("int").alias("salt"), F.col("cls").alias("t"), "df")
    every = F.when(hot, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    right = listed.where("in_eval").select("term", F.explode(every).alias("salt"), F.col("cls").alias("e"))
    square = F.pow(F.log(1 + F.lit(float(n)) / F.greatest(F.col("df").cast("double"), F.lit(max(n / floor, 1.0)))), 2)
    partial = left.join(right, ["term", "salt"]).where(F.col("t") != F.col("e")).groupBy("t", "e").agg(F.sum(square).alias("p"))
    # The list that ends first has all terms up to its end in common with the other. Beyond it a pair has at most what is left of the one, and of
    # the other what it has from that level on: a term weighs the same in both but for the norms, so the lesser of the two bounds the product
    bounds = vectors.select("cls", "whole", "rest", "level", "steps")
    tail = lambda c: _small(bounds.select(F.col("cls").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("whole", "rest", "level", "steps")]), 200)
    bounded = partial.join(tail("t"), "t").join(tail("e"), "e")
    beyond = F.greatest(F.least("rest_t", F.get("steps_e", F.col("level_t"))), F.least("rest_e", F.get("steps_t", F.col("level_e"))))
    norms = F.sqrt(F.col("whole_t") * F.col("whole_e"))
    candidates = cut(bounded.where((F.col("p") + beyond) / norms >= threshold - 1e-5).select("t", "e"))
    # only the vectors of candidates travel
    wanted = _small(candidates.select(F.explode(F.array("t", "e")).alias("cls")).distinct(), 16)
    chosen = vectors.select("cls", "whole", "terms", "dfs").join(wanted, "cls", "left_semi")
    t_side = chosen.select(F.col("cls").alias("t"), F.col("whole").alias("whole_t"), F.col("terms").alias("terms_t"), "dfs")
    e_side = chosen.select(F.col("cls").alias("e"), F.col("whole").alias("whole_e"), F.col("terms").alias("terms_e"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, e, wt, we, ts, ds, es = (batch.column(i) for i in range(7))
            dots = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                _, at, _ = np.intersect1d(ts[i].values.to_numpy(), es[i].values.to_numpy(), assume_unique=True, return_indices=True)
                dots[i] = _squares(ds[i].values.to_numpy()[at], n, floor).sum()
            cosine = dots / np.sqrt(wt.to_numpy() * we.to_numpy())
            keep = pa.array(cosine >= threshold - 1e-9)
            yield pa.RecordBatch.from_arrays([t, e, pa.array(cosine)], names=["t", "e", "cosine"]).filter(keep)

    both = candidates.join(t_side, "t").join(e_side, "e").select("t", "e", "whole_t", "whole_e", "terms_t", "dfs", "terms_e")
    return both.mapInArrow(products, "t bigint, e bigint, cosine double")


def overlap_report(golden: DataFrame, dataset_base: DataFrame) -> DataFrame:
    """(split, industry, n_eval, n_overlapping, n_pairs) per evaluation split and industry of the
    evaluation document; a missing industry is ''. A document in both dev and test counts in each."""
    pairs = cut(overlaps(golden, dataset_base))
    side = sides(golden)
    industry = F.coalesce(F.regexp_replace("industry", r"(?U)^\s+|\s+$", ""), F.lit(""))
    base = dataset_base.groupBy("doc_id").agg(F.min(industry).alias("industry"))
    evaluation = side.where("in_eval").select("doc_id", F.explode("splits").alias("split")).join(base, "doc_id")
    both = pairs.select(F.col("doc_id_a").alias("doc_id"), F.col("doc_id_b").alias("other")).unionByName(
        pairs.select(F.col("doc_id_b").alias("doc_id"), F.col("doc_id_a").alias("other"))
    )
    train = side.where("in_train").select(F.col("doc_id").alias("other"))
    per = both.join(train, "other").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"))
    return (
        evaluation.join(per, "doc_id", "left")
        .groupBy("split", "industry")
        .agg(
            F.count(F.lit(1)).alias("n_eval"),
            F.count_if(F.col("pairs") > 0).alias("n_overlapping"),
            F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"),
        )
    )
