"""One surviving record per group of captures of the same page.

Fields that depend on one another form bundles, and a bundle is taken whole from one capture:

* content: text, word_count, text_len, html_len, extraction_method
* provenance: source, error, flags
* title
* address (url_original, url_canonical, url_final, domain) and time (ts, ingested_at)

Every capture gives each bundle a trust, a vector that is compared part by part: how much of the bundle
is filled, the trust of its method, the words of its text, how recent it is. Bundles are tied by
functional dependencies: extraction_method -> source (content and provenance; read from the table, the
most frequent source of each method), and a title is as its source writes it (title and provenance).
Of the tied bundles the admissible combination of the greatest sum of trusts is found by branch and
bound; vectors compared part by part can be added and bounded like numbers. A bundle that no
dependency ties to another is its own search, which ends with its most trusted candidate. Where the
content has to be a page's best capture whatever else the page holds (page_choices), it leads: its trust
comes first, and a dependency that no capture of the page can meet doesn't bind it.

Of each page, bundle and value of the dependency only the most trusted capture can be in the result, so
candidates are aggregated to that with map-side combining: a page captured a million times ends as a
handful of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import count_words, is_blank
from lexmill.functions.url import host_of, page_key


@dataclass(frozen=True)
class Bundle:
    """Fields taken whole from one record: a name, the parts of its trust, greater is better and none
    null, and the value by which it is tied to other bundles ('' agrees with any), None if it isn't."""

    name: str
    trust: tuple[Column, ...]
    tie: Column | None = None


def _paged(captures: DataFrame, *columns: str) -> DataFrame:
    """The captures that belong to a page: url_canonical is neither null nor blank."""
    paged = captures.select("capture_id", "url_canonical", *columns).withColumn("__page", page_key(F.col("url_canonical")))
    return paged.where(F.col("__page").isNotNull() & ~F.col("__page").isin("", "?"))


def best_bundles(records: DataFrame, bundles: list[Bundle], key: str = "__page", record_id: str = "capture_id", least: int = 1, lead: bool = False) -> DataFrame:
    """(key, n, first, {bundle}_from): of each group of at least ``least`` records with one ``key``, how
    many they are, the least id, and the record each bundle is taken from. Of equal trusts the least id is
    taken; if no combination of the tied bundles is admissible, each is its most trusted. With ``lead`` a
    tie of the first tied bundle that another bundle can't agree with in the whole group doesn't bind."""
    parts = F.array(
        *[
            F.struct(F.lit(i).alias("b"), (F.lit("") if b.tie is None else b.tie).alias("tie"), F.array(*[t.cast("double") for t in b.trust]).alias("trust"))
            for i, b in enumerate(bundles)
        ]
    )
    narrow = records.select(F.col(key).alias("k"), F.col(record_id).alias("id"), F.explode(parts).alias("p"))
    candidates = narrow.groupBy("k", "p.b", "p.tie").agg(F.max(F.struct(F.col("p.trust").alias("trust"), (-F.col("id")).alias("back"))).alias("best"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    own = lambda i: F.col("b") == i
    tied = [i for i, b in enumerate(bundles) if b.tie is not None]
    free = [F.max(F.when(own(i), F.col("best"))).alias(f"best_{i}") for i, b in enumerate(bundles) if b.tie is None]
    listed = F.collect_list(F.when(F.col("b").isin(tied), F.struct("b", "tie", "best.trust", "best.back"))) if tied else F.lit(None)
    groups = candidates.groupBy("k").agg(F.sum(F.when(own(0), F.col("n"))).alias("n"), F.min("first").alias("first"), listed.alias("c"), *free).where(F.col("n") >= least)
    from_ = [(-F.col(f"best_{i}.back")).alias(f"{b.name}_from") for i, b in enumerate(bundles) if b.tie is None]
    kept = groups.select("k", "n", "first", "c", *from_)
    if not tied:
        return kept.withColumnRenamed("k", key).drop("c")
    names = [f"{bundles[i].name}_from" for i in tied]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[[(c["tie"], c["trust"], c["back"]) for c in group if c["b"] == i] for i in tied] for group in batch.column(3).to_pylist()]
            found = [branch_and_bound(unbound(x) if lead else x) for x in lists]
            picked = [pa.array([-x[j] for x in found], type=pa.int64()) for j in range(len(tied))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns) if i != 3] + picked, names=[n for n in batch.schema.names if n != "c"] + names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "c")
    done = kept.mapInArrow(run, schema + "".join(f", {n} bigint" for n in names))
    return done.select(F.col("k").alias(key), "n", "first", *[f"{b.name}_from" for b in bundles])


Candidate = tuple[str, list[float], int]


def branch_and_bound(lists: list[list[Candidate]]) -> list[int]:
    """One candidate (tie, trust, negative id) of each list, of those whose ties agree the combination
    of the greatest sum of trusts, by their negative ids.

    Branches are candidates in falling order of trust. One is left unexpanded if its sum with the most
    trusted candidates of the lists to come isn't above the best found so far.
    """
    orders = [sorted(c, key=lambda x: (x[1], x[2]), reverse=True) for c in lists]
    width = len(orders[0][0][1])
    rest: list[list[float]] = [[0.0] * width]  # the most that the lists from here on can add
    for own in reversed(orders):
        rest.append([a + b for a, b in zip(own[0][1], rest[-1])])
    rest.reverse()
    best: list[float] | None = None
    picked = [own[0][2] for own in orders]

    def expand(at: int, tie: str, total: list[float], path: list[int]) -> None:
        nonlocal best, picked
        if at == len(orders):
            if best is None or total > best:
                best, picked = total, path
            return
        for own_tie, trust, back in orders[at]:
            if own_tie and tie and own_tie != tie:
                continue
            with_it = [a + b for a, b in zip(total, trust)]
            if best is not None and [a + b for a, b in zip(with_it, rest[at + 1])] <= best:
                break  # later candidates of this list are trusted less
            expand(at + 1, own_tie or tie, with_it, [*path, back])

    expand(0, "", [0.0] * width, [])
    return picked


def unbound(lists: list[list[Candidate]]) -> list[list[Candidate]]:
    """``lists`` with '' for each tie of the first list that some other list has no candidate for. If the
    other lists have the same ties, every candidate of the first then is in an admissible combination."""
    first, *others = lists
    known = [{c[0] for c in own} for own in others]
    return [[(tie if all(tie in k or "" in k for k in known) else "", trust, back) for tie, trust, back in first], *others]


def page_choices(captures: DataFrame) -> DataFrame:
    """(first_capture_id, captures, {bundle}_from) of each page with two or more captures: content,
    provenance and title by branch and bound under the dependencies of ``choices``, with TESTDATA's order
    as the trust of the content: the words of its text (a null text has none), then its ts (null is less
    than any), then the smaller capture_id. These parts come before those of the other bundles, so what
    provenance and title add decides between combinations with the same content only. Columns for these
    two that ``captures`` hasn't count as null."""
    tied = ("source", "extraction_method", "title", "error")
    captures = captures.withColumns({n: F.lit(None).cast("string") for n in tied if n not in captures.columns})
    narrow = _paged(captures, *tied, "text", "ts").select(  # no text or title is shuffled
        "capture_id",
        "__page",
        "source",
        "extraction_method",
        "ts",
        count_words(F.col("text")).alias("words"),
        (_filled("source") + F.when(F.col("error").isNull(), 0.5).otherwise(0.0)).alias("origin"),
        _filled("title").alias("titled"),
    )
    c = _implied(narrow)
    zero = F.lit(0.0)
    ts = F.coalesce(F.col("ts"), zero)
    odd = F.isnan(ts)  # NaN is greater than any number; in the sums it can't stand
    number = F.when(odd, zero).otherwise(ts)
    recent = F.greatest(number, zero)
    whole = F.col("capture_id").cast("bigint")  # in two parts, which doubles hold exactly
    order = (F.col("words"), F.col("ts").isNotNull(), odd, number, -F.shiftright(whole, 32), -whole.bitwiseAND(F.lit(0xFFFFFFFF)))
    later = (zero,) * len(order)
    bundles = [
        Bundle("content", (*order, zero, zero), F.col("implied")),
        Bundle("provenance", (*later, F.col("origin"), recent), F.col("source")),
        Bundle("title", (*later, F.col("titled"), recent), F.col("source")),
    ]
    return best_bundles(c, bundles, least=2, lead=True).drop("__page").withColumnsRenamed({"n": "captures", "first": "first_capture_id"})


def page_groups(captures: DataFrame) -> DataFrame:
    """First and best capture of each page with two or more captures: the one that ``page_choices`` takes
    the content from. Captures whose url_canonical is null or blank belong to no page. Repeated
    capture_ids count as often as they stand there; an empty table gives no rows."""
    return page_choices(captures).select("first_capture_id", F.col("content_from").alias("best_capture_id"))


def _trusts(methods: DataFrame) -> dict[str, float]:
    """Trust by method. The table is fixed (nine rows); a larger one is refused rather than cut."""
    rows = methods.select("extraction_method", "trust").where(F.col("extraction_method").isNotNull()).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("method_trust has more than 1000 rows")
    return {r[0]: float(r[1] or 0) for r in rows}


def _lookup(column: Column, values: dict[str, float]) -> Column:
    if not values:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, column), F.lit(0.0))


def _implied(paged: DataFrame) -> DataFrame:
    """``paged`` with '' for a null source and, from the dependency extraction_method -> source, the source
    that its method implies: at most one a method, few methods."""
    c = paged.withColumn("source", F.coalesce("source", F.lit("")))
    seen = c.where((F.col("source") != "") & F.col("extraction_method").isNotNull()).groupBy("extraction_method", "source").count()
    implied = seen.groupBy("extraction_method").agg(F.max(F.struct(F.col("count"), F.col("source"))).getField("source").alias("implied"))
    return c.join(implied, "extraction_method", "left").withColumn("implied", F.coalesce("implied", F.lit("")))


def _filled(*names: str) -> Column:
    """How many of the columns are neither null nor blank."""
    return sum([F.when(is_blank(F.col(n)), 0.0).otherwise(1.0) for n in names[1:]], F.when(is_blank(F.col(names[0])), 0.0).otherwise(1.0))


def choices(captures: DataFrame, methods: DataFrame) -> DataFrame:
    """(__page, first_capture_id, captures, {bundle}_from) of every page: the captures that its bundles
    are taken from. A bad clock (ts of 0 or less, or none) is the least recent."""
    trust = _lookup(F.col("extraction_method"), _trusts(methods))
    c = _implied(_paged(captures, "url_final", "domain", "source", "extraction_method", "title", "text", "error", "ts"))
    recent = F.greatest(F.coalesce(F.col("ts"), F.lit(0.0)), F.lit(0.0))
    words = count_words(F.col("text"))
    zero = F.lit(0.0)
    has_text = F.when(words > 0, 1.0).otherwise(0.0)
    bundles = [
        Bundle("content", (has_text, F.when(words > 0, trust).otherwise(zero), words, recent), F.col("implied")),
        Bundle("provenance", (_filled("source") + F.when(F.col("error").isNull(), 0.5).otherwise(0.0), zero, zero, recent), F.col("source")),
        Bundle("title", (_filled("title"), F.when(_filled("title") > 0, trust).otherwise(zero), zero, recent), F.col("source")),
        Bundle("address", (_filled("url_final", "domain"), zero, zero, recent)),
        Bundle("time", (recent, zero, zero, zero)),
    ]
    return best_bundles(c, bundles).withColumnsRenamed({"n": "captures", "first": "first_capture_id"})


def survivors(captures: DataFrame, methods: DataFrame) -> DataFrame:
    """One record per page: every column of ``captures`` except capture_id, chosen bundle by bundle,
    with first_capture_id, the captures each bundle came from and the number of captures.

    word_count and text_len are recomputed from the chosen text (0 for a null one); domain is the
    chosen address's host where it is missing. Columns that ``captures`` has besides its own are
    ignored. Ties go to the smallest capture_id, of rows that share one to the same row in every run.
    An empty table gives no rows.
    """
    return _assemble(choices(captures, methods), captures)


def _assemble(chosen: DataFrame, captures: DataFrame) -> DataFrame:
    """The chosen captures' bundles side by side. Each is fetched by capture_id; the pages' ids are
    unpivoted first, so the captures are shuffled once."""
    parts = {
        "content": ["text", "html_len", "extraction_method"],
        "provenance": ["source", "error", "flags"],
        "title": ["title"],
        "address": ["url_original", "url_canonical", "url_final", "domain"],
        "time": ["ts", "ingested_at"],
    }
    roles = F.explode(F.array(*[F.struct(F.lit(b).alias("role"), F.col(f"{b}_from").alias("capture_id")) for b in parts]))
    wanted = (
        chosen.select("__page", "first_capture_id", "captures", roles.alias("__r"))
        .select("__page", "first_capture_id", "captures", "__r.role", "__r.capture_id")
        .groupBy("capture_id", "__page", "first_capture_id", "captures")
        .agg(F.collect_set("role").alias("roles"))
    )
    columns = [c for names in parts.values() for c in names]
    # of rows with one capture_id the same is taken in every run
    same = F.xxhash64(*[F.to_json(c) if c == "flags" else F.col(c) for c in columns])
    row = wanted.join(captures.select("capture_id", *columns, same.alias("__same")), "capture_id")
    has = {b: F.array_contains("roles", b) for b in parts}
    record = row.groupBy("__page", "first_capture_id", "captures").agg(
        *[F.max_by(F.struct(*names), F.when(has[b], F.col("__same"))).alias(f"__{b}") for b, names in parts.items()],
        *[F.max(F.when(has[b], F.col("capture_id"))).alias(f"{b}_from") for b in parts],
    )
    picked = record.select(
        "first_capture_id", "captures", *[f"__{b}.{c}" for b, names in parts.items() for c in names], *[f"{b}_from" for b in parts]
    )
    return picked.withColumns(
        {
            "word_count": count_words(F.col("text")).cast("int"),
            "text_len": F.coalesce(F.length("text"), F.lit(0)),
            "domain": F.when(is_blank(F.col("domain")), host_of(F.col("url_canonical"))).otherwise(F.col("domain")),
        }
    )
