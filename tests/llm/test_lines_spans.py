import unicodedata
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import main_body, repeated_lines, shared_spans


def letters(line):
    return "".join(c for c in line if unicodedata.category(c)[0] == "L").lower()


def brute_lines(rows, least=5, share=0.05):
    docs = [(i, d, t) for i, d, t in rows if d and t and t.strip()]
    size = Counter(d for _, d, _ in docs)
    seen = defaultdict(set)
    for i, d, t in docs:
        for x in t.split("\n"):
            if letters(x):
                seen[d, letters(x)].add(i)
    hit = {k for k, v in seen.items() if len(v) >= least and len(v) >= share * size[k[0]]}
    return {(i, n) for i, d, t in docs for n, x in enumerate(t.split("\n"), 1) if (d, letters(x)) in hit}


def test_repeated_lines(spark):
    rows = []
    for i in range(130):
        text = f"Share this: {i}!\nbody {chr(97 + i % 26)}{chr(97 + i // 26)} text\n\nSHARE  this\n{i}" if i % 2 else f"own line {chr(97 + i % 26)}{chr(97 + i // 26)}\n© Größe"
        rows.append((i * 40_000, ["a.example", "b.example", "", None][i % 4 if i % 8 else 0], text))
    rows += [(9_000_001, "c.example", "x"), (9_000_002, "c.example", None), (9_000_003, "c.example", " \n\t "), (9_000_004, "a.example", "")]
    df = spark.createDataFrame(rows, "capture_id bigint, domain string, text string")
    got = [tuple(r) for r in repeated_lines.repeated_lines(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_lines(rows)
    clean = {r["capture_id"]: r["text"] for r in repeated_lines.remove_lines(df, repeated_lines.repeated_lines(df)).collect()}
    assert clean[9_000_002] is None and clean[9_000_001] == "x"
    gone = brute_lines(rows)
    for i, _, t in rows:
        if t is not None:
            assert clean[i] == "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in gone)
    assert repeated_lines.repeated_lines(df.where("false")).collect() == []
    assert repeated_lines.repeated_line_report(df).count() == 3


def brute_pairs(rows, n=200):
    seen = defaultdict(set)
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            seen[t[k : k + n]].add(i)
    return {(a, b) for v in seen.values() for a in v for b in v if a < b}


def brute_share(rows, n=200):
    seen = defaultdict(set)
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            seen[t[k : k + n]].add(i)
    out = {}
    for i, t in rows:
        hit = set()
        for k in range(len(t or "") - n + 1):
            if len(seen[t[k : k + n]]) > 1:
                hit.update(range(k, k + n))
        out[i] = len(hit)
    return out


def passages(seed, n):
    import random

    r = random.Random(seed)
    return "".join(r.choice("abcdefgh ijklmno äöü漢") for _ in range(n))


def span_rows():
    shared, other = passages(1, 200), passages(2, 450)
    rows = [
        (1, passages(10, 300) + shared + passages(11, 80)),
        (2, shared + passages(12, 500)),
        (3, passages(13, 50) + shared[:199]),
        (4, other + passages(14, 100)),
        (5, passages(15, 90) + other[100:350] + passages(16, 10)),
        (6, passages(17, 600)),
        (7, passages(17, 600)),
        (8, None),
        (9, ""),
        (10, "x" * 700),
        (11, "y" + "x" * 260),
        (12, "short"),
        (13, passages(18, 10) + other[:210] + shared + passages(19, 5)),
    ]
    return rows


def test_shared_spans(spark):
    rows = span_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in shared_spans.shared_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    share = {r["doc_id"]: r["n_shared"] for r in shared_spans.shared_share(df).collect()}
    assert share == brute_share(rows)
    assert shared_spans.shared_pairs(df.where("false")).collect() == []


def test_long_texts_in_parts(spark, monkeypatch):
    rows = span_rows()
    whole = list(shared_spans._chunks([t for _, t in rows]))
    monkeypatch.setattr(shared_spans, "CHUNK", 256)
    parts = list(shared_spans._chunks([t for _, t in rows]))

    def found(chunks):
        out = set()
        for at, codes, starts, lengths in chunks:
            d, pos, h, left, right = shared_spans.compact_windows(codes, starts, lengths)
            out |= {(at[k][0], int(p) + at[k][1], int(x)) for k, p, x in zip(d, pos, h)}
        return out

    assert found(whole) == found(parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), max_size=4))
def test_compact_windows_are_the_least_tokens(texts):
    import numpy as np

    span, gram = 12, 5
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    d, pos, h, left, right = shared_spans.compact_windows(codes, starts, lengths, span, gram)
    rank = {}
    for k, p, x in zip(d, pos, h):
        assert rank.setdefault(texts[k][p : p + gram], int(x)) == int(x)
        assert left[list(zip(d, pos)).index((k, p))] <= p
    covered = {(int(k), s) for k, a, b in zip(d, left, right) for s in range(int(a), int(b) - span + 2)}
    assert covered == {(k, s) for k, t in enumerate(texts) for s in range(len(t) - span + 1)}


PAGE = """Menu
Home » Articles » All stories

Words: Ann Example
The pilot began in March and ended in June after 12 trial runs in two towns.

What the pilot changed

- cut the queue by 12 percent
- moved 5 cases to the new desk

Our desk kept the older tools in place. Continue reading →
Reader 12 wrote: I like this story, as it says what was done and why.
Tags: data, people, operations
Read next: How the desk learned from it
©  2024  Example Notes. All rights reserved."""


def test_furniture_by_form():
    lines = PAGE.split("\n")
    got = {lines[n - 1].split()[0] for n in main_body.furniture_lines(PAGE)}
    assert got == {"Menu", "Home", "Words:", "Our", "Reader", "Tags:", "Read", "©"}
    assert main_body.furniture_lines(None) == [] and main_body.furniture_lines("") == []


def test_outside_body(spark):
    rows = []
    for i in range(40):
        own = f"Report number {i} says {chr(97 + i % 26) * 9} and {chr(97 + i // 3) * 7} were counted again that year."
        rows.append((i, f"https://site.example/p{i}", f"Zum Verteiler beitreten\n{own}\nUnser Kleingedrucktes gilt hier"))
    rows += [(100, "https://site.example/e", "Access denied\nYou do not have permission to view this resource. Reference #1."), (101, None, "Menu\nThe harbour office counted 12 ships in June and wrote their names down."), (102, "https://site.example/n", None), (103, "https://site.example/b", " ")]
    df = spark.createDataFrame(rows, "capture_id bigint, url_canonical string, text string")
    got = {tuple(r) for r in main_body.outside_body(df).collect()}
    assert got == {(i, n) for i in range(40) for n in (1, 3)} | {(101, 1)}
    body = {r["capture_id"]: r["text"] for r in main_body.main_body(df).collect()}
    assert body[0].startswith("Report number 0") and "\n" not in body[0] and body[102] is None and body[100].startswith("Access")
    assert main_body.outside_body(df.where("false")).collect() == []


def test_style_tree_ignores_repeated_captures(spark):
    rows = [(i, "https://site.example/same", f"The same article line\nunique {'abcdefghij'[i]}{'abcdefghij'[i]}") for i in range(10)]
    df = spark.createDataFrame(rows, "capture_id bigint, url_canonical string, text string")
    assert main_body.low_importance(df).collect() == []
