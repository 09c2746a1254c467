import math
import random
import time

import pytest

from lexmill.llm import main_body, residue, survivor
from tests.llm.test_survivor import capture, captures

LONG = "article.body | default(" + "x" * 200 + ")"


@pytest.mark.parametrize(
    "slot",
    ["{{ %s }}" % LONG, "{%% %s %%}" % LONG, "${%s}" % LONG, "#{%s}" % LONG, "<%%= %s %%>" % LONG, "[%% %s %%]" % LONG, f"%%{'A' * 90}%%", f"@@{'A' * 90}@@", f"__MSG_{'a' * 90}__", f"%{'AB' * 30}%", f"[Insert {'a quote ' * 20}]"]
    + [f"<{'YEAR_' * 8}>", "{{ article.body\n  | safe }}", "<% if a\n\n b %>", "{{ t('a', {n: 1}) }}", "{% if n % 2 %}", "In {10} cases", "Tbd", "Fixme: text", "Undefined | A site"],
)
def test_slots_of_any_length(slot):
    """Neither long slots, nor slots over line ends, nor marks in another letter case are passed over."""
    text = f"A line.\n{slot}\nAnother."
    assert residue.has_slot(slot) and residue.slot_spans(text) == [(8, 8 + len(slot))]


@pytest.mark.parametrize("text", ["Write `{{` before and `}}` after it.", "Write “{{” before\nand “}}” after it.", "The sets {{1,2},{3,4}}", "Todo: lo que hace falta", "It is undefined\nOf course it is", "a {{ that is\nnever closed"])
def test_marks_that_are_no_slots(text):
    assert not residue.slot_spans(text)


def test_a_slot_between_quoted_marks():
    text = "Write `{{` first\n[Insert quote]\nthen `}}`."
    assert residue.slot_spans(text) == [(17, 31)]


@pytest.mark.parametrize("part", ["{{", "<% ", "{% ", "[% ", "${", "__A_a", "`{{` ", "“{{a}}” ", "{{ {a} ", "{{{a}"])
def test_many_marks_take_time_in_proportion(part):
    start = time.process_time()
    residue.slot_spans(part * 50_000)
    assert time.process_time() - start < 10


def test_bodies_of_captures_with_residue(spark):
    """A capture with a slot, however long, has no lines in p2_found and comes out without its furniture
    in p2_body; the other captures' counts don't change."""
    own = [f"Account number {i} of {chr(97 + i % 26) * 8}{chr(97 + i // 26) * 6} tells what the office in that town did about its letters." for i in range(42)]
    rows = [(i, f"https://site.example/{i}", f"Zum Verteiler beitreten\n{own[i]}") for i in range(40)]
    slots = [(50, "https://site.example/x", f"Zum Verteiler beitreten\n{own[40]}\nThe saving was {{{{ {LONG} }}}} in May."), (51, "https://other.example/x", f"{own[41]}\nPage not found\nThe saving was XX% in May.\nBy Ann Example in June")]
    schema = "capture_id bigint, url_canonical string, text string"
    df = spark.createDataFrame(rows + slots, schema)
    found = {tuple(r) for r in main_body.outside_body(df).collect()}
    assert found == {(i, 1) for i in range(40)} == {tuple(r) for r in main_body.outside_body(spark.createDataFrame(rows, schema)).collect()}
    body = {r["capture_id"]: r["text"] for r in main_body.main_body(df).collect()}
    assert body == {**{i: own[i] for i in range(40)}, 50: slots[0][2].split("\n", 1)[1], 51: own[41] + "\nPage not found\nThe saving was XX% in May."}


def test_best_captures_come_from_the_search(spark):
    """Provenance and title agree with the source that the best text's method implies, and what they add
    doesn't overrule the order of best captures."""
    rows = [capture(i, f"https://b.example/{i}", "some text here", source="medium", method="medium_amp") for i in range(20, 25)]
    rows += [capture(i, f"https://c.example/{i}", "some text here") for i in range(30, 35)]
    rows += [capture(1, "https://a.example/x", "a b c d", title=None), capture(2, "https://a.example/x", "a b c", source="medium", method="medium_amp", ts=9.0), capture(3, "https://a.example/x", None, ts=2.0)]
    # no capture of the page has the source that the method implies
    rows += [capture(5, "https://a.example/y", "a b c", source="a2", method="medium_amp"), capture(6, "https://a.example/y", "a b")]
    # equal words and ts: the smaller id, though the other has more of the rest
    rows += [capture(8, "https://a.example/z", "a b", title=None, source=None), capture(9, "https://a.example/z", "c d", source="medium", method="medium_amp")]
    df = captures(spark, rows)
    got = {r["first_capture_id"]: (r["captures"], r["content_from"], r["provenance_from"], r["title_from"]) for r in survivor.page_choices(df).collect()}
    assert got[1] == (3, 1, 3, 3) and got[5][:2] == (2, 5) and got[8][:2] == (2, 8) and set(got) == {1, 5, 8}
    groups = survivor.page_groups(df)
    assert sorted(map(tuple, groups.collect())) == [(1, 1), (5, 5), (8, 8)]
    assert "MapInArrow" in groups._jdf.queryExecution().toString()


def test_best_captures_of_odd_rows(spark):
    draw = random.Random(7)
    ids = draw.sample([s * (b + i) for s in (1, -1) for b in (1, 2**32, 2**53, 2**62) for i in range(200)], 1500)
    pick = lambda *of: draw.choice(of)
    rows = [
        capture(i, f"https://a.example/{draw.randrange(500)}", pick(None, "", "a", "a b", "c d"), pick("http", "a2", "medium", "", None), pick("http", "medium_amp", "other", None), pick(None, 0.0, -1.0, 1.5, 1.7e9, math.nan, math.inf, -math.inf), pick(None, "", "T"))
        for i in ids
    ]
    pages = {}
    for r in rows:
        ts = r[14]
        order = (-len((r[8] or "").split()), ts is None, not (ts is not None and math.isnan(ts)), 0 if ts is None or math.isnan(ts) else -ts, r[0])
        pages.setdefault(r[2], []).append((order, r[0]))
    want = sorted((min(i for _, i in p), min(p)[1]) for p in pages.values() if len(p) > 1)
    assert len(want) > 200 and sorted(map(tuple, survivor.page_groups(captures(spark, rows)).collect())) == want
