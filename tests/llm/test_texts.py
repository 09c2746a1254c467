import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import encoding_repair, mixing, residue, tokens, truncation

TEXTS = [
    "Häuser für die Übergröße, Möwenau prüfte „so“ – und €5",
    "À Saint-Orvain, l’équipe a été très occupée par l’œuvre",
    "En Tesolía, el señor Ñandú probó 5 casos más",
    "Подпишитесь на рассылку, нас уже 5, и в июле служба закупок упростила план рейсов на складе",
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("name", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "koi8_r", "cp866"])
def test_repairs_utf8_read_as(text, name):
    back = {b: c for c, b in encoding_repair.TABLES[name].items()}
    shown = "".join(chr(b) if b < 0x80 else back[b] for b in text.encode("utf-8"))
    assert encoding_repair.repair(shown) == (text, True)


def test_repairs_twice_wrong_and_partial():
    once = "naïve – but".encode().decode("cp1252")
    assert encoding_repair.repair("ok. " + once.encode().decode("cp1252") + " Größe")[0] == "ok. naïve – but Größe"


@pytest.mark.parametrize("shown, meant", [("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("latin-1", "cp1251"), ("cp1252", "koi8_r"), ("mac_roman", "cp1251")])
def test_repairs_russian(shown, meant):
    assert encoding_repair.repair(TEXTS[3].encode(meant).decode(shown)) == (TEXTS[3], True)


@pytest.mark.parametrize(
    "text",
    TEXTS
    + [
        "", "plain", "Ângela Vintorim runs the desk", "The brand is written SÃO VALDO", "A coração logo and the word DECISÃO marked it", "Le mot « âge » et la ville d’Âprecourt", "Ñandú_2",
        "ПОДЕЛИТЬСЯ СТАТЬЁЙ: ПОЧТА, ССЫЛКА", "Поделиться\xa0статьёй: почта", "Все\xa0статьи", "Главная\xa0| Решения", "Редакция\xa0Drandara", "– «шаг к системе», говорят",
        "ALLE ANGABEN OHNE GEWÄHR", "Confidentialité\xa0· Mentions", "½ µm Ørsund Þórvik Æthra 25 °C", "Javvioé’s desk",
    ],
)
def test_leaves_correct_text(text):
    assert encoding_repair.repair(text) == (text, False)


def test_lost_characters_count(spark):
    df = spark.createDataFrame([(1, "gr�n", None), (2, None, "SÃ¶hne"), (3, "fine", ""), (4, None, None)], "capture_id bigint, text string, title string")
    got = {(r["capture_id"], r["field"]): r["restored"] for r in encoding_repair.wrongly_decoded(df).collect()}
    assert got == {(1, "text"): "gr�n", (2, "title"): "Söhne"}
    fixed = {r["capture_id"]: (r["text"], r["title"]) for r in encoding_repair.restore(df).collect()}
    assert fixed == {1: ("gr�n", None), 2: (None, "Söhne"), 3: ("fine", ""), 4: (None, None)}
    assert encoding_repair.wrongly_decoded(df.where("false")).collect() == []


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.read_vocabulary())


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = tokens.load_ranks(tokens.read_vocabulary())
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n\t'  ab1é\x1c\x85　")), max_size=60))
def test_tokens_match(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_tokens_long_words(encoder, reference):
    r = random.Random(5)
    for text in ("a" * 5000, "ab" * 3000, "漢字" * 800, "".join(r.choice("abcdefg") for _ in range(4000)), "<|endoftext|> it's I'LL"):
        assert encoder.encode(text) == reference.encode_ordinary(text)
    raw = "".join(r.choice("etaoin") for _ in range(90)).encode()
    assert tokens.merge_short(raw, encoder.ranks) == tokens.merge_long(raw, encoder.ranks)


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, " ")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()}
    assert got[2] == [] and got[3] == [] and len(got[1]) == 2 and len(got[4]) == 1
    assert tokens.encode_corpus(df.where("false")).collect() == []


@pytest.mark.parametrize(
    "text, kind",
    [
        ("It is done.", truncation.COMPLETE), ("He said “done.”", truncation.COMPLETE), (None, truncation.COMPLETE), ("  ", truncation.COMPLETE), ("It was mov", truncation.OPEN),
        ("It was mov…", truncation.OPEN), ("It was [cut]", truncation.OPEN), ("It was don�", truncation.OPEN), ("Done.\n- one more item", truncation.LOOSE), ("Done.\nNext up: the next one", truncation.LOOSE),
        ("Done.\n— The desk, Merrin", truncation.LOOSE), ("Done.\nhttps://docs.example/1", truncation.LOOSE), ("Done.\nMerrin, October", truncation.LOOSE), ("Done.\nIn October the desk", truncation.OPEN), ("one,", truncation.OPEN),
    ],
)
def test_prose_ending(text, kind):
    assert truncation.prose_ending(text) == kind


@pytest.mark.parametrize(
    "raw, kind",
    [
        ('{"a": [1, {"b": "}"}]}', truncation.COMPLETE), ("```json\n{\"a\": 1}\n```", truncation.COMPLETE), ('{"a": 1}\n\nNote: fields were left blank (see above).', truncation.COMPLETE),
        ('{"a": [1, {"b": "x', truncation.OPEN), ('{"a": 1', truncation.OPEN), ('{"a": 1,…', truncation.OPEN), ("```json\n{\"a\": 1}", truncation.OPEN), ('{"a": 1}\n\nNote: fields wer', truncation.OPEN),
        ("<think>The article names", truncation.OPEN), ("Here is the requested object:", truncation.OPEN), ("I cannot do this.", truncation.COMPLETE), (None, truncation.COMPLETE), ("", truncation.COMPLETE),
        ("{'a': {'b': ['it']}}", truncation.COMPLETE), ('{"a": [1],}', truncation.COMPLETE), ("{'a': {'b': 'x', 'c", truncation.OPEN), ("{" * 50_000, truncation.OPEN),
    ],
)
def test_answer_ending(raw, kind):
    assert truncation.answer_ending(raw) == kind


def test_truncated_with_spikes(spark):
    line = "\n- an item of a list that has no stop and is long enough to be cut at any place whatever it says"
    rows = [(f"L{i}", f"https://a.example/{i}", "x" * (900 + 13 * i) + "." + line) for i in range(40)]
    rows += [(f"S{i}", "https://a.example/s", ("Some words here. " * 60 + line + "a" * 200)[: 1100]) for i in range(9)]
    rows += [("N", None, None), ("E", "https://a.example/e", "")]
    base = spark.createDataFrame(rows, "doc_id string, url_canonical string, text string")
    answers = spark.createDataFrame([(1, "m", '{"a": 1}'), (2, "m", '{"a": '), (3, None, None)], "prediction_id bigint, model_alias string, raw_response string")
    got = {tuple(r) for r in truncation.truncated(base, answers).collect()}
    assert got == {("dataset_base", f"S{i}") for i in range(9)} | {("predictions", "2")}
    rates = {(r["source_table"], r["source"]): (r["n"], r["cut"]) for r in truncation.truncation_rates(base, answers).collect()}
    assert rates["predictions", "m"] == (2, 1) and rates["predictions", ""] == (1, 0) and rates["dataset_base", "a.example"] == (50, 9)
    assert truncation.truncated(base.where("false"), answers.where("false")).collect() == []


PROSE = [
    f"The {a} desk moved {i} cases to the {b} in {c} and the queue fell by {i % 90} percent before the freeze in {c}."
    for i, (a, b, c) in enumerate((x, y, z) for x in ("pricing", "search", "fraud", "claims") for y in ("shared index", "label queue", "risk score", "image tagger") for z in ("March", "June", "Quorra", "Merrin"))
]


@pytest.mark.parametrize("text", ["Access denied\nYou do not have permission to view this page.", "Lorem ipsum dolor sit amet, consectetur.", "Please enable JavaScript to view this page.", "Seite nicht gefunden"])
def test_residue_windows(text):
    ratios = residue.fit(PROSE)
    assert residue.windows([text], ratios)


@pytest.mark.parametrize("text", ["An access denied message had puzzled the pricing desk for 12 weeks before the freeze in March.", PROSE[0], "", None])
def test_prose_is_no_residue(text):
    ratios = residue.fit(PROSE)
    assert residue.windows([text], ratios) == []


@pytest.mark.parametrize("text", ["Hello {{first_name}}, hi", "${page.copy}", "[Insert customer quote]", "<%= post.title %>", "%TITLE%", "@@HEAD@@", "__MSG_x__", "undefined min read by [object Object]", "#{name} leads", "TODO: add chart", "In <YEAR> it handled {0} cases"])
def test_slots(text):
    assert residue.slot_spans("A line.\n" + text)


@pytest.mark.parametrize("text", ["Teams write `${{price}}` in the draft", "A prompt such as “Dear {{customer}}, …” is filled", "Its TODO list shrank", "100 % of 5", "[a link](x)", "", "{a set} of words", "f(x) < y"])
def test_no_slots(text):
    assert not residue.slot_spans(text)


def test_residue(spark):
    rows = [(i, "\n".join(PROSE[i : i + 4]), f"A title about {i}", None) for i in range(50)]
    rows += [(100, "Page not found", "Error 503", "exception:{type(e).__name__}"), (101, None, None, None), (102, "", " ", "timeout"), (103, PROSE[1] + " {{slot}}", "Untitled document", "blocked")]
    df = spark.createDataFrame(rows, "capture_id bigint, text string, title string, error string")
    got = {(r["capture_id"], r["field"]) for r in residue.residue(df).collect()}
    assert got == {(100, "text"), (100, "title"), (100, "error"), (103, "text"), (103, "title")}
    kept = {r["capture_id"] for r in residue.exclude(df, residue.residue(df)).collect()}
    assert 100 not in kept and {0, 101, 102} <= kept
    assert residue.residue(df.where("false")).collect() == []


@given(st.integers(1, 500), st.floats(0.01, 0.99), st.integers(1, 500), st.floats(0.01, 0.99), st.integers(0, 1000))
def test_pivot_keeps_mass(wa, pa, wb, pb, seed):
    x, y = mixing.pivot((1, wa, pa), (2, wb, pb), seed)
    assert x[2] * wa + y[2] * wb == pytest.approx(pa * wa + pb * wb, abs=1e-5)
    assert {x[2], y[2]} & {0.0, 1.0} and all(0 <= p <= 1 for p in (x[2], y[2]))


def test_pivot_keeps_expectations():
    n = 4000
    mean = sum(mixing.pivot((1, 30, 0.3), (2, 50, 0.6), s)[0][2] for s in range(n)) / n
    assert mean == pytest.approx(0.3, abs=0.03)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 40)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(i, "big" if i % 10 else "small", "some words here " * (1 + i % 7)) for i in range(1000)] + [(5000, "other", "x"), (5001, None, "x"), (5002, "big", None), (5003, "big", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    got = {r["doc_id"]: r for r in mixing.mix(df, targets).collect()}
    assert len(got) == 1002 and max(r["copies"] for r in got.values() if r["source"] == "small") <= 3 and max(r["copies"] for r in got.values() if r["source"] == "big") <= 1
    assert got[5002]["copies"] == 0 and got[5003]["copies"] == 0
    shares = {r["source"]: r["actual_share"] for r in mixing.shares(df, targets).collect()}
    assert shares["big"] == pytest.approx(0.6, abs=0.01) and shares["small"] == pytest.approx(0.4, abs=0.01) and shares["gone"] == 0.0
    assert {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(5), targets).collect()} == {k: r["copies"] for k, r in got.items()}
    assert mixing.mix(df.where("false"), targets).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(df, targets.unionByName(targets))
