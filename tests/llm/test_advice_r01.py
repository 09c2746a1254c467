from lexmill.llm import encoding_repair, main_body, split_overlap
from tests.llm.test_split_overlap_brute import brute


def test_overlaps_of_changed_words_among_shared_templates(spark):
    """Five words of 160 differ; the template that all documents have weighs little, so the weighted cosine is below 0.7."""
    template = [f"t{i}" for i in range(120)]
    texts = {f"D{i:03d}": " ".join(template + [f"own{i}x{j}" for j in range(40)]) for i in range(100)}
    words = template + [f"own{j}" for j in range(40)]
    texts["X"] = " ".join(words)
    texts["Y"] = " ".join("changed" if i % 32 == 16 else w for i, w in enumerate(words))
    splits = {k: "train" if k == "X" or k < "D050" else "dev" for k in texts}
    scores = brute(texts, splits, split_overlap.THRESHOLD)[1]
    assert 0.6 < scores["X", "Y"] < 0.7 and max(s for p, s in scores.items() if p != ("X", "Y")) < 0.4
    base = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    golden = spark.createDataFrame(list(splits.items()), "doc_id string, split string")
    assert {tuple(r) for r in split_overlap.overlaps(golden, base).collect()} == {("X", "Y")}


CONSENT = "Zinnellpress and 60898 partners store small files on your device to measure visits. You can change your choice at any time."


def test_furniture_of_long_lines(spark):
    """White space doesn't make a line prose, and consent and legal wordings count at any length."""
    prose = "The harbour office counted twelve ships in June, wrote their names down and sent the list to both towns, which had asked for it in spring and again in May."
    wide = CONSENT.replace(" ", "  ")
    standing = prose + " All rights reserved."
    assert len(wide) > 140 and len(prose) > 140
    assert main_body.furniture_lines("\n".join([wide, prose, standing])) == [1, 3]
    for form in ("témoins de connexion", "accepts no liability", "sin garantía alguna", "we use cookies, please accept"):
        assert main_body.furniture_lines(f"{prose} {form}.") == [1]


def test_tree_counts_long_lines_and_listed_forms(spark):
    """Furniture of 200 and more characters that many pages show, and a spelling of a listed line that the list doesn't know."""
    notice = " ".join(["Unser Kleingedrucktes gilt für alle Seiten dieses Angebots und wird jeden Herbst neu gefasst"] * 3)
    assert len(notice) > 200
    rows = []
    for i in range(40):
        own = f"Report number {i} says {chr(97 + i % 26) * 9} and {chr(97 + i // 3) * 7} were counted again that year."
        listed = "M.e.n.u." if i == 7 else "Menu"
        rows.append((i, f"https://site.example/p{i}", f"{listed}\n{own}\n{notice}"))
    df = spark.createDataFrame(rows, "capture_id bigint, url_canonical string, text string")
    got = [tuple(r) for r in main_body.outside_body(df).collect()]
    assert sorted(got) == [(i, n) for i in range(40) for n in (1, 3)]


def test_garbled_values_of_every_legacy_encoding_are_found(spark):
    """What the automaton can repair passes the prefilter; only such characters are garbled in these values."""
    rows = [(1, "CafĂ©s were open"), (2, "CafÔÇÖs were open"), (3, "open ÔÇô closed"), (4, "Cafés were open – the café’s 12 °C")]
    for i, name in enumerate(encoding_repair.LEGACY):
        for k, ch in enumerate("éü’–ñ€"):
            seen = {b: c for c, b in encoding_repair.TABLES[name].items()}
            value = "Caf" + "".join(seen[b] for b in ch.encode()) + "s were open"
            if encoding_repair.repair(value)[1]:
                rows.append((10 * i + k + 100, value))
    assert len(rows) > 30
    df = spark.createDataFrame([(i, v, None) for i, v in rows], "capture_id bigint, text string, title string")
    got = {r["capture_id"]: r["restored"] for r in encoding_repair.wrongly_decoded(df).collect()}
    assert set(got) == {i for i, _ in rows} - {4}
    assert got[1] == "Cafés were open" and got[2] == "Caf’s were open" and got[3] == "open – closed"
