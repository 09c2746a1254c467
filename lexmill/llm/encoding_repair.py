"""Text decoded with the wrong character encoding: found, and restored where the bytes survive.

Characters are mapped back to the bytes they have in a legacy encoding, and an automaton of the byte
structure of UTF-8 walks over them and marks the maximal runs of well-formed multibyte sequences.
Only those runs are decoded, so correct text around them stays as it is. The walk is repeated for
text that went wrong twice. Texts in a one-byte script read as another one-byte script have no
multibyte structure; their words are found by letters of one script that can't stand together, and
mapped as whole words.

Built-in expressions look for characters that can take part in any of this, so that only the few
suspicious values reach Python.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.runtime import spread

#: Legacy encodings whose characters may stand for bytes of UTF-8.
LEGACY = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "mac_cyrillic")


def _reverse(name: str) -> dict[str, int]:
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            # a byte the encoding leaves open is passed through as the control of that number
            table[chr(b)] = b
    if name == "cp1252":
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


TABLES = {name: _reverse(name) for name in LEGACY}

# The byte automaton: classes of bytes, and for each state the class that may follow.
LEAD2, LEAD3, LEAD4, TRAIL = 1, 2, 3, 4


def _class(byte: int) -> int:
    if 0x80 <= byte <= 0xBF:
        return TRAIL
    if 0xC2 <= byte <= 0xDF:
        return LEAD2
    if 0xE0 <= byte <= 0xEF:
        return LEAD3
    if 0xF0 <= byte <= 0xF4:
        return LEAD4
    return 0


def _span_pattern(table: dict[str, int]) -> regex.Pattern:
    """The automaton of one encoding, compiled: lead characters followed by their trail characters,
    as often as they follow one another."""
    by: dict[int, list[str]] = {}
    for ch, b in table.items():
        by.setdefault(_class(b), []).append(ch)
    s = {k: "[" + "".join(map(regex.escape, sorted(v))) + "]" for k, v in by.items() if k}
    t = s[TRAIL]
    return regex.compile(f"(?:{s[LEAD2]}{t}|{s[LEAD3]}{t}{t}|{s[LEAD4]}{t}{t}{t})+")


SPANS = {name: _span_pattern(table) for name, table in TABLES.items()}
#: Characters that can begin, and that can go on, a multibyte sequence in each encoding.
LEADS = {name: frozenset(c for c, b in table.items() if _class(b) in (LEAD2, LEAD3, LEAD4)) for name, table in TABLES.items()}
TRAILS = {name: frozenset(c for c, b in table.items() if _class(b) == TRAIL) for name, table in TABLES.items()}


#: Characters that people write in these scripts; a decoded run is scored by how many it has.
_COMMON = regex.compile("[ -ſˆ˜Ѐ-џҐґ –-―‘-„†‡•…‰‹›₀-₿№™→←≤≥≠½]")
_RARE = regex.compile("[ƀ-ɏͰ-Ͽ֐-ۿऀ-ॿḀ-ỿ -⁯℀-⋿─-◿☀-➿ﬁﬂ﻿�　-ヿ一-鿿가-힯\U0001f300-\U0001faff]")


_PLAIN_RUSSIAN = regex.compile(r"[а-яёА-ЯЁ\xa0«»„“”–—…№°§©·]+")


_CONTROLS = regex.compile(r"[\x80-\x9f]")
_SIGN = regex.compile("[\U0001f300-\U0001faff☀-➿ﬁﬂ﻿�]")
_PUNCTUATION_866 = regex.compile(r"(?:т[АВ].)+")


def _score(decoded: str, run: str, name: str, inside: bool) -> int:
    """How much a decoded run looks like text: its length if all its characters are common, less for
    rare ones, 0 where it can't be text. ``inside`` says that the run is part of a Latin word."""
    plain = _CONTROLS.sub("", decoded)
    common = len(_COMMON.findall(plain))
    rare = len(_RARE.findall(plain))
    if common + rare < len(plain):
        return 0
    if not common and len(decoded) < 2 and not _SIGN.fullmatch(decoded):
        return 0
    if name in ("cp1251", "koi8_r", "cp866", "mac_cyrillic") and _PLAIN_RUSSIAN.fullmatch(run):
        # Russian letters and the signs beside them only: garbled if inside a Latin word, or as a punctuation mark's bytes
        if not inside and not (name == "cp866" and _PUNCTUATION_866.fullmatch(run)):
            return 0
    return 2 * len(run) - 3 * rare


@functools.lru_cache(maxsize=200_000)
def _decoded(run: str, name: str, inside: bool) -> tuple[str, int]:
    """What a run says in UTF-8 and its score, 0 if it isn't well-formed; runs recur within a corpus."""
    table = TABLES[name]
    try:
        decoded = bytes(table[c] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return "", 0
    return decoded, _score(decoded, run, name, inside)


def _joined(letter: str, other: str) -> bool:
    return other.isascii() and other.isalpha() and (letter.isalpha() or letter in "°§©")


def _genuine(run: str, before: str, name: str) -> bool:
    """Runs that are correct text after all: an accented letter at the end of a word before a sign
    (as in "DÉJÀ »" or "CAFÉ…")."""
    return name in ("cp1252", "latin-1", "cp1250") and len(run) == 2 and run[1] in " »«–—…’”“°·®©™§" and before.isupper()


# Script runs for one-byte encodings read as one another.
_LATIN_RUN = regex.compile(r"[¸¨À-ÿ]{4,}")
_MIXED = regex.compile(r"(?<![\p{L}\p{M}\d])(?:[A-Za-z]+[Ѐ-џҐґ]+[A-Za-z]*|[Ѐ-џҐґ]{1,2}[A-Za-z]{2,}[Ѐ-џҐґ]*[A-Za-z]*)(?![\p{L}\p{M}])")
_ALWAYS = regex.compile(r"[�\x80-\x84\x86-\x9f]|(?<=[\p{Ll}\d.,;:!?])Â(?=\s|$)|(?<=\s)Â(?=\s)")
_LOST_SPACE = regex.compile(r"(?<=[\p{Ll}\d.,;:!?\s])Â(?=\s)")
_LOST_GRAVE = regex.compile(r"(?<![\p{L}])Ã (?=[\p{Ll}\p{Lu}])")
_VOWELS = set("аеёиоуыэюя")
_LATIN_WORD = regex.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ACCENT = regex.compile("[äöüßéèàâêîôûçñáíóúëïùÄÖÜÉ]")
_RUSSIAN_WORD = regex.compile(r"[а-яёА-ЯЁ]+")
_TURNED_CASE = regex.compile(r"[а-яё][А-ЯЁ]")
_LATIN_ACCENTS = regex.compile(r"[¸¨À-ÿ]+")
_ANY_CYRILLIC = regex.compile(r"[Ѐ-џ]")
_RUSSIAN_SIGN = regex.compile(r"[А-яЁё«»—–№]")
_LETTER_OR_SIGN = regex.compile(r"[\p{L}]|[^\x00-\x7f]")
_ALL_RUSSIAN = regex.compile(r"[А-яЁё\s\p{P}\d]*")


def _cyrillic_words(run: str) -> str | None:
    """The Russian word behind a run of Latin letters with accents, or None."""
    for name in ("cp1252", "latin-1"):
        try:
            raw = run.encode(name)
        except UnicodeEncodeError:
            continue
        for real in ("cp1251", "koi8_r"):
            word = raw.decode(real, "replace")
            if _RUSSIAN_WORD.fullmatch(word) and _VOWELS & set(word.lower()) and not _TURNED_CASE.search(word):
                return word
    return None


def _repair_once(text: str) -> tuple[str, bool]:
    """One decoding of all garbled runs, with the encoding that explains most characters first."""
    best: tuple[int, str] | None = None
    present = set(text)
    for name, pattern in SPANS.items():
        if LEADS[name].isdisjoint(present) or TRAILS[name].isdisjoint(present):
            continue
        gain = 0
        out, at = [], 0
        for m in pattern.finditer(text):
            run = m.group()
            if _genuine(run, text[m.start() - 1 : m.start()], name):
                continue
            inside = _joined(run[0], text[m.start() - 1 : m.start()]) or _joined(run[-1], text[m.end() : m.end() + 1])
            decoded, score = _decoded(run, name, inside)
            if score <= 0:
                continue
            out += [text[at : m.start()], decoded]
            at = m.end()
            gain += score
        if gain and (best is None or gain > best[0]):
            best = gain, "".join(out) + text[at:]
    return (best[1], True) if best else (text, False)


def repair(text: str | None) -> tuple[str | None, bool]:
    """(restored text, whether anything in it was decoded wrongly). Characters that were lost
    (replacement characters, stray controls) stay and count. Null and empty texts hold nothing."""
    if not text or text.isascii():
        return text, False
    turned = _russian(text)
    found = turned != text
    text = turned
    for _ in range(3):
        text, changed = _repair_once(text)
        found |= changed
        if not changed:
            break
    if "Â" in text and _LOST_SPACE.search(text):
        found, text = True, _LOST_SPACE.sub("", text)
    if "Ã " in text and _LOST_GRAVE.search(text):
        found, text = True, _LOST_GRAVE.sub("à ", text)
    words = [w for m in _LATIN_RUN.finditer(text) if (w := _cyrillic_words(m.group()))]
    if len(words) >= 2:
        found = True
        text = _LATIN_ACCENTS.sub(lambda m: _cyrillic_words(m.group()) or m.group(), text)
    if _ALWAYS.search(text):
        found = True
    if not found and _ANY_CYRILLIC.search(text):
        swapped = _MIXED.findall(text)
        back = [w for w in swapped if _latin_word(w)]
        if back:
            found = True
            text = _MIXED.sub(lambda m: _latin_word(m.group()) or m.group(), text)
    return text, found


_FUNCTION_WORDS = regex.compile(r"(?<![\p{L}])(?:и|в|на|с|для|по|не|как|к|из|от|при|за|что|до|или|о)(?![\p{L}])", regex.I)
_FLIPPED = regex.compile(r"(?<![\p{L}])[а-яё][А-ЯЁ]{2,}(?![\p{L}])")
_FOREIGN = regex.compile(r"[\x80-\xff–-›€ŒœŠšŸŽžƒˆ˜ﬁﬂ∞∏π∑∫Ω√≈∆◊‡·‚„‰Ѐ-ӿ─-╿░-▓■-]")
_MISREAD = tuple(
    (shown, meant)
    for shown in ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "cp1252", "latin-1", "mac_roman")
    for meant in ("cp1251", "koi8_r", "cp866")
    if shown != meant
)


def _reread(line: str, shown: str, meant: str) -> str | None:
    """What a line's bytes say in another one-byte encoding; None where it isn't Russian."""
    try:
        raw = line.encode(shown)
    except UnicodeEncodeError:
        try:  # places that the encoding lacks came through as controls
            raw = b"".join(c.encode(shown) if ord(c) < 0x80 or ord(c) > 0x9F else bytes([ord(c)]) for c in line)
        except UnicodeEncodeError:
            return None
    other = raw.decode(meant, "replace")
    strange = len(_FOREIGN.findall(line))
    russian = len(_RUSSIAN_SIGN.findall(other))
    return other if russian >= 0.85 * strange and not _FLIPPED.search(other) else None


def _russian(text: str) -> str:
    """The text, or with its lines in the Cyrillic encoding in which most of them have the little
    words that Russian sentences have, where as shown they have none."""
    lines = text.split("\n")
    strange = lambda x: len(x) - len(x.encode("ascii", "ignore"))
    open_lines = [
        i
        for i, x in enumerate(lines)
        if (k := strange(x)) >= 4 and k >= 0.3 * len(x) and len(_FOREIGN.findall(x)) >= 0.5 * len(_LETTER_OR_SIGN.findall(x))
        if not (_FUNCTION_WORDS.search(x) and not _FLIPPED.search(x))
    ]
    if not open_lines:
        return text
    best, winner = 0, {}
    for shown, meant in _MISREAD:
        read = {i: y for i in open_lines if (y := _reread(lines[i], shown, meant)) is not None}
        worth = sum(len(_FUNCTION_WORDS.findall(y)) for y in read.values()) + sum(bool(_FLIPPED.search(lines[i])) for i in read)
        if worth > best:
            best, winner = worth, read
    plain = all(_ALL_RUSSIAN.fullmatch(lines[i]) and not _FLIPPED.search(lines[i]) for i in winner)
    if best < (3 if plain else 2) and (plain or not best or len(winner) < len([x for x in lines if x.strip()])):
        return text
    return "\n".join(winner.get(i, x) for i, x in enumerate(lines))


def _latin_word(word: str) -> str | None:
    """The Latin word whose accented letters were read as Cyrillic, or None."""
    for name in ("cp1251",):
        try:
            real = word.encode(name).decode("cp1252")
        except UnicodeError:
            continue
        if _LATIN_WORD.fullmatch(real) and _ACCENT.search(real):
            return real
    return None


def _sequences() -> str:
    """The sequences of the byte automaton in every encoding of LEGACY, as Java and Python write them."""
    some = lambda chars: "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(chars)) + "]"
    out = []
    for name, table in TABLES.items():
        for n in (LEAD2, LEAD3, LEAD4):
            out.append(f"{some(c for c in LEADS[name] if _class(table[c]) == n)}{some(TRAILS[name])}{{{n}}}")
    return "|".join(out)


#: Characters that some wrong decoding produces and ordinary text of these languages hardly has, or
#: pairs of characters that only a wrong decoding puts side by side. Everything here begins with a
#: character beyond ASCII, which the look-ahead tests first: most places of most texts end there.
SUSPICIOUS = (
    rf"(?=[^\x00-\x7f])(?:{_sequences()}|[\u0080-\u009f�─-╿√∆∂∑∫≠¬ƒ₧⌐一-鿿]"
    r"|[Â-ß][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]|[à-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{2}|(?<=[a-z\d.,;:!?\s])Â\s|Ã "
    r"|‚[ÄÇËà]"
    r"|[ЀЂ-Џѐђ-џҐґ]|[РСВГ][ -¿–-›€™№]"
    r"|(?<=[A-Za-z])[Ѐ-џ]|[Ѐ-џ](?=[A-Za-z])"
    r"|[À-ÿ]{4}|Γ[Çé]|[а-я][А-Я]"
    r"|[—–][\u0080-ÿ–-≠Ωπ∏])"
)


def suspicious(column: Column) -> Column:
    """Whether a value may hold wrongly decoded characters; false for null."""
    return F.coalesce(column.rlike(SUSPICIOUS), F.lit(False))


def wrongly_decoded(docs: DataFrame, doc_id: str = "capture_id", fields: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """(doc_id, field, restored): each field of each document that holds characters from a wrong
    decoding, recoverable or not, with its text restored as far as the bytes survive.

    Null, empty and plain ASCII values hold none. Repeated rows are reported as often as they stand.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    long, docs = None, spread(docs.select(doc_id, *fields))
    for f in fields:
        part = docs.select(F.col(doc_id), F.lit(f).alias("field"), F.col(f).alias("value")).where(suspicious(F.col(f)))
        long = part if long is None else long.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [repair(v) for v in batch.column(2).to_pylist()]
            keep = pa.array([f for _, f in done], type=pa.bool_())
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t for t, _ in done], type=pa.string())], names=[doc_id, "field", "restored"]
            )
            yield out.filter(keep)

    return long.mapInArrow(run, f"`{doc_id}` {kind}, field string, restored string")


def restore(docs: DataFrame, doc_id: str = "capture_id", fields: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """``docs`` with every wrongly decoded field restored in place; all other values unchanged."""

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(fields)):
                k = batch.schema.get_field_index(f"__{i}")
                values = batch.column(k).to_pylist()
                batch = batch.set_column(k, batch.schema.field(k), pa.array([v if v is None else repair(v)[0] for v in values], type=pa.string()))
            yield batch

    marked = docs.select(doc_id, *[F.col(f).alias(f"__{i}") for i, f in enumerate(fields)]).where(
        _any([suspicious(F.col(f"__{i}")) for i in range(len(fields))])
    )
    fixed = marked.mapInArrow(fix, marked.schema).withColumnRenamed(doc_id, "__key").dropDuplicates(["__key"])
    joined = docs.join(fixed, docs[doc_id] == fixed["__key"], "left")
    values = {f: F.when(F.col("__key").isNull() | ~suspicious(F.col(f)), F.col(f)).otherwise(F.col(f"__{i}")) for i, f in enumerate(fields)}
    return joined.withColumns(values).drop("__key", *[f"__{i}" for i in range(len(fields))])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
