"""The main body of a page, by a site style tree.

The captures of one host are merged into a tree: host, presentation node, content node. A capture is
text without tags, so a line is a leaf. Its content is its letters; its presentation is what it looks
like: a short label before a colon, and the form it has among those that pages are made of (bread
crumbs, credits, consent, pointers to other pages, remarks and so on, FORMS).

The importance of a node on a host with m pages that shows it on c of them is 1 - log(c) / log(m): the
entropy of its feature over the pages, 1 for what only one page has, 0 for what all have. Every line is
fed to the tree, whatever its length or form, and a line is cut if one of its nodes has low importance.
Content and labels are judged by the host's pages alone. A form's wording is evidence of its own, which
weighs as much as two more pages, one that shows it and one that doesn't (the rule of succession): on a
host of very few pages it decides, on a larger one the host's own pages do. Pages without a host are
taken together for their forms.

Counts are exact and taken over distinct pages, so that a page captured often isn't furniture.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.url import page_key
from lexmill.llm import encoding_repair, residue
from lexmill.runtime import cut, spread

LOW_IMPORTANCE = 0.4  # of content and labels
LOW_FORM = 0.8  # of forms, whose wording is evidence already
LEAST_PAGES = 4  # of a host that must show a content or label node before it can be furniture
PRIOR = (1, 2)  # pages that a form's wording weighs: that show it, in all
LABEL = 28  # characters of a label before a colon

_DATE = r"\d{1,4}[./\- ]\d{1,2}[./\- ]\d{2,4}"

# General wordings of page furniture, by form. Lines are compared in lower case, with
# single spaces and zeros for digits. A form is known by how a line begins (HEADS, with what may follow),
# ends (TAILS) or by what it holds (PARTS, SHAPES).
HEADS = {
    "credit": ("words|written|posted|published|text|photo|photos|by|von|par|por|автор|редакция|редактор|rédaction|redacción|redaktion|texte|texto|foto|fotos|auteur|autor", r"\b[^.!?]{0,90}$"),
    "dated": ("posted|published|updated|last updated|veröffentlicht|aktualisiert|publié|mis à jour|publicado|actualizado|опубликовано|обновлено", r"\b.{0,60}$"),
    "keywords": (
        "tags|tag|topics|topic|filed under|categories|category|keywords|schlagwörter|themen|kategorien|kategorie|mots-clés|étiquettes|catégories|catégorie|thèmes|etiquetas|temas|categorías|categoría|метки|теги|темы"
        "|рубрики|рубрика",
        r"\b ?:? ?[^.!?]{2,120}$",
    ),
    "letter": ("newsletter|subscribe|suscríbete|подпишитесь|abonnieren|abonnez-vous|follow us|folgen sie uns|suivez-nous|síguenos|get new posts|join 0", r"\b"),
    "share": ("share|teilen|beitrag teilen|artikel teilen|partager|comparte|compartir|поделиться", r"\b.{0,60}$"),
    "copy": ("copy link|link kopieren|copier le lien|copiar enlace|скопировать ссылку", r"\b"),
    "pointer": (
        "related|read next|read also|also read|read more|more|next|previous|prev|see also|more from|more in|more on|more like this|up next|also on|popular now|trending|most read|latest|recommended|don’t miss"
        "|you may also like|you might also like|lesen sie auch|lies auch|weiter|zurück|vorheriger|nächster|mehr von|mehr aus|mehr zum thema|auch interessant|beliebt|meistgelesen|das könnte sie auch interessieren"
        "|à lire aussi|à lire|lire aussi|suivant|précédent|plus de|voir aussi|populaire|les plus lus|vous aimerez aussi|sur le même sujet|lee también|lea también|siguiente|anterior|más de|más sobre|ver también"
        "|te puede interesar|lo más leído|popular|читайте также|далее|назад|предыдущая|следующая|ещё от|ещё по теме|популярное|вам также понравится|смотрите также|по теме",
        r"\b(?: [\p{L}\p{N}&.’'\-]+){0,4} ?:",
    ),
    "pointer list": (
        "popular now|you may also like|you might also like|trending now|most read|recommended for you|don’t miss|up next|also on|beliebt|meistgelesen|das könnte sie auch interessieren|auch interessant"
        "|les plus lus|vous aimerez aussi|à lire aussi|te puede interesar|lo más leído|популярное|вам также понравится|читайте также|читают сейчас",
        r"\b",
    ),
    "remark": (
        "reader|guest|visitor|user|commenter|leser|leserin|gast|besucher|nutzer|lecteur|lectrice|visiteur|invité|lector|lectora|invitado|usuario|читатель|гость|посетитель|пользователь",
        r"\w{0,3} ?0+(?: ?(?:wrote|writes|says|said|schreibt|schrieb|meint|écrit|dit|dice|escribe|escribió|пишет|написал\p{L}*))? ?:",
    ),
    "reply": (
        "reply|comment|answer|response|antwort|kommentar|réponse|commentaire|respuesta|comentario|ответ|комментарий",
        r" (?:from|by|to|von|auf|an|de|à|a|от|для) [^:]{1,40} ?:",
    ),
    "copyright": ("©|(c)|copyright", ""),
    "helpful": ("was this page helpful|was this article helpful|war diese seite|war dieser artikel|cette page vous a|cet article vous a|¿te ha sido|была ли эта", r"\b.{0,50}$"),
    "place": ("you are here|sie sind hier|vous êtes ici|estás aquí|вы здесь", " ?:"),
}
TAILS = {"preview": "continue reading|read more|mehr lesen|weiterlesen|lire la suite|seguir leyendo|leer más|читать далее|читать дальше"}
PARTS = {
    "consent": r"\bcookies?\b.{0,80}(?:accept|reject|settings|annehmen|ablehnen|notwendig|refuser|accepter|aceptar|rechazar|принять|отклонить|agree|set\b|statisti|mesurer|medir|статистик)"
    r"|(?:accept|agree|consent|accepter|aceptar|принять).{0,60}\bcookies?\b|\bstor\w+\b.{0,40}\bon your device|your privacy matters|témoins de connexion|speicher\w+\b.{0,30}\bauf (?:ihrem|deinem) gerät"
    r"|\bguarda\w*\b.{0,40}\ben (?:tu|su) (?:equipo|dispositivo)|сохраня\w+\b.{0,40}\bна вашем|файлы cookie",
    "letter": r"\b(?:weekly|daily|monthly) (?:letter|newsletter|digest)\b|lettre hebdomadaire|boletín\b.{0,30}0",
    "legal": r"all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|все права защищены|accepts? no liability|ohne gewähr|nachdruck nur mit|à titre indicatif|sans garantie\W*$"
    r"|sin garantía alguna|без каких-либо гарантий",
}
HINTS = {
    "consent": "cookie|device|your privacy matters|témoins de connexion|gerät|equipo|dispositivo|на вашем".split("|"),
    "letter": "weekly|daily|monthly|hebdomadaire|boletín".split("|"),
    "legal": "reserv|vorbehalten|réservés|защищены|liability|gewähr|nachdruck|indicatif|garant|гарантий".split("|"),
}
SHAPES = {  # with the characters or letters that a line must hold, at its beginning or end
    "crumbs": (r"^[^.!?»›>/]{1,60}(?: [»›>/] (?:[^.!?»›>/]|[.](?=\S)){1,100}){1,4}$", "anywhere", (" » ", " › ", " > ", " / ")),
    "bar": (r"^[^.!?|]{1,24}(?: \| [^.!?|]{1,24}){1,8}$|^[^.!?·]{1,22}(?: · [^.!?·]{1,22}){1,6}$", "anywhere", (" | ", " · ")),
    "count": (
        r"^0[0.,  ]*(?:people shared this|shares?|saves?|likes?|comments?|mal geteilt|partages?|veces compartido|комментари\p{L}*|kommentare?|commentaires?|comentarios?)\b.{0,8}$"
        r"|^0[0.,  ]*(?:comments?|kommentare?|commentaires?|comentarios?|комментари\p{L}*|replies|antworten|réponses|respuestas) ?·|^поделились 0[0.,  ]*раз",
        "begin",
        ("0", "поделились"),
    ),
    "minutes": (r"^0[0.,  ]*(?:min|minutes?|minuten|минут\p{L}*)\b[^.!?]{0,60}$|^(?:[^.!?]|[.](?=\S)){8,140} [–—-] 0[0.,]* min\p{L}*$", "anywhere", (" min", " минут")),
    "date": (r"^[^.!?]{2,60}, (?:le )?" + _DATE + "$|^" + _DATE + "$", "end", ("0",)),
}

_ZEROS = bytes.maketrans(b"123456789", b"000000000")
_FRONT, _BACK = " ·|»«›•*–—-", " ·|»›!:;?"
_LABELS = frozenset(x.rstrip(_BACK) for x in residue.FURNITURE)


def folded(text: str) -> str:
    """Lower case, zeros for digits. Surrogates, which no Spark string has, become question marks."""
    return text.encode("utf-8", "replace").translate(_ZEROS).decode("utf-8").lower()


def _first_word(line: str) -> str:
    if line[:1] == "©":
        return "©"
    return line.partition(" ")[0].rstrip("0:,.;!?·|»")


def _by_start() -> dict[str, list[tuple[str, regex.Pattern]]]:
    """Patterns of HEADS by the first word of a line they can match."""
    out: dict[str, list[tuple[str, regex.Pattern]]] = {}
    for form, (heads, rest) in HEADS.items():
        groups: dict[str, list[str]] = {}
        for h in heads.split("|"):
            groups.setdefault(_first_word(h), []).append(regex.escape(h, literal_spaces=True))
        for word, own in groups.items():
            out.setdefault(word, []).append((form, regex.compile(f"(?:{'|'.join(own)}){rest}")))
    return out


_HEADS = _by_start()
_TAILS = {form: tuple(x.split("|")) for form, x in TAILS.items()}
_PARTS = {form: regex.compile(p) for form, p in PARTS.items()}
_SHAPES = {place: [(form, regex.compile(p), marks) for form, (p, at, marks) in SHAPES.items() if at == place] for place in ("anywhere", "begin", "end")}
_LONGEST_SHAPE = 500  # characters the patterns of SHAPES can match at most
_SENTENCE = regex.compile(r"[.!?…][\"”’»)]?$")


def form_of(line: str) -> str | None:
    """The form of a line, None for one that looks like text of an article."""
    return _form_of(folded(line))


def _form_of(low: str) -> str | None:
    whole = " ".join(low.split())
    known = _forms.get(whole)
    if known is None:
        known = _form(whole)
        if len(whole) <= 160:  # a memory of short lines, which recur but for their numbers
            if len(_forms) > 200_000:
                _forms.clear()
            _forms[whole] = known
    return known or None


_forms: dict[str, str] = {}


def _form(whole: str) -> str:
    bare = whole.rstrip(_BACK)
    front = whole.lstrip(_FRONT)
    if not bare or bare in _LABELS or front.rstrip(_BACK) in _LABELS:
        return "label"
    if heads := _HEADS.get(_first_word(front)):
        at = len(whole) - len(front)
        for form, pattern in heads:
            if pattern.match(whole, at) or pattern.match(bare, at):
                return form
    end = bare[-40:].rstrip(".… →)]")
    for form, tails in _TAILS.items():
        if end.endswith(tails):
            return form
    for form, hints in HINTS.items():
        for h in hints:
            if h in whole:
                if _PARTS[form].search(whole):
                    return form
                break
    if len(whole) <= _LONGEST_SHAPE:
        shapes = [x for x in _SHAPES["anywhere"] if any(m in whole for m in x[2])]
        shapes += [x for x in _SHAPES["begin"] if whole.startswith(x[2])] + [x for x in _SHAPES["end"] if bare.endswith(x[2])]
        for form, pattern, _ in shapes:
            if pattern.match(whole) or pattern.match(bare):
                return form
    return ""


def furniture_lines(text: str | None) -> list[int]:
    """Numbers, from 1, of the lines that have a form of furniture; blank lines have none."""
    if not text:
        return []
    return [i for i, line in enumerate(text.split("\n"), 1) if line.strip() and form_of(line)]


_LETTERS = regex.compile(r"[^\p{L}]+")
_NO_ASCII = bytes(b for b in range(256) if not 97 <= b <= 122)
CONTENT, NAME, FORM = 0, 1, 2


def node_keys(line: str) -> list[tuple[int, int]]:
    """(kind, hash) of the tree's nodes a line belongs to: its content (letters; in Latin script only
    the ASCII ones, so that wrongly decoded accents don't matter), if a short label precedes a colon
    and no sentence follows, its label, and its form, if it has one."""
    return _node_keys(folded(line))


def _key(text: str) -> int | None:
    kept = text.encode("utf-8", "replace").translate(None, _NO_ASCII)
    if len(kept) < 0.6 * len(text):
        every = _LETTERS.sub("", text)
        kept = kept if len(kept) >= 0.6 * len(every) else every.encode("utf-8", "replace")
    return xxhash.xxh64_intdigest(kept) - 2**63 if kept else None


def _node_keys(low: str) -> list[tuple[int, int]]:
    out = [(CONTENT, k)] if (k := _key(low)) is not None else []
    label, colon, rest = low.partition(":")
    if colon and 2 <= len(label.strip()) <= LABEL and len(rest) <= 100 and not _SENTENCE.search(rest.strip()) and (k := _key(label)) is not None:
        out.append((NAME, k))
    if (form := _form_of(low)) is not None:
        out.append((FORM, _FORM_KEYS[form]))
    return out


_FORM_KEYS = {f: i for i, f in enumerate(["label", *HEADS, *TAILS, *dict.fromkeys([*PARTS, *SHAPES])])}


_NODE = "line_no int, host bigint, page bigint, kind int, key bigint"
NO_HOST = 0


def _nodes(docs: DataFrame, doc_id: str, text: str, url: str, every: bool = False) -> DataFrame:
    """One pass over the documents whose text holds no residue: a row for each tree node of each line, and
    one with line 0 a document. With ``every`` there are also those that hold some, as no page, so that
    the other documents' counts stay as they are."""
    docs = spread(docs.select(doc_id, text, url))
    model = docs.sparkSession.sparkContext.broadcast(residue.fit(residue.count_ngrams(docs, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                yield one(whole.slice(at, 256))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, odd = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        held = {i for i, *_ in residue.windows(texts, model.value)}
        held |= {i for i, t in enumerate(texts) if t and i not in held and residue.slot_spans(t)}
        rows, numbers, kinds, keys = [], [], [], []
        for i, t in enumerate(texts):
            if not t or t.isspace() or i in held and not every:
                continue
            rows.append(i)
            numbers.append(0)
            kinds.append(None)
            keys.append(None)
            for n, line in enumerate(folded(encoding_repair.repair(t)[0] if odd[i] else t).split("\n"), 1):
                if line and not line.isspace():
                    for kind, key in _node_keys(line):
                        rows.append(i)
                        numbers.append(n)
                        kinds.append(kind)
                        keys.append(key)
        at = pa.array(rows, type=pa.int64())
        shown = pa.array([None if i in held else i for i in rows], type=pa.int64())
        columns = [batch.column(0).take(at), pa.array(numbers, type=pa.int32()), batch.column(3).take(at), batch.column(4).take(shown), pa.array(kinds, type=pa.int32()), pa.array(keys, type=pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[doc_id, "line_no", "host", "page", "kind", "key"])

    page = page_key(F.col(url))
    host = F.regexp_extract(page, r"^[^/?]*", 0)
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias(doc_id),
        text,
        encoding_repair.suspicious(F.col(text)).alias("__odd"),
        F.when(F.coalesce(host, F.lit("")) == "", F.lit(NO_HOST)).otherwise(F.xxhash64(host)).cast("bigint").alias("__host"),
        # a page without an address is its own
        F.coalesce(F.xxhash64(page), F.xxhash64(F.lit("no page"), F.col(doc_id))).alias("__page"),
    )
    return rows.mapInArrow(run, f"`{doc_id}` bigint, {_NODE}")


def _importance(pages: Column, of: Column) -> Column:
    return 1 - F.log(F.greatest(pages.cast("double"), F.lit(1.0))) / F.log(F.greatest(of.cast("double"), F.lit(2.0)))


def tree(nodes: DataFrame) -> DataFrame:
    """(host, kind, key, c, m, importance): the nodes of every host's tree, with the pages that show
    them and the host's pages. Hosts are hashes; NO_HOST holds the pages without one, whose content and labels have
    no importance of their own (1)."""
    # pages are counted per salted part of a node first, so a node on all pages of a host is no hot key
    part = F.pmod("page", F.lit(64))
    leaves = nodes.where(F.col("kind").isNotNull())
    counts = leaves.groupBy("host", "kind", "key", part.alias("part")).agg(F.count_distinct("page").alias("c")).groupBy("host", "kind", "key").agg(F.sum("c").alias("c"))
    sizes = nodes.where(F.col("line_no") == 0).groupBy("host", part.alias("part")).agg(F.count_distinct("page").alias("m")).groupBy("host").agg(F.sum("m").alias("m"))
    own = counts.where((F.col("kind") == FORM) | (F.col("c") >= LEAST_PAGES)).join(sizes, "host")
    # a form that only documents with residue show counts as shown by one page
    form = _importance(F.greatest("c", F.lit(1)) + PRIOR[0], F.greatest("m", F.lit(1)) + PRIOR[1])
    alone = F.when(F.col("host") == NO_HOST, 1.0).otherwise(_importance(F.col("c"), F.col("m")))
    return own.withColumn("importance", F.when(F.col("kind") == FORM, form).otherwise(alone))


def _weak(nodes: DataFrame) -> DataFrame:
    """(host, kind, key) of the nodes whose branches are cut."""
    limit = F.when(F.col("kind") == FORM, LOW_FORM).otherwise(LOW_IMPORTANCE)
    return tree(nodes).where(F.col("importance") <= limit).select("host", "kind", "key")


def cut_lines(docs: DataFrame, doc_id: str = "capture_id", text: str = "text", url: str = "url_canonical", every: bool = False) -> DataFrame:
    """(doc_id, line_no, by): every line in a branch of low importance and the kind of node that cut it,
    ``content``, ``label`` or ``form``, the first of these. Documents whose text holds
    residue have lines only with ``every``."""
    nodes = cut(_nodes(docs, doc_id, text, url, every))
    lines = nodes.where(F.col("kind").isNotNull()).join(_weak(nodes), ["host", "kind", "key"], "left_semi")
    first = lines.groupBy(doc_id, "line_no").agg(F.min("kind").alias("kind"))
    return first.select(doc_id, "line_no", F.element_at(F.array(F.lit("content"), F.lit("label"), F.lit("form")), F.col("kind") + 1).alias("by"))


def low_importance(docs: DataFrame, doc_id: str = "capture_id", text: str = "text", url: str = "url_canonical") -> DataFrame:
    """(doc_id, line_no) of lines in branches of low importance on their host, forms set aside.
    Documents without a host, and null or blank texts, give nothing."""
    nodes = cut(_nodes(docs, doc_id, text, url))
    weak = _weak(nodes).where(F.col("kind") != FORM)
    return nodes.where(F.col("kind").isNotNull()).join(weak, ["host", "kind", "key"], "left_semi").select(doc_id, "line_no").distinct()


def outside_body(docs: DataFrame, doc_id: str = "capture_id", text: str = "text", url: str = "url_canonical") -> DataFrame:
    """(doc_id, line_no): every line with something other than white space that is outside the main
    body, lines counted from 1. Documents whose text is residue (an error page, an unfilled template)
    have no body and are left out, as are null and blank texts. doc_id must be a whole number; a row
    that is there twice gives its lines once."""
    return cut_lines(docs, doc_id, text, url).drop("by")


def main_body(docs: DataFrame, doc_id: str = "capture_id", text: str = "text", url: str = "url_canonical") -> DataFrame:
    """``docs`` with only the main body in ``text``, also of documents that hold residue, such as an
    unfilled slot; lines are joined by line ends, blank lines at either end go. Documents without lines
    outside the body are unchanged, nulls stay null."""
    gone = cut_lines(docs, doc_id, text, url, every=True).groupBy(F.col(doc_id).alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(gone, docs[doc_id] == F.col("__id"), "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.array_contains(F.col("__gone"), (i + 1).cast("int")))
    body = F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(body)).drop("__id", "__gone")
