"""Template residue, filler, error pages and demands for scripts, found and told apart from prose.

Three character n-gram models are fitted: filler, error notices (with demands to enable scripts) and
natural prose. The first two learn from the general wordings listed below, prose from the n-grams of
every text of the table: counted per task, summed by a shuffle, a table of fixed size whatever the
corpus. Each text is scored as one long vector of log-likelihood ratios; sentences are the windows. A
window is residue if its mean ratio is high over its whole length, against prose and against a model
of the labels of normal pages: a sentence that only quotes or
discusses a notice has prose around the quotation, which pulls the mean down. Unfilled slots are a
matter of syntax, not of wording, and are found by pattern; a slot between quotation marks or
backticks is quoted. What share of a text its residue covers decides whether the record is excluded
or only cleaned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.runtime import spread

ORDER = 4  # characters of an n-gram
BITS = 18  # of the hashed n-gram tables, 1 MB each
THRESHOLD = 0.45  # mean log ratio of a window from which it is residue
UNSEEN = -0.7  # ratio, at most, of an n-gram that no notice has
STRENGTH = 12.0  # sum of log ratios a window needs
EXCLUDE_COVERAGE = 0.5

# General wordings of filler and stand-ins, the filler model's training text.
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.
Lorem ipsum
Lorem ipsum dolor sit amet
Dolor sit amet, lorem ipsum et cetera
Placeholder
Placeholder text
Placeholder content
This is a placeholder.
This is placeholder text, please replace it.
Replace this text with your own.
Replace this paragraph
Add your text here
Your text here
Your text goes here
Your title here
Your headline here
Your title goes here
Your headline goes here
Headline goes here
Title goes here
Body text goes here
Copy goes here
Description goes here
Enter your text here
Enter a title
Insert text here
Insert title here
Insert headline
Click here to edit this text
Describe your product here in a few sentences.
Write a short description of your company.
Sample text
Sample page
Example text
This is sample text. Write your own words here.
Dummy text
Dummy article, do not publish
Do not publish
Test page, not for publication
This is a test
Test test test
Test article
Hello world! This is your first post. Edit or delete it, then start writing.
Untitled
Untitled document
Untitled page
Untitled post
No title
New page
New post
New document
Draft, to be completed
Coming soon
Content coming soon
Content to follow
Text to follow
To be confirmed
To be determined
TBD
TODO: write this section
TODO: add image
FIXME: text is missing
xxx
xxxx xxxx xxxx
xxx xxx xxx
asdf
asdf asdf asdf
asdfgh jkl
qwerty
qwerty qwerty
blah blah blah
foo bar baz
The quick brown fox jumps over the lazy dog.
Blindtext
Dies ist ein Blindtext.
Hier steht ein Blindtext.
Platzhalter
Platzhaltertext
Mustertext
Beispieltext
Beispieltext, bitte ersetzen
Hier kommt Ihr Text hin
Hier Text einfügen
Überschrift hier einfügen
Titel einfügen
Ohne Titel
Unbenannt
Neue Seite
Text folgt
Texte de remplissage
Faux texte
Texte d’exemple
Texte à compléter
Texte à remplacer
Votre texte ici
Votre titre ici
Insérez votre texte ici
Insérer le titre
Sans titre
Nouvelle page
Contenu à venir
Texto de relleno
Texto de ejemplo
Texto de muestra
Reemplace este texto
Su texto aquí
Tu título aquí
Escriba aquí su texto
Inserte el título
Sin título
Nueva página
Contenido pendiente
Текст-заполнитель
Рыбный текст
Пример текста
Образец текста
Замените этот текст
Здесь будет текст
Введите текст
Вставьте заголовок
Заголовок страницы
Без названия
Без заголовка
Новая страница
Текст появится позже
""".strip().split("\n")

# General wordings of error, block and maintenance pages and of demands for scripts.
NOTICES = """
Error
Error 0
Error code 0
Error code: 0
HTTP error 0
0 Bad Request
0 Unauthorized
0 Forbidden
0 Not Found
0 Method Not Allowed
0 Request Timeout
0 Gone
0 Too Many Requests
0 Internal Server Error
0 Bad Gateway
0 Service Unavailable
0 Gateway Timeout
0 – page not found
Not found
Page not found
Page not available
File not found
The page was not found.
The page could not be found.
Sorry, the page you requested could not be found.
The page you are looking for does not exist.
The page you are looking for might have been removed, had its name changed or is temporarily unavailable.
The requested page does not exist on this server.
The requested URL was not found on this server.
The address you typed does not exist on this site.
Nothing was found at this location. Check the address or try a search.
The link you followed may be broken, or the page may have been removed.
This page does not exist. Please check the spelling of the address or return to the home page.
This article is no longer available.
This content is no longer available.
This content has been deleted or moved.
This content is not available in your country.
Sorry, this article is not available in your region.
This page is not available in your location for legal reasons.
Access denied
Access to this page has been denied.
Permission denied
Forbidden
Unauthorized
You do not have permission to access this page.
You don’t have permission to view this resource on this server.
You are not authorized to view this page.
You have been blocked.
Your address has been blocked. Reference number 0
Reference #0
Incident 0
Request id 0
You must be signed in to view this page.
Your session has expired. Please sign in again.
Your session has timed out. Log in to continue.
Bad gateway
Bad request
Gateway timeout
Service unavailable
Service temporarily unavailable
The service is temporarily unavailable. Please try again later.
The server is temporarily unable to service your request. Please try again later.
The server encountered an internal error and was unable to complete your request.
The server returned an invalid or incomplete response.
The web server reported a bad reply.
The server took too long to respond.
The connection has timed out.
The connection to the origin server timed out.
Connection refused
Connection reset
Internal server error
Application error
An error occurred while processing your request.
An unexpected error occurred.
An unhandled exception occurred.
Unhandled exception in line 0
Something went wrong.
Sorry, something went wrong on our side.
Oops! Something went wrong.
Please try again later.
Please try again in a few minutes.
Try again in 0 seconds.
Retry after 0 seconds
Too many requests
Too many requests from your address. Please wait.
Rate limit exceeded
We have detected unusual traffic from your network.
Error establishing a database connection
nginx
Apache server
Traceback (most recent call last):
File "main.py", line 0, in <module>
File "/usr/lib/python3/site.py", line 0, in run
raise ValueError
KeyError: 'name'
IndexError: list index out of range
AttributeError: object has no attribute
TypeError: cannot read properties of undefined
ReferenceError: variable is not defined
Exception in thread "main" java.lang.NullPointerException
Fatal error: Uncaught exception
Warning: Undefined variable in index.php on line 0
Notice: undefined index on line 0
Syntax error, unexpected token
Segmentation fault
Stack trace
Down for maintenance
Under maintenance
The site is under maintenance.
The site is currently down for scheduled maintenance. We will be back soon.
We are performing planned maintenance and will be back shortly.
Be right back
Just a moment...
One moment, please
Please wait
Checking your browser
Checking if the site connection is secure
Please wait while we check your browser.
Please verify that you are a human.
Are you a robot?
Confirm that you are not a robot.
We need to make sure that you are a person and not a robot.
Please solve the puzzle to continue.
Complete the security check to access the site.
Attention required
Please enable JavaScript to continue.
Please enable JavaScript to view this page.
Please enable JavaScript and cookies to continue.
Please turn on JavaScript and reload the page.
You need to enable JavaScript to run this app.
JavaScript is disabled.
JavaScript is disabled in your browser.
JavaScript is required to view this site.
JavaScript must be enabled
This site requires JavaScript.
This page needs scripts to work. Switch them on in your browser and reload.
This site needs scripts and cookies. Please turn on both.
Your browser has scripts turned off.
Your browser does not support JavaScript.
Please enable cookies in your browser.
Loading...
Loading, please wait
Redirecting...
If you are not redirected, click here.
Seite nicht gefunden
Die Seite wurde nicht gefunden.
Die angeforderte Seite existiert nicht.
Diese Adresse gibt es auf unserer Website nicht.
Die gesuchte Seite ist nicht mehr verfügbar.
Zugriff verweigert
Zugriff nicht erlaubt. Vorgangsnummer 0
Sie haben keine Berechtigung für diese Seite.
Interner Serverfehler
Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.
Dienst nicht verfügbar
Der Dienst ist vorübergehend nicht erreichbar.
Wartungsarbeiten
Wegen Wartungsarbeiten nicht erreichbar
Bitte aktivieren Sie JavaScript.
Bitte aktivieren Sie JavaScript in Ihrem Browser.
Bitte schalten Sie JavaScript ein und laden Sie die Seite neu.
Für diese Seite wird JavaScript benötigt.
Page introuvable
Page non trouvée
La page demandée n’existe pas.
Cette adresse n’existe pas sur notre site.
Cette page n’est plus disponible.
Accès refusé
Accès interdit. Référence 0
Vous n’avez pas l’autorisation d’accéder à cette page.
Erreur interne du serveur
Une erreur est survenue. Veuillez réessayer plus tard.
Service indisponible
Service temporairement indisponible
Site en maintenance
Veuillez activer JavaScript.
Veuillez activer JavaScript pour continuer.
Activez JavaScript dans votre navigateur et rechargez la page.
JavaScript est nécessaire pour afficher ce site.
Página no encontrada
No se encontró la página.
La página solicitada no existe.
Esta dirección no existe en nuestro sitio.
Esta página ya no está disponible.
Acceso denegado
Acceso prohibido. Número de referencia 0
No tiene permiso para ver esta página.
Error interno del servidor
Se ha producido un error. Inténtelo de nuevo más tarde.
Servicio no disponible
Servicio temporalmente no disponible
Sitio en mantenimiento
Active JavaScript en su navegador.
Por favor, active JavaScript para continuar.
Es necesario activar JavaScript para ver este sitio.
Страница не найдена
Запрошенная страница не существует.
Такого адреса на нашем сайте нет.
Эта страница больше недоступна.
Доступ запрещён
Доступ закрыт. Номер обращения 0
У вас нет прав на просмотр этой страницы.
Внутренняя ошибка сервера
Произошла ошибка. Повторите попытку позже.
Сервис недоступен
Сервис временно недоступен
Ведутся технические работы
Сайт на обслуживании
Включите JavaScript в браузере.
Пожалуйста, включите JavaScript, чтобы продолжить.
Для просмотра сайта нужен JavaScript.
""".strip().split("\n")

# General labels of a page's furniture, which belongs to normal pages.
FURNITURE = """
menu|main menu|navigation|home|about|about us|contact|contact us|help|faq|support|search|blog|news|products|solutions|platform|pricing|company|careers|press|resources|status|accessibility|sitemap|topics|topics a–z
sign in|sign up|sign out|log in|log out|login|register|create account|create an account|my account|subscribe|unsubscribe|newsletter|follow us|start free trial|free trial|try for free|book a demo|request a demo|contact sales|get started|learn more|download
skip to content|skip to main content|jump to content|back to top|back to overview|overview|all stories|all articles|all posts|load more|show more|view all|see all|read more|continue reading
privacy|privacy policy|terms|terms of use|terms of service|imprint|legal|legal notice|cookies|cookie policy|cookie settings|accept all|reject all|manage choices|share|print|copy link|mail|comments|leave a comment|reply|advertisement
was this page helpful?|was this article helpful?|was this helpful?|yes no|rate this article|related articles|more articles|popular articles
menü|hauptmenü|startseite|über uns|kontakt|hilfe|suche|suchen|anmelden|abmelden|einloggen|registrieren|konto|abonnieren|zum inhalt springen|nach oben|zurück zur übersicht|alle beiträge|alle artikel|mehr anzeigen|mehr lesen|weiterlesen|impressum|datenschutz|agb|cookie-einstellungen|alle annehmen|alle akzeptieren|nur notwendige|einstellungen|teilen|drucken|kommentare|anzeige|produkte|lösungen|preise|karriere|presse|themen|war diese seite hilfreich?
menu principal|accueil|à propos|nous contacter|contactez-nous|aide|recherche|rechercher|se connecter|se déconnecter|s’inscrire|mon compte|s’abonner|aller au contenu|retour en haut|tous les articles|voir plus|lire la suite|mentions légales|confidentialité|gérer mes choix|tout accepter|tout refuser|partager|imprimer|commentaires|publicité|produits|tarifs|carrières|presse|thèmes|cette page vous a-t-elle été utile ?
menú|menú principal|inicio|quiénes somos|acerca de|contacto|contáctanos|ayuda|buscar|iniciar sesión|cerrar sesión|registrarse|mi cuenta|suscribirse|saltar al contenido|volver arriba|todos los artículos|ver más|leer más|seguir leyendo|aviso legal|privacidad|configurar|aceptar todo|rechazar todo|compartir|imprimir|comentarios|publicidad|productos|precios|empleo|prensa|temas|¿te ha sido útil esta página?
меню|главная|о нас|контакты|связаться с нами|помощь|поиск|войти|выйти|регистрация|зарегистрироваться|подписаться|перейти к содержанию|наверх|все статьи|показать ещё|читать далее|читать дальше|условия|конфиденциальность|настроить|принять все|отклонить|поделиться|распечатать|комментарии|реклама|решения|цены|вакансии|пресса|темы|была ли эта страница полезной?
""".replace("\n", "|").strip("|").split("|")

# Sentences that talk about notices; they belong to prose.
DISCUSSED = """
The team rewrote its page not found message after readers had complained about the tone.
Users who saw the forbidden page called the help desk twice as often.
The old site showed an error page whenever the session expired.
Half of the visitors leave when a site tells them to enable scripts.
The designers kept the dummy text in the brochure until the last proof.
Every service unavailable answer of the gateway is written to a log and counted.
The course teaches JavaScript to clerks who had never written a script.
""".strip().split("\n")

# Plain prose and headings, so that the model of a small corpus has some background.
PLAIN = """
The first report says that the work went well and that most people found their way around the new system.
In the second year the team counted every case again and wrote down what had changed since the start.
Our readers asked how the numbers were collected, and this is the answer the office gave us.
A title about the town and its people
Report on the state of the work in the north
What the team learned from a year of trials
How one office changed the way it answers letters
Der erste Bericht sagt, dass die Arbeit gut lief und die meisten Leute sich schnell zurechtfanden.
Im zweiten Jahr zählte das Team jeden Fall noch einmal und schrieb auf, was sich geändert hatte.
Was das Amt aus einem Jahr Versuch gelernt hat
Le premier rapport dit que le travail s’est bien passé et que la plupart des gens s’y sont retrouvés.
La deuxième année, l’équipe a recompté chaque dossier et noté ce qui avait changé.
Ce que le bureau a appris d’une année d’essais
El primer informe dice que el trabajo fue bien y que la mayoría de la gente se orientó pronto.
En el segundo año el equipo contó cada caso otra vez y anotó lo que había cambiado.
Lo que la oficina aprendió de un año de pruebas
В первом отчёте говорится, что работа прошла хорошо и что большинство людей быстро освоилось.
На второй год команда снова посчитала все дела и записала, что изменилось.
Чему служба научилась за год испытаний
""".strip().split("\n")

# Slots by syntax, of any length. Those between marks of a template language may go over line ends; none
# holds its own opening mark, so a mark that is never closed is read once only.
_SLOT = regex.compile(
    r"\{\{(?:[^{}]++|\{[^{}]*+\})*+\}\}|\{%(?:[^%{]++|%(?!\})|\{(?!%))*+%\}|[$#]\{(?:[^{}]++|\{[^{}]*+\})*+\}|<%(?:[^<%]++|<(?!%)|%(?!>))*+%>|\[%(?:[^%\[]++|%(?!\])|\[(?!%))*+%\]"
    r"|%%\w{2,}+%%|@@\w{2,}+@@|__[A-Z][A-Za-z0-9]*+_\w+?__"
    r"|(?<![\w%])%[A-Z][A-Z_]{2,}+%(?![\w%])|\[object Object\]|\bundefined[^\S\n]+\|[^\S\n]|\bundefined[^\S\n]+(?:min|by|of)\b"
    r"|\[(?:insert|headline|title|subtitle|your|company|customer|client|name|product|date|author|city|quote|image|figure|text|body|lead|photo|caption|add|first|last|placeholder|tbd|todo)\b[^\[\]\n]*+\]"
    r"|(?<![\w{$#])\{\d++\}|(?<!\w)<[A-Z][A-Z_]{2,}+>"
    r"|\bXX+[^\S\n]?%|\bTBD\b|\bTK{2,}\b|(?<!\S)(?:TODO|FIXME):",
    regex.I,
)
_CASED = regex.compile(r"^(?:<[a-z_]+>|xx+\s?%|tbd|tk+|(?:todo|fixme):|%[a-z_]+%|__[a-z]\w*__|undefined.*)$")
_ERROR_SLOT = regex.compile(r"\{\{[^{}]*\}\}|\$\{[^{}]*\}|#\{[^{}]*\}|\{[A-Za-z_][\w.() ]*\}|<%.*?%>|%[sdr]\b|%[A-Z_]{3,}%|%%\w+%%|@@\w+@@|__[A-Z]+_\w+__|\{\d*\}")
_QUOTED = regex.compile(r"`[^`\n]*`|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\"|‘[^’\n]*’")
_BRAND_TAIL = regex.compile(r"\s+[|–—-]\s+\S+\s*$")


def _slots(text: str, at: int = 0) -> Iterator[tuple[int, int]]:
    """Start and end of the unfilled slots from ``at`` on that aren't quoted."""
    quoted: list[tuple[int, int]] | None = None
    begins: list[int] = []
    while m := _SLOT.search(text, at):
        at = m.start() + 1  # what isn't a slot may still hold one
        slot = m.group()
        if slot == "Todo:" or _CASED.match(slot) and slot == slot.lower() and not slot.startswith("undefined"):
            continue  # "Todo:" is a word of Spanish
        if quoted is None:
            quoted = [q.span() for q in _QUOTED.finditer(text)]
            begins = [a for a, _ in quoted]
        if all((k := bisect_left(begins, place)) and place < quoted[k - 1][1] for place in m.span()):
            continue  # the slot, or each of its marks
        if slot[0] == "[" and "object" not in slot and text[m.end() : m.end() + 1] == "(":
            continue  # a link
        yield m.span()


def has_slot(text: str) -> bool:
    """Whether the text holds an unfilled slot that isn't quoted."""
    return next(_slots(text), None) is not None


def _folded(text: str) -> str:
    """Lower case (only where the length stays) and white space as plain spaces and line ends."""
    low = text.lower()
    return low if len(low) == len(text) else text


# Digits count as 0, white space as a space; characters beyond the first plane keep their number.
_FOLD = np.arange(1 << 16, dtype=np.uint32)
_FOLD[48:58] = 48
_FOLD[[9, 10, 160]] = 32


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hashed n-grams starting at every place."""
    if len(codes) < ORDER:
        return np.zeros(0, np.int64)
    c = np.where(codes < 1 << 16, _FOLD[codes & 0xFFFF], codes).astype(np.uint32) if codes.max() >> 16 else _FOLD[codes]
    n = len(c) - ORDER + 1
    h = np.zeros(n, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            h *= np.uint32(0x9E3779B1)
            h += c[k : n + k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def _array(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _table(texts: Iterable[str], weight: float = 1.0) -> np.ndarray:
    counts = np.zeros(1 << BITS, np.float64)
    for t in texts:
        np.add.at(counts, _hashes(_array(f" {_folded(t)} ")), weight)
    return counts


def _runs(values: list[str | None]) -> np.ndarray:
    """Characters of the texts one after another, each begun and ended by a line end."""
    whole = "\n" + "\n".join(v for v in values if v) + "\n"
    return _array(_folded(whole) if whole.isascii() else "\n" + "\n".join(_folded(v) for v in values if v) + "\n")


def count_ngrams(docs: DataFrame, *columns: str) -> np.ndarray:
    """Counts by hashed n-gram over the whole texts of all documents. Each task sums its own and sends
    at most 2**BITS numbers, as many as there are in the end; null and empty values have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for column in batch.columns:
                for at in range(0, batch.num_rows, 256):
                    values = [v for v in column.slice(at, 256).to_pylist() if v]
                    grams = _hashes(_runs(values))
                    own = np.ones(len(grams), bool)  # not over the line end between two texts
                    ends = np.cumsum([len(v) + 1 for v in values[:-1]], dtype=np.int64)
                    for k in range(1, ORDER - 1):
                        own[ends - k] = False
                    counts += np.bincount(grams[own], minlength=1 << BITS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["gram", "n"])

    table = docs.select(*columns).mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS, np.float64)
    out[table.column("gram").to_numpy()] = table.column("n").to_numpy()
    return out


def fit(prose: list[str] | np.ndarray) -> np.ndarray:
    """Log-likelihood ratios (filler or notice against prose) by hashed n-gram, as float32. ``prose`` is
    texts or the counts of their n-grams."""
    counts = prose if isinstance(prose, np.ndarray) else _table(prose)
    counts = counts + _table(PLAIN) + _table(DISCUSSED, max(4.0, counts.sum() / 50_000))
    total = counts.sum()

    labels = _table(FURNITURE)
    prose_p = (counts + 0.25) / (max(total, 100_000) + 0.25 * (1 << BITS))
    prose_p = np.maximum(prose_p, labels / (labels.sum() + 0.02 * (1 << BITS)))

    def ratio(seeds: list[str]) -> np.ndarray:
        seen = _table(seeds) + _table([t.replace("0", "000") for t in seeds if "0" in t])
        seen_p = (seen + 0.02) / (seen.sum() + 0.02 * (1 << BITS))
        ratio = np.log(seen_p) - np.log(prose_p)
        ratio[seen == 0] = np.minimum(ratio[seen == 0], UNSEEN)  # what the notices never say is no evidence for them
        return ratio

    return np.maximum(ratio(FILLER), ratio(NOTICES)).astype(np.float32)


def windows(texts: list[str | None], ratios: np.ndarray, threshold: float | None = None) -> list[tuple[int, int, int, float]]:
    """(text, start, end, mean ratio) of the sentence windows whose mean reaches the threshold. All
    texts are scored in one pass: they lie one after another, each begun and ended by a line end."""
    limit = THRESHOLD if threshold is None else threshold
    kept = [(i, t) for i, t in enumerate(texts) if t]
    if not kept:
        return []
    codes = _runs([t for _, t in kept])
    starts = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for _, t in kept])])[:-1]
    h = _hashes(codes)
    space = (codes == 32) | (codes == 10) | (codes == 9) | (codes == 160)
    stop = (codes == 46) | (codes == 33) | (codes == 63) | (codes == 0x2026)
    ends = np.zeros(len(codes), bool)  # a window ends with this character
    ends[:-1] = (codes[:-1] == 10) | (codes[:-1] == 124) | (stop[:-1] & space[1:])
    ends[-1] = True
    begin = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    finish = np.flatnonzero(ends) + 1
    # a window's n-grams start at the character before it and end inside it
    first = np.minimum(np.maximum(begin - 1, 0), len(h))
    last = np.minimum(np.maximum(finish - ORDER + 1, first), len(h))
    sums = np.concatenate([[0.0], np.cumsum(ratios[h], dtype=np.float64)])
    count = np.maximum(last - first, 1)
    total = sums[last] - sums[first]
    mean = total / count
    hit = np.flatnonzero((mean >= limit) & (total >= STRENGTH))
    which = np.searchsorted(starts, begin[hit], side="right") - 1
    return [(kept[w][0], int(begin[k] - starts[w]), int(finish[k] - starts[w]), float(mean[k])) for w, k in zip(which, hit) if w >= 0]


# Marks without one of which no text has a slot: as they are, in lower case, and a pattern for percents.
_MAYBE = ("{", "[", "<", "%%", "@@", "__")
_MAYBE_WORDS = ("undefined", "tbd", "tkk", "todo:", "fixme:")
_MAYBE_PERCENT = regex.compile(r"%\p{L}|x\s?%", regex.I)


def _may_have_slot(text: str) -> bool:
    if any(m in text for m in _MAYBE) or "%" in text and _MAYBE_PERCENT.search(text):
        return True
    low = text.lower()
    return any(m in low for m in _MAYBE_WORDS)


# Titles that stand for an error page by its code alone.
_CODE_TITLE = regex.compile(r"^\s*(?:error|http|fehler|erreur|ошибка)?\s*:?\s*[45]\d\d(?:\s+[\p{L}’' ]{2,30})?\s*[.!]?\s*$", regex.I)


def slot_spans(text: str) -> list[tuple[int, int]]:
    """Lines of the text that hold an unfilled slot; one over several lines has a span over all of them."""
    spans: list[tuple[int, int]] = []
    if not _may_have_slot(text):
        return spans
    for start, end in _slots(text):
        if not spans or start >= spans[-1][1]:
            stop = text.find("\n", end)
            spans.append((text.rfind("\n", 0, start) + 1, stop if stop >= 0 else len(text)))
    return spans


def title_head(value: str) -> str:
    """The title without a site's name behind a bar or dash."""
    return _BRAND_TAIL.sub("", value)


def residue(docs: DataFrame, doc_id: str = "capture_id", text: str = "text", title: str = "title", error: str = "error") -> DataFrame:
    """(doc_id, field, coverage): each field that is or holds residue, with the share of its
    characters inside residue windows. In ``error`` only unfilled slots count. Null, empty and blank
    values hold none; repeated rows are reported as often as they stand."""
    docs = spread(docs.select(doc_id, text, title, error))
    model = docs.sparkSession.sparkContext.broadcast(fit(count_ngrams(docs, text)))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                yield one(whole.slice(at, 256), ratios)

    def one(batch: pa.RecordBatch, ratios: np.ndarray) -> pa.RecordBatch:
        keys, texts, titles, errors = (batch.column(i).to_pylist() for i in range(4))
        spans: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for i, a, b, _ in windows(texts, ratios):
            spans.setdefault((i, "text"), []).append((a, b))
        for i, t in enumerate(texts):
            if t and (found := slot_spans(t)):
                spans.setdefault((i, "text"), []).extend(found)
        heads = [title_head(t) if t else None for t in titles]
        covered: dict[int, int] = {}
        for i, a, b, _ in windows(heads, ratios):
            covered[i] = covered.get(i, 0) + b - a
        for i, n in covered.items():
            # a title is one window: only one that is residue nearly from end to end counts
            if n >= 0.6 * len(heads[i].strip()):
                spans[i, "title"] = [(0, len(titles[i]))]
        for i, t in enumerate(titles):
            if t and (slot_spans(t) or _CODE_TITLE.match(title_head(t))):
                spans[i, "title"] = [(0, len(t))]
        for i, e in enumerate(errors):
            if e and _ERROR_SLOT.search(e):
                spans[i, "error"] = [(0, len(e))]
        values = {"text": texts, "title": titles, "error": errors}
        found = sorted(spans.items())
        ids = [keys[i] for (i, _), _ in found]
        fields = [f for (_, f), _ in found]
        shares = [min(1.0, _covered(sorted(s)) / len(values[f][i])) for (i, f), s in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, type=batch.column(0).type), pa.array(fields, type=pa.string()), pa.array(shares, type=pa.float64())],
            names=[doc_id, "field", "coverage"],
        )

    return docs.mapInArrow(run, f"`{doc_id}` {kind}, field string, coverage double")


def _covered(spans: list[tuple[int, int]]) -> int:
    total, last = 0, 0
    for a, b in spans:
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


def exclude(docs: DataFrame, found: DataFrame, doc_id: str = "capture_id", coverage: float = EXCLUDE_COVERAGE) -> DataFrame:
    """``docs`` without those whose text is residue over at least ``coverage`` of its length."""
    gone = found.where((F.col("field") == "text") & (F.col("coverage") >= coverage)).select(F.col(doc_id).alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
