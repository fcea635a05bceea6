"""Line-first quality rules.

Every line is judged alone (punctuation, navigation, boilerplate); failing lines go, and a
document that loses more than a share of its words is rejected. Whole-text counts come with it.

Defined cases: null text counts as a text without words, its cleaned text is null and it is not
kept; an empty text stays empty and is not kept; blank lines are neither judged nor counted as
lost; a very long text is judged whole, in the memory of a few of its copies; repeated rows are judged each on their own; an empty table gives an empty table; further
input columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, keyed

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
TERMINAL = ".!?:;\"')]}…”’»。！？"
NAV_SEPARATORS = frozenset(["|", ">", "»", "›", "·", "•", "/"])
#: Lines of navigation and phrases of boilerplate, by language; QualityRules takes others.
NAV_LINES = {
    "en": (
        "home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back",
        "contact", "contact us", "about", "about us", "sitemap", "skip to content", "read more", "share", "top",
    ),
    "de": (
        "startseite", "menü", "suche", "suchen", "anmelden", "abmelden", "registrieren", "weiter", "zurück",
        "kontakt", "über uns", "impressum", "datenschutz", "seitenübersicht", "zum inhalt", "zum inhalt springen",
        "mehr lesen", "weiterlesen", "teilen", "nach oben",
    ),
    "fr": (
        "accueil", "menu", "recherche", "rechercher", "connexion", "se connecter", "s'inscrire", "suivant",
        "précédent", "retour", "contact", "contactez-nous", "à propos", "À propos", "plan du site", "aller au contenu",
        "lire la suite", "en savoir plus", "partager", "haut de page", "mentions légales",
    ),
    "es": (
        "inicio", "menú", "buscar", "búsqueda", "iniciar sesión", "acceder", "registrarse", "siguiente", "anterior",
        "volver", "contacto", "contáctenos", "acerca de", "sobre nosotros", "mapa del sitio", "ir al contenido",
        "leer más", "seguir leyendo", "compartir", "arriba",
    ),
}
BOILERPLATE = {
    "en": (
        "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies",
        "enable javascript", "lorem ipsum", "subscribe to our", "click here", "licensed under", "copyright (c)", "©",
    ),
    "de": (
        "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookie-richtlinie", "verwendet cookies",
        "javascript aktivieren", "newsletter abonnieren", "klicken sie hier", "lizenziert unter",
    ),
    "fr": (
        "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies",
        "activer javascript", "abonnez-vous à", "cliquez ici", "sous licence",
    ),
    "es": (
        "todos los derechos reservados", "política de privacidad", "condiciones de uso", "términos de uso",
        "utiliza cookies", "active javascript", "suscríbase a", "haga clic aquí", "bajo licencia",
    ),
}


def every(lists: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The phrases of all languages, each once."""
    return tuple(dict.fromkeys(x for words in lists.values() for x in words))


@dataclass(frozen=True)
class QualityRules:
    """min_words, max_repeat_percent: whole-text limits. long_line_words: a line of so many words
    may end without punctuation. nav_words: the longest navigation line. max_lost_percent: share of
    words a document may lose with its lines. nav_lines, boilerplate: phrases as they look with A-Z
    lowered; a line is navigation if it is such a phrase, boilerplate if it holds one. A document's
    language isn't asked: the lists hold those of all languages that the corpus may have."""

    min_words: int = 50
    max_repeat_percent: int = 50
    long_line_words: int = 20
    nav_words: int = 8
    max_lost_percent: int = 50
    nav_lines: tuple[str, ...] = every(NAV_LINES)
    boilerplate: tuple[str, ...] = every(BOILERPLATE)


def line_fault(line: str, rules: QualityRules) -> str | None:
    """Why a line is removed: 'boilerplate', 'navigation' or 'punctuation'; None: it stays."""
    words = line.encode("utf-8", "surrogatepass").split()
    if not words:
        return None
    low = line.translate(_LOWER).strip(SPACES)
    if any(x in low for x in rules.boilerplate):
        return "boilerplate"
    if len(words) <= rules.nav_words:
        if low in rules.nav_lines or sum(w.decode("utf-8", "replace") in NAV_SEPARATORS for w in words) >= 2:
            return "navigation"
    if len(words) < rules.long_line_words and low[-1] not in TERMINAL:
        return "punctuation"
    return None


_LOWER = {c: c + 32 for c in range(65, 91)}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set[tuple] = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    total, covered = 0, 0  # covered: first word not yet counted
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def judge(text: str | None, rules: QualityRules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines,
    n_removed_lines, lost_words, cleaned text."""
    if text is None:
        return 0, 0, 0, 0, 0, True, False, 0, 0, 0, None
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words)
    seen: set[str] = set()
    stay: list[str] = []
    dup = lines = removed = lost = 0
    for line in text.split("\n"):
        size = len(line.encode("utf-8", "surrogatepass").split())
        if size:
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
            if line_fault(line, rules):
                removed += 1
                lost += size
                continue
        stay.append(line)
    failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    kept = not failed and 100 * lost <= rules.max_lost_percent * n
    return n, word_chars, symbols, dup, repeats, failed, kept, lines, removed, lost, "\n".join(stay)


FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines bigint, n_removed_lines bigint, lost_words bigint"
)


def apply_quality_rules(
    docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """One row per input row: doc_id, the counts, the verdict and (with_text) the cleaned text.

    A pass over rows without any shuffle; a task holds one Arrow batch.
    """
    src = keyed(docs, doc_id=id_col, text=text_col)
    id_type = src.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(ids: list, texts: list):
        for i, t in zip(ids, texts, strict=True):
            got = judge(t, rules)
            yield (i, *got) if with_text else (i, *got[:-1])

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema(
        [("doc_id", to_arrow_type(src.schema["doc_id"].dataType)), *zip(names, kinds, strict=True)]
        + [("cleaned", pa.string())] * with_text
    )
    return arrow_rows(src, run, schema, f"doc_id {id_type}, {FIELDS}" + ", cleaned string" * with_text)
