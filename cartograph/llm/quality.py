"""Line-first quality rules (operator 4), with DataFrame functions only.

Every line is judged alone, by punctuation, navigation and boilerplate rules;
lines that fail are removed; a document that loses too many of its words is
rejected.  Everything is computed within the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WS, text_or_empty

MIN_WORDS = 50
#: Percent of words in repeated three-word windows above which a document fails.
MOST_REPEATED = 50
#: Share of its words that a document may lose with the lines removed.
MOST_LOST = 0.3
#: A line is heavy with symbols, or a menu, when so large a share of its words holds one.
SYMBOL_SHARE = 0.2
#: A line of so many words needs no closing punctuation, and may hold words of menus and notices up to a share of all.
LONG_LINE = 30
PHRASE_SHARE = 0.2

# Fixed values of the line rules.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>\u00bb\u203a\u2022\u00b7/\u2192"
CLOSED = "[.!?\u2026\u3002:;][\"'\u201d\u2019\u00bb)\\]]*[ \\t-\\r]*\\z"
MENUS = (
    "home|menu|log ?in|log ?out|sign (?:in|up)|register|search|next|previous|back to top|read more|show more|share(?: this)?|subscribe|skip to content|contact us|about us|site ?map|print|tweet|follow us",
    "startseite|men\u00fc|anmelden|abmelden|registrieren|suchen?|weiter|zur\u00fcck|nach oben|mehr lesen|weiterlesen|mehr anzeigen|teilen|abonnieren|kontakt|\u00fcber uns|impressum|drucken",
    "accueil|connexion|d\u00e9connexion|inscription|rechercher|suivant|pr\u00e9c\u00e9dent|haut de page|lire la suite|voir plus|partager|s.abonner|contact|\u00e0 propos|plan du site|imprimer",
    "inicio|iniciar sesi\u00f3n|cerrar sesi\u00f3n|registrarse|buscar|siguiente|anterior|volver arriba|leer m\u00e1s|ver m\u00e1s|compartir|suscribirse|contacto|qui\u00e9nes somos|mapa del sitio|imprimir",
)
NOTICES = (
    "all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|(?:uses?|accept) cookies|enable javascript|lorem ipsum|copyright (?:\\(c\\)|\u00a9|[0-9]{4})|powered by [A-Za-z0-9_]+|page not found",
    "alle rechte vorbehalten|nutzungsbedingungen|datenschutzerkl\u00e4rung|cookie-richtlinie|verwendet cookies|javascript aktivieren|seite nicht gefunden",
    "tous droits r\u00e9serv\u00e9s|conditions d.utilisation|politique de confidentialit\u00e9|utilise des cookies|activer javascript|page introuvable",
    "todos los derechos reservados|condiciones de uso|pol\u00edtica de privacidad|(?:utiliza|usa) cookies|activar javascript|p\u00e1gina no encontrada",
)
MENU = f"^[^A-Za-z0-9_\u00c0-\u024f]*(?:{'|'.join(MENUS)})[^A-Za-z0-9_\u00c0-\u024f]*\\z"
BOILERPLATE = "|".join(NOTICES)
CASELESS = "(?iu)"
#: A letter or digit of a phrase's words; anything else stands between words.
LETTER = "A-Za-z0-9_\u00c0-\u024f"


def _by_first_letter(phrases: str) -> str:
    """The same alternatives, those that begin with one letter together, so that most words fail at once."""
    parts, depth, start = [], 0, 0
    for k, c in enumerate(phrases + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(phrases[start:k])
            start = k + 1
    groups: dict[str, list[str]] = {}
    for x in parts:
        first = x[0] if x[0].isalpha() and x[1:2] not in ("?", "*", "+") else ""
        groups.setdefault(first, []).append(x[len(first) :])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


PHRASES = "|".join((*MENUS, *NOTICES)).lower()
#: A phrase of a lower-cased line between spaces, with what stands before it.
PHRASE = f"[^{LETTER}](?:{_by_first_letter(PHRASES.replace('[a-za-z0-9_]', '[a-z0-9_]'))})(?=[^{LETTER}])"


def _line(x: Column) -> Column:
    """Words of a line, and whether it stays."""
    words = F.regexp_count(x, F.lit(WORD))
    plain = F.length(F.translate(x, SYMBOLS + "{}" + SEPARATORS, "")) == F.length(x)  # most lines: no symbol, no separator
    symbols = F.regexp_count(x, F.lit("[^ \\t-\\r]*[#*$%&|<>{}][^ \\t-\\r]*"))
    lone = F.regexp_count(x, F.lit(f"(?<![^ \\t-\\r])[{SEPARATORS}]+(?![^ \\t-\\r])"))
    heavy = (symbols > SYMBOL_SHARE * words) | (lone > SYMBOL_SHARE * words)
    found = F.regexp_extract_all(F.concat(F.lit(" "), F.lower(x), F.lit(" ")), F.lit(PHRASE), F.lit(0))
    phrases = F.regexp_count(F.array_join(found, ""), F.lit(f"[{LETTER}]+"))
    short = F.when(words < LONG_LINE, x.rlike(CLOSED) & ~x.rlike(CASELESS + MENU) & ~x.rlike(CASELESS + BOILERPLATE)).otherwise(phrases <= PHRASE_SHARE * words)
    return F.struct(words.alias("n"), (short & (plain | ~heavy)).alias("stays"))


def measured(docs: DataFrame, least_bits: int = 1) -> DataFrame:
    """docs with the base measures and __lines (words, stays), one row a document; keys of windows spend least_bits or more on the place."""
    text = text_or_empty()
    rows = docs.withColumn("__text", text)
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumn("__parts", lines)
    rows = rows.withColumn("__words", F.filter(F.split("__text", "[ \\t-\\r]+"), lambda x: x != ""))
    rows = rows.withColumn("__h", F.transform("__words", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("n_words", F.size("__h").cast("long"))
    rows = rows.withColumn("word_chars", F.length(F.translate("__text", WS, "")).cast("long"))
    rows = rows.withColumn("n_symbols", (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"))
    rows = rows.withColumn("n_dup_lines", (F.size("__parts") - F.size(F.array_distinct("__parts"))).cast("long"))
    # windows as hash << bits | position: sorted, equal windows are neighbours
    rows = rows.withColumn("__bits", F.greatest(F.length(F.bin("n_words")), F.lit(least_bits)))
    at = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.size("__h") - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__at", at)
    key = lambda i: F.call_function("shiftleft", F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2)), F.col("__bits")).bitwiseOR(i.cast("long"))
    rows = rows.withColumn("__sorted", F.sort_array(F.transform("__at", lambda i: F.coalesce(key(i), F.lit(0).cast("long")))))
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1
    window = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    near = lambda x, i: F.coalesce(window(x) == window(F.get("__sorted", i)), F.lit(False))
    word = lambda x, k: F.get("__words", (x.bitwiseAND(place) + k).cast("int"))
    differ = lambda x, y: (word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2))
    # the key keeps part of the hash, so neighbours are compared word by word; if any of one key differ, the windows themselves are sorted
    mixed = F.size(F.filter("__sorted", lambda x, i: near(x, i - 1) & differ(x, F.get("__sorted", i - 1)))) > 0
    rows = rows.withColumn("__mixed", mixed)
    quick = F.transform(F.filter("__sorted", lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x.bitwiseAND(place))
    whole = F.sort_array(F.transform("__at", lambda i: F.struct(F.array(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)).alias("w"), i.cast("long").alias("at"))))
    rows = rows.withColumn("__whole", F.when(F.col("__mixed"), whole))
    same = lambda x, i: F.coalesce(x["w"] == F.get("__whole", i)["w"], F.lit(False))
    sure = F.transform(F.filter("__whole", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"])
    rows = rows.withColumn("__twice", F.sort_array(F.when(F.col("__mixed"), sure).otherwise(quick)))
    # each repeated window covers three words; those that overlap count once
    covered = F.aggregate("__twice", F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n")), lambda s: s["n"])
    rows = rows.withColumn("n_repeat_words", covered)
    rows = rows.withColumn("__lines", F.transform("__parts", _line))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return rows.drop("__words", "__h", "__bits", "__at", "__sorted", "__mixed", "__whole", "__twice")


def line_quality(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """docs with the base measures, kept_words, kept and clean_text (the lines that stay).

    Null texts have no words and fail the base rule; repeated rows are judged
    each, alike; input columns with the names of the results are replaced; an
    empty table gives no rows.
    """
    rows = measured(docs)
    rows = rows.withColumn("kept_words", F.aggregate("__lines", F.lit(0).cast("long"), lambda s, x: s + F.when(x["stays"], x["n"]).otherwise(0)))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("kept_words") <= most_lost * F.col("n_words")))
    rows = rows.withColumn("clean_text", F.array_join(F.transform(F.filter(F.arrays_zip("__parts", "__lines"), lambda x: x["__lines"]["stays"]), lambda x: x["__parts"]), "\n"))
    return rows.drop("__text", "__parts", "__lines")
