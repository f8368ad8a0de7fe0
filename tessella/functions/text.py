"""Column expressions on strings: normal forms, keys, tokens and line predicates. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with accents and their plain forms.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝŸ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCYY"

# Patterns that tell kinds of lines apart.
MARKER = r"^\s*\[(?:PAGINA|SLIDE)\s+\d+\]\s*\z"
HEADING = r"^#{1,4}\s+\S"
EQUATION_MARKER = r"^\[(?:ECUACION_PARCIAL|ECUACION_NO_EXTRAIBLE|TEXTO_ILEGIBLE)(?![\p{L}\p{N}_])"
# A number and a unit end where letters and digits of any alphabet do (what \b means differs between engines and versions of Java);
# units ignore the case of A to Z, and the Kelvin sign is a K. A percent sign counts only before a letter or digit.
UNIT = r"(?i)(?=\d)(?<![\p{L}\p{N}_])\d+(?:[.,]\d+)?\s*(?:%(?=[\p{L}\p{N}_])|(?:[k\u212AMGT]?W|[k\u212AMGT]?Pa|bar|psi|[k\u212A]g|g|mg|m|cm|mm|[k\u212A]m|s|min|h|Hz|N|J|V|A|[k\u212A]|C)(?![\p{L}\p{N}_]))"
TECHNICAL = r"\t|\||\$|(?i:\\frac|\\int|\\sum)|=\s*\S"
PAGE_NUMBER = r"^\s*\d+\s*$"
FILLER = r"^\s*[-–—=_\.·•]{3,}\s*$"
URL_ONLY = r"(?i)^\s*https?://\S+\s*$"
SLIDE_META = r"(?i)^\s*(?:Slide|Diapositiva)\s+\d+\s*$"
DIGIT_LETTER = r"(?i)(?:\d+\s*[a-záéíóúñ]|[a-záéíóúñ]+\s*\d+)"
WORD = r"[A-Za-zÀ-ÿ0-9]+"


def stripped(c: Column | str) -> Column:
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def unaccented(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def normalize_for_matching(c: Column) -> Column:
    """Lower case without accents, all but letters, digits and space as space, single spaces."""
    # One class of letters and no alternatives: three times as fast as leaving single spaces as they are.
    return F.trim(F.regexp_replace(F.lower(unaccented(c)), r"[^a-z0-9]+", " "))


def letters_and_digits(c: Column) -> Column:
    """The normal form without its spaces."""
    return F.regexp_replace(F.lower(unaccented(c)), r"[^a-z0-9]+", "")


def without_bullet(c: Column) -> Column:
    return stripped(F.regexp_replace(stripped(c), r"^[•▪●\-–*·]\s*", ""))


def title_key(c: Column) -> Column:
    """Lower case without accents, all but a-z, digits and spaces as space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(unaccented(c)), r"[^a-z0-9 ]", " "))


def topic_key(c: Column) -> Column:
    """The normal form of a topic without its leading section number."""
    bare = F.regexp_replace(stripped(c), r"^\d+(\.\d+)*\.?\s*", "")
    return normalize_for_matching(bare)


def slugify(c: Column, default: str = "elemento") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(unaccented(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def significant_tokens(c: Column, least: int = 3, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct words of the normal form with least letters or more, in order of first occurrence, without pure numbers and
    stopwords."""
    tokens = F.filter(F.split(normalize_for_matching(c), " "), lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$"))
    return F.array_except(F.array_distinct(tokens), F.array(*map(F.lit, stopwords))) if stopwords else F.array_distinct(tokens)


# Markers that cleaning and extraction leave in a text.
STRUCTURE_MARKER = r"(?i)\[(?:PAGINA|SLIDE)\s+\d+\]|\[TEXTO_ILEGIBLE\]|\[FIGURA[^\]]*\]|\[ECUACION_PARCIAL:[^\]]*\]|\[ECUACION_NO_EXTRAIBLE\]|\[ECUACION_RECONSTRUIDA:[^\]]*\]"
TERM = r"[\wÀ-ÿ]+"  # \w (ASCII) takes a sixth of the time of its ranges written out
# Words that are no key terms of a text, and no words of a topic.
TERM_STOPWORDS = (
    "para", "entre", "desde", "hasta", "sobre", "como", "donde", "cuando", "porque", "segun", "esto", "esta", "estas", "estos", "tambien", "puede", "pueden", "deber", "deben", "tener", "tiene",
    "their", "with", "from", "that", "this", "pagina", "slide",
)
TOPIC_STOPWORDS = ("de", "la", "el", "los", "las", "y", "en", "del", "al", "un", "una", "por", "con")


def term_norms(c: Column) -> Column:
    """The normal forms of a text's words, in order, with repeats: of whole runs of letters, digits and underscores, so that a
    letter without a plain form is a space inside its word. One pass over the text."""
    whole = F.coalesce(c, F.lit(""))
    bare = F.when(F.contains(whole, F.lit("[")), F.regexp_replace(whole, STRUCTURE_MARKER, " ")).otherwise(whole)
    apart = F.regexp_replace(bare, rf"[^{TERM[1:-2]}]+", "\n")
    plain = F.regexp_replace(F.lower(F.translate(apart, ACCENTED + "_", PLAIN + " ")), r"[^\w\n]+", " ")  # no capitals are left
    return F.transform(F.split(plain, "\n"), lambda t: F.trim(t))


def topic_tokens(c: Column) -> Column:
    """The words of a topic's normal form with more than two letters that are no stopwords, with repeats."""
    return F.filter(F.split(normalize_for_matching(c), " "), lambda t: (F.length(t) > 2) & ~t.isin(*TOPIC_STOPWORDS))


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def is_technical(line: Column) -> Column:
    return line.rlike(TECHNICAL) | line.rlike(UNIT)


def is_marker(line: Column) -> Column:
    return line.rlike(MARKER)


def is_equation_marker(line: Column) -> Column:
    return line.rlike(EQUATION_MARKER)


def keeps_from_frequency(line: Column) -> Column:
    """Lines that repetition alone does not condemn: headings, markers, digits beside letters, more than three different words,
    or punctuation."""
    several = F.size(F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(f"({WORD})"), 1), F.lower))) > 3
    return is_heading(line) | is_equation_marker(line) | line.rlike(DIGIT_LETTER) | several | line.rlike(r"[:,;()]")


def is_glyph_soup(line: Column) -> Column:
    """Lines all of whose tokens have one or two letters."""
    tokens = F.split(stripped(line), r"\s+")
    return (line != "") & ~is_heading(line) & ~is_equation_marker(line) & ~line.rlike(r"[=$#|]") & ~is_technical(line) & F.forall(tokens, lambda t: F.length(t) <= 2)
