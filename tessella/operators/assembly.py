"""Putting documents together from ordered parts, and cutting them apart again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as T

from .structure import chunk_numbers, is_section_header, ordered, pack

# The canonical sections of a document, their order and their names.
ORDER = ("teoria", "procedimiento", "tabla", "ejemplo_resuelto", "ejercicio_propuesto", "resumen")
NAMES = {
    "es": {"teoria": "Contenido teórico", "ejemplo_resuelto": "Ejemplos resueltos", "ejercicio_propuesto": "Ejercicios propuestos", "tabla": "Tablas de referencia", "procedimiento": "Procedimientos", "resumen": "Resumen"},
    "en": {"teoria": "Theory", "ejemplo_resuelto": "Solved examples", "ejercicio_propuesto": "Practice problems", "tabla": "Reference tables", "procedimiento": "Procedures", "resumen": "Summary"},
}


def doc_metadata(items: DataFrame, doc: str) -> DataFrame:
    """items(doc, pos, kind, title, lang) -> doc, kind (mixto for several), title (the first), lang (the commonest, ties to the one seen
    first; es for any but es and en)."""
    langs = items.filter("lang is not null").groupBy(doc, "lang").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    common = langs.groupBy(doc).agg(F.max_by("lang", F.struct("n", (-F.col("first")).alias("f"))).alias("lang"))
    kinds = items.groupBy(doc).agg(F.when(F.count_distinct("kind") > 1, "mixto").otherwise(F.coalesce(F.max("kind"), F.lit("mixto"))).alias("kind"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("pos"))).alias("title"))
    both = kinds.join(common.hint("shuffle_merge"), doc, "left")
    return both.select(doc, "kind", F.coalesce("title", F.lit("No detectado")).alias("title"), F.when(F.col("lang").isin("es", "en"), F.col("lang")).otherwise("es").alias("lang"))


def clean_item_headings(lines: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """lines without headings of level 1 and canonical ones of level 2; other ones of level 2 become level 3."""
    canonical = F.col("line").startswith("## ") & (F.substring("line", 4, 1000).isin(*without) if without else F.lit(False))
    kept = lines.filter(~F.col("line").startswith("# ") & ~canonical)
    return kept.withColumn("line", F.when(F.col("line").startswith("## "), F.concat(F.lit("#"), "line")).otherwise(F.col("line")))


def assemble_sections(items: DataFrame, metadata: DataFrame, doc: str) -> DataFrame:
    """items(doc, pos, kind, body), doc_metadata -> doc, markdown: front matter, title, and one section a kind in canonical order, with
    mixed bodies among the theory."""
    kind = F.when(F.col("kind") == "mixto", "teoria").otherwise(F.col("kind"))
    bodies = items.filter(F.trim("body") != "").select(doc, "pos", kind.alias("kind"), F.trim("body").alias("body")).groupBy(doc, "kind").agg(ordered("pos", "body", "\n\n").alias("body"))
    place = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(ORDER)], F.lit(len(ORDER)))
    m = metadata.select(doc, "title", "lang", F.col("kind").alias("doc_kind"))
    name = F.coalesce(*[F.when((F.col("lang") == lang) & (F.col("kind") == k), v) for lang, names in NAMES.items() for k, v in names.items()], F.when(F.col("lang") == "en", "Content").otherwise("Contenido"))
    parts = bodies.join(m.select(doc, "lang").hint("shuffle_merge"), doc).select(doc, place.alias("place"), F.concat(F.lit("## "), name, F.lit("\n\n"), "body").alias("part"))
    whole = parts.groupBy(doc).agg(ordered("place", "part", "\n\n---\n").alias("sections"))
    front = F.concat(F.lit("---\narchivo_origen: "), F.col(doc).cast("string"), F.lit("\ntipo_documento: "), "doc_kind", F.lit("\ntema_detectado: "), "title", F.lit("\nidioma: "), "lang", F.lit("\n---"))
    head = F.when(F.col("title") != "No detectado", F.concat(F.lit("# "), "title"))
    return m.join(whole.hint("shuffle_merge"), doc, "left").select(doc, F.concat_ws("\n\n", front, head, "sections").alias("markdown"))


def remove_empty_sections(lines: DataFrame, doc: str) -> DataFrame:
    """lines without the sections of level 2 that have no line but blanks and separators."""
    by = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    head = F.col("line").startswith("## ")
    real = ~head & ~F.trim("line").isin("", "---")
    marked = lines.withColumn("section", F.sum(head.cast("int")).over(by)).withColumn("real", F.max(real.cast("int")).over(W.partitionBy(doc, "section")))
    return marked.filter((F.col("section") == 0) | (F.col("real") == 1)).drop("section", "real")


def front_matter_field(c: Column, field: str) -> Column:
    """The value of a field in the block between the first two --- lines; null without."""
    inner = F.regexp_extract(c, r"(?s)^---\n(.*?)\n---", 1)
    return F.nullif(F.regexp_extract(inner, rf"(?m)^{field}:\s*(.*)$", 1), F.lit(""))


def without_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^---\n.*?\n---\n*", "")


def write_subblocks(parts: DataFrame, doc: str) -> DataFrame:
    """parts(doc, ord, name, state, body) -> doc, markdown with each part between marks that carry its attributes."""
    body = F.when(F.trim(F.coalesce("body", F.lit(""))) == "", "_Pendiente de generar._").otherwise(F.col("body"))
    one = F.concat(F.lit("<!-- SUBBLOQUE_INICIO orden="), "ord", F.lit(' estado="'), "state", F.lit('" nombre="'), "name", F.lit('" -->\n'), body, F.lit("\n<!-- SUBBLOQUE_FIN -->"))
    return parts.groupBy(doc).agg(ordered("ord", one, "\n\n").alias("markdown"))


SUBBLOCK = r'(?s)<!-- SUBBLOQUE_INICIO orden=(\d+) estado="([^"]*)" nombre="([^"]*)" -->\n(.*?)\n<!-- SUBBLOQUE_FIN -->'


def read_subblocks(docs: DataFrame, doc: str, text: str = "markdown") -> DataFrame:
    """doc, ord, state, name, body of the marked parts."""
    whole = docs.select(doc, F.explode(F.regexp_extract_all(text, F.lit(f"({SUBBLOCK})"), 1)).alias("part"))
    return whole.select(doc, F.regexp_extract("part", SUBBLOCK, 1).cast("int").alias("ord"), F.regexp_extract("part", SUBBLOCK, 2).alias("state"), F.regexp_extract("part", SUBBLOCK, 3).alias("name"), F.regexp_extract("part", SUBBLOCK, 4).alias("body"))


def interpolate_starts(anchors: DataFrame, doc: str) -> DataFrame:
    """anchors(doc, ord, start, length) with missing starts put evenly between their neighbours, the text's begin and its end."""
    by = W.partitionBy(doc).orderBy("ord")
    back, ahead = by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(0, W.unboundedFollowing)
    known = F.col("start").isNotNull()
    a = anchors.withColumns({"lo": F.coalesce(F.last("start", True).over(back), F.lit(0)), "lo_ord": F.coalesce(F.last(F.when(known, F.col("ord")), True).over(back), F.lit(-1)), "hi": F.coalesce(F.first("start", True).over(ahead), F.col("length")), "n": F.count("*").over(W.partitionBy(doc))})
    a = a.withColumn("hi_ord", F.coalesce(F.first(F.when(known, F.col("ord")), True).over(ahead), F.col("n")))
    guess = F.floor(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("ord") - F.col("lo_ord")) / (F.col("hi_ord") - F.col("lo_ord")))
    return a.withColumn("start", F.when(known, F.col("start")).otherwise(guess)).select(doc, "ord", "start", "length")


def split_by_anchors(starts: DataFrame, doc: str) -> DataFrame:
    """doc, ord, begin, end: fragments from each start to the next, the first from the text's begin, the last to its end."""
    by = W.partitionBy(doc).orderBy("ord")
    begin = F.when(F.row_number().over(by) == 1, F.lit(0)).otherwise(F.col("start"))
    return starts.select(doc, "ord", begin.cast("long").alias("begin"), F.coalesce(F.lead("start").over(by), "length").cast("long").alias("end"))


def interleave(bodies: DataFrame, inserts: DataFrame, doc: str, text: str = "body") -> DataFrame:
    """bodies(doc, text), inserts(doc, pos, offset, piece) -> doc, text: pieces put in at their offsets, which are kept within the text and
    never go back."""
    size = F.length(text)
    by = W.partitionBy(doc).orderBy("pos")
    j = inserts.join(bodies.select(doc, F.col(text).alias("__t"), size.alias("__n")).hint("shuffle_merge"), doc).withColumn("at", F.greatest(F.lit(0), F.least("offset", "__n")))
    j = j.withColumn("at", F.max("at").over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.coalesce(F.lag("at").over(by), F.lit(0)))
    chunk = F.concat(F.expr("substring(__t, before + 1, at - before)"), "piece")
    made = j.groupBy(doc).agg(ordered("pos", chunk, "").alias("head"), F.max("at").alias("upto"))
    both = bodies.join(made.hint("shuffle_merge"), doc, "left")
    return both.select(doc, F.when(F.col("head").isNull(), F.col(text)).otherwise(F.concat("head", F.expr(f"substring({text}, upto + 1)"))).alias("text"))


SENTENCE_END = re.compile(r'[.!?]["\')]*(?:\s|$)')
TABLE_LINES = re.compile(r"(?m)(?:^[^\S\n]*\|[^\n]*(?:\n|\Z))+")


def cut_oversized(text: str, most: int, hard: int, ahead: int = 300) -> list[str]:
    """A long text in parts of about most characters. A part ends after its last newline, or else at most; if that falls into
    the lines of a table, after the table, and if into a sentence, after this one when it ends within ahead characters; neither
    makes a part longer than hard."""
    tables = [m.span() for m in TABLE_LINES.finditer(text)]
    parts, at, k = [], 0, 0
    while at < len(text):
        cut = at + most
        if cut < len(text):
            cut = text.rfind("\n", at, cut) + 1 or cut
            while k < len(tables) and tables[k][1] <= cut:
                k += 1
            if k < len(tables) and tables[k][0] < cut and tables[k][1] - at <= hard:
                cut = tables[k][1]
            if cut < len(text) and text[cut - 1] != "\n" and not text[max(at, cut - 10) : cut].rstrip().endswith((".", "!", "?")):
                m = SENTENCE_END.search(text, cut, min(len(text), cut + ahead, at + hard))
                cut = m.end() if m else cut
        if part := text[at:cut].strip():
            parts.append(part)
        at = cut
    return parts


def cut_section(text: str, header: str | None, most: int, hard: int, repeat: bool = True) -> list[str]:
    """A section that is too long in parts of whole paragraphs, each under the section's header; too long paragraphs are cut."""
    body, room = (text.partition("\n")[2], max(400, most - len(header) - 1)) if header else (text, most)
    paragraphs = [x for p in map(str.strip, body.split("\n\n")) if p for x in ([p] if len(p) <= room else cut_oversized(p, room, hard))]
    none = [False] * len(paragraphs)
    chunks: list[list[str]] = []
    for p, c in zip(paragraphs, chunk_numbers([len(p) for p in paragraphs], none, none, room, room), strict=True):
        if c == len(chunks):
            chunks.append([])
        chunks[c].append(p)
    parts = ["\n\n".join(c) for c in chunks]
    return [f"{header}\n{p}" if header and (repeat or not k) else p for k, p in enumerate(parts)] or [header or ""]


def split_oversized(paragraphs: DataFrame, doc: str, *, most: int, hard: int | None = None) -> DataFrame:
    """paragraphs(doc, no, text) -> doc, no, part_no, text: only those longer than most pass through Python, a row at a time."""
    kind = paragraphs.schema[doc].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, n, k, p) for d, n, t in zip(b[doc], b["no"], b["text"], strict=True) for k, p in enumerate(cut_oversized(t, most, hard or 2 * most))]
            yield pd.DataFrame(rows, columns=[doc, "no", "part_no", "text"])

    long_ = paragraphs.filter(F.length("text") > most).select(doc, F.col("no").cast("long").alias("no"), "text").mapInPandas(cut, f"{doc} {kind}, no long, part_no long, text string")
    rest = paragraphs.filter(F.length("text") <= most).select(doc, F.col("no").cast("long").alias("no"), F.lit(0).cast("long").alias("part_no"), "text")
    return rest.unionByName(long_)


def chunk_documents(lines: DataFrame, doc: str, *, target_tokens: int = 1500, ratio: int = 4, flush: int = 500, repeat: bool = True) -> DataFrame:
    """lines(doc, line_no, line) -> doc, chunk_no, chunk.

    Sections begin at headers and are packed in order up to max(1000, target_tokens * ratio) characters; a section with a header
    begins a new chunk once the one at hand has flush characters. A section that is too long is cut by paragraphs, and shares its
    chunks with no other; its header stands above each part (with repeat; else above the first). A document without headers is
    packed by paragraphs. Documents without text give no chunk."""
    most, hard = max(1000, target_tokens * ratio), 2 * target_tokens * ratio
    kind = lines.schema[doc].dataType.simpleString()
    by = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("head", is_section_header(F.trim("line"))).withColumn("no", F.sum(F.col("head").cast("long")).over(by))
    text = T.stripped(ordered("line_no", "line"))
    sections = marked.groupBy(doc, "no").agg(F.max(F.when(F.col("head"), F.trim("line"))).alias("header"), text.alias("text")).filter("text <> ''")
    several = sections.groupBy(doc).agg((F.max("no") > 0).alias("several"))
    known = sections.join(several.hint("shuffle_merge"), doc)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, n, k, p, h is not None, True) for d, n, h, t in zip(b[doc], b["no"], b["header"], b["text"], strict=True) for k, p in enumerate(cut_section(t, h, most, hard, repeat))]
            yield pd.DataFrame(rows, columns=[doc, "no", "part_no", "text", "head", "alone"])

    short = known.filter(F.col("several") & (F.length("text") <= most)).select(doc, "no", F.lit(0).cast("long").alias("part_no"), "text", F.col("header").isNotNull().alias("head"), F.lit(False).alias("alone"))
    long_ = known.filter(F.col("several") & (F.length("text") > most)).select(doc, "no", "header", "text").mapInPandas(cut, f"{doc} {kind}, no long, part_no long, text string, head boolean, alone boolean")
    plain = known.filter("not several").select(doc, F.posexplode(F.split("text", "\n\n")).alias("no", "text")).withColumn("text", T.stripped(F.col("text"))).filter("text <> ''")
    paragraphs = split_oversized(plain, doc, most=most, hard=hard).select(doc, "no", "part_no", "text", F.lit(False).alias("head"), F.lit(False).alias("alone"))
    return pack(short.unionByName(long_).unionByName(paragraphs), doc, most=most, flush=flush)


def extract_figures(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """doc, pos, figure: the different [FIGURA: ...] marks of a document, ignoring case; the first form stays."""
    f = docs.select(doc, F.posexplode(F.regexp_extract_all(text, F.lit(r"\[FIGURA:\s*([^\]]*)\]"), 1)).alias("pos", "figure"))
    return f.withColumn("r", F.row_number().over(W.partitionBy(doc, F.lower("figure")).orderBy("pos"))).filter("r = 1").drop("r")


def math_spans(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """doc, pos, span, kind: displayed formulas as valid, prose (several words) or invalid (no sign of mathematics)."""
    s = docs.select(doc, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)\$\$(.*?)\$\$"), 1)).alias("pos", "span"))
    bare = F.regexp_replace("span", r"\\[a-zA-Z]+|\\text\{[^}]*\}", " ")
    long_words = F.size(F.regexp_extract_all(bare, F.lit(r"([A-Za-zÀ-ÿ]{4,})"), 1))
    return s.withColumn("kind", F.when(long_words >= 3, "prose").when(F.col("span").rlike(r"[=+\-*/^_\\<>]"), "valid").otherwise("invalid"))


def variable_glossary(lines: DataFrame, doc: str) -> DataFrame:
    """doc, symbol, description: from Markdown tables of symbols, before 'donde X es ...' clauses; of several the first."""
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|\s*|\s*\|$", ""), r"\s*\|\s*"), lambda x: F.trim(x))
    rows = lines.filter(F.col("line").startswith("|") & ~F.col("line").rlike(r"^\|[\s:|-]+\|$")).withColumn("cells", cells).filter(F.size("cells") >= 2)
    table = rows.filter(~F.lower(F.element_at("cells", 1)).rlike("^(s[ií]mbolo|symbol|variable)")).select(doc, F.lit(0).alias("from"), "line_no", F.regexp_replace(F.element_at("cells", 1), r"\$", "").alias("symbol"), F.element_at("cells", 2).alias("description"))
    clause = r"(?i)\b(?:donde|where)\s+\$?([A-Za-z](?:_\w+)?)\$?\s+(?:es|is)\s+([^.,;]+)"
    where = lines.filter(F.col("line").rlike(clause)).select(doc, F.lit(1).alias("from"), "line_no", F.regexp_extract("line", clause, 1).alias("symbol"), F.trim(F.regexp_extract("line", clause, 2)).alias("description"))
    best = table.unionByName(where).filter("symbol <> '' and description <> ''").withColumn("r", F.row_number().over(W.partitionBy(doc, "symbol").orderBy("from", "line_no"))).filter("r = 1")
    return best.select(doc, "symbol", "description")


def place_equations(elements: DataFrame, sections: DataFrame, doc: str) -> DataFrame:
    """elements(doc, element, heading, expression), sections(doc, section_no, title, body) -> doc, element, section_no: the section that holds the
    expression, one with the element's heading first; else the last."""
    # Catalyst makes lower(upper(x)) lower(x), so the one letter whose upper case is two is folded by itself.
    folded = lambda c: F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    s = sections.select(doc, "section_no", folded("title").alias("t"), "body")
    j = elements.join(s.hint("shuffle_merge"), doc).withColumn("has", F.col("body").contains(F.col("expression"))).withColumn("named", F.col("has") & (F.col("t") == folded(F.coalesce("heading", F.lit("")))))
    place = F.when(F.col("has"), F.col("section_no")).otherwise(-F.col("section_no"))
    return j.withColumn("r", F.row_number().over(W.partitionBy(doc, "element").orderBy(F.desc("has"), F.desc("named"), place))).filter("r = 1").select(doc, "element", "section_no")


def assemble_multiple(docs: DataFrame, group: str, order: str, name: str, text: str = "markdown") -> DataFrame:
    """group, markdown: documents in order under one front matter, the first one's, with '## name' before each further one."""
    by = W.partitionBy(group).orderBy(order)
    first = F.row_number().over(by) == 1
    part = F.when(first, F.col(text)).otherwise(F.concat(F.lit("## "), F.col(name), F.lit("\n\n"), without_front_matter(F.col(text))))
    return docs.withColumn("__part", part).groupBy(group).agg(ordered(order, "__part", "\n\n---\n\n").alias("markdown"))
