"""Structure of texts: headings, sections, styles, topic candidates, chunks, languages and routes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as T
from tessella.sources import stored


def ordered(by: str, value: Column | str, separator: str = "\n") -> Column:
    """An aggregate: the values joined in the order of by."""
    value = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), value.alias("v")))), lambda s: s["v"]), separator)


def headings(lines: DataFrame, doc: str, *, lowest: int = 4, without: tuple[str, ...] = ()) -> DataFrame:
    """doc, line_no, level, text, norm: Markdown headings down to a level, without those of the given normal forms."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    found = lines.filter(F.col("line").startswith("#")).withColumn("level", level).filter((F.col("level") > 0) & (F.col("level") <= lowest))
    found = found.withColumn("text", F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)).withColumn("norm", T.normalize_for_matching(F.col("text")))
    return found.filter(~F.col("norm").isin(*without)).select(doc, "line_no", "level", "text", "norm") if without else found.select(doc, "line_no", "level", "text", "norm")


def split_h2_sections(lines: DataFrame, doc: str, *, opening: str = "Introducción") -> DataFrame:
    """doc, section_no, title, body: texts between headings of level 2; what stands before the first one, without its level 1
    headings, is the opening section if it is not blank."""
    is_h2 = F.col("line").startswith("## ")
    numbered = lines.withColumn("section_no", F.sum(is_h2.cast("int")).over(W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))
    shown = numbered.filter(~is_h2 & ~((F.col("section_no") == 0) & F.col("line").startswith("# ")))
    bodies = shown.groupBy(doc, "section_no").agg(T.stripped(ordered("line_no", "line")).alias("body"))
    titles = numbered.filter(is_h2).select(doc, "section_no", F.trim(F.expr("substring(line, 4)")).alias("title"))
    both = titles.join(bodies.hint("shuffle_merge"), [doc, "section_no"], "full")
    return both.select(doc, "section_no", F.coalesce("title", F.lit(opening)).alias("title"), F.coalesce("body", F.lit("")).alias("body")).filter((F.col("section_no") > 0) | (F.col("body") != ""))


# Words that begin a section.
SECTION_KEYWORDS = (
    "Chapter", "Section", "Topic", "Tema", "Capitulo", "Capítulo", "Seccion", "Sección", "Introduccion", "Introducción", "Introduction", "Summary", "Resumen",
    "Ejercicios", "Exercises", "Problems", "Ejemplos", "Examples",
)
_KEYWORD = "(?i)^(" + "|".join(SECTION_KEYWORDS) + ")"


def is_section_header(line: Column) -> Column:
    """Numbered, Markdown, keyword or upper-case lines."""
    upper = (F.length(line) > 4) & (F.length(line) < 80) & (line == F.upper(line)) & ~line.contains("=") & ~line.rlike(r"^\[(?:PAGINA|SLIDE)\s+\d+\]")
    return (line != "") & (line.rlike(r"^\d+(?:\.\d+)*\.?\s+\S") | line.rlike(r"^#{1,6}\s+.*[a-zA-Z]{2,}") | line.rlike(_KEYWORD) | upper & ~line.rlike(r"^#{1,6}\s"))


def split_semantic_sections(lines: DataFrame, doc: str) -> DataFrame:
    """doc, section_no (0: before the first header), header, n_lines, chars: nothing for documents without a header."""
    header = is_section_header(F.col("line"))
    by = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("header", header).withColumn("section_no", F.sum(F.col("header").cast("int")).over(by))
    sections = marked.groupBy(doc, "section_no").agg(F.max(F.when(F.col("header"), F.col("line"))).alias("header"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))
    return sections.withColumn("most", F.max("section_no").over(W.partitionBy(doc))).filter("most > 0").drop("most")


def section_nav(sections: DataFrame, doc: str, order: str, title: str) -> DataFrame:
    """sections with previous and next title and an ordinal label."""
    by = W.partitionBy(doc).orderBy(order)
    label = F.concat(F.row_number().over(by), F.lit(" / "), F.count("*").over(W.partitionBy(doc)))
    return sections.select(doc, order, F.lag(title).over(by).alias("previous"), F.lead(title).over(by).alias("next"), label.alias("label"))


def disambiguate_labels(df: DataFrame, doc: str, title: str, order: list[str]) -> DataFrame:
    """The n-th repetition of a title gets ' (n)'."""
    n = F.row_number().over(W.partitionBy(doc, title).orderBy(*order))
    return df.withColumn("label", F.when(n > 1, F.concat(F.col(title), F.lit(" ("), n, F.lit(")"))).otherwise(F.col(title)))


def detect_slide_like(lines: DataFrame, doc: str, *, least: int = 35, share: float = 0.32, few: int = 3) -> DataFrame:
    """doc, n_lines, n_short, slide_like: many lines that are not blank, and a share of them of few words."""
    words = F.size(F.split("line", r"\s+"))
    counts = lines.filter("line <> ''").groupBy(doc).agg(F.count("*").alias("n_lines"), F.count(F.when(words <= few, 1)).alias("n_short"))
    return counts.withColumn("slide_like", (F.col("n_lines") >= least) & (F.col("n_short") >= F.col("n_lines") * share))


def body_style(words: DataFrame, doc: str, *, smallest: float = 7.0, math: str = "(?i)math|symbol") -> DataFrame:
    """doc, font, size: the commonest style of words(doc, page, top, x0, font, size, text), sizes rounded to halves; ties go to
    the one seen first."""
    seen = words.withColumn("size", F.bround(F.col("size") * 2) / 2).filter((F.col("size") >= smallest) & ~F.col("font").rlike(math))
    counts = seen.groupBy(doc, "font", "size").agg(F.count("*").alias("n"), F.min(F.struct("page", "top", "x0")).alias("first"))
    return counts.withColumn("r", F.row_number().over(W.partitionBy(doc).orderBy(F.desc("n"), "first"))).filter("r = 1").select(doc, "font", "size")


def group_words_into_lines(words: DataFrame, doc: str) -> DataFrame:
    """doc, page, y, line: words with the same rounded height, from left to right."""
    return words.groupBy(doc, "page", F.bround("top").alias("y")).agg(*_placed()).select(doc, "page", "y", _joined(F.col("xs"), F.col("texts")).alias("line"))


def _placed(shown: Column | None = None) -> list[Column]:
    """Aggregates xs and texts: the left edges and texts of the words shown, one beside the other. Two lists are shuffled with
    fewer bytes than one of structs."""
    shown = F.col("text").isNotNull() if shown is None else shown
    return [F.collect_list(F.when(shown, F.coalesce(F.col("x0").cast("double"), F.lit(float("-inf"))))).alias("xs"), F.collect_list(F.when(shown, F.col("text"))).alias("texts")]


def _joined(xs: Column, texts: Column) -> Column:
    """The texts from left to right."""
    return F.array_join(F.transform(F.array_sort(F.zip_with(xs, texts, lambda x, t: F.struct(x.alias("x"), t.alias("t")))), lambda s: s["t"]), " ")


def style_runs(words: DataFrame, doc: str, y: Column, shown: Column | None = None) -> DataFrame:
    """doc, page, y, font, size, n, first (left edge), place, xs, texts: the words of one style in a line. All that is asked about
    styles and lines comes from this table, which is written out, so that words are made and shuffled once."""
    at = F.min(F.struct("page", "top", "x0")).alias("place")
    return stored(words.withColumn("y", y).groupBy(doc, "page", "y", "font", "size").agg(F.count("*").alias("n"), F.min("x0").alias("first"), at, *_placed(shown)))


def _body_of(runs: DataFrame, doc: str, *, smallest: float = 7.0, math: str = "(?i)math|symbol") -> DataFrame:
    """body_style of style_runs whose sizes are rounded."""
    seen = runs.filter((F.col("size") >= smallest) & ~F.col("font").rlike(math))
    counts = seen.groupBy(doc, "font", "size").agg(F.sum("n").alias("n"), F.min("place").alias("first"))
    return counts.withColumn("r", F.row_number().over(W.partitionBy(doc).orderBy(F.desc("n"), "first"))).filter("r = 1").select(doc, "font", "size")


def _lines_of_runs(runs: DataFrame, doc: str) -> DataFrame:
    """doc, page, y, line of style_runs."""
    whole = runs.groupBy(doc, "page", "y").agg(F.flatten(F.collect_list("xs")).alias("xs"), F.flatten(F.collect_list("texts")).alias("texts"))
    return whole.select(doc, "page", "y", _joined(F.col("xs"), F.col("texts")).alias("line"))


def heading_prefix(words: DataFrame, doc: str, *, dominant: float = 0.7) -> DataFrame:
    """doc, page, y, prefix: '#', '##' or '###' for lines whose dominant style differs from the body's and is larger, or bold."""
    return _prefixes(style_runs(words.withColumn("size", F.bround(F.col("size") * 2) / 2), doc, F.bround("top")), doc, dominant=dominant)


def _prefixes(runs: DataFrame, doc: str, *, dominant: float = 0.7) -> DataFrame:
    """heading_prefix of style_runs."""
    line = W.partitionBy(doc, "page", "y")
    top = runs.withColumn("all", F.sum("n").over(line)).withColumn("r", F.row_number().over(line.orderBy(F.desc("n"), "first"))).filter((F.col("r") == 1) & (F.col("n") >= F.col("all") * dominant))
    body = _body_of(runs, doc).select(doc, F.col("font").alias("body_font"), F.col("size").alias("body_size"))
    ratio = F.col("size") / F.col("body_size")
    other = (F.col("font") != F.col("body_font")) | (F.col("size") != F.col("body_size"))
    prefix = F.when(ratio >= 1.45, "#").when(ratio >= 1.2, "##").when(F.col("font").rlike("(?i)bold") & (ratio >= 0.9), "###")
    return top.join(body.hint("shuffle_merge"), doc).withColumn("prefix", F.when(other, prefix)).filter("prefix is not null").select(doc, "page", "y", "prefix")


def slide_titles(shapes: DataFrame, doc: str, slide: str, *, longest: int = 100) -> DataFrame:
    """doc, slide, title: of each slide the title placeholder, else the first short text of one line; once a document by key."""
    fits = F.col("is_title") | ((F.length("text") <= longest) & ~F.col("text").contains("\n"))
    able = shapes.filter(fits & (F.trim("text") != "")).withColumn("r", F.row_number().over(W.partitionBy(doc, slide).orderBy(F.desc("is_title"), "shape_no"))).filter("r = 1")
    keyed = able.withColumn("key", T.topic_key(F.col("text")))
    return keyed.withColumn("k", F.row_number().over(W.partitionBy(doc, "key").orderBy(slide))).filter("k = 1").select(doc, slide, F.col("text").alias("title"))


# Names of administrative sections, openings of prose, words a title does not end with.
ADMIN_PREFIXES = (
    "identificacion de la asignatura", "competencias y resultados de aprendizaje", "metodologia y plan de trabajo", "evaluacion del aprendizaje", "recursos bibliografia",
    "distribucion de los contenidos",
)
ADMIN_EXACT = (
    "contenidos", "contextualizacion", "requisitos", "competencias", "metodologia", "evaluacion", "recursos", "bibliografia", "presenciales", "no presenciales",
    "clases expositivas", "practicas de aula", "practicas de aula seminarios", "practicas de laboratorio", "practicas de laboratorio campo", "tutorias grupales",
    "sesiones de evaluacion", "trabajo autonomo", "trabajo en grupo", "exposicion de trabajos realizados en grupo", "evaluacion continua",
    "evaluacion extraordinaria", "evaluacion diferenciada",
)
PROSE_OPENINGS = (
    "ademas", "asimismo", "por tanto", "por lo tanto", "sin embargo", "no obstante", "es decir", "de acuerdo", "por ejemplo", "en consecuencia", "por consiguiente",
    "entonces", "asi pues", "de hecho", "en este caso", "con ello", "con lo que", "de esta forma", "de esta manera", "de este modo", "por ultimo", "finalmente",
    "en resumen", "en definitiva", "a continuacion",
)
FUNCTION_WORDS = ("de", "del", "la", "el", "los", "las", "y", "o", "en", "a", "con", "por", "para", "que", "su", "sus", "un", "una", "al")


# Titles of a course's own parts, and what is on a page but no topic.
COURSE_PART = r"^(tema|bloque|unidad|chapter|topic|module)\s+\d+"
VISUAL_NOISE = ("contexto", "temario", "indice", "index", "outline", "tipos", "types", "ejemplos de aplicaciones", "liquidos", "newtonianos")


def valid_topic(name: Column) -> Column:
    """Could the line be the title of a topic?"""
    # As variables of a function the name and its key are made once a row and not once a rule.
    return F.exists(F.array(T.without_bullet(name)), lambda name: F.exists(F.array(T.topic_key(name)), lambda norm: _valid_topic(name, norm)))


def _valid_topic(name: Column, norm: Column) -> Column:
    tokens = F.split(norm, " ")
    numbers = F.size(F.filter(tokens, lambda t: t.rlike("[0-9]")))
    admin = norm.isin(*ADMIN_EXACT) | norm.rlike("^(" + "|".join(ADMIN_PREFIXES) + ")")
    prose = norm.rlike("^(" + "|".join(PROSE_OPENINGS) + ")( |$)")
    noise = norm.rlike(COURSE_PART) | norm.isin(*VISUAL_NOISE) | norm.startswith("contexto")
    cut = (F.length(norm) <= 80) & F.element_at(tokens, -1).isin(*FUNCTION_WORDS)
    return (F.length(norm) >= 4) & ~admin & ~prose & ~noise & ~F.replace(norm, F.lit(" "), F.lit("")).rlike(r"^[0-9]+$") & ~(name.contains("/") & (F.length(norm) < 12)) & (numbers < 3) & ~cut


NUMBERED = r"^([1-9]\d*(?:\.\d+)+)\.?\s+(\S.*)$"


def numbered_candidates(lines: DataFrame, doc: str) -> DataFrame:
    """doc, line_no, prefix, name, evidence: lines 'N.M Title'. Of equal titles the first stays, then of equal numbers the
    longest title, at the place of the first."""
    found = lines.filter(F.col("line").rlike(NUMBERED)).withColumn("prefix", F.regexp_extract("line", NUMBERED, 1)).withColumn("name", F.trim(F.regexp_extract("line", NUMBERED, 2))).filter("prefix <> ''")
    good = found.filter(~F.col("name").rlike("^[a-záéíóúñ]") & ~F.col("name").rlike(r"(?i)^(figura|tabla|ecuaci[oó]n|figure|table)\b") & valid_topic(F.col("name"))).withColumn("key", T.topic_key(F.col("name")))
    good = good.repartition(doc)  # both windows then need no further shuffle
    once = good.withColumn("r", F.row_number().over(W.partitionBy(doc, "key").orderBy("line_no"))).filter("r = 1")
    longest = once.withColumn("r", F.row_number().over(W.partitionBy(doc, "prefix").orderBy(F.desc(F.length("name")), "line_no"))).withColumn("at", F.min("line_no").over(W.partitionBy(doc, "prefix"))).filter("r = 1")
    return longest.select(doc, F.col("at").alias("line_no"), "prefix", "name", F.concat(F.lit("Sección "), F.col("prefix")).alias("evidence"))


def numbering_quality(lines: DataFrame, doc: str) -> DataFrame:
    """doc, raw, accepted: numbered lines, and those that become candidates."""
    raw = lines.groupBy(doc).agg(F.count(F.when(F.col("line").rlike(NUMBERED), 1)).alias("raw"))
    return raw.join(numbered_candidates(lines, doc).groupBy(doc).agg(F.count("*").alias("accepted")).hint("shuffle_merge"), doc, "left").na.fill(0, ["accepted"])


def candidate_cascade(candidates: DataFrame, doc: str, *, enough: int = 2) -> DataFrame:
    """candidates(doc, strategy, priority, pos, name): numbered ones alone where there are enough; else all strategies by
    priority, each key once."""
    counted = candidates.withColumn("numbered", F.count(F.when(F.col("priority") == 0, 1)).over(W.partitionBy(doc)))
    left = counted.filter((F.col("numbered") < enough) | (F.col("priority") == 0)).withColumn("key", T.topic_key(F.col("name"))).filter("key <> ''")
    return left.withColumn("r", F.row_number().over(W.partitionBy(doc, "key").orderBy("priority", "pos"))).filter("r = 1").select(doc, "strategy", "pos", "name")


def topic_sets_disjoint(a: Column, b: Column) -> Column:
    """Both sides have topics, and none in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def guide_first_merge(guide: DataFrame, material: DataFrame, block: str) -> DataFrame:
    """Blocks with topics of their own keep them; the others take those of their material."""
    own = guide.withColumn("origin", F.lit("Guía docente"))
    other = material.join(guide.select(block).distinct(), block, "left_anti").withColumn("origin", F.lit("Detectado"))
    return own.unionByName(other)


def chunk_numbers(lengths: list[int], heads: list[bool], alone: list[bool], most: int, flush: int) -> list[int]:
    """The chunk of each of some parts in order: parts go together, with two characters between, up to most characters; a part
    with a head begins a chunk once the one at hand has flush characters; one that is alone shares its chunk with none."""
    out, chunk, size = [], -1, None  # size: of the chunk at hand, None if it is closed
    for n, head, single in zip(lengths, heads, alone, strict=True):
        if single or size is None or head and size >= flush or size + 2 + n > most:
            chunk, size = chunk + 1, None if single else n
        else:
            size += 2 + n
        out.append(chunk)
    return out


def pack(parts: DataFrame, doc: str, *, most: int, flush: int) -> DataFrame:
    """parts(doc, no, part_no, text, head, alone) -> doc, chunk_no, chunk. Only the parts' lengths of one document meet in Python, in
    one value; texts are joined by Spark."""

    @F.pandas_udf("array<int>")
    def numbers(sizes: pd.Series) -> pd.Series:
        return pd.Series([chunk_numbers([x["n"] for x in s], [x["head"] for x in s], [x["alone"] for x in s], most, flush) for s in sizes])

    rows = F.struct("no", "part_no", F.length("text").alias("n"), "head", "alone", "text")
    by_doc = parts.groupBy(doc).agg(F.array_sort(F.collect_list(rows)).alias("parts"))  # of one document
    sizes = F.transform("parts", lambda x: F.struct(x["n"].alias("n"), x["head"].alias("head"), x["alone"].alias("alone")))
    placed = by_doc.withColumn("chunks", numbers(sizes)).select(doc, F.posexplode(F.arrays_zip("parts", "chunks")).alias("at", "x"))
    return placed.groupBy(doc, F.col("x.chunks").alias("chunk_no")).agg(ordered("at", F.col("x.parts.text"), "\n\n").alias("chunk"))


def pack_paragraphs(docs: DataFrame, doc: str, paragraphs: str, *, most: int) -> DataFrame:
    """doc, chunk_no, chunk: paragraphs packed in order while they fit, with a blank line between."""
    each = docs.select(doc, F.posexplode(paragraphs).alias("no", "text")).filter(F.trim("text") != "")
    return pack(each.select(doc, "no", F.lit(0).alias("part_no"), "text", F.lit(False).alias("head"), F.lit(False).alias("alone")), doc, most=most, flush=most)


def chunk_stats(chunks: DataFrame, doc: str) -> DataFrame:
    size = F.length("chunk")
    return chunks.groupBy(doc).agg(F.count("*").alias("n"), F.round(F.avg(size), 3).alias("mean_size"), F.min(size).alias("least"), F.max(size).alias("most"))


# Mathematical symbols, and patterns of equations.
MATH_SYMBOLS = "∫∑∂∇×·√ΔΩαβγδεζηθλμνξπρστφχψω=<>≤≥±"
EQUATION_SIGNS = ("d/dt", "d²", "∫", "Σ")


def math_density(c: Column) -> Column:
    return (F.length(c) - F.length(F.translate(c, MATH_SYMBOLS, ""))) / F.greatest(F.length(c), F.lit(1))


def route(c: Column, *, least: int = 200, density: float = 0.02) -> Column:
    """'smart' for texts that are long enough and dense in mathematics, else 'fast'."""
    signs = F.exists(F.array(*map(F.lit, EQUATION_SIGNS)), lambda s: c.contains(s))
    return F.when((F.length(c) >= least) & ((math_density(c) > density) | signs), "smart").otherwise("fast")


# Words that vote for a language.
SPANISH = ("de", "la", "el", "y", "en", "los", "las", "para", "con", "una", "un", "por", "del", "que", "tema", "teoria", "horas", "bloque", "subtema")
ENGLISH = ("the", "and", "of", "to", "in", "for", "with", "is", "are", "on", "from", "this", "that", "topic", "theory", "hours", "block", "section", "subtopic")


def detect_language(docs: DataFrame, group: str, text: str = "text", *, head: int = 500, share: float = 0.60) -> DataFrame:
    """group, es, en, language: votes of the first characters of each text; english if its share is larger than share."""
    tokens = F.regexp_extract_all(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, head)), F.lit("([a-zA-Záéíóúñü]+)"), 1)
    votes = docs.select(group, F.size(F.filter(tokens, lambda t: t.isin(*SPANISH))).alias("es"), F.size(F.filter(tokens, lambda t: t.isin(*ENGLISH))).alias("en"))
    sums = votes.groupBy(group).agg(F.sum("es").alias("es"), F.sum("en").alias("en"))
    return sums.withColumn("language", F.when(F.col("en") > share * (F.col("es") + F.col("en")), "english").otherwise("spanish"))


def tagged(c: Column, tag: str) -> Column:
    """The text between <tag> and </tag>, or after an unclosed one; null if there is none."""
    closed = F.regexp_extract(c, rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1)
    return F.when(c.rlike(rf"(?is)<{tag}>.*</{tag}>"), closed).when(c.rlike(rf"(?is)<{tag}>"), F.regexp_extract(c, rf"(?is)<{tag}>\s*(.*)$", 1))


def keyword_rule(c: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first rule one of whose keywords occurs in the text."""
    out = None
    for name, words in rules:
        met = F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(c).contains(w))
        out = F.when(met, name) if out is None else out.when(met, name)
    return out.otherwise(default)


def combine_history(turns: DataFrame, conversation: str, order: str, text: str) -> DataFrame:
    """conversation, instruction: the turns in order, the last one marked as the one that counts."""
    got = turns.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("t"))
    earlier = F.transform(F.slice("t", 1, F.size("t") - 1), lambda s: F.concat(F.lit("- "), s[text]))
    return got.select(conversation, F.array_join(F.concat(earlier, F.array(F.concat(F.lit("PRIORIDAD: "), F.element_at("t", -1)[text]))), "\n").alias("instruction"))


def index_page_topics(lines: DataFrame, doc: str, *, keyword: str = r"(?iu)^(?:[ií]ndice|contenidos?|index|outline)\b", least: int = 2) -> DataFrame:
    """lines(doc, page, line_no, is_title, line) -> doc, page, ord, name: of the first page whose first title is an index keyword, the valid
    topics in the lines below it, if there are enough."""
    first = lines.filter("is_title").groupBy(doc, "page").agg(F.min("line_no").alias("at"), F.min_by("line", "line_no").alias("title")).filter(F.col("title").rlike(keyword))
    below = lines.join(first.select(doc, "page", "at").hint("shuffle_merge"), [doc, "page"]).filter((F.col("line_no") > F.col("at")) & valid_topic(F.col("line"))).withColumn("key", T.topic_key(F.col("line")))
    once = below.withColumn("r", F.row_number().over(W.partitionBy(doc, "page", "key").orderBy("line_no"))).filter("r = 1").withColumn("n", F.count("*").over(W.partitionBy(doc, "page"))).filter(F.col("n") >= least)
    page = once.groupBy(doc).agg(F.min("page").alias("page"))
    return once.join(page.hint("shuffle_merge"), [doc, "page"]).select(doc, "page", F.row_number().over(W.partitionBy(doc).orderBy("line_no")).alias("ord"), F.col("line").alias("name"))


def visual_titles(words: DataFrame, doc: str) -> DataFrame:
    """doc, status, n_titles: titles found by their style, each key once and without noise; documents without styled words, without titles, or
    with them are sin_metadatos, sin_titulos and ok."""
    runs = style_runs(words.withColumn("size", F.bround(F.col("size") * 2) / 2), doc, F.bround("top"))
    titles = _lines_of_runs(runs, doc).join(_prefixes(runs, doc).hint("shuffle_merge"), [doc, "page", "y"]).filter(valid_topic(F.col("line")) & ~F.col("line").rlike(r"^[a-záéíóúñ]") & (F.size(F.split("line", " ")) <= 12)).withColumn("key", T.topic_key(F.col("line")))
    counts = titles.groupBy(doc).agg(F.count_distinct("key").alias("n_titles"))
    styled = runs.groupBy(doc).agg(F.sum(F.when(F.col("size").isNotNull(), F.col("n")).otherwise(0)).alias("styled"))
    both = styled.join(counts.hint("shuffle_merge"), doc, "left")
    status = F.when(F.col("styled") == 0, "sin_metadatos").when(F.col("n_titles").isNull(), "sin_titulos").otherwise("ok")
    return both.select(doc, status.alias("status"), F.coalesce("n_titles", F.lit(0)).alias("n_titles"))


# Fonts of formulas, fonts with weight, openings of prose on a page, the share of a page that is margin, its height if
# that isn't known, and how much larger than the body a title is.
FORMULA_FONTS, HEAVY_FONTS = "(?i)math|symbol|ding", "(?i)bold|bd|black|heavy"
PAGE_PROSE = r"^(permiten|tienen|los |las |el |la |se |son |esta|este|como |para |ejemplo)"
MARGIN, HEIGHT, LARGER, WEIGHTED = 0.06, 800.0, 1.2, 0.9


def visual_noise(text: Column) -> Column:
    """Is a line of large letters no title: a cover, a course's own part, prose, a label, or a stray letter?"""
    norm, tokens = T.topic_key(text), F.split(T.stripped(text), r"\s+")
    label = F.endswith(text, F.lit(":")) & (F.length(norm) < 45)
    single = (F.size(tokens) == 1) & (F.length(F.element_at(tokens, 1)) <= 2)
    return (F.length(norm) < 3) | norm.isin(*VISUAL_NOISE) | norm.startswith("contexto") | norm.rlike(COURSE_PART) | norm.rlike(PAGE_PROSE) | label | text.rlike(r"^\p{Ll}") | (F.size(tokens) > 12) | single | text.rlike(r"^\p{L}(\s|$)")


def styled_lines(words: DataFrame, doc: str, *, dominant: float = 0.7) -> DataFrame:
    """words(doc, page, top, x0, font, size, text) -> doc, page, y, line, size, is_title: the lines of words of one height, from
    left to right, with the size of their dominant style, and whether this is a title's: larger than the body, or of a heavy font
    that isn't the body's. Documents of fewer than 20 words, or without a body, have none."""
    known = words.select(doc, "page", "top", "x0", F.trim(F.coalesce("font", F.lit(""))).alias("font"), (F.bround(F.coalesce("size", F.lit(0.0)) * 2) / 2).alias("size"), "text")
    runs = style_runs(known, doc, F.bround("top"), F.col("text") != "")
    enough = runs.groupBy(doc).agg(F.sum("n").alias("n")).filter("n >= 20").select(doc)
    body = _body_of(runs.filter("font <> ''"), doc, math=FORMULA_FONTS).join(enough.hint("shuffle_merge"), doc).select(doc, F.col("font").alias("body_font"), F.col("size").alias("body_size"))
    text = _lines_of_runs(runs.filter(F.size("texts") > 0), doc)
    line = W.partitionBy(doc, "page", "y")
    top = runs.filter("font <> '' and size > 0").withColumn("all", F.sum("n").over(line)).withColumn("r", F.row_number().over(line.orderBy(F.desc("n"), "first"))).filter("r = 1")
    placed = text.join(top.hint("shuffle_merge"), [doc, "page", "y"]).join(body.hint("shuffle_merge"), doc)
    heavy = (F.col("font") != F.col("body_font")) & F.col("font").rlike(HEAVY_FONTS) & (F.col("size") >= F.col("body_size") * WEIGHTED)
    other = (F.col("font") != F.col("body_font")) | (F.col("size") != F.col("body_size"))
    title = (F.col("n") >= F.col("all") * dominant) & other & ((F.col("size") > F.col("body_size") * LARGER) | heavy)
    return placed.select(doc, "page", "y", T.without_bullet(F.col("line")).alias("line"), "size", title.alias("is_title"))


def visual_title_rows(words: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """words(doc, page, top, x0, font, size, text), pages(doc, page, height) -> doc, ord, title, reference: of a document with an
    index page the topics listed there, else the lines of a title's style outside the margins that are no noise and can be topics,
    each key once. Pages of unknown height have a usual one."""
    lines = stored(styled_lines(words, doc))
    listed = stored(index_page_topics(lines.withColumnRenamed("y", "line_no"), doc))
    quoted = lambda name: F.when(F.length(name) > 60, F.concat(F.substring(name, 1, 57), F.lit("…"))).otherwise(name)
    index = listed.select(doc, "ord", F.col("name").alias("title"), F.format_string("Índice: «%s» (p. %s)", quoted(F.col("name")), F.col("page").cast("string")).alias("reference"))
    sized = lines.filter("is_title").join(pages.select(doc, "page", "height").hint("shuffle_merge"), [doc, "page"], "left").withColumn("height", F.coalesce("height", F.lit(HEIGHT)))
    inside = sized.filter((F.col("y") >= F.col("height") * MARGIN) & (F.col("y") <= F.col("height") - F.col("height") * MARGIN) & (F.length("line") <= 120))
    able = inside.filter(~visual_noise(F.col("line")) & valid_topic(F.col("line"))).withColumn("key", T.topic_key(F.col("line"))).filter("key <> ''")
    alone = able.join(listed.select(doc).distinct().hint("shuffle_merge"), doc, "left_anti")
    once = alone.withColumn("r", F.row_number().over(W.partitionBy(doc, "key").orderBy("page", "y"))).filter("r = 1")
    said = F.format_string("Visual: «%s» (p. %s, %spt)", quoted(F.col("line")), F.col("page").cast("string"), F.col("size").cast("string"))
    return index.unionByName(once.select(doc, F.row_number().over(W.partitionBy(doc).orderBy("page", "y")).alias("ord"), F.col("line").alias("title"), said.alias("reference")))
