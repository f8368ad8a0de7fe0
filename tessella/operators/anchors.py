"""Splitting a block's text into one fragment per topic at the headings that fit the topics, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as T
from tessella.functions.blocks import bag, bag_bound
from tessella.sources import stored

from .assembly import front_matter_field
from .matching import CONTAINED, NUMBERED, TOP, heading_score, monotone_anchors

# Names of the standard sections of a document, which begin no topic; the heading of notes; thresholds; messages.
STANDARD = (
    "Contenido teórico", "Ejemplos resueltos", "Ejercicios propuestos", "Tablas de referencia", "Procedimientos", "Resumen", "Contenido",
    "Theory", "Solved examples", "Practice problems", "Reference tables", "Procedures", "Summary", "Content",
)
NOTES = "Notas del presentador"
HIGH, LOW = 0.78, 0.65
NO_TITLE, WEAK, NOTHING_THERE, EMPTY = "No se localizó título para «%s»; contenido inferido por posición.", "Coincidencia débil (%.2f) entre «%s» y «%s».", "Ancla encontrada pero el tramo asignado está vacío.", "El markdown del bloque está vacío."
NO_CONTENT, NOTHING_FOUND = "*Sin contenido.*", "*Sin contenido detectado para este apartado.*"


def bodies(docs: DataFrame, doc: str, text: str = "markdown") -> DataFrame:
    """doc, body, theme: the text behind the front matter, and the theme that this names."""
    whole = T.stripped(F.coalesce(F.col(text), F.lit("")))
    parts = F.split(whole, "---", 3)
    cut = F.when(F.startswith(whole, F.lit("---")) & (F.size(parts) >= 3), F.regexp_replace(F.get(parts, F.lit(2)), r"^\n+", "")).otherwise(whole)
    return docs.select(doc, cut.alias("body"), front_matter_field(whole, "tema_detectado").alias("theme"))


def anchor_headings(texts: DataFrame, doc: str) -> DataFrame:
    """texts(doc, body, theme) -> doc, pos, level, heading: the headings of levels 1 to 4 and where their lines begin, without the
    title of level 1 that is the theme, notes, and standard sections of level 2."""
    cut = texts.select(doc, T.title_key(F.coalesce("theme", F.lit(""))).alias("theme"), F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    line = T.stripped("line")
    # Of other lines only the length is moved.
    lines = cut.select(doc, "theme", "line_no", F.length("line").alias("size"), F.when(line.rlike(r"^#{1,4}\s+.+$"), line).alias("line"))
    before = F.sum(F.col("size") + 1).over(W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)) - F.col("size") - 1
    found = lines.withColumn("pos", before).filter("line is not null").withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,4})\s", 1))).withColumn("heading", T.stripped(F.regexp_extract("line", r"^#{1,4}\s+(.+)$", 1)))
    key = T.title_key(F.col("heading"))
    title = (F.col("level") == 1) & (F.col("theme") != "") & (key == F.col("theme"))
    standard = (F.col("level") == 2) & key.isin([_plain(s) for s in STANDARD])
    return found.filter(~title & (key != _plain(NOTES)) & ~standard).select(doc, F.col("pos").cast("long").alias("pos"), "level", "heading")


def _plain(name: str) -> str:
    return name.lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))


def scored_headings(topics: DataFrame, headings: DataFrame, doc: str, *, least: float = HIGH) -> DataFrame:
    """topics(doc, ord, name, evidence) and headings of a document -> doc, ord, pos, heading, score of at least least. A heading is
    scored only if the letters of both, as bags, can give what the bonuses leave to reach."""
    key = lambda c: T.title_key(F.coalesce(F.col(c), F.lit("")))
    a = topics.withColumn("a_bag", bag(key("name"))).withColumn("a_size", F.length(key("name")))
    b = headings.withColumn("b_bag", bag(key("heading"))).withColumn("b_size", F.length(key("heading")))
    need = least - CONTAINED - NUMBERED - TOP
    met = a.join(b.hint("shuffle_merge"), doc).filter((F.col("a_size") > 0) & (bag_bound(F.col("a_bag"), F.col("b_bag"), F.col("a_size") + F.col("b_size")) >= need))
    scored = met.select(doc, "ord", "pos", "heading", heading_score(F.col("name"), F.col("evidence"), F.col("heading"), F.col("level")).alias("score"))
    return scored.filter(F.col("score") >= least)


def fragment_starts(anchored: DataFrame, doc: str) -> DataFrame:
    """anchored(doc, ord, anchor (place or null), length) with start and end.

    Topics without an anchor are put evenly between the anchored ones beside them; the first topic without one begins at 0, and
    behind the last anchored one each takes a growing share of the rest. Without any anchor all begin at 0."""
    by = W.partitionBy(doc).orderBy("ord")
    all_, back, ahead = W.partitionBy(doc), by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(0, W.unboundedFollowing)
    a = anchored.withColumn("i", F.row_number().over(by) - 1).withColumns({"n": F.count("*").over(all_), "any": F.max("anchor").over(all_).isNotNull()})
    a = a.withColumn("at", F.coalesce("anchor", F.when((F.col("i") == 0) & F.col("any"), F.lit(0)))).withColumn("k", F.when(F.col("at").isNotNull(), F.col("i")))
    a = a.withColumns({"p0": F.last("at", True).over(back), "i0": F.last("k", True).over(back), "p1": F.first("at", True).over(ahead), "i1": F.first("k", True).over(ahead)})
    between = F.col("p0") + F.floor((F.col("p1") - F.col("p0")) * (F.col("i") - F.col("i0")) / (F.col("i1") - F.col("i0")))
    share = F.floor((F.col("length") - F.col("p0")) * (F.col("i") - F.col("i0")) / (F.col("n") - F.col("i0")))
    a = a.withColumn("share", F.when(F.col("i1").isNull(), share).otherwise(0))
    behind = F.col("p0") + F.sum("share").over(by.rowsBetween(W.unboundedPreceding, 0))
    start = F.when(~F.col("any"), 0).when(F.col("at").isNotNull(), F.col("at")).when(F.col("p1").isNotNull(), between).otherwise(behind).cast("long")
    a = a.withColumn("start", start)
    return a.withColumn("end", F.greatest("start", F.coalesce(F.lead("start").over(by), "length")).cast("long")).drop("n", "any", "at", "k", "p0", "i0", "p1", "i1", "share")


def split_at_anchors(docs: DataFrame, topics: DataFrame, doc: str, *, least: float = HIGH, low: float = LOW) -> DataFrame:
    """docs(doc, markdown), topics(doc, ord, name, evidence) -> doc, ord, name, markdown, start, end, anchor, score, confidence,
    warnings, review.

    Topics in order take the best heading behind the one before that scores least or more. Confidence is alta, media, baja or
    sin_ancla by the score; review: whether this fragment asks for a look. What stands before the first anchor joins the first
    fragment. A null or blank text gives fragments without content; topics of a document that isn't there give none, and documents
    without topics give none here and a row in split_summary. (doc, ord) names a topic. Texts, topics and scores are written out."""
    texts = stored(bodies(docs, doc))
    topics = stored(topics.select(doc, "ord", "name", "evidence"))
    scores = stored(scored_headings(topics, anchor_headings(texts, doc), doc, least=least))
    chosen = monotone_anchors(scores.select(doc, "ord", "pos", "score"), doc, least=least).filter("pos is not null")
    known = chosen.withColumnRenamed("pos", "anchor").join(scores.select(doc, F.col("ord").cast("long").alias("ord"), F.col("pos").alias("anchor"), "heading", "score").hint("shuffle_merge"), [doc, "ord", "anchor"])
    asked = topics.select(doc, F.col("ord").cast("long").alias("ord"), F.coalesce("name", F.lit("")).alias("name"))
    sized = asked.join(texts.select(doc, F.length("body").cast("long").alias("length")).hint("shuffle_merge"), doc)
    placed = fragment_starts(sized.join(known.hint("shuffle_merge"), [doc, "ord"], "left"), doc)
    parts = placed.groupBy(doc).agg(F.collect_list(F.struct("ord", "i", "name", "start", "end", "anchor", "heading", "score")).alias("parts"))
    rows = texts.join(parts.hint("shuffle_merge"), doc).select(doc, "body", F.explode("parts").alias("p")).select(doc, "body", "p.*")

    piece = lambda a, b: T.stripped(F.substring(F.col("body"), (a + 1).cast("int"), (b - a).cast("int")))
    own, intro = piece(F.col("start"), F.col("end")), piece(F.lit(0), F.col("anchor"))
    r = rows.withColumn("own", own).withColumn("intro", F.when((F.col("i") == 0) & (F.col("anchor") > 0), intro))
    joined = F.when((F.col("intro") != "") & ~F.col("own").contains(F.col("intro")), T.stripped(F.concat("intro", F.lit("\n\n"), "own"))).otherwise(F.col("own"))
    r = r.withColumn("own", joined).withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("blank", T.stripped("body") == "")
    found = F.col("anchor").isNotNull()
    confidence = F.when(~found, "sin_ancla").when(F.col("score") >= HIGH, "alta").when(F.col("score") >= low, "media").otherwise("baja")
    r = r.withColumn("confidence", confidence)
    weak = F.when(~found, F.format_string(NO_TITLE, "name")).when(F.col("confidence") == "baja", F.format_string(WEAK, "score", "name", "heading"))
    missing = F.when(found & (F.col("own") == ""), NOTHING_THERE)
    warnings: Column = F.when(F.col("blank"), F.array(F.lit(EMPTY))).otherwise(F.array_compact(F.array(weak, missing)))
    content = F.when(F.col("blank"), NO_CONTENT).when(F.col("own") == "", NOTHING_FOUND).otherwise(F.col("own"))
    markdown = F.concat(F.lit("# "), "name", F.lit("\n\n"), content)
    return r.select(doc, "ord", "name", markdown.alias("markdown"), "start", "end", F.col("heading").alias("anchor"), F.bround("score", 3).alias("score"), F.col("score").alias("exact"), "confidence", warnings.alias("warnings"), (F.size(warnings) > 0).alias("review"))


def split_summary(fragments: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """doc, n, score (mean of the fragments'), review: whether any fragment or the lack of topics asks for a look."""
    of = fragments.groupBy(doc).agg(F.count("*").alias("n"), F.bround(F.avg("exact"), 3).alias("score"), F.bool_or("review").alias("review"))
    return docs.select(doc).distinct().join(of.hint("shuffle_merge"), doc, "left").select(doc, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("review", F.lit(True)).alias("review"))
