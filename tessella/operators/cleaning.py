"""Line filters and cleaning by frequency across the sections of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.sources import stored

#: Bytes up to which noise lines go to all tasks.
BROADCAST_BYTES = 64 << 20


def line_kinds(lines: DataFrame) -> DataFrame:
    """lines(..., line) with technical, heading, marker and equation_marker flags."""
    line = F.col("line")
    return lines.withColumns({"technical": T.is_technical(line), "heading": T.is_heading(line), "marker": T.is_marker(line), "equation_marker": T.is_equation_marker(line)})


def trivial_reason(line: Column) -> Column:
    """Why a line without technical content is dropped by itself, or null."""
    reason = F.when(line.rlike(T.PAGE_NUMBER), "page_number").when(line.rlike(T.FILLER), "filler").when(line.rlike(T.URL_ONLY), "url").when(line.rlike(T.SLIDE_META), "slide")
    return F.when(reason.isNotNull() & ~T.is_technical(line), reason)  # the anchored patterns first: they fail at once


def structural_noise(lines: DataFrame, doc: str, section: str, *, share: float = 0.60, longest: int = 60) -> DataFrame:
    """doc, line, n, total: short lines that stand in more than share of the document's different sections."""
    line = F.col("line")
    able = (line != "") & (F.length(line) <= longest) & ~T.is_marker(line) & ~T.is_heading(line) & ~T.is_technical(line) & ~T.keeps_from_frequency(line)
    counts = lines.filter(able).select(doc, section, "line").distinct().groupBy(doc, "line").agg(F.count("*").alias("n"))
    totals = lines.groupBy(doc).agg(F.count_distinct(section).alias("total"))
    return counts.join(totals.hint("shuffle_merge"), doc).filter(F.col("n") > F.col("total") * share)


def glyph_headers(lines: DataFrame, doc: str, section: str, *, fifths: float = 4.0) -> DataFrame:
    """doc, line, n, total: lines of one- and two-letter tokens that stand in fifths / 5 of two sections or more."""
    line = F.col("line")
    counts = lines.filter(~T.is_marker(line) & T.is_glyph_soup(line)).select(doc, section, "line").distinct().groupBy(doc, "line").agg(F.count("*").alias("n"))
    totals = lines.groupBy(doc).agg(F.count_distinct(section).alias("total"))
    return counts.join(totals.hint("shuffle_merge"), doc).filter((F.col("total") >= 2) & (F.col("n") * 5 >= F.col("total") * fifths))


def drop_filename_lines(lines: DataFrame, stem: str) -> DataFrame:
    """Lines that are not just the file's name."""
    return lines.filter(F.lower("line") != F.lower(F.trim(stem)))


# Words that a line read backwards is recognised by.
KNOWN_WORDS = ("de", "del", "la", "el", "tema", "chapter", "section", "slide", "content", "engineering", "machine", "elements")


def mirrored(line: Column) -> Column:
    """Was the line read backwards? It has more known words when reversed than as it is. (The counts of vowels and of runs of
    consonants are the same both ways, so they cannot tell.)"""
    def known(c: Column) -> Column:
        return F.size(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w.isin(*KNOWN_WORDS)))

    return (F.length(line) >= 4) & (known(F.reverse(line)) > known(line))


SPACED = r"((?:^|[^A-Za-zÀ-ÿ0-9_])[A-Za-záéíóúñ]\s+[A-Za-záéíóúñ]\s+[A-Za-záéíóúñ])"  # three single letters
SALVAGE = r"(?i)^\p{L}$|^[\d.,+\-*/=^_{}\\()]+$|^[A-Za-zÀ-ÿ]{1,4}$|^\d+(?:[.,]\d+)?\s*(?:%|[kMGT]?W|[kMGT]?Pa|bar|psi|kg|g|mg|m|cm|mm|km|s|min|h|Hz|N|J|V|A|K|°C|°)$"


def equation_shard(line: Column) -> Column:
    """Is the line a formula broken up into short tokens?"""
    tokens = F.split(T.stripped(line), r"\s+")
    n, short = F.size(tokens), F.size(F.filter(tokens, lambda t: F.length(t) <= 2))
    long_ = F.size(F.filter(tokens, lambda t: (F.length(t) > 6) & t.rlike(r"^[A-Za-zÀ-ÿ]+$")))
    prose = T.is_technical(line) & line.rlike(r"=\s*\S") & (F.size(F.filter(F.regexp_extract_all(line, F.lit(f"({T.WORD})"), 1), lambda w: F.length(w) > 3)) >= 2)
    broken = (short / n >= 0.55) | line.rlike(r"[ð¼½¾¿¡»›þÿ]|[^\x00-\x7F].*[^\x00-\x7F].*[^\x00-\x7F]") & (short >= 3) | (F.size(F.regexp_extract_all(line, F.lit(SPACED), 1)) >= 2)
    return (n >= 4) & (long_ < 2) & (line != "") & ~T.is_heading(line) & ~T.is_equation_marker(line) & broken & ~prose


def salvaged(line: Column) -> Column:
    """What can be read of a broken formula, as a marker."""
    tokens = F.transform(F.split(T.stripped(line), r"\s+"), lambda t: F.regexp_replace(t, r"^[.,;:]+|[.,;:]+$", ""))
    kept = F.slice(F.array_distinct(F.filter(tokens, lambda t: (t != "") & t.rlike(SALVAGE))), 1, 48)
    text = F.array_join(kept, " ")
    return F.when(F.length(text) >= 2, F.concat(F.lit("[ECUACION_PARCIAL: "), text, F.lit("]"))).otherwise(F.lit("[ECUACION_NO_EXTRAIBLE]"))


def reasons(lines: DataFrame, doc: str, section: str, *, light: bool = False, share: float = 0.60, fifths: float = 4.0) -> DataFrame:
    """lines with reason: page_number, filler, url, slide, frequency, glyph, or null for lines that stay."""
    noise = glyph_headers(lines, doc, section, fifths=fifths) if light else structural_noise(lines, doc, section, share=share)
    noise = stored(noise.select(doc, F.lower("line").alias("lowered")).distinct().withColumn("noise", F.lit(True)))
    # Noise is short lines; the lines of the corpus stay where they are while its bytes are few.
    few = (noise.agg(F.sum(F.octet_length("lowered") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    joined = lines.withColumn("lowered", F.lower("line")).join(noise.hint("broadcast" if few else "shuffle_merge"), [doc, "lowered"], "left").drop("lowered")
    line = F.col("line")
    by_noise = F.coalesce("noise", F.lit(False)) & (F.lit(light) | (F.length(line) <= 60)) & ~T.is_heading(line) & ~T.is_technical(line)
    return joined.withColumn("reason", F.when((line != "") & ~T.is_marker(line), F.coalesce(trivial_reason(line), F.when(by_noise, "glyph" if light else "frequency")))).drop("noise")


def clean_corpus(lines: DataFrame, doc: str, section: str, *, light: bool = False, share: float = 0.60, fifths: float = 4.0) -> DataFrame:
    """lines(doc, section, line_no, line) -> doc, section, text: trivial and repeated lines dropped, broken formulas salvaged,
    inner space and blank lines reduced. A section that loses all is [TEXTO_ILEGIBLE]."""
    line = F.col("line")
    marked = reasons(lines, doc, section, light=light, share=share, fifths=fifths)
    fixed = F.when(~T.is_marker(line) & equation_shard(line), salvaged(line)).otherwise(F.regexp_replace(line, r"(\S)[ \t]{2,}(\S)", "$1 $2"))
    kept = marked.withColumn("kept", F.when(F.col("reason").isNull(), F.struct("line_no", fixed.alias("line"))))
    joined = kept.groupBy(doc, section).agg(F.array_join(F.transform(F.array_sort(F.collect_list("kept")), lambda s: s["line"]), "\n").alias("text"))  # of one section
    text = T.stripped(F.regexp_replace("text", r"\n{3,}", "\n\n"))
    return joined.select(doc, section, F.when(text == "", "[TEXTO_ILEGIBLE]").otherwise(text).alias("text"))


def cleaning_audit(lines: DataFrame, doc: str, section: str, *, light: bool = False, share: float = 0.60) -> DataFrame:
    """Per document: lines and characters in and out, and lines dropped by each rule."""
    marked = reasons(lines, doc, section, light=light, share=share)
    stays = F.col("reason").isNull()
    return marked.groupBy(doc).agg(
        F.count("*").alias("n_lines"),
        F.sum(F.length("line")).alias("chars_in"),
        F.sum(F.when(stays, F.length("line")).otherwise(0)).alias("chars_out"),
        F.count(F.when(F.col("reason") == "frequency", 1)).alias("by_frequency"),
        F.count(F.when(F.col("reason") == "glyph", 1)).alias("by_glyph"),
        F.count(F.when(~stays & ~F.col("reason").isin("frequency", "glyph"), 1)).alias("by_rule"),
    )
