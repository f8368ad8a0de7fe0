"""Matching of names, topics, blocks and anchors. Every match starts from an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as T
from tessella.functions.blocks import bag, bag_bound, block_ratio
from tessella.sources import stored

from .quality import size_hint


def token_overlap_pairs(left: DataFrame, right: DataFrame, within: str, *, least: int = 3) -> DataFrame:
    """left(within, a, a_name), right(within, b, b_name) -> within, a, b, overlap: shared tokens over the smaller number of tokens, for pairs
    that share one."""
    def tokens(df: DataFrame, id_: str, name: str) -> DataFrame:
        return df.select(within, id_, T.significant_tokens(F.col(name), least).alias("t")).withColumn(f"n_{id_}", F.size("t")).select(within, id_, f"n_{id_}", F.explode("t").alias("token"))

    met = tokens(left, "a", "a_name").join(tokens(right, "b", "b_name").hint("shuffle_merge"), [within, "token"])
    shared = met.groupBy(within, "a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    return shared.select(within, "a", "b", (F.col("shared") / F.greatest(F.lit(1), F.least("n_a", "n_b"))).alias("overlap"))


def greedy_one_to_one(pairs: DataFrame, store) -> DataFrame:
    """pairs(a, b, score) -> a, b, score: best pairs first, nothing used twice, ties by a and then b. In each round the pairs
    that are the best of both their sides are taken, which gives what taking one after the other gives; store writes a round's
    result out. Rounds go on until no pair is left."""
    left, taken = pairs.select("a", "b", "score"), None
    while True:
        order = (F.desc("score"), "a", "b")
        ranked = left.withColumn("ra", F.row_number().over(W.partitionBy("a").orderBy(*order))).withColumn("rb", F.row_number().over(W.partitionBy("b").orderBy(*order)))
        best = store(ranked.filter("ra = 1 and rb = 1").select("a", "b", "score"))
        if not best.take(1):
            return best if taken is None else taken
        taken = best if taken is None else taken.unionByName(best)
        left = store(left.join(best.select("a").hint("shuffle_merge"), "a", "left_anti").join(best.select("b").hint("shuffle_merge"), "b", "left_anti"))


def assign_files(blocks: DataFrame, files: DataFrame, within: str, store) -> DataFrame:
    """blocks(within, block, name), files(within, file, stem) -> within, block, file, how: one file for each block.

    Pairs that share a token are taken best first by their overlap, ties to the earlier block and file, and no file twice
    (overlap). The blocks that are left take the files that are left, both in order (free); when no file is left, a block takes the
    file that stands where it stands among all blocks, or else the first one (place). Groups without files have null."""
    pairs = token_overlap_pairs(blocks.select(within, F.col("block").alias("a"), F.col("name").alias("a_name")), files.select(within, F.col("file").alias("b"), F.col("stem").alias("b_name")), within)
    keyed = pairs.select(F.struct(within, "a").alias("a"), F.struct(within, "b").alias("b"), F.col("overlap").alias("score"))
    taken = store(greedy_one_to_one(keyed, store).select(F.col(f"a.{within}").alias(within), F.col("a.a").alias("block"), F.col("b.b").alias("file")))
    placed = blocks.select(within, "block", (F.row_number().over(W.partitionBy(within).orderBy("block"))).alias("place"))
    left = placed.join(taken.select(within, "block").hint("shuffle_merge"), [within, "block"], "left_anti").withColumn("nth", F.row_number().over(W.partitionBy(within).orderBy("block")))
    free = files.select(within, "file").join(taken.select(within, "file").hint("shuffle_merge"), [within, "file"], "left_anti").withColumn("nth", F.row_number().over(W.partitionBy(within).orderBy("file")))
    same = files.select(within, F.col("file").alias("same"), F.row_number().over(W.partitionBy(within).orderBy("file")).alias("place"))
    first = files.groupBy(within).agg(F.min("file").alias("first"))
    rest = left.join(free.hint("shuffle_merge"), [within, "nth"], "left").join(same.hint("shuffle_merge"), [within, "place"], "left").join(first.hint("shuffle_merge"), within, "left")
    how = F.when(F.col("file").isNotNull(), "free").when(F.col("first").isNotNull(), "place")
    return taken.select(within, "block", "file", F.lit("overlap").alias("how")).unionByName(rest.select(within, "block", F.coalesce("file", "same", "first").alias("file"), how.alias("how")))


def like_lengths(left: DataFrame, right: DataFrame, within: str, *, width: int = 8, spare: float = 1e-9) -> DataFrame:
    """left(within, name, need), right(within, other) -> their pairs of a group, with all columns, whose lengths allow for a
    similarity of need: it asks for lengths within a factor of need / (2 - need). Names meet by group and length."""
    factor = F.col("need") / (2 - F.col("need"))
    size = F.length("name")
    lo, hi = F.floor(size * factor - spare), F.when(F.col("need") > 0, F.ceil(size / factor + spare))
    asked = left.withColumn("size", size).withColumn("lo", lo).withColumn("hi", hi)
    asked = asked.withColumn("bucket", F.explode(F.sequence((F.col("lo") / width).cast("int"), (F.col("hi") / width).cast("int"))))
    held = right.withColumn("other_size", F.length("other")).withColumn("bucket", (F.col("other_size") / width).cast("int"))
    return asked.join(held.hint("shuffle_merge"), [within, "bucket"]).filter(F.col("other_size").between(F.col("lo"), F.col("hi"))).drop("bucket", "lo", "hi")


def similar_names(left: DataFrame, right: DataFrame, within: str, *, least: float) -> DataFrame:
    """left(within, name, need), right(within, other), both distinct normal forms -> within, name, other, score: the similarity by
    matching blocks of pairs of a group that can reach need, which is least or more.

    Names meet by group and length. Of those that meet, a pair is formed only if the letters that both have, counted as bags,
    allow for need."""
    spare = 1e-9
    met = like_lengths(left.withColumn("bag", bag(F.col("name"))), right.withColumn("other_bag", bag(F.col("other"))), within, spare=spare)
    can = bag_bound(F.col("bag"), F.col("other_bag"), F.col("size") + F.col("other_size")) >= F.col("need") - spare
    pairs = met.filter(can).select(within, "name", "other")
    return pairs.withColumn("score", block_ratio(F.col("name"), F.col("other"))).filter(F.col("score") >= least)


def rare_token_scores(left: DataFrame, right: DataFrame, within: str) -> DataFrame:
    """left(within, name), right(within, other) -> within, name, score: of each name its similarity with one name that has its
    rarest token among those of its group, which tells how good a match must be at least."""
    tokens = right.select(within, "other", F.explode(F.array_distinct(F.split("other", " "))).alias("token")).groupBy(within, "token").agg(F.count("*").alias("n"), F.min("other").alias("other"))
    met = left.select(within, "name", F.explode(F.array_distinct(F.split("name", " "))).alias("token")).join(tokens.hint("shuffle_merge"), [within, "token"])
    one = met.groupBy(within, "name").agg(F.min_by("other", F.struct("n", "other")).alias("other"))
    return one.select(within, "name", block_ratio(F.col("name"), F.col("other")).alias("known"))


def fuzzy_best_match(left: DataFrame, right: DataFrame, within: str, store, *, least: float = 0.35) -> DataFrame:
    """left(within, a, a_name), right(within, b, b_name) -> within, a, b, score, how: the b of the same group whose name is the most
    similar by matching blocks (similar), ties to the smaller b. If none reaches least, the b in the same place: the a-th in order
    takes the b-th in order, and the first one where there are fewer (position). A group without any b gives null.

    Names are compared by their topic keys and only once each; store writes a table out. A name without letters is similar to
    another such name only."""
    names = store(left.select(within, "a", T.topic_key(F.coalesce("a_name", F.lit(""))).alias("name")))
    others = store(right.select(within, "b", T.topic_key(F.coalesce("b_name", F.lit(""))).alias("other")))
    asked, held = names.select(within, "name").distinct(), others.groupBy(within, "other").agg(F.min("b").alias("b"))
    known = rare_token_scores(asked, held, within)
    need = F.greatest(F.lit(least), F.coalesce("known", F.lit(0.0)))
    scored = similar_names(asked.join(known.hint("shuffle_merge"), [within, "name"], "left").select(within, "name", need.alias("need")), held.select(within, "other"), within, least=least)
    best = scored.join(held.hint("shuffle_merge"), [within, "other"]).groupBy(within, "name").agg(F.max("score").alias("score"), F.min_by("b", F.struct((-F.col("score")).alias("s"), "b")).alias("b"))
    placed = names.withColumn("place", F.row_number().over(W.partitionBy(within).orderBy("a")))
    files = others.withColumn("place", F.row_number().over(W.partitionBy(within).orderBy("b"))).select(within, "place", F.col("b").alias("same"))
    first = others.groupBy(within).agg(F.min("b").alias("first"))
    joined = placed.join(best.hint("shuffle_merge"), [within, "name"], "left").join(files.hint("shuffle_merge"), [within, "place"], "left").join(first.hint("shuffle_merge"), within, "left")
    how = F.when(F.col("score").isNotNull(), "similar").when(F.col("first").isNotNull(), "position")
    return joined.select(within, "a", F.coalesce("b", "same", "first").alias("b"), F.bround("score", 6).alias("score"), how.alias("how"))


# Evidence that says nothing.
EMPTY_EVIDENCE = (
    "", "—", "-", "–", "sin señal verificable", "sin senal verificable", "fallback", "sin señal", "sin senal", "guía docente", "guia docente",
)


def enrich_evidence(topics: DataFrame, found: DataFrame, block: str, *, least: float = 0.85, store=stored) -> DataFrame:
    """topics(block, name, evidence) with empty evidence filled from found(block, name, evidence, pos), and origin.

    By the topic key first; of equal keys the last counts (Detectado). What is still empty takes the evidence of the most similar
    key of its block from least on, of equally similar ones the first in order (Detectado (aprox.)). Other rows are Propio. A topic
    without a key takes nothing. A column key in both tables, with the topic keys of their names, saves making them row by row.

    What a block knows is written out once. Names are compared only where a key is missing, and each two of them once, in however
    many blocks they meet."""
    made = lambda df: df if "key" in df.columns else df.withColumn("key", T.topic_key(F.col("name")))
    known = store(made(found).filter("key <> ''").groupBy(block, "key").agg(F.max_by("evidence", "pos").alias("new")))
    empty = F.col("evidence").isNull() | F.lower(F.trim("evidence")).isin(*EMPTY_EVIDENCE)
    keyed = made(topics).withColumn("empty", F.coalesce(empty & (F.col("key") != ""), F.lit(False)))
    met = store(keyed.join(known.withColumn("__known", F.lit(True)).hint("shuffle_merge"), [block, "key"], "left"))
    is_open = F.col("empty") & F.col("__known").isNull()
    open_ = met.filter(is_open).select(block, F.col("key").alias("name")).distinct().withColumn("need", F.lit(least))
    pairs = store(like_lengths(open_, known.select(block, F.col("key").alias("other"), F.col("new").alias("near")), block).select(block, "name", "other", "near"))
    each = store(pairs.select("name", "other").distinct())  # written out, so that letters are not counted before it
    can = bag_bound(bag(F.col("name")), bag(F.col("other")), F.length("name") + F.length("other")) >= least - 1e-9
    scored = store(each.filter(can).withColumn("score", block_ratio(F.col("name"), F.col("other"))).filter(F.col("score") >= least))
    best = pairs.join(scored.hint(size_hint(scored, "name", "other")), ["name", "other"]).groupBy(block, F.col("name").alias("key")).agg(F.min_by("near", F.struct((-F.col("score")).alias("s"), "other")).alias("near"))
    joined = met.filter(~is_open).withColumn("near", F.lit(None).cast(dict(best.dtypes)["near"])).unionByName(met.filter(is_open).join(best.hint("shuffle_merge"), [block, "key"], "left"))
    origin = F.when(F.col("empty") & F.col("new").isNotNull(), "Detectado").when(F.col("empty") & F.col("near").isNotNull(), "Detectado (aprox.)").otherwise("Propio")
    value = F.when(F.col("empty"), F.coalesce("new", "near", "evidence")).otherwise(F.col("evidence"))
    return joined.withColumn("origin", origin).withColumn("evidence", value).drop("new", "near", "key", "empty", "__known")


# How an evidence names a section, and what the bonuses are.
SECTION_EVIDENCE = r"(?iu)^Secci[oó]n\s+([\d.]+)"
CONTAINED, NUMBERED, TOP, THIRD, SURE = 0.15, 0.15, 0.10, 0.05, 0.6


def heading_score(topic: Column, evidence: Column, heading: Column, level: Column) -> Column:
    """Similarity by matching blocks, and more for containment, for the section number that the evidence names, and for level 1
    or 3 where they are similar already; at most 1. A topic without letters has 0."""
    a, b = T.title_key(topic), T.title_key(heading)
    base = block_ratio(a, b)
    number = F.regexp_extract(T.stripped(F.coalesce(evidence, F.lit(""))), SECTION_EVIDENCE, 1)
    text = T.stripped(heading)
    goes_on = F.substring(text, F.length(number) + 1, F.lit(1)).rlike(r"[\p{L}\p{N}_]")
    numbered = (number != "") & F.startswith(text, number) & (F.endswith(number, F.lit(".")) == goes_on)  # the number ends there
    bonus = F.when(b.contains(a) | a.contains(b), CONTAINED).otherwise(0.0) + F.when(numbered, NUMBERED).otherwise(0.0)
    depth = F.when(base > SURE, F.when(level == 1, TOP).when(level == 3, THIRD).otherwise(0.0)).otherwise(0.0)
    return F.when(a == "", 0.0).otherwise(F.least(F.lit(1.0), base + bonus + depth))


def match_by_number(blocks: DataFrame, files: DataFrame, within: str) -> DataFrame:
    """blocks(within, block, label), files(within, file, stem) -> within, block, file: the smallest file whose stem ends in the block's number."""
    number = r"(\d+)\s*$"
    f = files.withColumn("no", F.regexp_extract("stem", number, 1).cast("long")).groupBy(within, "no").agg(F.min("file").alias("file"))
    return blocks.withColumn("no", F.regexp_extract("label", number, 1).cast("long")).join(f.hint("shuffle_merge"), [within, "no"], "left").select(within, "block", "file")


def suggest_anchor(instructions: DataFrame, options: DataFrame, key: str, *, longer: int = 3) -> DataFrame:
    """instructions(key, text), options(key, pos, option) -> key, anchor: the longest option that occurs in the text, or one of whose longer
    words does; else the first option."""
    low = F.lower("text")
    word = F.exists(F.split(F.lower("option"), r"\s+"), lambda w: (F.length(w) > longer) & low.contains(w))
    met = instructions.join(options.hint("shuffle_merge"), key).withColumn("met", low.contains(F.lower("option")) | word)
    best = F.max_by("option", F.when(F.col("met"), F.struct(F.length("option"), -F.col("pos"))))
    return met.groupBy(key).agg(F.coalesce(best, F.min_by("option", "pos")).alias("anchor"))


# An anchor that names a figure, and a heading line.
FIGURE_ANCHOR, HEADING_LINE = r"(?i)^\[FIGURA:\s*(.+)\]$", r"^(#{1,6})\s+(.*)$"


def subsections(sections: DataFrame, doc: str, *, nested: bool = False) -> DataFrame:
    """sections(doc, section_no, body) -> doc, section_no, pos, level, heading, ends: the heading lines of bodies, where they begin,
    and where their subsection ends: at the next heading, or, nested, at the next one of the same or a higher level, else at the
    body's end. The next one of each level is a window's least position, so no heading is compared with another."""
    lines = sections.select(doc, "section_no", F.length("body").alias("size"), F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    by = W.partitionBy(doc, "section_no").orderBy("line_no")
    placed = lines.withColumn("pos", F.sum(F.length("line") + 1).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.length("line") - 1)
    found = placed.filter(F.col("line").rlike(HEADING_LINE)).withColumn("level", F.length(F.regexp_extract("line", HEADING_LINE, 1)))
    later = by.rowsBetween(1, W.unboundedFollowing)
    next_ = [F.min(F.when(F.col("level") <= n, F.col("pos"))).over(later) for n in range(1, 7)] if nested else [F.min("pos").over(later)] * 6
    ends = F.coalesce(F.element_at(F.array(*next_), F.col("level")) if nested else next_[0], F.col("size"))
    return found.select(doc, "section_no", "pos", "level", T.stripped(F.regexp_extract("line", HEADING_LINE, 2)).alias("heading"), ends.cast("long").alias("ends"))


def _grams(c: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct pieces of so many letters."""
    none = F.array().cast("array<string>")

    def pieces(n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(none)

    return F.array_distinct(F.concat(*map(pieces, sizes)))


def place_fragments(fragments: DataFrame, sections: DataFrame, doc: str, *, nested: bool = False) -> DataFrame:
    """fragments(doc, fragment, anchor, html), sections(doc, section_no, title, body) -> doc, fragment, section_no, offset, how.

    The section whose title the anchor is (title), at its end; else the first section with a heading of level 2 to 4 that contains
    the anchor (heading), at the end of the subsection of level 3 or 4 whose heading it is, or else contains it, the first one, or
    at the section's end if there is none; else the end of the last section (last). Case doesn't count. Blank fragments and those
    with a figure for an anchor have no place; a document without sections takes none.

    Anchors and headings of a document meet by three letters (all of a shorter anchor), never all with all."""
    low = lambda c: F.lower(T.stripped(F.coalesce(F.col(c), F.lit(""))))
    asked = fragments.filter(T.stripped(F.coalesce("html", F.lit(""))) != "").select(doc, "fragment", low("anchor").alias("anchor")).filter(~F.col("anchor").rlike(FIGURE_ANCHOR))
    sized = sections.select(doc, "section_no", low("title").alias("anchor"), F.length(F.coalesce("body", F.lit(""))).cast("long").alias("size"))
    titles = sized.groupBy(doc, "anchor").agg(F.min_by(F.struct("section_no", F.col("size").alias("offset")), "section_no").alias("by_title"))
    heads = subsections(sections.withColumn("body", F.coalesce("body", F.lit(""))), doc, nested=nested).filter(F.col("level").between(2, 4)).withColumn("low", F.lower("heading"))
    pieces = heads.withColumn("gram", F.explode(_grams(F.col("low"), (1, 2, 3))))
    wanted = asked.filter("anchor <> ''").select(doc, "anchor").distinct().withColumn("gram", F.substring("anchor", 1, 3))
    met = wanted.join(pieces.hint("shuffle_merge"), [doc, "gram"]).filter(F.col("low").contains(F.col("anchor")))
    deep = F.when(F.col("level") >= 3, F.struct((F.col("low") != F.col("anchor")).alias("contains"), "pos"))
    first = met.groupBy(doc, "anchor", "section_no").agg(F.min_by("ends", deep).alias("offset"))
    by_heading = first.groupBy(doc, "anchor").agg(F.min_by(F.struct("section_no", "offset"), "section_no").alias("by_heading"))
    last = sized.groupBy(doc).agg(F.max_by(F.struct("section_no", F.col("size").alias("offset")), "section_no").alias("last"))
    joined = asked.join(titles.filter("anchor <> ''").hint("shuffle_merge"), [doc, "anchor"], "left").join(by_heading.hint("shuffle_merge"), [doc, "anchor"], "left").join(last.hint("shuffle_merge"), doc)
    how = F.when(F.col("by_title").isNotNull(), "title").when(F.col("by_heading").isNotNull(), "heading").otherwise("last")
    spot = joined.select(doc, "fragment", how.alias("how"), F.coalesce("by_title", "by_heading", "last").alias("spot")).select(doc, "fragment", "spot.section_no", "spot.offset", "how")
    ends = sized.select(doc, "section_no", "size")  # a heading of level 2 alone: the section's end
    return spot.join(ends.hint("shuffle_merge"), [doc, "section_no"]).select(doc, "fragment", "section_no", F.coalesce("offset", "size").alias("offset"), "how")


def figure_overrides(fragments: DataFrame, doc: str) -> DataFrame:
    """fragments(doc, fragment, ord, anchor, html) -> doc, figure, fragment: of the fragments anchored to a figure the last one by
    ord, then fragment; blank ones don't count. Descriptions are told apart as they are written."""
    figure = T.stripped(F.regexp_extract(T.stripped("anchor"), FIGURE_ANCHOR, 1))
    named = fragments.filter(T.stripped(F.coalesce("html", F.lit(""))) != "").withColumn("figure", figure).filter("figure <> ''")
    return named.groupBy(doc, "figure").agg(F.max_by("fragment", F.struct(F.coalesce("ord", F.lit(0)), "fragment")).alias("fragment"))


def monotone_anchors(scores: DataFrame, doc: str, *, least: float = 0.78) -> DataFrame:
    """scores(doc, ord, pos, score) -> doc, ord, pos: topics in order each take the best heading behind the anchor before it; ties
    go to the earliest, and scores below least give no anchor."""
    rows = scores.groupBy(doc, "ord").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("pos").cast("long").alias("pos")))).alias("c"))
    topics = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "c"))).alias("topics"))
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<struct<ord:bigint,pos:bigint>>").alias("out"))

    def take(acc: Column, t: Column) -> Column:
        able = F.filter(t["c"], lambda c: (c["pos"] > acc["at"]) & (-c["s"] >= least))
        pos = F.when(F.size(able) > 0, F.element_at(able, 1)["pos"])
        return F.struct(F.coalesce(pos, acc["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(t["ord"].alias("ord"), pos.alias("pos")))).alias("out"))

    return topics.select(doc, F.explode(F.aggregate("topics", start, take)["out"]).alias("o")).select(doc, "o.ord", "o.pos")
