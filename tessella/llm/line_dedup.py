"""Operator 7, line dedup: a suffix array over line numbers by distributed prefix doubling, in DataFrame operations only.

Lines are named by their rank among the distinct repeated lines. Each round of doubling ranks the pairs (rank of the first half,
rank of the second half), so that after k rounds suffixes are ranked by their first 2**k lines: equal ranks are an interval of
the suffix array with a longest common prefix of that depth at least. Only repeated names are carried on; rounds end when none
are left or none is needed. The interval that agrees in any number of lines m is read from the ranks of the round below m at
the first and at the last 2**k of these lines, which overlap.

A run of lines is deleted if it stands earlier too and has min_lines lines and min_chars characters in all, or is one line of
long_line characters. Of the suffixes that begin with it only the first in document order is kept. All such runs, of whatever
length, are unions of the shortest ones that begin or end at each line: these are found by an as-of search in the running sums
of characters, named as above, and what the later ones of each name cover is joined to maximal runs.

Every step is a join or an aggregation by rank with partial aggregation before the shuffle, or a window within one document;
a line that fills a third of the corpus becomes one row of the ranks, and is dealt to many tasks where it is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import only, spread_join, stored, table

#: A repeated run counts with so many lines and characters, or as one line of so many characters.
MIN_LINES, MIN_CHARS, LONG_LINE = 2, 80, 200


def ranked(rows: DataFrame, *columns: str) -> DataFrame:
    """rows whose columns repeat, with their rank instead: an order-preserving number, from the partitions of a range sort."""
    repeated = rows.groupBy(*columns).agg(F.count("*").alias("__n")).filter("__n > 1")
    names = stored(repeated.orderBy(*columns).withColumn("rank", F.monotonically_increasing_id()))
    return stored(spread_join(rows, names, list(columns), "__n").drop("__n", *columns))


def shortest_runs(lines: DataFrame, *, min_lines: int, min_chars: int, long_line: int) -> DataFrame:
    """lines(row, doc_id, line_no, chars) -> row, doc_id, start, end: within stretches of neighbouring lines, the shortest run that
    counts from each line on and up to each line, and the lines that count alone."""
    nth = F.row_number().over(W.partitionBy("row").orderBy("line_no"))
    placed = lines.select("row", "doc_id", "line_no", "chars", (F.col("line_no") - nth).alias("stretch"))
    by = W.partitionBy("row", "stretch").orderBy("line_no")
    upto = F.sum("chars").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = placed.select("row", "doc_id", "stretch", (F.col("line_no") + 1).alias("at"), upto.alias("c"), "chars", (F.row_number().over(by) == 1).alias("new"))
    # The borders of lines with the characters before them; a stretch of n lines has n + 1.
    ends = F.when(F.col("new"), F.array(F.struct((F.col("at") - 1).alias("at"), (F.col("c") - F.col("chars")).alias("c")), F.struct("at", "c"))).otherwise(F.array(F.struct("at", "c")))
    edges = stored(after.select("row", "doc_id", "stretch", F.explode(ends).alias("edge")).select("row", "doc_id", "stretch", "edge.*"))

    def nearest(sign: int) -> DataFrame:
        """The shortest run from (1) or up to (-1) each border: row, doc_id, start, end."""
        ask = edges.select("row", "doc_id", "stretch", (F.col("c") + sign * min_chars).alias("c"), F.lit(1).alias("kind"), F.lit(0).alias("order"), F.col("at").alias("own"), F.lit(None).cast("int").alias("met"))
        give = edges.select("row", "doc_id", "stretch", "c", F.lit(0).alias("kind"), (-sign * F.col("at")).alias("order"), F.lit(None).cast("int").alias("own"), F.col("at").alias("met"))
        order = W.partitionBy("row", "stretch").orderBy(F.desc("c") if sign > 0 else F.asc("c"), "kind", "order").rowsBetween(W.unboundedPreceding, W.currentRow)
        both = ask.unionByName(give).withColumn("near", F.last("met", ignorenulls=True).over(order))
        far = F.greatest("near", F.col("own") + min_lines) if sign > 0 else F.least("near", F.col("own") - min_lines)
        edge = F.max("met").over(W.partitionBy("row", "stretch")) if sign > 0 else F.min("met").over(W.partitionBy("row", "stretch"))
        found = both.withColumn("far", far).withColumn("edge", edge).filter("kind = 1 and near is not null").filter((F.col("edge") - F.col("far")) * sign >= 0)
        start, end = ("own", "far") if sign > 0 else ("far", "own")
        return found.select("row", "doc_id", F.col(start).alias("start"), F.col(end).alias("end"))

    alone = lines.filter(F.col("chars") >= long_line).select("row", "doc_id", F.col("line_no").alias("start"), (F.col("line_no") + 1).alias("end"))
    return nearest(1).unionByName(nearest(-1)).unionByName(alone).distinct()


def rank_levels(names: DataFrame, deepest: int) -> DataFrame:
    """names(row, line_no, rank): the repeated lines -> row, line_no, level, rank: the suffixes that share their first 2**level lines
    with another one, by prefix doubling up to deepest lines."""
    now, level = names, 0
    found = now.withColumn("level", F.lit(0))
    while 2 ** (level + 1) <= deepest:
        step = 2**level
        at = W.partitionBy("row").orderBy("line_no").rangeBetween(step, step)
        pairs = stored(now.withColumn("next", F.first("rank").over(at)).filter("next is not null").withColumnRenamed("rank", "first"))
        now, level = ranked(pairs, "first", "next"), level + 1
        if now.isEmpty():
            break
        found = found.unionByName(now.withColumn("level", F.lit(level)))
    return found


def removed_runs(docs: DataFrame, *, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, long_line: int = LONG_LINE) -> DataFrame:
    """docs(row, doc_id, text) -> row, runs: the maximal runs of lines to delete, as an ordered array of (start, end), end
    exclusive."""
    text = docs.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = stored(text.select("row", "doc_id", "line_no", F.length("line").alias("chars"), F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(7)).alias("b")))
    known = ranked(lines, "a", "b")
    runs = stored(shortest_runs(known, min_lines=min_lines, min_chars=min_chars, long_line=long_line))
    deepest = runs.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    ranks = rank_levels(known.select("row", "line_no", "rank"), deepest)

    size = F.col("end") - F.col("start")
    leveled = runs.withColumn("level", sum((size >= 2**k).cast("int") for k in range(1, 31)))
    one = ranks.select("row", "level", F.col("line_no").alias("start"), F.col("rank").alias("first"))
    two = ranks.select("row", "level", F.col("line_no").alias("tail"), F.col("rank").alias("second"))
    met = leveled.withColumn("tail", F.col("end") - F.expr("shiftleft(1, level)")).join(one.hint("shuffle_merge"), ["row", "level", "start"])
    named = stored(met.join(two.hint("shuffle_merge"), ["row", "level", "tail"]).select("row", "doc_id", "start", "end", size.alias("size"), "first", "second"))
    # Intervals of suffixes that share the run, each with its first one in document order.
    shared = named.groupBy("size", "first", "second").agg(F.min(F.struct("doc_id", "row", "start")).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    later = spread_join(named, stored(shared), ["size", "first", "second"], "n").filter((F.col("row") != F.col("kept.row")) | (F.col("start") != F.col("kept.start")))

    spans = later.groupBy("row", "start").agg(F.max("end").alias("end"))
    by = W.partitionBy("row").orderBy("start")
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("island", F.sum("new").over(by))
    joined = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))  # of one document


def dedup_lines(docs: DataFrame, *, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, long_line: int = LONG_LINE) -> DataFrame:
    """docs(doc_id, text, ...) with later copies of repeated runs of lines deleted from text, and n_lines, n_removed and n_runs
    added (columns of these names are replaced, all others pass through).

    A run of any length counts that has min_lines and min_chars in all. Lines are parted by newlines and compared whole. The first copy, by doc_id (null first) and then by place, stays; rows
    with one doc_id are ordered by their place in the input. A run of copies that overlaps itself keeps its first line or
    lines. A null text has no lines and stays null; an empty text has one empty line; a text that loses all its lines becomes
    empty."""
    rows = docs.drop("n_lines", "n_removed", "n_runs").withColumn("__row", F.monotonically_increasing_id())
    runs = removed_runs(rows.select(F.col("__row").alias("row"), "doc_id", "text"), min_lines=min_lines, min_chars=min_chars, long_line=long_line)
    joined = rows.join(runs.select(F.col("row").alias("__row"), F.col("runs").alias("__runs")).hint("shuffle_merge"), "__row", "left")
    return kept_lines(joined).drop("__row", "__runs")


def kept_lines(df: DataFrame) -> DataFrame:
    """df(text, __runs) with the runs cut out of text, n_lines, n_removed and n_runs."""
    lines = F.split("text", "\n")
    n = F.size(lines)
    starts = F.concat(F.array(F.lit(0)), F.transform("__runs", lambda r: r["end"]))
    ends = F.concat(F.transform("__runs", lambda r: r["start"]), F.array(n))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda g: F.slice(lines, g["s"] + 1, g["e"] - g["s"])))
    some = F.col("__runs").isNotNull()
    return df.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"),
            "n_removed": F.when(some, F.aggregate("__runs", F.lit(0), lambda a, r: a + r["end"] - r["start"])).otherwise(0).cast("long"),
            "n_runs": F.when(some, F.size("__runs")).otherwise(0).cast("long"),
            "text": F.when(some, F.array_join(kept, "\n")).otherwise(F.col("text")),
        }
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, k, length(line) AS chars, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM l),
b AS (SELECT doc_id, k AS j, c FROM c UNION ALL SELECT doc_id, 0, 0 FROM t),
lo AS (SELECT doc_id, c, min(j) AS j FROM b GROUP BY doc_id, c),
hi AS (SELECT doc_id, c, max(j) AS j FROM b GROUP BY doc_id, c),
u AS (SELECT s.doc_id, s.j AS s, greatest(s.j + 2, e.j) AS e FROM b s ASOF JOIN lo e ON s.doc_id = e.doc_id AND s.c + 80 <= e.c
      UNION SELECT e.doc_id, least(e.j - 2, s.j), e.j FROM b e ASOF JOIN hi s ON s.doc_id = e.doc_id AND e.c - 80 >= s.c
      UNION SELECT doc_id, k - 1, k FROM c WHERE chars >= 200),
v AS (SELECT u.doc_id, s, e, row_number() OVER (PARTITION BY e - s, array_to_string(lines[s + 1 : e], chr(10)) ORDER BY u.doc_id, s) AS nth
      FROM u JOIN t ON u.doc_id = t.doc_id WHERE s >= 0 AND e <= len(lines)),
s AS (SELECT DISTINCT doc_id, unnest(range(s + 1, e + 1)) AS k FROM v WHERE nth > 1),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(s.k) AS n_removed, string_agg(CASE WHEN s.k IS NULL THEN l.line END, chr(10) ORDER BY l.k) AS kept FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.k = s.k GROUP BY l.doc_id),
g AS (SELECT doc_id, count(*) AS n_runs FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM s) WHERE p IS NULL OR k > p + 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(g.n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN g USING (doc_id)
"""
