"""Operator 10, benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of 13 words (the whole item, if shorter). A window is a set of shingles, each with its place;
shingles are ordered by rarity over the whole corpus. A document can hold a window only if it holds the window's rarest
shingle - a prefix of length one is necessary for containment - at a place that leaves room for the whole window. These
candidate places are then verified exactly: the window occurs there if every one of its shingles stands at its place.

The benchmark side is small but is only broadcast behind a check of its bytes; the corpus is exploded, filtered against the
benchmark's shingles in the same stage, and only what matches is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import join_hint, only, stored, table, words

WINDOW, SHINGLE = 13, 3


def _shingles(array: Column, q: int) -> Column:
    """The runs of q words, joined by spaces, in order."""
    if q == 1:
        return array
    whole = F.arrays_zip(*[array.alias("w0"), *[F.slice(array, k + 1, F.greatest(F.size(array) - k, F.lit(0))).alias(f"w{k}") for k in range(1, q)]])
    return F.slice(whole, 1, F.greatest(F.size(array) - (q - 1), F.lit(0)))


def _exploded(df: DataFrame, q: int, *keep: str) -> DataFrame:
    """keep, pos (from 0), shingle: a row for each run of q words of the array words."""
    if q == 1:
        return df.select(*keep, F.posexplode("words").alias("pos", "shingle"))
    zipped = df.select(*keep, F.posexplode(_shingles(F.col("words"), q)).alias("pos", "z"))
    return zipped.select(*keep, "pos", F.concat_ws(" ", *[F.col("z").getField(f"w{k}") for k in range(q)]).alias("shingle"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, least_share: int = 20) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the document's words inside any occurrence of an item's window; contaminated: n_hit > 0 and least_share *
    n_hit >= n_words. Null and empty texts have no words. Rows of docs with one doc_id are separate rows of the result, each
    judged by its own text; a null doc_id is kept. Items with the same id count once; an item without words has no window; a
    null item_id is judged but named as an empty string."""
    spark = docs.sparkSession
    items = only(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    sized = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    cut = sized.select("item", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("n")), lambda k: F.slice("words", k + 1, F.col("n")))).alias("words"))
    windows = stored(cut.select("item", "n", "words", F.sha2(F.array_join("words", " "), 256).alias("window")))
    lengths = sorted({min(shingle, r["n"]) for r in windows.select("n").distinct().collect()})

    rows = only(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    texts = rows.select("row", words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    kinds = windows.dropDuplicates(["window"]).select("window", "n", "words")
    parts = [_exploded(kinds.filter(F.least(F.col("n"), F.lit(shingle)) == q), q, "window", "n").withColumn("q", F.lit(q)) for q in lengths]
    if not parts:
        parts = [_exploded(kinds, 1, "window", "n").withColumn("q", F.lit(1))]
    inside = parts[0]
    for p in parts[1:]:
        inside = inside.unionByName(p)
    inside = stored(inside.withColumnRenamed("pos", "offset"))  # window, n, offset, shingle, q

    # Where the corpus holds a shingle of the benchmark at all. One pass; nothing else of the corpus is shuffled.
    wanted = stored(inside.select("shingle", "q").distinct())
    small = join_hint(wanted, "shingle")
    met = None
    for q in lengths:
        part = _exploded(texts.filter(F.col("n_words") >= q), q, "row", "n_words").join(wanted.filter(F.col("q") == q).select("shingle").hint(small), "shingle").select("row", "n_words", "pos", "shingle")
        met = part if met is None else met.unionByName(part)
    if met is None:
        met = texts.select("row", "n_words", F.lit(0).alias("pos"), F.lit("").alias("shingle")).limit(0)
    met = stored(met)

    # The order by rarity, and each window's prefix: its rarest shingle (ties: the smallest, then the first).
    rarity = met.groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = inside.join(rarity.hint("shuffle_merge"), "shingle", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = W.partitionBy("window").orderBy("df", "shingle", "offset")
    prefix = stored(ranked.withColumn("at", F.row_number().over(first)).filter("at = 1 and df > 0").select("window", "n", "shingle", "offset", "q"))
    shingles_of = stored(inside.join(prefix.select("window").hint("shuffle_merge"), "window", "left_semi"))

    how = join_hint(prefix, "window", "shingle")
    # Bounds by position and length: the whole window must lie in the document.
    places = met.join(prefix.hint(how), "shingle").select("row", (F.col("pos") - F.col("offset")).alias("start"), "window", "n", "q", "n_words").filter("start >= 0 and start + n <= n_words")
    # Exact: the place holds the window if all its n - q + 1 shingles stand in their places.
    how = join_hint(shingles_of, "window", "shingle")
    expected = places.join(shingles_of.select("window", "offset", "shingle").hint(how), "window").select("row", "start", "window", "n", "q", (F.col("start") + F.col("offset")).alias("pos"), "shingle")
    held = expected.join(met.drop("n_words").hint("shuffle_merge"), ["row", "pos", "shingle"], "left_semi")
    occurrences = stored(held.groupBy("row", "start", "window", "n", "q").count().filter(F.col("count") == F.col("n") - F.col("q") + 1).select("row", "start", "window", "n"))

    # Words covered: the sum of what each start adds beyond what those before it have covered.
    spans = occurrences.groupBy("row", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = F.coalesce(F.max("end").over(W.partitionBy("row").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hits = spans.withColumn("added", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), before))).groupBy("row").agg(F.sum("added").alias("n_hit"))
    owners = stored(windows.select("window", "item").distinct())
    named = occurrences.select("row", "window").distinct().join(owners.hint(join_hint(owners, "window", "item")), "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = hits.join(named.hint("shuffle_merge"), "row")

    sizes = rows.select("row", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    judged = sizes.join(found.hint("shuffle_merge"), "row", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return judged.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (F.lit(least_share) * hit >= F.col("n_words"))).alias("contaminated"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
o AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
