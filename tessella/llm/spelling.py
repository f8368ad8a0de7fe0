"""Operator 13, spelling variants by a relational trie frontier.

The words are a trie held as a table of edges. States (word, position, node, edits) begin without an edit on a word's own path;
joined with the edge table they make their one edit, and then, level by level, follow the edges that spell the rest of the word.
A state that ends where a word ends has found a near word: one inserted, deleted or replaced code point apart.

Three things keep the frontier small, and lose nothing. Edges are compressed: a node is kept only where paths part or a word
ends, and a level is an edge with all its letters, so that long words take few levels. An edit can only be where paths part, and
near is mutual, so only replacing by a smaller letter and deleting are followed. And each word is entered twice, forwards and
backwards, from its middle on: an edit in its first half is one in the second half of the word read backwards, where nodes have
few edges. Nodes are known by a hash of their path; two paths with one hash would add states, not lose any, and each pair is
compared at last.

All is joins and aggregations of JVM expressions; the frontier of each level is written and read back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, only, stored, table

#: Runs of these are words; a deletion is planted where this divides the checksum.
LETTERS, PLANTED = "[A-Za-zÀ-ÿ]+", 97
#: Code points and occurrences that a word has at least; how many times as frequent its form is.
LENGTH, TIMES, RATIO = 5, 3, 2


def _from(text: Column | str, at: Column | int) -> Column:
    """The text from a place on, counted from 1."""
    text = F.col(text) if isinstance(text, str) else text
    return F.substring(text, F.lit(at) if isinstance(at, int) else at, F.length(text))


def paths(words: DataFrame) -> DataFrame:
    """words(id, word) -> id, text (the word forwards or backwards), at: the kept nodes on its path from its middle on, each with
    pos, node, firsts (the letters that follow), terminal (whether a word ends there)."""
    size = F.length("word")
    ways = [F.struct(F.lit(0).alias("way"), F.col("word").alias("text"), F.expr("length(word) div 2").cast("int").alias("middle")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("text"), (size - F.expr("length(word) div 2")).cast("int").alias("middle"))]
    both = words.select("id", F.explode(F.array(*ways)).alias("w")).select("id", "w.*")
    spots = both.select("id", "way", F.explode(F.sequence("middle", F.length("text"))).alias("pos"), "text").select("id", "way", "pos", F.xxhash64("way", F.substring("text", F.lit(1), F.col("pos"))).alias("node"), F.substring("text", F.col("pos") + 1, F.lit(1)).alias("next"))
    parts = spots.groupBy("node").agg(F.min("next").alias("lo"), F.max("next").alias("hi"), F.array_join(F.collect_set("next"), "").alias("firsts"))
    kept = parts.filter("lo <> hi or lo = ''").select("node", "firsts", (F.col("lo") == "").alias("terminal"))
    own = spots.select("id", "way", "pos", "node").join(kept.hint("shuffle_merge"), "node").groupBy("id", "way").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "firsts", "terminal"))).alias("at"))
    text = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
    return own.join(words.select("id", "word").hint("shuffle_merge"), "id").select("id", text.alias("text"), "at")


def edges(of: DataFrame) -> DataFrame:
    """The edge table: node, first (letter), label (all letters up to the next kept node), child, firsts and terminal of the child."""
    n = F.size("at") - 1
    steps = of.filter(n > 0).select("text", F.explode(F.arrays_zip(F.slice("at", F.lit(1), n).alias("a"), F.slice("at", F.lit(2), n).alias("b"))).alias("s"))
    label = F.substring("text", F.col("s.a.pos") + 1, F.col("s.b.pos") - F.col("s.a.pos"))
    return steps.select(F.col("s.a.node").alias("node"), F.substring(label, 1, 1).alias("first"), label.alias("label"), F.col("s.b.node").alias("child"), F.col("s.b.firsts").alias("firsts"), F.col("s.b.terminal").alias("terminal")).distinct()


def _can_go_on(rest: Column) -> Column:
    """Whether a word ends at the child if nothing is left, or the next letter follows there."""
    return F.when(rest == "", F.col("terminal")).otherwise(F.instr(F.col("firsts"), F.substring(rest, 1, 1)) > 0)


def near_pairs(words: DataFrame) -> DataFrame:
    """words(id, word), a stored table of distinct words -> a, b: ids of the words one edit apart, each pair once in each order."""
    of = stored(paths(words))
    trie = stored(edges(of))
    begun = of.select("id", "text", F.explode("at").alias("s")).filter(F.col("s.pos") < F.length("text")).select("id", F.col("s.node").alias("node"), _from("text", F.col("s.pos") + 1).alias("rest"), F.col("s.terminal").alias("ends"))
    # A word that is another one and one letter more.
    found = [begun.filter(F.col("ends") & (F.length("rest") == 1)).select("id", "node")]

    own, second, size = F.substring("rest", 1, 1), F.substring("rest", 2, 1), F.length("label")
    replaced = (F.col("first") < own) & (F.length("rest") >= size) & (F.substring("rest", F.lit(2), size - 1) == _from("label", 2))
    deleted = (F.col("first") == second) & (second != own) & (F.substring("rest", F.lit(2), size) == F.col("label"))
    after = [F.when(replaced, _from("rest", size + 1)), F.when(deleted, _from("rest", size + 2))]
    met = begun.drop("ends").join(trie.hint("shuffle_merge"), "node").filter(replaced | deleted)
    edited = met.select("id", "child", "firsts", "terminal", F.explode(F.array(*after)).alias("rest")).filter(F.col("rest").isNotNull() & _can_go_on(F.col("rest")))
    frontier = stored(edited.select("id", F.col("child").alias("node"), "rest"))
    while True:
        found.append(frontier.filter("rest = ''").select("id", "node"))
        going = frontier.filter("rest <> ''")
        if going.isEmpty():
            break
        met = going.withColumn("first", own).join(trie.hint("shuffle_merge"), ["node", "first"]).filter(F.substring("rest", F.lit(1), size) == F.col("label"))
        left = met.select("id", "child", "firsts", "terminal", _from("rest", size + 1).alias("rest")).filter(_can_go_on(F.col("rest")))
        frontier = stored(left.select("id", F.col("child").alias("node"), "rest"))

    ends = of.select(F.element_at("at", -1)["node"].alias("node"), F.col("id").alias("other"))
    pairs = reduce(DataFrame.unionByName, found).join(ends.hint("shuffle_merge"), "node").filter("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    one, two = (words.select(F.col("id").alias(x), F.col("word").alias(f"{x}_word")) for x in "ab")
    sure = pairs.join(one.hint("shuffle_merge"), "a").join(two.hint("shuffle_merge"), "b").filter(F.levenshtein("a_word", "b_word", 1) == 1)
    return stored(sure.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(id, to) -> id, to: the last word that following the forms leads to, by doubling. A form is RATIO times as frequent as
    its word, so there are few steps and no circles."""
    now = stored(forms)
    while True:
        on = now.select(F.col("id").alias("to"), F.col("to").alias("next"))
        further = stored(now.join(on.hint("shuffle_merge"), "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        now = further.select("id", "to")
        if further.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, *, length: int = LENGTH, times: int = TIMES, ratio: float = RATIO) -> DataFrame:
    """words(word, n) -> word, n, n_near, form, form_n, root, for words of at least length code points and times occurrences.

    n_near: how many such words are one edit apart; form: the one of them of largest n (ties: the smallest in code-point order) if
    that is at least ratio times the word's n, else null, as form_n; root: where following the forms ends, the word itself without
    a form. Rows of one word are added up; null words and counts don't count. An empty table gives no rows."""
    added = only(words, "word", "n").filter(F.col("word").isNotNull() & (F.length("word") >= length)).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)
    known = stored(added.withColumn("id", F.monotonically_increasing_id()))
    pairs = near_pairs(known.select("id", "word"))
    others = known.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"), F.col("id").alias("form_id")).alias("other"))
    near = pairs.join(others.hint("shuffle_merge"), "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    joined = known.join(near.hint("shuffle_merge"), "id", "left")
    formed = F.coalesce(-F.col("best.less") >= F.lit(ratio) * F.col("n"), F.lit(False))
    placed = stored(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(formed, c).alias(name) for name, c in (("form", F.col("best.form")), ("form_n", -F.col("best.less")), ("to", F.col("best.form_id")))]))
    last = roots(placed.filter("to is not null").select("id", "to")).withColumnRenamed("to", "last")
    named = last.join(known.select(F.col("id").alias("last"), F.col("word").alias("root")).hint("shuffle_merge"), "last").select("id", "root")
    return placed.join(named.hint("shuffle_merge"), "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def words_of(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> word, n: the runs of letters with A-Z lower-cased, counted over all texts. Of a run whose checksum h
    (of `doc_id:run`) PLANTED divides, code point h mod length is deleted. Null texts have none; with a null doc_id none is planted."""
    runs = only(docs, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    lower = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), _from("run", at + 2))
    word = F.when(F.col("h") % PLANTED == 0, cut).otherwise(F.col("run"))
    return lower.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(words_of(table(spark, sf_dir, "documents")))
