"""Operator 5, near duplicates by ProbMinHash.

A text is its weighted shingles (five words; the weight is how often one occurs). Each shingle sends arrivals of a Poisson
process of its weight to random registers; the register keeps the shingle that arrives first. Two texts agree in a register
with the probability Jaccard similarity of their weights, sum over i of 1 / sum over j of max(x_j / x_i, y_j / y_i). A shingle
stops when its next arrival is later than all registers hold, so nearly all stop after the first. Registers are banded; texts
that share a band are verified by the exact similarity, linked from 0.8 on, and links make classes.

Equal texts are one node from the start. In a band's bucket each text is paired with the bucket's smallest; then the buckets in
which texts of different classes are left are gone through again, small ones by all their pairs, large ones class by class. The
number of pairs is thus linear in a group of copies. What is still apart in large buckets is gone through exactly, block against
block inside tasks, and only links leave them: no two texts of one bucket that are similar enough stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded_batches, join_hint, lean, only, spread_join, stored, table
from .shingles import mix, text_shingles

#: Words of a shingle, similarity of a link, bands and registers of a band: a pair at 0.8 shares a band in all but 7 cases of
#: 100,000. Buckets of at most SMALL texts are gone through pair by pair.
WORDS, SIMILARITY, BANDS, ROWS, SMALL = 5, 0.8, 24, 5, 32
#: Bands whose pairs are verified first.
FIRST = 4
#: Edges that one task may handle.
FEW = 200_000
#: Texts and bytes of a block of a large bucket (one text at least), shingles compared at once, texts signed at once.
BLOCK, BLOCK_BYTES, STRIP, SIGNED = 256, 4 << 20, 2048, 128

_STEP = np.uint64(0x9E3779B97F4A7C15)


def probminhashes(texts: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """The signatures of texts given as shingles and weights, a row each: in each register the shingle of the first arrival. The
    arrivals of all texts are worked on together."""
    first, held = np.full(len(texts) * registers, np.inf), np.zeros(len(texts) * registers, np.uint64)
    if not texts:
        return held.reshape(0, registers)
    of = np.repeat(np.arange(len(texts)), [len(s) for s, _ in texts])
    d, rate = np.concatenate([s for s, _ in texts]), np.concatenate([w for _, w in texts]).astype(np.float64)
    time, turn = np.zeros(len(d)), 0
    while len(d):
        turn += 1
        ahead = np.arange(2 * turn, 2 * turn + 2, dtype=np.uint64) * _STEP
        draw = mix(d + ahead[0])
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        to = (mix(d + ahead[1]) % np.uint64(registers)).astype(np.int64) + of * registers
        np.minimum.at(first, to, time)
        won = first[to] == time
        held[to[won]] = d[won]
        on = time < first.reshape(-1, registers).max(axis=1)[of]
        d, rate, time, of = d[on], rate[on], time[on], of[on]
    return held.reshape(-1, registers)


def probminhash(shingles: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The signature of one text."""
    return probminhashes([(shingles, weights)], registers)[0]


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact similarity of two weighted sets, given as sorted distinct elements and their weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto, after = np.cumsum(x), y.sum() - np.cumsum(y)
    both = np.flatnonzero((x > 0) & (y > 0))
    last = np.searchsorted(ratio, ratio[both], side="right") - 1
    return float((x[both] / (upto[last] + after[last] / ratio[both])).sum())


def signatures(docs: DataFrame, *, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, key (of the text; null for null and empty ones), bands (hashes; empty without words)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)
        for batch in lean(batches):
            sizes, out, some = [], [], []

            def sign() -> None:
                held = probminhashes(some, bands * rows).reshape(-1, bands, rows)
                h = np.broadcast_to(place, held.shape[:2])
                for k in range(rows):
                    h = mix(h * _STEP + held[:, :, k])
                out.append(h.reshape(-1).view(np.int64))
                some.clear()

            for part in text_shingles(batch.column(2).to_pylist(), words):
                sizes.append(bands if len(part[0]) else 0)
                if len(part[0]):
                    some.append(part)
                if len(some) >= SIGNED:
                    sign()
            sign()
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out)))], names=["doc_id", "key", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = only(bounded_batches(docs), "doc_id", "text").select("doc_id", F.when(F.length("text") > 0, F.md5("text")).alias("key"), "text")
    return keyed.mapInArrow(signed, f"doc_id {kind}, key string, bands array<long>")


def linked(pairs: DataFrame, texts: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Of pairs(a, b) of keys those whose texts are similar enough, with their similarity."""

    @F.pandas_udf("double")
    def measured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in lean(batches):
            yield pd.Series([probability_jaccard(a, b) for a, b in zip(text_shingles(list(left), words), text_shingles(list(right), words), strict=True)], dtype="float64")

    named = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("left")).hint("shuffle_merge"), "a")
    both = named.join(texts.select(F.col("key").alias("b"), F.col("text").alias("right")).hint("shuffle_merge"), "b")
    return both.select("a", "b", measured("left", "right").alias("similarity")).filter(F.col("similarity") >= similarity)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, class (the smallest node of its component), by alternating large and small stars: every node's
    neighbours are handed to its smallest one, until nothing changes. While there are at most FEW edges, which is counted each
    time, a round is one task without a shuffle; beyond, it is dealt by node."""

    def pairs(df: DataFrame, *both: tuple[Column | str, Column | str]) -> DataFrame:
        """df's rows once for each of both, as edges (u, v) with u > v."""
        ends = [F.struct(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")) for x, y in both]
        return df.select(F.explode(F.array(*ends)).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()

    edges, before = pairs(links, ("a", "b")), None
    while True:
        edges = stored(edges)
        now = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == before:
            return edges.select("v", F.explode(F.array("u", "v")).alias("node")).select("node", F.col("v").alias("class")).distinct()
        before = now
        in_one = (lambda df: df.coalesce(1)) if now[0] <= FEW else (lambda df: df)
        edges = in_one(edges)
        near = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = in_one(pairs(near.join(least.hint("shuffle_merge"), "u").filter("v > u"), ("v", "m")))  # else the next join deals them anew
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = pairs(edges.join(least.hint("shuffle_merge"), "u"), ("v", "m"), ("u", "m"))


def shared_weights(texts: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the texts rows against each of the texts columns: the weight of the shingles of the one, and of the other, that
    both have. Strips of shingles at a time."""
    of = np.repeat(np.arange(len(texts)), [len(s) for s, _ in texts])
    every, code, df = np.unique(np.concatenate([s for s, _ in texts]), return_inverse=True, return_counts=True)
    by = np.argsort(code, kind="stable")
    by = by[df[code[by]] > 1]  # what one text has alone is shared with none
    of, column, weight = of[by], (np.cumsum(df > 1) - 1)[code[by]], np.concatenate([w for _, w in texts])[by]
    one, two = np.zeros((len(rows), len(columns))), np.zeros((len(rows), len(columns)))
    for at in range(0, int((df > 1).sum()), STRIP):
        a, b = np.searchsorted(column, [at, at + STRIP])
        table = np.zeros((len(texts), STRIP))
        table[of[a:b], column[a:b] - at] = weight[a:b]
        x, y = table[rows], table[columns]
        one += x @ (y > 0).astype(np.float64).T
        two += (x > 0).astype(np.float64) @ y.T
    return one, two


def links_of_blocks(texts: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, rows: np.ndarray, columns: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between the texts rows and the texts columns, so many that all classes with two texts that are similar enough are
    connected.

    If texts have the shares p and q of their weight in common, their similarity is at most 1 / (1/p + 1/q - 1), and just that if
    all weights are 1. Where this is enough it is measured, unless links found before connect both already."""
    one, two = shared_weights(texts, rows, columns)
    total = np.array([max(1, w.sum()) for _, w in texts], dtype=np.float64)
    p, q = one / total[rows][:, None], two / total[columns]
    with np.errstate(invalid="ignore"):
        most = np.where(p > 0, p * q / (p + q - p * q), 0.0)
    i, j = np.nonzero((most >= similarity - 1e-9) & (classes[rows][:, None] != classes[columns]))
    root = list(range(int(classes.max()) + 1))

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    found = []
    for k in np.argsort(-most[i, j], kind="stable"):
        a, b = int(rows[i[k]]), int(columns[j[k]])
        ca, cb = top(int(classes[a])), top(int(classes[b]))
        if ca != cb and probability_jaccard(texts[a], texts[b]) >= similarity:
            root[ca] = cb
            found.append((a, b))
    return found


def block_links(mixed: DataFrame, texts: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """mixed(band, key, class), texts(key, text) -> a, b: links that connect all classes of which two texts of one band are similar
    enough.

    A band's texts are dealt to blocks of bounded size, those of its largest class to blocks of their own, and each task compares
    two blocks. Blocks of the largest class do not meet. The work is quadratic in a band of very many classes, but a task holds two
    blocks, a text is handed out once for each block it meets, and no pair leaves a task unless it links."""
    placed = stored(mixed.join(texts.select("key", F.octet_length("text").cast("long").alias("bytes")).hint("shuffle_merge"), "key").select("band", "key", "class", "bytes"))
    each = placed.groupBy("band", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    whole = each.groupBy("band").agg(F.max(F.struct("n", "class", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    needed = lambda n, size: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(size / block_bytes)).cast("int")
    blocks = stored(whole.select("band", F.col("main.class").alias("main"), needed(F.col("main.n"), F.col("main.bytes")).alias("mains"), needed(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("others")))
    dealt = placed.join(blocks.hint(join_hint(blocks, "main")), "band").withColumn("is_main", F.col("class") == F.col("main"))
    own = F.when(F.col("is_main"), F.pmod(F.xxhash64("key"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("key"), "others")).cast("int")
    meets = F.sequence(F.when(F.col("is_main"), F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)
    met = dealt.select("band", "key", "class", own.alias("block"), F.explode(meets).alias("with"))
    given = met.select("band", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "key", "class").join(texts.hint("shuffle_merge"), "key")

    def compared(group: pa.Table) -> pa.Table:
        keys, (_, classes) = group.column("key").to_pylist(), np.unique(group.column("class").to_pylist(), return_inverse=True)
        side, lo, hi = (group.column(c).to_numpy() for c in ("block", "lo", "hi"))
        rows, columns = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        found = []
        if classes.max() and len(rows) and len(columns):
            found = links_of_blocks(list(text_shingles(group.column("text").to_pylist(), words)), classes, rows, columns, similarity)
        ends = [sorted((keys[a], keys[b])) for a, b in found]
        return pa.table({"a": pa.array([a for a, _ in ends], pa.string()), "b": pa.array([b for _, b in ends], pa.string())})

    return given.groupBy("band", "lo", "hi").applyInArrow(compared, "a string, b string").distinct()


def mixed_buckets(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """shared(band, key, n) with the class of each key, of the bands in which there are several classes."""
    placed = shared.join(classes.withColumnRenamed("node", "key").hint("shuffle_merge"), "key", "left").withColumn("class", F.coalesce("class", "key"))
    mixed = placed.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("band")
    return placed.join(mixed.hint("shuffle_merge"), "band").select("band", "key", "class", "n")


def apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs(a, b) those in different classes(node, class), with a_class and b_class; a key without a class is its own."""
    first, second = (classes.select(F.col("node").alias(x), F.col("class").alias(f"{x}_class")) for x in "ab")
    placed = pairs.join(first.hint("shuffle_merge"), "a", "left").join(second.hint("shuffle_merge"), "b", "left")
    return placed.withColumns({f"{x}_class": F.coalesce(f"{x}_class", x) for x in "ab"}).filter("a_class <> b_class")


def near_components(docs: DataFrame, signed: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """node, class: the components of verified links between the keys of different texts, for keys that have any."""
    nodes = signed.filter("key is not null").dropDuplicates(["key"]).select("key", F.posexplode("bands").alias("nth", "band"))
    least = nodes.groupBy("band").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(nodes.join(least.hint("shuffle_merge"), "band").select("band", "nth", "key", "first", "n"))
    stars_of = lambda some: shared.filter("key <> first").filter(some).select(F.col("first").alias("a"), F.col("key").alias("b")).distinct()
    needed = shared.select("key").distinct()
    keyed = only(docs, "text").filter(F.length("text") > 0).select(F.md5("text").alias("key"), "text")
    texts = stored(keyed.join(needed.hint("shuffle_merge"), "key", "left_semi").dropDuplicates(["key"]))
    # The first bands bring most of a large group together; of the others only pairs that are still apart are verified.
    stars = stored(stars_of(F.col("nth") < FIRST))
    links = stored(linked(stars, texts, words=words, similarity=similarity))
    late = stored(apart(stars_of(F.col("nth") >= FIRST), components(links)).select("a", "b").join(stars.hint("shuffle_merge"), ["a", "b"], "left_anti"))
    stars = stars.unionByName(late)
    links = stored(links.unionByName(linked(late, texts, words=words, similarity=similarity)))

    of = stored(components(links))
    open_ = stored(mixed_buckets(shared, of))
    if open_.isEmpty():
        return of
    one, two = open_.filter(F.col("n") <= small), open_.filter(F.col("n") > small)
    pair = [F.col("x.key").alias("a"), F.col("y.key").alias("b")]
    differ = (F.col("x.class") != F.col("y.class")) & (F.col("x.key") < F.col("y.key"))
    near = one.alias("x").join(one.alias("y").hint("shuffle_merge"), (F.col("x.band") == F.col("y.band")) & differ).select(*pair)
    heads = two.groupBy("band", "class").agg(F.min("key").alias("key"))
    chain = heads.withColumn("a", F.lag("key").over(W.partitionBy("band").orderBy("class"))).filter("a is not null").select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b"))
    more = stored(near.unionByName(chain).distinct().join(stars.hint("shuffle_merge"), ["a", "b"], "left_anti"))
    links = stored(links.unionByName(linked(more, texts, words=words, similarity=similarity)))

    of = stored(components(links))
    left = stored(mixed_buckets(two.select("band", "key", "n"), of))
    if left.isEmpty():
        return of
    return stored(components(links.select("a", "b").unionByName(block_links(left, texts, words=words, similarity=similarity))))


def near_classes(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """docs(doc_id, text) -> a row per document: doc_id, class_id (the smallest doc_id of its class), n_copies (documents with exactly its text).

    Texts without words are alike only if equal; null and empty texts are in no class but their own; a null doc_id never is a
    class_id unless it is alone. Repeated rows are copies."""
    signed = stored(signatures(docs, words=words, bands=bands, rows=rows))
    of = near_components(docs, signed, words=words, similarity=similarity, small=small).withColumnRenamed("node", "key")
    texts = signed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    placed = stored(texts.join(of.hint("shuffle_merge"), "key", "left").withColumn("class", F.coalesce("class", "key")))
    heads = placed.groupBy("class").agg(F.min("first").alias("class_id"))
    known = stored(placed.join(heads.hint("shuffle_merge"), "class").select("key", "class_id", "n_copies"))
    own = signed.select("doc_id", "key")
    met = spread_join(own.filter("key is not null"), known, ["key"], "n_copies").select("doc_id", "class_id", "n_copies")
    alone = own.filter("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return met.unionByName(alone).withColumn("class_id", F.coalesce("class_id", "doc_id"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
