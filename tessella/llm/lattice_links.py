"""Operator 12, near duplicates among vectors by lattice hashing.

In each of TABLES tables a vector's direction is projected to eight random dimensions and decoded to the nearest point of the E8
lattice, whose cell is its home. It is also a guest in the PROBES neighbouring cells that are nearest to it. Two vectors meet in a
cell where one of them is at home; those of one label that meet are compared by their exact cosine.

Vectors that are equal and of one label are one node from the start, with a count. A pair may meet often: it counts where it
meets first, which both vectors' cells tell, so nothing need be gathered to make pairs distinct, and pairs are never emitted: a
task returns, for each vector, how many it is linked with and the smallest vector that it hangs together with. A cell of more than
BLOCK vectors is dealt to tasks by pairs of blocks, so that no task holds more than two blocks and none of its pairs is left out.

Two vectors of a cosine of 0.98 meet in one table in more than 0.95 of all cases, so four tables miss one in 100,000. SCALE is
the size of the cells, for vectors of eight dimensions; of more, cells are smaller as projected distances are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, join_hint, lean, only, spread_join, stored, table
from .near_dedup import components
from .shingles import mix

COSINE, TABLES, PROBES, SCALE = 0.98, 4, 4, 0.57
#: Vectors of a block, and pairs that are compared at once.
BLOCK, PAIRS = 1024, 1 << 15

_signs = np.array(list(itertools.product((1.0, -1.0), repeat=8)))
#: The 240 shortest vectors of E8: all of two ones, and of eight halves with an even number of minus signs.
SHORTEST = np.concatenate([np.unique([np.where(np.isin(np.arange(8), pair), s, 0.0) for pair in itertools.combinations(range(8), 2) for s in _signs], axis=0), _signs[(_signs < 0).sum(axis=1) % 2 == 0] / 2])
_PLACES = np.random.default_rng(8).integers(1, 1 << 63, 9, dtype=np.uint64) | np.uint64(1)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points of integers with an even sum: rounded, and where the sum is odd, the worst place rounded the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by one half."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


def _number(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit number of each lattice point and table."""
    twice = np.rint(2 * points).astype(np.int64).view(np.uint64)
    return mix((twice * _PLACES[:8]).sum(axis=-1, dtype=np.uint64) + np.uint64(table + 1) * _PLACES[8])


def cells(unit: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Of each vector of length 1 and each table the home cell and the cells in which it is a guest, nearest first."""
    n, d = unit.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng([t, d])
        axes = np.linalg.qr(rng.standard_normal((max(d, 8), 8)))[0][:d]
        x = np.einsum("nd,dk->nk", unit, axes) / (scale * np.sqrt(8 / max(d, 8))) + rng.uniform(0, 1, 8)
        home = nearest_e8(x)
        near = np.argsort(-((x - home) @ SHORTEST.T), axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = _number(home, t)
        out[:, t, 1:] = _number(home[:, None, :] + SHORTEST[near], t)
    return out.view(np.int64)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs meet, given the cells of one table of both."""
    return (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)


def _pairs_within(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """i < j of each group of rows, from start to end, PAIRS of them or those of one row at a time."""
    row = np.concatenate([np.arange(a, b) for a, b in zip(start, end, strict=True)] or [np.zeros(0, np.int64)])
    last = np.repeat(end, end - start)
    many = last - row - 1
    total = np.cumsum(many)
    for part in np.split(np.arange(len(row)), np.searchsorted(total, np.arange(PAIRS, total[-1] if len(total) else 0, PAIRS))):
        i = np.repeat(row[part], many[part])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])


def linked(ids: np.ndarray, vectors: np.ndarray, held: np.ndarray, cell: np.ndarray, block: np.ndarray, one_block: np.ndarray, start: np.ndarray, end: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of linked pairs that count here. start, end: the rows of each cell, ordered by their table; held: the cells of
    each row; block, one_block: the row's block, and whether the cell isn't dealt by pairs of blocks."""
    norm = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
    unit = vectors / norm[:, None]
    left, right = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        at_home = lambda k: (held[k][:, :, 0] == cell[k][:, None]).any(axis=1)
        home_i, home_j = at_home(i), at_home(j)
        fine = (home_i | home_j) & (one_block[i] | (block[i] != block[j])) & (ids[i] != ids[j])
        i, j, home_i, home_j = i[fine], j[fine], home_i[fine], home_j[fine]
        near = np.einsum("nd,nd->n", vectors[i], vectors[j]) / (norm[i] * norm[j]) >= cosine
        i, j, home_i, home_j = i[near], j[near], home_i[near], home_j[near]
        first = np.ones(len(i), bool)
        for t in range(held.shape[1]):
            here = ((held[i][:, t] == cell[i][:, None]).any(axis=1)) & ((held[j][:, t] == cell[j][:, None]).any(axis=1))
            a, b = held[i][:, t], held[j][:, t]
            # In one table both may be guests in each other's home: it counts in the home of the smaller id.
            mutual = here & (a[:, 0] != b[:, 0]) & (a == b[:, :1]).any(axis=1) & (b == a[:, :1]).any(axis=1)
            first &= ~mutual | np.where(ids[i] < ids[j], home_i, home_j)
            left.append(i[first & here])
            right.append(j[first & here])
            first &= ~here & ~_meet(a, b)

    small = end - start < 24
    for i, j in _pairs_within(start[small], end[small]):
        keep(i, j)
    for a, b in zip(start[~small], end[~small], strict=True):
        for k in range(a, b, 256):
            i, j = np.nonzero(unit[k : min(k + 256, b)] @ unit[a:b].T >= cosine - 1e-9)
            i, j = i + k, j + a
            for part in np.array_split(np.flatnonzero(i < j), -(-len(i) // PAIRS) or 1):
                keep(i[part], j[part])
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return joined(left), joined(right)


def _hanging(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of the n places that each hangs together with by the pairs."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, least[i], low)
        np.minimum.at(new, least[j], low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


POSTED = "label long, dim int, cell long, home boolean, id long, n long, vector array<double>, cells array<long>"
GROUP = ["label", "dim", "cell", "lo", "hi"]


def postings(nodes: DataFrame, *, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """nodes(id, label, n, vector) -> a row for each of its cells, home or not, with all its cells."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            dims = np.diff(batch.column(3).offsets.to_numpy())
            for d in np.unique(dims):
                rows = batch.filter(pa.array(dims == d))
                x = rows.column(3).flatten().to_numpy().reshape(len(rows), d)
                own = cells(x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None], tables, probes, scale)
                flat, per = own.reshape(len(rows), -1), tables * (1 + probes)
                many = rows.take(pa.array(np.repeat(np.arange(len(rows)), per)))
                home = np.tile(np.arange(per) % (1 + probes) == 0, len(rows))
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(many) + 1, dtype=np.int32) * per), pa.array(np.repeat(flat, per, axis=0).ravel()))
                yield pa.RecordBatch.from_arrays([many.column(1), pa.array(np.full(len(many), d, np.int32)), pa.array(flat.ravel()), pa.array(home), many.column(0), many.column(2), many.column(3), held], names=[c.split()[0] for c in POSTED.split(", ")])

    return bounded_batches(nodes).select("id", "label", "n", "vector").mapInArrow(posted, POSTED)


def links(nodes: DataFrame, *, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """nodes(id, label, n, vector), a stored table -> id, met (the sum of n over linked nodes found at one place), least (a node of
    the same component); several rows a node."""
    rows = stored(postings(nodes, tables=tables, probes=probes, scale=scale))
    key = ["label", "dim", "cell"]
    large = stored(rows.groupBy(*key).count().filter(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    dealt = rows.join(large.hint(join_hint(large)), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*key, F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "id", "n", "vector", "cells")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = tables * (1 + probes)

        def of(rows: pa.Table) -> pa.RecordBatch:
            keys = np.stack([rows.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in GROUP])
            new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            ids, n, side = (rows.column(c).combine_chunks().to_numpy() for c in ("id", "n", "block"))
            bounds = np.append(np.flatnonzero(new), len(ids))
            held = rows.column("cells").combine_chunks().flatten().to_numpy().reshape(len(ids), tables, 1 + probes)
            flat, offset = rows.column("vector").combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(keys[1])])
            assert held.size == len(ids) * per
            out_i, out_j = [], []
            for d in np.unique(keys[1]):
                at = np.flatnonzero(keys[1] == d)
                mine = np.flatnonzero(keys[1][bounds[:-1]] == d)
                vectors = flat[(offset[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)
                size = np.diff(bounds)[mine]
                end = np.cumsum(size)
                i, j = linked(ids[at], vectors, held[at], keys[2][at], side[at], (keys[3] == keys[4])[at], end - size, end, cosine)
                out_i.append(at[i])
                out_j.append(at[j])
            i, j = np.concatenate(out_i), np.concatenate(out_j)
            known, place = np.unique(ids, return_inverse=True)
            i, j, count = place[i], place[j], np.zeros(len(known), np.int64)
            times = np.zeros(len(known), np.int64)
            times[place] = n
            np.add.at(count, i, times[j])
            np.add.at(count, j, times[i])
            some = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(known[some]), pa.array(count[some]), pa.array(known[_hanging(len(known), i, j)[some]])], names=["id", "met", "least"])

        waiting = None
        for batch in lean(batches):
            rows = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            keys = [rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in GROUP]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last group begins
            if cut:
                yield of(rows.slice(0, cut).combine_chunks())
            waiting = rows.slice(cut)
        if waiting is not None and len(waiting):
            yield of(waiting.combine_chunks())

    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(compared, "id long, met long, least long")


def linked_vectors(vectors: DataFrame, *, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding, label) -> a row per row: vec_id, n_links (other rows of its label within the cosine), component_id
    (the smallest vec_id reachable by links, itself included), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing; nor do
    vectors of different lengths. Equal rows are rows like others, linked with each other. A null vec_id counts as a vector, is
    never the component_id of others, and isn't kept. An empty table gives no rows."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = only(vectors, "vec_id", "embedding", "label").select("vec_id", F.col("label").cast("long").alias("label"), F.when(fine, v.cast("array<double>")).alias("vector"))
    usable = rows.filter(F.col("vector").isNotNull())
    nodes = stored(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    found = stored(links(nodes, cosine=cosine, tables=tables, probes=probes, scale=scale, block=block))
    met = found.groupBy("id").agg(F.sum("met").alias("met"))
    of = components(found.filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "id")
    placed = stored(nodes.select("id", "first", "n").join(of.hint("shuffle_merge"), "id", "left").withColumn("class", F.coalesce("class", "id")))
    heads = placed.groupBy("class").agg(F.min("first").alias("component_id"))
    classed = placed.join(heads.hint("shuffle_merge"), "class").join(met.hint("shuffle_merge"), "id", "left").select("id", (F.col("n") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"), "component_id")
    known = stored(nodes.select("id", "label", "vector", "n").join(classed.hint("shuffle_merge"), "id").select("label", "vector", "n", "n_links", "component_id"))
    inner = spread_join(usable, known, ["label", "vector"], "n").select("vec_id", "n_links", "component_id")
    outer = rows.filter(F.col("vector").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inner.unionByName(outer).withColumn("component_id", F.coalesce("component_id", "vec_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op12_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
counted AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
heads AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN counted ON vec_id = counted.a LEFT JOIN heads ON vec_id = heads.a
"""
