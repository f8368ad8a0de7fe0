"""Operator 3, approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. The index is dealt to blocks of bounded size; each block holds an
inverted file, which posts every vector under each of its pivots with the place that the pivot has in its order. A query
meets, in every block, the postings of its own pivots, ranks the block's vectors by the footrule distance of the two orders
(a pivot missing from one of them counts as standing just behind its end) and reranks the nearest share by the exact cosine.
The best of all blocks are merged.

Equal vectors are indexed once with their smallest ids, which is all that can be returned of them, so a vector that fills a
third of the table does not crowd a block. Queries go to the blocks in parts of bounded size; nothing depends on the size of
the table but the number of blocks and parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import only, stored, table

#: Pivots, taken from a sample of the vectors (those with the smallest hashes); places of a permutation that are kept; rows of
#: a block; queries of a part; share of a block that is reranked, and how many vectors at least.
PIVOTS, PREFIX, BLOCK, PART, SHARE, LEAST = 256, 64, 8192, 16_384, 0.2, 160


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array of double): vectors that are null, empty, zero or hold null or non-finite components go."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return only(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine).select("vec_id", v.cast("array<double>").alias("vector"))


def _orders(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, in order; ties go to the first pivot."""
    near = unit @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


class Block:
    """The inverted file of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        orders = _orders(self.vectors / self.norms[:, None], pivots, prefix)
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        self.row = (by // orders.shape[1]).astype(np.int64)
        self.weight = (orders.shape[1] - by % orders.shape[1]).astype(np.int16)  # prefix - place
        self.start = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
        self.prefix = orders.shape[1]

    def search(self, query_id: int, vector: np.ndarray, order: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and cosines of the k best. The footrule is prefix * (prefix + 1) - 2 * (the sum, over common pivots, of the
        smaller of prefix - place in both orders)."""
        rows, shared = [], []
        for place, p in enumerate(order):
            a, b = self.start[p], self.start[p + 1]
            rows.append(self.row[a:b])
            shared.append(np.minimum(self.weight[a:b], self.prefix - place))
        n = len(self.ids)
        footrule = self.prefix * (self.prefix + 1) - 2 * np.bincount(np.concatenate(rows), weights=np.concatenate(shared), minlength=n)
        footrule[self.ids == query_id] = np.inf
        m = min(n, max(least, int(np.ceil(share * n))))
        near = np.argpartition(footrule, m - 1)[:m] if m < n else np.arange(n)
        near = near[np.isfinite(footrule[near])]
        near.sort()
        scores = (self.vectors[near] * vector).sum(axis=1) / (self.norms[near] * np.sqrt((vector * vector).sum()))
        best = np.lexsort((self.ids[near], -scores))[:k]
        return self.ids[near][best], scores[best]


def neighbours(vectors: DataFrame, queries: DataFrame, *, k: int = 5, pivots: int = PIVOTS, prefix: int = PREFIX, block: int = BLOCK, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> query_id, rank, vec_id, score: for each query the k vectors of largest cosine
    found, none with the query's own id; ties go to the smaller vec_id, fewer rows if there are fewer candidates.

    Vectors that are null, empty, zero or hold null or non-finite components take no part on either side, nor do rows without
    an id. Only vectors of the same length are compared. A repeated row counts once; two different vectors with one id are two
    candidates and two queries. An empty table gives no rows."""
    same = W.partitionBy("vector").orderBy("vec_id")
    rows = usable(vectors).groupBy("vec_id", "vector").agg(F.lit(1).alias("one")).withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    index = stored(rows.select("vec_id", "vector", "nth", F.size("vector").alias("dim")))
    asked = stored(usable(queries).distinct().withColumn("dim", F.size("vector")))
    dims = {r["dim"]: r["count"] for r in index.groupBy("dim").count().collect()}
    sample = {d: index.filter((F.col("nth") == 1) & (F.col("dim") == d)).orderBy(F.xxhash64("vector"), "vec_id").limit(pivots).select("vector").collect() for d in dims}
    given = {d: np.array([r["vector"] for r in s]) for d, s in sample.items()}
    given = {d: p / np.linalg.norm(p, axis=1, keepdims=True) for d, p in given.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(given)  # at most pivots vectors a length

    blocks = F.create_map(*[F.lit(x) for d, n in dims.items() for x in (d, -(-n // block))]) if dims else F.create_map(F.lit(0), F.lit(1))
    parts = max(1, -(-asked.count() // PART))
    left = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks[F.col("dim")]).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("dim")] - 1))).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(theirs):
            axes = shared.value[int(mine["dim"].iloc[0])]
            held = Block(mine["vec_id"].to_numpy(np.int64), np.stack(mine["vector"].to_numpy()), axes, min(prefix, len(axes)))
            asked_for = np.stack(theirs["vector"].to_numpy())
            orders = _orders(asked_for / np.sqrt((asked_for * asked_for).sum(axis=1))[:, None], axes, held.prefix)
            for query_id, vector, order in zip(theirs["vec_id"].to_numpy(np.int64), asked_for, orders, strict=True):
                ids, scores = held.search(query_id, vector, order, k, share, least)
                out.append(pd.DataFrame({"query_id": query_id, "of": xxhash.xxh3_64_intdigest(vector.tobytes()) >> 1, "vec_id": ids, "score": scores}))
        return pd.concat(out)[["query_id", "of", "vec_id", "score"]] if out else pd.DataFrame({"query_id": [], "of": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "of": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("dim", "block", "part").cogroup(right.groupBy("dim", "block", "part")).applyInPandas(search, "query_id long, of long, vec_id long, score double")
    best = W.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.filter(F.col("vec_id") % 50 == 0))
