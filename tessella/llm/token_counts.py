"""Operator 2, token counts: map-side two-tier lookup.

A compact table of frequent pieces and their lengths in tokens is broadcast; what it lacks is encoded by the vocabulary's own
library and kept in a bounded cache of each worker. No piece is ever shuffled for counting. The table only saves time: a
piece's length is the same whichever tier answers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, kept, lean, only, stored, table
from .pieces import LETTERS, Cache, Splitter

def _worker(vocabulary: str, cache_bytes: int) -> tuple[Splitter, Cache]:
    """This worker's splitter with the library's model and its cache, made once a vocabulary."""
    return kept((Cache, hash(vocabulary), cache_bytes), lambda: (Splitter(vocabulary, with_model=True), Cache(cache_bytes)))


def _length(split: Splitter, piece: str) -> int:
    return 1 if piece in split.special else len(split.model.tokenize("".join([LETTERS[b] for b in piece.encode()])))


def frequent_lengths(docs: DataFrame, vocabulary: str, *, table_size: int = 65_536, sample_rows: int = 20_000, text: str = "text") -> dict[str, int]:
    """The first tier: lengths of the commonest pieces, at most table_size. Which pieces it holds comes from a sample of about
    sample_rows rows and never touches a result. The counts are written out; the driver gets first how many pieces occur how
    often, from which the least count follows that at most table_size pieces reach, and then these pieces, whatever the number
    of partitions."""
    spark, rows = bounded_batches(docs).sparkSession, docs.count()
    share = min(1.0, sample_rows / max(1, rows))
    words = spark.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, _ = _worker(words.value, 0)
        for batch in lean(batches, keeps=True):
            found: Counter = Counter()
            for x in batch.column(0).to_pylist():
                found.update(split(x))
            fit = {p: n for p, n in found.items() if len(p) <= 64}
            yield pa.RecordBatch.from_arrays([pa.array(fit.keys(), pa.string()), pa.array(fit.values(), pa.int64()), pa.array([_length(split, p) for p in fit], pa.int32())], names=["piece", "n", "length"])

    some = only(docs, text).toDF("text") if share == 1 else only(docs, text).toDF("text").sample(share, seed=7)
    counts = stored(some.mapInArrow(counted, "piece string, n long, length int").groupBy("piece").agg(F.sum("n").alias("n"), F.max("length").alias("length")))
    left, least = table_size, 1
    for r in sorted(counts.groupBy("n").count().collect(), reverse=True):  # of the sample's counts
        left -= r["count"]
        if left < 0:
            least = r["n"] + 1
            break
    return {r["piece"]: r["length"] for r in counts.filter(F.col("n") >= least).select("piece", "length").collect()}


def token_counts(docs: DataFrame, vocabulary: str, *, limit: int = 2048, table_size: int = 65_536, sample_rows: int = 20_000, cache_bytes: int = 1 << 25, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) added.

    vocabulary: the content of a tokenizers JSON file. Null and empty texts have no bytes and no tokens. Repeated rows are
    counted each by itself; columns of these names are replaced, all others pass through."""
    spark = docs.sparkSession
    tiers = spark.sparkContext.broadcast((frequent_lengths(docs, vocabulary, table_size=table_size, sample_rows=sample_rows, text=text), vocabulary))

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first, words = tiers.value
        split, second = _worker(words, cache_bytes)
        for batch in lean(batches, keeps=True):
            out = []
            for x in batch:
                n, missed = 0, []
                for piece in split(x):
                    k = first.get(piece)
                    if k is None:
                        missed.append(piece)
                    else:
                        n += k
                for piece in missed:
                    k = second.new.get(piece)
                    if k is None:
                        k = second.old.get(piece)
                        second.put(piece, k := _length(split, piece) if k is None else k, 0)
                    n += k
                out.append(n)
            yield pd.Series(out, dtype="int64")

    return docs.withColumns({"n_bytes": F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long"), "n_tokens": counts(F.col(f"`{text}`"))}).withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary_text(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return token_counts(docs, vocabulary_text()).select("doc_id", "n_bytes", "n_tokens", "over_limit")
