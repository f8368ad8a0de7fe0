"""Helpers that the corpus operators share: reading tables, the shared working folder, word columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: ASCII that is neither a digit nor, after lower-casing A-Z, a lower-case letter.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one stands in for it in local runs only."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", given)
    return given


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors, and gives Spark
    its true size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text, as counted below, up to which a table may be broadcast.
BROADCAST_BYTES = 64 << 20


def join_hint(df: DataFrame, *texts: str) -> str:
    """The hint for joining df, a stored table: broadcast while its bytes (those of the named text columns and 64 a row) are at
    most BROADCAST_BYTES, which is counted, else shuffle_merge."""
    size = F.lit(64).cast("long") + sum((F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c in texts), F.lit(0))
    return "broadcast" if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else "shuffle_merge"


def spread_join(rows: DataFrame, by_key: DataFrame, keys: list[str], times: str, *, share: int = 1000, parts: int = 64) -> DataFrame:
    """rows joined with by_key, a stored table of one row a key that has in times how many rows have the key.

    Keys with more than 1 / share of all rows, of which there are at most share, are dealt to parts tasks each; by_key's row of
    such a key goes to all of them. The other keys are joined as ever, in the same shuffle."""
    total = by_key.agg(F.sum(times)).first()[0] or 0
    hot = by_key.filter(F.col(times) > max(total / share, 1000)).select(*keys, F.lit(parts).alias("__parts"))
    own = [c for c in rows.columns if c not in keys] or keys  # by the row's own values: a task that is run again deals alike
    dealt = rows.join(hot.hint("broadcast"), keys, "left")  # at most share rows
    dealt = dealt.withColumn("__part", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*own), F.lit(parts))).otherwise(0).cast("int")).drop("__parts")
    often = F.when(F.col(times) > max(total / share, 1000), parts - 1).otherwise(0)
    every = by_key.withColumn("__part", F.explode(F.sequence(F.lit(0), often)))
    return dealt.join(every.hint("shuffle_merge"), [*keys, "__part"]).drop("__part")


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """The one object that this Python worker keeps between tasks; another key replaces it."""
    if _kept.get("key") != key:
        _kept.clear()
        _kept.update(key=key, made=make())
        _release()
    return _kept["made"]


def _release() -> None:
    """Free memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def lean(batches: Iterator, keeps: bool = False, returned: int = 1 << 18) -> Iterator:
    """The batches. Before the first one what another operator has kept in this worker goes (unless keeps), and after the last
    one free memory goes back to the system, so that a worker that is used again does not grow from stage to stage. Arrays of
    returned bytes or more go back at once, which takes time where many are made."""
    if hasattr(ctypes.CDLL(None), "mallopt"):
        ctypes.CDLL(None).mallopt(-3, returned)  # M_MMAP_THRESHOLD
    if not keeps:
        _kept.clear()
    yield from batches
    _release()


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; its session now hands batches of at most 4 MB to Python, so that a worker's memory follows neither the length of texts
    nor the number of rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def words(text: Column) -> Column:
    """The array of words of a text: A-Z lower-cased, then runs of digits, letters and anything beyond ASCII. Null: none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, NOT_WORD), "")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
