"""Versioned outputs: a dataset is written beside the earlier ones and then published as the next version, whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T

#: How often the next number is tried, if others publish at the same time.
TRIES = 1000


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the folder of its versions."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The published versions and the names of their datasets. A number that was claimed, but not published, is not among them."""
    fs, folder = _folder(spark, path)
    found: dict[int, str] = {}
    if not fs.exists(folder):
        return found
    for status in fs.listStatus(folder):
        name, size = status.getPath().getName(), status.getLen()
        if name.startswith("v") and name[1:].isdigit() and size == 32:
            stream = fs.open(status.getPath())
            try:
                found[int(name[1:])] = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
    return found


def block_file(label: Column) -> Column:
    """The file name of a block: by the number in its label, else by the label itself."""
    number = F.regexp_extract(F.coalesce(label, F.lit("")), r"(?i)bloque\s*(\d+)", 1)
    named = T.slugify(F.coalesce(F.nullif(label, F.lit("")), F.lit("sin-numero")))
    return F.concat(F.lit("bloque-"), F.when(number != "", number.cast("decimal(38,0)").cast("string")).otherwise(named), F.lit(".md"))


def write_version(blocks: DataFrame, path: str, *, token: str | None = None) -> int:
    """blocks(doc, label, markdown) written under path as its next version, whose number is returned: doc, file, label, markdown.
    Blank texts are left out.

    The dataset goes to a folder of its own. Then the next free number is claimed by a file that must not exist yet, which holds
    the dataset's name: of several writers each gets a number, none overwrites another, and a reader sees a version only when all
    of it is there. A write that failed leaves an unpublished folder. With a token (32 letters or digits), repeating a write that
    was published gives its number again and writes nothing."""
    spark = blocks.sparkSession
    name = token or uuid.uuid4().hex
    if len(name) != 32 or not name.isalnum() or not name.isascii():
        raise ValueError("a token has 32 letters or digits")
    known = {dataset: number for number, dataset in versions(spark, path).items()}
    if name in known:
        return known[name]
    rows = blocks.filter(T.stripped(F.coalesce("markdown", F.lit(""))) != "").select("doc", block_file(F.col("label")).alias("file"), "label", T.stripped("markdown").alias("markdown"))
    rows.write.mode("overwrite").parquet(f"{path}/data/{name}")  # its own folder: a retry replaces what it left itself
    fs, folder = _folder(spark, path)
    fs.mkdirs(folder)
    number = max(versions(spark, path), default=0)
    for _ in range(TRIES):
        number += 1
        claim = spark._jvm.org.apache.hadoop.fs.Path(folder, f"v{number}")
        if fs.exists(claim):
            continue
        try:
            stream = fs.create(claim, False)
        except Exception as error:
            if "AlreadyExists" in str(error):
                continue
            raise
        stream.write(bytearray(name.encode()))
        stream.close()
        return number
    raise RuntimeError(f"no free version under {path}")


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A published version, the last one if none is named, with its number."""
    known = versions(spark, path)
    number = max(known, default=0) if number is None else number
    if number not in known:
        raise ValueError(f"{path} has no version {number}")
    return spark.read.parquet(f"{path}/data/{known[number]}").withColumn("version", F.lit(number))
