"""Reading the tables and cutting texts into sections and lines; stored tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions.text import stripped

SECTION_START = r"(?m)(?=^\[(?:PAGINA|SLIDE)\s+\d+\])"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")


def explode_sections(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """key, section_no (from 0), page (number in the marker, null without), text: a document cut before each page or slide
    marker; blank parts go, a document without markers is one section."""
    parts = docs.select(key, F.posexplode(F.filter(F.split(unix_newlines(F.col(text)), SECTION_START), lambda s: F.trim(s) != "")).alias("section_no", "text"))
    number = F.regexp_extract("text", r"^\[(?:PAGINA|SLIDE)\s+(\d+)\]", 1)
    return parts.withColumn("page", F.nullif(number, F.lit("")).cast("int"))


def explode_lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line_no (from 0), start and end offset, line (trimmed)."""
    lines = df.select(*keys, F.posexplode(F.split(unix_newlines(F.col(text)), "\n")).alias("line_no", "raw"))
    end = F.sum(F.length("raw") + 1).over(W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)) - 1
    placed = lines.withColumn("end", end).withColumn("start", F.col("end") - F.length("raw"))
    return placed.select(*keys, "line_no", "start", "end", stripped("raw").alias("line"))


def lines_of(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line_no, line (trimmed), without offsets: a narrow map with no shuffle."""
    return df.select(*keys, F.posexplode(F.split(unix_newlines(F.col(text)), "\n")).alias("line_no", "raw")).select(*keys, "line_no", stripped("raw").alias("line"))


def concat_materials(materials: DataFrame, group: str, order: str, text: str = "text", *, separator: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """The texts of a group in order as one, and the rejected members with their reason."""
    reason = F.when(F.col(text).isNull(), "no_encontrado").when(F.trim(text) == "", "sin texto")
    marked = materials.withColumn("reason", reason)
    joined = marked.filter("reason is null").groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), separator).alias("text"), F.count("*").alias("n_materials"))
    return joined, marked.filter("reason is not null").select(group, order, "reason")


def truncate_to_budget(materials: DataFrame, group: str, *, budget: int = 120_000, each: int = 20_000, text: str = "text") -> DataFrame:
    """If a group's texts are longer than budget together, each is cut to its first each characters."""
    totals = materials.groupBy(group).agg(F.sum(F.length(text)).alias("total"))
    joined = materials.join(totals, group)
    return joined.withColumn(text, F.when(F.col("total") > budget, F.substring(text, 1, each)).otherwise(F.col(text)))


def usable_texts(docs: DataFrame, *, least: int = 50, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with at least so many characters, and the others."""
    enough = F.length(F.trim(F.coalesce(text, F.lit("")))) >= least
    return docs.filter(enough), docs.filter(~enough)


def table_profile(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """table, n_rows, latest (of its date column, as text), columns."""
    parts = [
        df.agg(F.count("*").alias("n_rows"), (F.date_format(F.max(date), "yyyy-MM-dd HH:mm:ss") if date else F.lit(None).cast("string")).alias("latest")).select(F.lit(name).alias("table_name"), "n_rows", "latest", F.lit(",".join(df.columns)).alias("columns"))
        for name, (df, date) in sorted(tables.items())
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Rows of one partition of dealt.
ROWS = 250_000


def dealt(rows: int, df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to as many partitions as rows ask for, whatever the session's number is, so that the memory of a task
    stays the same as tables grow. Tables that are to meet are dealt with the same rows."""
    return df.repartition(max(1, -(-rows // ROWS)), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where that is unset, in local runs only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
