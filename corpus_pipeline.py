"""The corpus pipeline: documents -> without toxic ones -> without repeated lines -> without near duplicates -> without
contaminated ones -> tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all but the last return the columns of
documents. run() writes each stage's result as Parquet to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import bpe_digests
from tessella.llm.common import join_hint, spread_join, stored, table
from tessella.llm.decontamination import decontaminate
from tessella.llm.line_dedup import dedup_lines
from tessella.llm.near_dedup import near_classes
from tessella.llm.token_counts import vocabulary_text
from tessella.llm.toxicity import score_toxicity, toxicity_model


def whole(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as one column __doc, with just these columns beside it: no name of docs can clash with one of an operator."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    return docs.select(every, *[F.col(f"`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the rejection threshold. A null or empty text has no words and stays; each row,
    repeated or not, is judged by its own text; a row without doc_id has no label but is judged all the same."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(whole(docs, "text"), model).filter("not toxic").select("__doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; documents that lose all their lines go. n_chars, where there is one,
    follows the text. Null texts have no lines and stay."""
    done = dedup_lines(whole(docs, "doc_id", "text")).filter("n_removed < n_lines or n_lines = 0")
    own = {c: F.col("__doc").getField(c) for c in docs.columns}
    given = own | {"text": F.col("text")}
    if "n_chars" in own:
        given["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(own["n_chars"])
    return done.select(*[x.alias(c) for c, x in given.items()])


def numbered(docs: DataFrame) -> DataFrame:
    """docs as __doc, doc_id and text with a row number, which is the same whenever a table is read."""
    return whole(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of rows whose row numbers are not in gone."""
    gone = stored(gone.select("row"))
    return rows.join(gone.hint(join_hint(gone)), "row", "left_anti").select("__doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that with the smallest doc_id and of these the first; one without a doc_id only
    if no row of the class has one. Null and empty texts are in no class and stay."""
    rows = numbered(docs)
    classes = near_classes(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "class_id")
    ranked = stored(rows.select("row", F.col("doc_id").isNull().alias("none"), "doc_id").join(stored(classes).hint("shuffle_merge"), "row"))
    first = stored(ranked.groupBy("class_id").agg(F.min(F.struct("none", "doc_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    return without(rows, spread_join(ranked.filter("class_id is not null"), first, ["class_id"], "n").filter("row <> first.row"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth is benchmark text, each judged by its own text. Null and empty texts have no words and
    stay."""
    rows = numbered(docs)
    judged = decontaminate(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, judged.filter("contaminated").select(F.col("doc_id").alias("row")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the text decoded from them, a row for each row; a null or empty
    text has no tokens."""
    return bpe_digests(docs, vocabulary_text())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no fitted classifier and no tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None
