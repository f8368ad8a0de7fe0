"""Operators that go through the lines or words of a corpus once: what follows reads a table that was written out."""

from pyspark.sql import functions as F

from tessella.operators import guides as G
from tessella.operators import structure as O


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Range (")


def test_hours_and_guides(spark):
    line = F.element_at(F.array(*map(F.lit, ("5. Contenidos", "Tema 1. Ejes", "1.1 Ejes huecos", "Modalidades | Horas", "Clases expositivas | 20", "6. Metodología"))), (F.col("id") + 1).cast("int"))
    lines = spark.range(6).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("line_no"), line.alias("line"))
    hours = G.table_or_text_hours(lines, "doc")
    assert scans(hours) == 0 and [tuple(r) for r in hours.collect()] == [(1, 20.0, 0.0, 0.0)]
    flat = G.guide_topics_flat(lines, "doc")
    assert scans(flat) <= 1 and [r["name"] for r in flat.orderBy("ord").collect()][0] == "Ejes huecos"


def test_styles(spark):
    first, word = F.col("id") < 3, F.element_at(F.array(*map(F.lit, ("Ejes", "huecos", "soldados"))), (F.col("id") % 3 + 1).cast("int"))
    font, size = F.when(first, "Arial-Bold").otherwise("Arial"), F.when(first, 16.0).otherwise(10.0)
    w = spark.range(24).select(F.lit(1).alias("doc"), F.lit(1).alias("page"), F.floor(F.col("id") / 3).cast("double").alias("top"), (F.col("id") % 3).alias("x0"), font.alias("font"), size.alias("size"), word.alias("text"))
    titles = O.visual_titles(w, "doc")
    assert scans(titles) == 0 and [tuple(r) for r in titles.collect()] == [(1, "ok", 1)]


def test_partitions_grow_with_rows(spark):
    from tessella import sources as S

    df = spark.range(10)
    assert [S.dealt(n, df, "id").rdd.getNumPartitions() for n in (0, S.ROWS, S.ROWS + 1, 7 * S.ROWS)] == [1, 1, 2, 7]


def test_fragments(spark):
    from tessella.operators import anchors as A

    first = F.col("id") == 0
    d = spark.range(2).select(F.col("id").alias("doc"), F.when(first, "# Ejes\nA\n  ## Uniones\nB").otherwise("x").alias("markdown"))
    t = spark.range(2).select(F.lit(0).cast("long").alias("doc"), F.col("id").alias("ord"), F.when(first, "Ejes").otherwise("Uniones").alias("name"), F.lit(None).cast("string").alias("evidence"))
    made = A.split_at_anchors(d, t, "doc")
    assert scans(made) == 0 and [(r["anchor"], r["start"], r["end"]) for r in made.orderBy("ord").collect()] == [("Ejes", 0, 9), ("Uniones", 9, 23)]
