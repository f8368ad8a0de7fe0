"""Queries of course guides: one for each customer, whose orders are blocks and whose items are topics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella import sources as S
from tessella.operators import guides as G
from tessella.operators.structure import ordered

from .registry import query


def guides(spark, sf_dir):
    """o_custkey, text: guides in five layouts, by the customer's number: labelled blocks with numbered topics; dashed blocks without
    topics; counted blocks with topics in lines; chapters with topics after bullets; topics in the block's line and the next ones.
    Each block is followed by page furniture; a block behind the contents doesn't count, nor do customers whose number ends in 9,
    whose guides have no contents."""
    o = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").distinct().withColumn("b", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    t = S.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p_partkey")).join(S.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_partkey")
    topic = F.when(F.col("l_linenumber") == 5, "valores de").otherwise(F.concat_ws(" ", F.lower("p_type"), F.substring("p_name", 1, 4)))
    j = o.join(t.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"), topic.alias("topic")).hint("shuffle_merge"), "o_orderkey", "left").withColumn("k", F.col("o_custkey") % 5)
    b, n, k, name = F.col("b").cast("string"), F.col("n").cast("string"), F.col("k"), F.concat(F.lit("Pedido "), F.col("o_orderkey").cast("string"))
    line = F.when(k == 0, F.concat(b, F.lit("."), n, F.lit(". "), "topic")).when(k == 2, F.col("topic")).when(k == 3, F.concat(F.lit("• "), "topic")).when(k == 4, F.concat("topic", F.lit(".")))
    one = j.groupBy("o_custkey", "k", "o_orderkey", "b").agg(ordered("n", F.when(F.col("n").isNotNull(), line), "\n").alias("topics"))
    head = F.when(k == 0, F.concat(F.lit("Tema "), b, F.lit(". "), name)).when(k == 1, F.concat(b, F.lit(".-"), name)).when(k == 2, F.concat(b, F.lit(". "), name)).when(k == 3, F.concat(F.lit("CAPÍTULO "), b, F.lit(" - "), name)).otherwise(F.concat(b, F.lit(". "), name, F.lit(": ")))
    block = F.concat(head, F.when(k == 4, "").otherwise("\n3 de 10\nGuía docente de Pedidos\n"), F.coalesce("topics", F.lit("")))
    whole = one.groupBy("o_custkey").agg(ordered("b", block, "\n\n").alias("body"))
    title = F.when(F.col("o_custkey") % 10 == 9, "5. Otros\n").otherwise("5. Contenidos\nIntroducción a los pedidos\n")
    return whole.select("o_custkey", F.concat(F.lit("1. Identificación de la asignatura\nTema 7. Nada\n"), title, "body", F.lit("\n\n6. Metodología y plan de trabajo\nTema 9. Nada\nlinea suelta")).alias("text"))


_TOPICS = """o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)),
l AS (SELECT l_orderkey, l_linenumber AS n, max(l_partkey) AS p FROM lineitem GROUP BY ALL),
t AS (SELECT o_custkey, b, n, lower(p_type) || ' ' || substr(p_name, 1, 4) AS name FROM o JOIN l ON o_orderkey = l_orderkey JOIN part ON p = p_partkey WHERE n <> 5 AND o_custkey % 5 <> 1 AND o_custkey % 10 <> 9),
k AS (SELECT *, trim(regexp_replace(name, '[^a-z0-9]+', ' ', 'g')) AS key FROM t),
v AS (SELECT * FROM k WHERE NOT list_contains(['de', 'del', 'la', 'el', 'los', 'las', 'y', 'o', 'en', 'a', 'con', 'por', 'para', 'que', 'su', 'sus', 'un', 'una', 'al'], string_split(key, ' ')[-1])),
d AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey, b, key ORDER BY n) = 1)"""


@query(f"""WITH {_TOPICS} SELECT o_custkey, b AS block_no, CAST(b AS INTEGER) AS number, CAST(1 AS INTEGER) AS ord, 'block' AS kind, 'Pedido ' || o_orderkey AS name FROM o WHERE o_custkey % 10 <> 9
UNION ALL SELECT o_custkey, b, CAST(b AS INTEGER), CAST(row_number() OVER (PARTITION BY o_custkey, b ORDER BY n) AS INTEGER), 'topic', trim(name) FROM d""")
def guide_structure(spark, sf_dir):
    return G.guide_structure(S.lines_of(guides(spark, sf_dir), "o_custkey"), "o_custkey").withColumn("block_no", F.col("block_no").cast("long"))


@query(f"""WITH {_TOPICS}, once AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY o_custkey, key ORDER BY b, n) = 1)
SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY b, n) AS INTEGER) AS ord, trim(name) AS name FROM once""")
def guide_topics_flat(spark, sf_dir):
    return G.guide_topics_flat(S.lines_of(S.stored(guides(spark, sf_dir)), "o_custkey"), "o_custkey")


def hour_tables(spark, sf_dir):
    """o_custkey, text: guides with hours from the customer's orders. By the number's rest by three: a table of theory alone before
    a full one; two full ones; none. Hours stand in the row, after a year, or two lines below. Sentences follow."""
    n = S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count("*") % 7).alias("t"), (F.count_distinct("o_orderstatus") * 5).alias("s"), (F.sum("o_orderkey") % 4).alias("l"))
    k = F.col("o_custkey") % 3
    header = "Modalidades organizativas | Horas | %"
    early = F.concat_ws("\n", F.lit(header), F.lit("Clases expositivas | 77"), F.when(k == 1, F.lit("Prácticas de aula | 76\nPráct. de lab. | 75")), F.lit("\n".join(["texto"] * 50)))
    table = F.concat_ws(
        "\n", F.lit(header), F.lit("Tema 1 Clases expositivas | 50"), F.lit("Clases magistrales 2024\n3. Desglose 55"), F.concat(F.col("t").cast("string"), F.lit(" | 150")),
        F.lit("Seminarios y talleres | 98"), F.lit("Prácticas de aula / Seminarios"), F.concat(F.col("s").cast("string"), F.lit(" | 20 %")), F.lit("Prácticas de seminario | 97"),
        F.concat(F.lit("Prácticas de aula de informática | "), F.col("l").cast("string"), F.lit(",4")), F.lit("Total de clases expositivas | 96 | 100 %"),
    )
    told = "Los seminarios ocupan 14 horas\nPrácticas de laboratorio: 9 sesiones\nLas prácticas de laboratorio: 13 horas\nLas clases expositivas ocupan 11 horas\nPrácticas de aula, 7 h"
    text = F.concat_ws("\n", F.lit("Guía docente"), F.when(k < 2, F.concat_ws("\n", early, table)), F.lit("\n".join(["texto"] * 50)), F.lit(told))
    return n.select("o_custkey", text.alias("text"))


_HOURS = """n AS (SELECT o_custkey, o_custkey % 3 AS k, count(*) % 7 AS t, count(DISTINCT o_orderstatus) * 5 AS s, sum(o_orderkey) % 4 AS l FROM orders GROUP BY 1),
h AS (SELECT o_custkey, CASE WHEN k = 2 THEN 0 WHEN k = 1 AND (t = 0 OR l = 0) THEN 77 ELSE t END AS theory, CASE WHEN k = 2 THEN 0 WHEN k = 1 AND (t = 0 OR l = 0) THEN 76 ELSE s END AS seminar, CASE WHEN k = 2 THEN 0 WHEN k = 1 AND (t = 0 OR l = 0) THEN 75 ELSE l END AS lab FROM n)"""


@query(f"WITH {_HOURS} SELECT o_custkey, CAST(theory AS DOUBLE) AS theory, CAST(seminar AS DOUBLE) AS seminar, CAST(lab AS DOUBLE) AS lab FROM h")
def extract_hours(spark, sf_dir):
    return G.extract_hours(S.lines_of(hour_tables(spark, sf_dir), "o_custkey"), "o_custkey")


@query(f"WITH {_HOURS} SELECT o_custkey, CAST(CASE WHEN theory = 0 THEN 11 ELSE theory END AS DOUBLE) AS theory, CAST(CASE WHEN seminar = 0 THEN 7 ELSE seminar END AS DOUBLE) AS seminar, CAST(CASE WHEN lab = 0 THEN 13 ELSE lab END AS DOUBLE) AS lab FROM h")
def extract_hours_freetext(spark, sf_dir):
    return G.table_or_text_hours(S.lines_of(hour_tables(spark, sf_dir), "o_custkey"), "o_custkey")
