"""Queries of the relational state. The catalogue is nation, customer, orders; actions are events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import state as D
from tessella.sources import dealt, table

from .registry import query

_STATES = "s AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 'aprobado' ELSE 'generado' END) AS best, min(CASE WHEN quality = 1 THEN 'aprobado' ELSE 'generado' END) AS state FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)"


def _states(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.when(F.col("quality") == 1, "aprobado").otherwise("generado")).alias("state"))


@query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS kept, count(DISTINCT l_partkey) - 1 AS n_gone FROM lineitem GROUP BY ALL")
def dedupe_keep_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    kept, moved = D.dedupe_keep_latest(rows, ["l_orderkey", "l_linenumber"], "l_partkey")
    gone = rows.join(kept, ["l_orderkey", "l_linenumber", "l_partkey"], "left_anti").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_gone"))
    return kept.join(gone, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("kept"), F.coalesce("n_gone", F.lit(0)).alias("n_gone"))


@query("WITH k AS (SELECT s_nationkey, max(s_suppkey) AS kept FROM supplier GROUP BY 1) SELECT kept AS l_suppkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN k USING (s_nationkey) GROUP BY 1")
def repoint_fk(spark, sf_dir):
    _, moved = D.dedupe_keep_latest(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey")
    return D.repoint(table(spark, sf_dir, "lineitem").select("l_suppkey"), moved, "l_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, value FROM e WHERE r = 1")
def upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    median = e.groupBy("user_id").agg(F.max("event_id").alias("last"))
    old = e.join(median, "user_id").filter(F.col("event_id") < F.col("last") / 2).drop("last")
    new = e.join(median, "user_id").filter(F.col("event_id") >= F.col("last") / 2).drop("last")
    first, _ = D.dedupe_keep_latest(old, ["user_id", "event_type"], "event_id")
    return D.upsert(first, new, ["user_id", "event_type"], "event_id")


@query("SELECT DISTINCT p_name FROM part WHERE p_size > 10 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 2)")
def insert_ignore(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    new, _ = D.insert_ignore(p.filter("p_size <= 2").select("p_name"), p.filter("p_size > 10").select("p_name"), "p_name")
    return new


@query("""WITH e AS (SELECT user_id, ts, event_id, value, CASE event_type WHEN 'view' THEN 'edit' WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'draft' ELSE 'regenerate' END AS action FROM events),
g AS (SELECT *, sum(CASE WHEN action = 'regenerate' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM e),
n AS (SELECT * FROM g QUALIFY era = max(era) OVER (PARTITION BY user_id))
SELECT user_id, CASE arg_max(action, (ts, event_id)) WHEN 'approve' THEN 'aprobado' WHEN 'edit' THEN 'editado' ELSE 'generado' END AS state,
  CAST(arg_max(event_id, (ts, event_id)) FILTER (action IN ('draft', 'regenerate')) AS VARCHAR) AS draft, CAST(arg_max(event_id, (ts, event_id)) FILTER (action = 'edit') AS VARCHAR) AS final,
  arg_max(greatest(1, least(10, value)), (ts, event_id)) FILTER (action = 'approve') AS score FROM n GROUP BY user_id""")
def fold_state(spark, sf_dir):
    action = F.when(F.col("event_type") == "view", "edit").when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "click", "draft").otherwise("regenerate")
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", action.alias("action"), F.col("event_id").cast("string").alias("text"), F.col("value").alias("score"))
    return D.fold_state(log, "user_id", ["ts", "event_id"])


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'N' AS new FROM lineitem), m AS (SELECT l_orderkey, max(l_linenumber) AS most FROM l WHERE NOT new GROUP BY 1)
SELECT l_orderkey, l_partkey, CAST(coalesce(most, -1) + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS BIGINT) AS ord FROM (SELECT DISTINCT l_orderkey, l_partkey FROM l WHERE new) LEFT JOIN m USING (l_orderkey)""")
def append_with_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    new = rows.filter("l_returnflag = 'N'").select("l_orderkey", "l_partkey").distinct()
    done = D.append_with_order(rows.filter("l_returnflag <> 'N'").withColumnRenamed("l_linenumber", "ord"), new, "l_orderkey", "ord", ["l_partkey"])
    return done.select("l_orderkey", "l_partkey", F.col("ord").cast("long").alias("ord"))


@query("SELECT l_orderkey, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'O' THEN l_quantity + 1 ELSE l_quantity END), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def replace_subtree(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    n = lines.count()  # from the files' footers
    lines = dealt(n, lines, "l_orderkey")
    orders = dealt(n, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    open_ = orders.filter("o_orderstatus = 'O'").select("l_orderkey")
    known = lines.join(orders.select("l_orderkey"), "l_orderkey", "left_semi")
    new = known.join(open_, "l_orderkey", "left_semi").withColumn("l_quantity", F.col("l_quantity") + 1)
    return D.replace_subtree(known, new, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(f"WITH {_STATES} SELECT source, count(*) AS total, count(CASE WHEN state = 'aprobado' THEN 1 END) AS approved, round_even(count(CASE WHEN state = 'aprobado' THEN 1 END) / greatest(count(*), 1) * 100, 1) AS percent FROM documents LEFT JOIN s USING (doc_id) GROUP BY source")
def progress(spark, sf_dir):
    return D.progress(table(spark, sf_dir, "documents"), _states(spark, sf_dir), ["source"], "doc_id")


@query(f"WITH {_STATES} SELECT source, doc_id, n_chars, CASE WHEN state = 'aprobado' THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS percent FROM documents LEFT JOIN s USING (doc_id)")
def progress_breakdown(spark, sf_dir):
    d = D.with_default_state(table(spark, sf_dir, "documents"), _states(spark, sf_dir), "doc_id")
    return d.select("source", "doc_id", "n_chars", F.when(F.col("state") == "aprobado", 100.0).otherwise(0.0).alias("percent"))


@query("""WITH c AS (SELECT c_nationkey AS n_nationkey, count(*) AS customers, count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS builders FROM customer GROUP BY 1),
o AS (SELECT c_nationkey AS n_nationkey, count(*) AS orders, max(o_orderdate) AS latest, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT n_name, coalesce(customers, 0) AS customers, coalesce(builders, 0) AS builders, coalesce(orders, 0) AS orders, strftime(latest, '%Y-%m-%d') AS latest, round_even(coalesce(done, 0) / greatest(coalesce(orders, 0), 1) * 100, 1) AS percent,
 CASE WHEN coalesce(orders, 0) = 0 THEN 'sin iniciar' WHEN done = orders THEN 'completada' ELSE 'en progreso' END AS badge FROM nation LEFT JOIN c USING (n_nationkey) LEFT JOIN o USING (n_nationkey)""")
def portfolio(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    c = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.count(F.when(F.col("c_mktsegment") == "BUILDING", 1)).alias("builders"))
    placed = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus").join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    o = placed.groupBy("n_nationkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("latest"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(c, "n_nationkey", "left").join(o, "n_nationkey", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    badge = F.when(zero("orders") == 0, "sin iniciar").when(F.col("done") == F.col("orders"), "completada").otherwise("en progreso")
    return n.select("n_name", zero("customers").alias("customers"), zero("builders").alias("builders"), zero("orders").alias("orders"), F.date_format("latest", "yyyy-MM-dd").alias("latest"), D.percent(zero("done"), zero("orders")).alias("percent"), badge.alias("badge"))


@query(f"WITH {_STATES} SELECT source, count(CASE WHEN trim(coalesce(nullif(CASE WHEN state = 'aprobado' THEN text END, ''), text, '')) <> '' THEN 1 END) AS with_text, count(CASE WHEN state = 'aprobado' THEN 1 END) AS approved FROM documents LEFT JOIN s USING (doc_id) GROUP BY source")
def curated_work_counts(spark, sf_dir):
    d = D.with_default_state(table(spark, sf_dir, "documents"), _states(spark, sf_dir), "doc_id")
    final = F.when(F.col("state") == "aprobado", F.col("text"))
    return d.groupBy("source").agg(F.count(F.when(F.trim(F.coalesce(F.nullif(final, F.lit("")), "text", F.lit(""))) != "", 1)).alias("with_text"), F.count(F.when(F.col("state") == "aprobado", 1)).alias("approved"))


@query("SELECT user_id, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS mean_click, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, count(CASE WHEN value > 50 THEN 1 END) AS warnings, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY user_id")
def metrics(spark, sf_dir):
    click = F.col("event_type") == "click"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(F.when(click, F.col("value"))), 6).alias("mean_click"), F.count(F.when(click, 1)).alias("clicks"), F.count(F.when(F.col("value") > 50, 1)).alias("warnings"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("SELECT c_custkey, count(o_orderkey) AS blocks, round(coalesce(sum(o_totalprice), 0), 2) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS approved, round_even(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / greatest(count(o_orderkey), 1) * 100, 1) AS percent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def kpis(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("blocks"), F.sum("o_totalprice").alias("total"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("approved"))
    j = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0)
    return j.select("c_custkey", "blocks", F.round("total", 2).alias("total"), "approved", D.percent(F.col("approved"), F.col("blocks")).alias("percent"))


@query("""WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS topics, min(l_linestatus) AS status FROM lineitem GROUP BY 1)
SELECT o_custkey, o_orderkey, 'B' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS label, coalesce(topics, 0) AS topics, coalesce(status, 'pendiente') AS state FROM orders LEFT JOIN l USING (o_orderkey)""")
def curriculum_map(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("topics"), F.min("l_linestatus").alias("status"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(lines, "o_orderkey", "left")
    label = F.concat(F.lit("B"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    return o.select("o_custkey", "o_orderkey", label.alias("label"), F.coalesce("topics", F.lit(0)).alias("topics"), F.coalesce("status", F.lit("pendiente")).alias("state"))


@query(f"WITH {_STATES} SELECT doc_id, coalesce(state, 'pendiente') AS state FROM documents LEFT JOIN s USING (doc_id)")
def block_states(spark, sf_dir):
    return D.with_default_state(table(spark, sf_dir, "documents").select("doc_id"), _states(spark, sf_dir), "doc_id")


@query("SELECT c_custkey, event_id, value, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY ts DESC, event_id DESC) AS INTEGER) AS recent FROM events JOIN customer ON user_id = c_custkey WHERE value > 20")
def warnings_feed(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value > 20").select(F.col("user_id").alias("c_custkey"), "event_id", "ts", "value")
    j = e.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return j.withColumn("recent", F.row_number().over(W.partitionBy("c_custkey").orderBy(F.desc("ts"), F.desc("event_id")))).drop("ts")


@query("SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS reasoning, 9 AS version FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority, 9 FROM orders WHERE o_orderstatus <> 'F'")
def evolve_schema(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    defaults = {"reasoning": F.lit(None).cast("string"), "version": F.lit(9)}
    old = D.evolve_schema(o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), defaults)
    new = D.evolve_schema(o.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("reasoning")), defaults)
    return old.unionByName(new, allowMissingColumns=True)


@query("""SELECT 'enum_status' AS rule, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL
UNION ALL SELECT 'fk_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'not_null_name', count(*) FROM part WHERE p_name IS NULL
UNION ALL SELECT 'range_quantity', count(*) FROM lineitem WHERE l_quantity < 1 OR l_quantity > 40
UNION ALL SELECT 'unique_line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)""")
def constraint_report(spark, sf_dir):
    o, line, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return D.violations({
        "enum_status": o.filter(~F.col("o_orderstatus").isin("F", "O") | F.col("o_orderstatus").isNull()),
        "fk_customer": o.select("o_custkey").filter("o_custkey is not null").join(customers, "o_custkey", "left_anti"),
        "not_null_name": part.filter("p_name is null"),
        "range_quantity": line.filter("l_quantity < 1 or l_quantity > 40"),
        "unique_line": line.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1"),
    })
