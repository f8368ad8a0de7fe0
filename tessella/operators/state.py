"""Relational state: upserts, removal of duplicates, folding of action logs, progress and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def dedupe_keep_latest(df: DataFrame, keys: list[str], id_: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the largest id of each key, and a map old id -> kept id for those that go."""
    kept = df.groupBy(*keys).agg(F.max(id_).alias("kept"))
    joined = df.join(kept, keys)
    return joined.filter(F.col(id_) == F.col("kept")).drop("kept"), joined.filter(F.col(id_) != F.col("kept")).select(F.col(id_).alias("old"), "kept")


def repoint(children: DataFrame, moved: DataFrame, column: str) -> DataFrame:
    """children with column pointing to the kept ids of moved(old, kept)."""
    joined = children.join(moved, children[column] == moved["old"], "left")
    return joined.withColumn(column, F.coalesce("kept", column)).drop("old", "kept")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """target with changes inserted or put in place of rows with the same keys; the change with the largest order wins, and a
    column that a change leaves null keeps its value. One aggregation: maxima of (order, value) over values that are there."""
    columns = [c for c in target.columns if c not in keys]
    lowest = target.withColumn("__rank", F.lit(0)).unionByName(changes.select(target.columns).withColumn("__rank", F.lit(1)))
    at = F.struct("__rank", order)
    return lowest.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def insert_ignore(target: DataFrame, names: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The names to add - not blank, not there yet, once each - and the rejected ones with their reason."""
    there = target.select(F.col(name)).distinct().withColumn("there", F.lit(True))
    first = names.groupBy(name).agg(F.count("*").alias("times"))
    joined = first.join(there, name, "left")
    reason = F.when(F.col(name).isNull() | (F.trim(name) == ""), "blank").when(F.col("there"), "exists")
    marked = joined.withColumn("reason", reason)
    return marked.filter("reason is null").select(name), marked.filter("reason is not null").select(name, "reason", "times")


def fold_state(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """log(key, order, action, text, score) -> the current row of each key. draft and regenerate set the draft, and regenerate
    clears what came before it; edit sets the final text; approve sets the score, kept within 1 to 10."""
    by = W.partitionBy(key).orderBy(*order)
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    eras = log.withColumn("era", F.sum(F.when(F.col("action") == "regenerate", 1).otherwise(0)).over(upto)).withColumn("at", F.struct(*order))
    last = eras.groupBy(key).agg(F.max("era").alias("era"))
    now = eras.join(last, [key, "era"])
    a = F.col("action")
    state = F.max_by(F.when(a == "approve", "aprobado").when(a == "edit", "editado").otherwise("generado"), "at")
    return now.groupBy(key).agg(
        state.alias("state"),
        F.max_by("text", F.when(a.isin("draft", "regenerate"), F.col("at"))).alias("draft"),
        F.max_by("text", F.when(a == "edit", F.col("at"))).alias("final"),
        F.max_by(F.greatest(F.lit(1), F.least(F.lit(10), F.col("score"))), F.when(a == "approve", F.col("at"))).alias("score"),
    )


def append_with_order(existing: DataFrame, new: DataFrame, parent: str, order: str, by: list[str]) -> DataFrame:
    """new with its next order numbers after the largest one of its parent, from 0."""
    most = existing.groupBy(parent).agg(F.max(order).alias("__most"))
    n = F.row_number().over(W.partitionBy(parent).orderBy(*by))
    return new.withColumn("__n", n).join(most, parent, "left").withColumn(order, F.coalesce("__most", F.lit(-1)) + F.col("__n")).drop("__n", "__most")


def replace_subtree(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """children without those of the parents in new, and new."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def progress(items: DataFrame, states: DataFrame, group: list[str], key: str) -> DataFrame:
    """Per group: total, approved and percent (half-even to one place) of items whose state is aprobado."""
    joined = items.select(*group, key).join(states.select(key, "state"), key, "left")
    done = F.count(F.when(F.col("state") == "aprobado", 1))
    return joined.groupBy(*group).agg(F.count("*").alias("total"), done.alias("approved")).withColumn("percent", percent(F.col("approved"), F.col("total")))


def percent(part: Column, whole: Column) -> Column:
    return F.bround(part / F.greatest(whole, F.lit(1)) * 100, 1)


def with_default_state(items: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """items with their state, pendiente where none is known."""
    return items.join(states.select(key, "state"), key, "left").withColumn("state", F.coalesce("state", F.lit("pendiente")))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """rule, n: how many rows break each rule; each check is the DataFrame of its offenders."""
    parts = [bad.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, bad in sorted(checks.items())]
    return reduce(DataFrame.unionByName, parts)


def evolve_schema(old: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """old with the columns it lacks, at their defaults; columns that are there stay."""
    return old.withColumns({c: v for c, v in defaults.items() if c not in old.columns})
