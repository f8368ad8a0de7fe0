"""Fidelity in groups against one pair at a time, against a plain search and against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import tessella.plans as plans
from tessella.functions import text as T
from tessella.functions.tokens import tokens_absent
from tessella.operators import quality as Q


def test_tokens_absent_against_search(spark):
    rng = random.Random(2)
    word = lambda most: "".join(rng.choice("abñ") for _ in range(rng.randint(1, most)))
    rows = [(k, "".join(word(9) for _ in range(rng.randint(0, 40))) if k % 9 else None, " ".join(word(9) for _ in range(rng.randint(0, 12)))) for k in range(200)]
    rows += [(500, "abcde" * 60_000 + "fgh", "abcde deabc cdefgh efghi bcdef"), (501, "abc", None), (502, "", "abcdef a"), (503, "xabcdeyabcdez", "abcdez xabcde abcdex")]
    got = {r["k"]: r["a"] for r in spark.createDataFrame(rows, "k int, t string, l string").select("k", tokens_absent(F.col("t"), F.col("l")).alias("a")).collect()}
    assert got == {k: [i for i, x in enumerate(line.split(" ") if line else []) if x not in (t or "")] for k, t, line in rows}


def test_term_norms_against_ranges(spark):
    """The words of a text are runs of A-Z, a-z, 0-9, _ and À-ÿ, and in their normal forms only a-z and 0-9 stay."""
    rng = random.Random(6)
    chars = [*"abYZ09_ _\n\r\t[]ßłéÉÿŸ×ÀñΣ–😀", "[FIGURA: x]", "[pagina 3]", "[TEXTO_ILEGIBLE]"]
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 40))) for _ in range(300)]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    ranges = F.split(F.regexp_replace(F.regexp_replace("x", T.STRUCTURE_MARKER, " "), "[^A-Za-z0-9_À-ÿ]+", "\n"), "\n")
    slow = F.transform(ranges, lambda t: T.normalize_for_matching(t))
    assert d.filter(T.term_norms(F.col("x")) != slow).count() == 0


def test_groups_against_single_pairs(spark):
    """Parts of any size give what single pairs give; terms count once, with the letters inside them that have no plain form."""
    rng = random.Random(3)
    words = ["rozamiento", "dinámico", "straße", "meßgerät", "fuerza", "fuerzas", "para", "[FIGURA: engranaje]", "helicoidal", "a1b2c3", "de", "hełiço"]
    text = lambda: rng.choice([" ".join(rng.choices(words, k=rng.randint(0, 9))), "".join(rng.choices(words, k=3)), None])
    outputs = [(rng.choice("ab"), k, "s", text()) for k in range(60)] + [("none", 99, "s", "fuerza")]
    sources = [("a", "Rozamiento dinámico, meßgerät straße fuerzas fuerzas para"), ("a", "hełiço helicoidal [FIGURA: engranaje]"), ("b", None), ("c", "fuerza")]
    n = {g: sum(o[0] == g for o in outputs) for g in "abc"}
    o = spark.createDataFrame([(*r, n.get(r[0], 1)) for r in outputs], "g string, doc int, own string, text string, n long")
    s = spark.createDataFrame([(*r, n[r[0]]) for r in sources], "g string, text string, n long")
    pairs = Q.fidelity(o.drop("n").join(s.select("g", F.col("text").alias("source")), "g"), "source", "text")
    columns = ["g", "doc", "own", "n_terms", "score", "passed"]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    want = rows(pairs.withColumns({c: F.when(F.col("source").isNotNull(), F.col(c)) for c in columns[3:]}))
    assert len(want) == 2 * n["a"] + n["b"] and pairs.select("score").distinct().count() > 3
    for together in (1, 7, 256):
        made = Q.fidelity_in_groups(o, s, "g", "doc", "text", "text", together=together)
        assert made.columns == columns and rows(made) == want
    first = pairs.filter("doc = 0 or n_terms > 0").select("source", "text", "missing").collect()
    assert {x for r in first for x in r["missing"]} <= {"Rozamiento", "dinámico", "meßgerät", "straße", "fuerzas", "hełiço", "helicoidal"}


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Many documents that begin alike, some without a key or text, some keys that are there twice."""
    rng = random.Random(4)
    words = ["rozamiento", "dinámico", "meßgerät", "fuerza", "helicoidal", "engranaje", "straße", "de"]
    text = lambda head: head.ljust(40, ".") + " ".join(rng.choices(words, k=rng.randint(0, 12)))
    rows = [(k, f"s{k % 3}", text("The same beginning")) for k in range(2000)] + [(k, "s4", text(f"Other {k // 2}")) for k in range(3000, 3040)]
    rows += [(None, "s1", text("The same beginning")), (None, "s1", text("Other 1500")), (None, "s1", text("No key")), (4000, "s2", None), (4001, "s2", "short"), (4002, "s2", "short"), (4003, "s2", ""), (4004, None, "")]
    rows += [(0, "s5", text("The same beginning")), (0, "s5", text("Other 1501")), (4003, "s5", None)]
    where = tmp_path_factory.mktemp("documents")
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{where}/documents.parquet")
    return str(where)


@pytest.mark.parametrize("hint", ["broadcast", "shuffle_merge"])
def test_query_equals_its_sql(spark, documents, monkeypatch, hint):
    monkeypatch.setattr(Q, "size_hint", lambda *_: hint)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{documents}/documents.parquet/*.parquet'")
    plain = lambda rows: sorted([str(round(v, 9)) if isinstance(v, float) else str(v) for v in r] for r in rows)
    for name in ("fidelity", "fidelity_rollup"):
        assert plain(plans.queries()[name](spark, documents).collect()) == plain(db.execute(plans.oracle_sql()[name]).fetchall())


def test_a_large_group_is_dealt(spark, documents, tmp_path):
    """No task has all documents of a beginning."""
    spark.read.parquet(f"{documents}/documents.parquet").filter("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = plans.queries()["fidelity"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made) > 3 and max(r["count"] for r in made) < sum(r["count"] for r in made) * 0.7
