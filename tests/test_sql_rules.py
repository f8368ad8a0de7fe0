"""Queries and their SQL on odd texts, where the engines' own rules differ."""

import difflib
import random

import duckdb
import pytest

import tessella.plans as plans
from tessella.plans import cleaning, ratio_sql


def test_ratio_sql_keeps_stretches_without_agreement():
    """Right strings of 200 letters or more, whose frequent letters begin no block and only extend one."""
    rng = random.Random(3)
    pairs = [("la teoria", "la " + "teoria de las maquinas " * 12), ("aab" * 20, "a" * 240 + "b"), ("e la", "e la " * 50)]
    pairs += [("".join(rng.choice("ab cde") for _ in range(rng.randint(1, 60))), "".join(rng.choice("ab cde") for _ in range(230))) for _ in range(20)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pr (x VARCHAR, y VARCHAR)")
    con.executemany("INSERT INTO pr VALUES (?, ?)", pairs)
    made = {(x, y): r for x, y, r in con.execute(f"WITH RECURSIVE {ratio_sql.ratio('pr')} SELECT x, y, r FROM ratio").fetchall()}
    assert made == {(x, y): pytest.approx(difflib.SequenceMatcher(None, x, y).ratio(), abs=1e-12) for x, y in pairs}


ODD = (
    "5 mñ", "ñ5 kg", "5 kgé", "5 kǵ", "é5 kg", "µ5 kg", "5 kg_", "5 kg", "x 2,5 kPa.", "5 K", "5 Kg", "5 ſ", "5\x0bkg", "5 %", "5 % x", "5 %é", "5%ñ", "5 % ", "5 MıN", "\\ſum", "\\FRAC", "=\x0bx", "= \u0085",
    "\x0b5", "x\x0b", "a \u0085", "a  ", "#  ", "#\x0bx", "#", "[PAGINA 5]\u0085", "[PAGINA 5]  ", "[PAGINA\x0b5]", "[SLIDE 5]", "[TEXTO_ILEGIBLEñ", "[TEXTO_ILEGIBLE]", "[TEXTO_ILEGIBLE", "", "a\rb\r\nc",
)


def test_line_kinds_on_odd_lines(spark, tmp_path):
    """Letters of other alphabets at the ends of numbers and units, and white space that engines take differently."""
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(ODD)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in cleaning.flag_line_kinds(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    made = con.execute(plans.oracle_sql()["flag_line_kinds"]).fetchall()
    assert len(got) == len(ODD) + 2 and got == set(made)
    technical = {i for i, line, *flags in got if flags[0]}
    assert {ODD.index("5 kg"), ODD.index("5 %é"), ODD.index("5 K")} <= technical and not {ODD.index("5 mñ"), ODD.index("ñ5 kg"), ODD.index("5 ſ")} & technical
