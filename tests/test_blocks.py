"""Similarity by matching blocks: the kernel against the standard library, and what is built on it."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tessella import sources as S
from tessella.functions import blocks
from tessella.functions import text as T
from tessella.operators import assembly as A
from tessella.operators import matching as M
from tessella.operators import quality as Q


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def some_text(rng):
    letters = rng.choice(["ab", "abc", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz  éñ𝄞"])
    return "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 10, 30, 150, 199, 200, 260, 600])))


def changed(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 8)):
        at = rng.randint(0, len(s))
        if rng.random() < 0.5:
            s[at:at] = list(some_text(rng)[: rng.randint(0, 20)])
        else:
            del s[at : at + rng.randint(0, 9)]
    return "".join(s)


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_kernel(monkeypatch, chunk):
    """1000 pairs, at once and in strips of a few places."""
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    rng = random.Random(chunk)
    left = [some_text(rng) for _ in range(1000)]
    right = [changed(rng, a) if rng.random() < 0.6 else some_text(rng) for a in left]
    assert blocks.block_ratios(left, right) == pytest.approx([ratio(a, b) for a, b in zip(left, right, strict=True)], abs=1e-12)


def test_bounds_lose_nothing(spark):
    """Of all pairs of a group exactly those are measured whose lengths and letters allow for the threshold; best as by all pairs."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(1, 9)))
    vocabulary = [word() for _ in range(40)]
    name = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 4)))
    left = [(g, k, name()) for g in "xy" for k in range(40)]
    right = [(g, 100 + k, name()) for g in "xz" for k in range(30)]
    a, b = spark.createDataFrame(left, "g string, a long, a_name string"), spark.createDataFrame(right, "g string, b long, b_name string")
    for least in (0.35, 0.6, 0.85):
        got = {(r["g"], r["a"]): (r["b"], r["how"]) for r in M.fuzzy_best_match(a, b, "g", S.stored, least=least).collect()}
        for g, k, n in left:
            files = [(i, m) for h, i, m in right if h == g]
            best = max(((ratio(n, m), -i) for i, m in files), default=(0, 0))
            if files and best[0] >= least:
                want = (-best[1], "similar")
            else:
                want = (files[k][0] if k < len(files) else files[0][0], "position") if files else (None, None)
            assert got[g, k] == want
    pairs = {(r["name"], r["other"]) for r in M.similar_names(a.filter("g = 'x'").select("g", F.col("a_name").alias("name"), F.lit(0.85).alias("need")).distinct(), b.filter("g = 'x'").select("g", F.col("b_name").alias("other")).distinct(), "g", least=0.0).collect()}
    fits = lambda n, m: not n + m or 2 * sum(min(n.count(c), m.count(c)) for c in set(n)) / len(n + m) >= 0.85
    assert all(fits(n, m) for n, m in pairs)
    assert {(n, m) for g, _, n in left if g == "x" for h, _, m in right if h == "x" and ratio(n, m) >= 0.85} <= pairs


def test_heading_score(spark):
    rows = [("Ejes y árboles", "Sección 2.1", "2.1 Ejes", 3), ("Ejes", "Seccion 2", "2.1 Ejes", 2), ("Ejes", "sección 2", "21 Ejes", 2), ("", None, "Ejes", 1), ("Ejes", None, "", 1), ("Soldadura", "", "Soldadura", 1), ("Tornillos", None, "Tornillo", 3)]
    df = spark.createDataFrame(rows, "t string, e string, h string, n int")
    got = [r[0] for r in df.select(M.heading_score(F.col("t"), F.col("e"), F.col("h"), F.col("n"))).collect()]
    base = [ratio(a, b) for a, b in (("ejes y arboles", "2 1 ejes"), ("ejes", "2 1 ejes"), ("ejes", "21 ejes"))]
    assert got == pytest.approx([base[0] + 0.15, base[1] + 0.30, base[2] + 0.15, 0.0, 0.15, 1.0, 1.0])


def test_edit_percentage(spark):
    rows = [("a b c", " a b c\n"), ("abcd", "abxd"), ("", ""), ("abc", None), (None, "abc"), ("x" * 5000, "x" * 5000 + "y" * 5000)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(Q.edit_percentage(F.col("a"), F.col("b"))).collect()] == [0.0, 25.0, 0.0, 100.0, None, 33.3]


def test_headings_by_fold(spark):
    elements = spark.createDataFrame([(1, 0, "GESCHSS.", "x+y"), (1, 1, "geschß.", "x+y"), (1, 2, None, "none")], "doc int, element int, heading string, expression string")
    sections = spark.createDataFrame([(1, 1, "A", "x+y"), (1, 2, "Geschß.", "x+y"), (1, 3, "B", "")], "doc int, section_no int, title string, body string")
    assert sorted((r[1], r[2]) for r in A.place_equations(elements, sections, "doc").collect()) == [(0, 2), (1, 2), (2, 3)]


def test_title_key(spark):
    assert spark.range(1).select(T.title_key(F.lit(" Ár-bol  N.º 2 "))).first()[0] == "ar bol  n   2"


def test_evidence_of_open_names(spark):
    """Names are compared only where a key is missing, and once for all blocks; a known key without evidence is not missing."""
    from pyspark.sql import functions as F

    from tessella import sources as S
    from tessella.operators import matching as M

    t = spark.createDataFrame([(b, k, n, e) for b in range(6) for k, (n, e) in enumerate([("Ejes lisos", "—"), ("Ejes lisas", None), ("Uniones", "visto"), ("...", ""), ("Nada", "")])], "b int, k int, name string, evidence string")
    f = spark.createDataFrame([(b, n, e, p) for b in range(5) for n, e, p in [("ejes lisos", "vieja", 1), ("1. Ejes lisos", "nueva", 2), ("ejes lisox", "otra", 3), ("nada", None, 4), ("nade", "x", 5)]], "b int, name string, evidence string, pos int")
    tables = []
    made = M.enrich_evidence(t, f, "b", store=lambda df: tables.append(S.stored(df)) or tables[-1])
    got = {(r["b"], r["k"]): (r["evidence"], r["origin"]) for r in made.collect()}
    full = {0: ("nueva", "Detectado"), 1: ("nueva", "Detectado (aprox.)"), 2: ("visto", "Propio"), 3: ("", "Propio"), 4: ("", "Propio")}
    bare = {0: ("—", "Propio"), 1: (None, "Propio"), 2: ("visto", "Propio"), 3: ("", "Propio"), 4: ("", "Propio")}
    assert got == {(b, k): (full if b < 5 else bare)[k] for b in range(6) for k in range(5)}
    each = next(x for x in tables if x.columns == ["name", "other"])
    assert each.count() == 2 and each.filter("name = 'ejes lisas'").count() == 2  # the five blocks' ten pairs
    again = M.enrich_evidence(t.withColumn("key", F.lower("name")), f.withColumn("key", F.lower("name")), "b")
    assert again.filter("origin = 'Detectado'").count() == 5
