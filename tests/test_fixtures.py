"""Small cases of the operators' rules, as inline tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessella import sources as S
from tessella.functions import text as T
from tessella.operators import assembly, cleaning, guides, matching, quality, state, structure


def lines(spark, sections):
    """A document of sections, each a list of lines."""
    rows = [("d", s, n, x) for s, part in enumerate(sections) for n, x in enumerate(part)]
    return spark.createDataFrame(rows, "doc string, section int, line_no int, line string")


def cleaned(df, **how):
    return "\n".join(r["text"] for r in cleaning.clean_corpus(df, "doc", "section", **how).orderBy("section").collect())


def test_repeated_titles(spark):
    page = lambda p: lines(spark, [[f"{p}Elementos de Máquinas", f"Contenido técnico de la diapositiva {i}."] for i in range(1, 9)])
    assert cleaned(page("### ")).count("Elementos de Máquinas") == 8
    assert "Elementos de Máquinas" not in cleaned(page(""))
    assert cleaned(page(""), light=True).count("Elementos de Máquinas") == 8


def test_page_numbers_and_markers(spark):
    out = cleaned(lines(spark, [["Texto útil.", "42"], ["Más texto.", "43"]]))
    assert "42" not in out and "Texto útil." in out
    assert cleaned(lines(spark, [["[ECUACION_PARCIAL: F = mu N]", f"Párrafo explicativo número {i}"] for i in range(6)])).count("ECUACION_PARCIAL") == 6


def test_equation_shard(spark):
    out = cleaned(lines(spark, [["n e d s a u q R F = m u N", "Un párrafo completo que explica la fuerza de rozamiento."]]))
    assert out.startswith("[ECUACION_") and "Un párrafo completo" in out


def test_glyph_headers(spark):
    out = cleaned(lines(spark, [["s a", "n i", "uq", f"## Título {i}", f"Cuerpo de la página número {i}."] for i in range(10)]), light=True)
    assert "s a" not in out.split("\n") and out.count("Cuerpo") == 10 and out.count("## Título") == 10
    rare = cleaned(lines(spark, [["xy", "Texto largo"] if i < 2 else ["Texto largo"] for i in range(10)]), light=True)
    assert rare.count("xy") == 2


def test_empty_section_is_unreadable(spark):
    assert cleaned(lines(spark, [["7"], ["Texto"]])).startswith("[TEXTO_ILEGIBLE]")


def test_sections_and_lines(spark):
    d = spark.createDataFrame([("a", "[PAGINA 3]\r\nuno\r\n[SLIDE 4]\ndos"), ("b", "sin marcas"), ("c", None)], "doc string, text string")
    assert [(r["doc"], r["page"]) for r in S.explode_sections(d).orderBy("doc", "section_no").collect()] == [("a", 3), ("a", 4), ("b", None)]
    got = S.explode_lines(d, "doc").filter("doc = 'a'").orderBy("line_no").collect()
    assert [(r["start"], r["end"], r["line"]) for r in got] == [(0, 10, "[PAGINA 3]"), (11, 14, "uno"), (15, 24, "[SLIDE 4]"), (25, 28, "dos")]


def test_materials_with_reasons(spark):
    m = spark.createDataFrame([("g", 2, "b"), ("g", 1, "a"), ("g", 3, None), ("g", 4, " ")], "g string, o int, text string")
    whole, bad = S.concat_materials(m, "g", "o")
    assert whole.first()["text"] == "a\n\nb" and {(r["o"], r["reason"]) for r in bad.collect()} == {(3, "no_encontrado"), (4, "sin texto")}


@pytest.mark.parametrize(("name", "good"), [("Engranajes rectos", True), ("Evaluación", False), ("Además de lo anterior", False), ("12 34 56", False), ("Relación entre presión y temperatura en", False), ("L", False), ("Requisitos", False)])
def test_valid_topic(spark, name, good):
    assert spark.range(1).select(structure.valid_topic(F.lit(name)).alias("v")).first()["v"] is good


def test_numbered_lines(spark):
    rows = [("d", i, x) for i, x in enumerate(["1.1 Introducción general", "1.2 Engranajes", "1.3 Además se observa", "Figura 4.5 Esquema", "2.1 Figura del plano", "1.2 Engranajes rectos y helicoidales", "0.1 Portada"])]
    got = structure.numbered_candidates(spark.createDataFrame(rows, "doc string, line_no int, line string"), "doc").orderBy("line_no").collect()
    assert [(r["prefix"], r["name"]) for r in got] == [("1.1", "Introducción general"), ("1.2", "Engranajes rectos y helicoidales")]


def test_progress(spark):
    items = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(10, 14)] + [("c", 20)], "g string, k int")
    states = spark.createDataFrame([(0, "aprobado"), (10, "aprobado"), (11, "aprobado"), (12, "editado")], "k int, state string")
    assert {r["g"]: r["percent"] for r in state.progress(items, states, ["g"], "k").collect()} == {"a": 33.3, "b": 50.0, "c": 0.0}


def test_fold_state(spark):
    log = [(1, 1, "draft", "a", None), (1, 2, "edit", "b", None), (1, 3, "approve", None, 12.0), (2, 1, "draft", "a", None), (2, 2, "approve", None, 7.0), (2, 3, "regenerate", "c", None)]
    got = {r["k"]: r.asDict() for r in state.fold_state(spark.createDataFrame(log, "k int, t int, action string, text string, score double"), "k", ["t"]).collect()}
    assert got[1] == {"k": 1, "state": "aprobado", "draft": "a", "final": "b", "score": 10.0}
    assert got[2] == {"k": 2, "state": "generado", "draft": "c", "final": None, "score": None}


def test_upsert_keeps_what_changes_leave_null(spark):
    target = spark.createDataFrame([(1, 10, "a", "x"), (2, 11, "b", "y")], "k int, at int, p string, q string")
    changes = spark.createDataFrame([(1, 1, "c", None), (3, 2, "d", None), (3, 3, None, "z")], "k int, at int, p string, q string")
    got = {r["k"]: (r["p"], r["q"]) for r in state.upsert(target, changes, ["k"], "at").collect()}
    assert got == {1: ("c", "x"), 2: ("b", "y"), 3: ("d", "z")}


def test_hours_are_normalized(spark):
    t = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 3.0), ("b", 1, 0.0), ("b", 2, 0.0), ("c", 1, 10.0)], "d string, i int, h double")
    got = {(r["d"], r["i"]): r["new_hours"] for r in quality.normalize_hours(t, "d", "h", ["i"], total=10.0).collect()}
    assert sum(v for (d, _), v in got.items() if d == "a") == 10.0 and got["a", 1] == 3.0 and got["b", 1] == 5.0 and got["c", 1] == 10.0


def test_fidelity_and_markers(spark):
    p = spark.createDataFrame([(1, "fuerza de rozamiento dinamico", "La fuerza y el rozamiento dinámico"), (2, "de la", "nada"), (3, "engranaje helicoidal", "otra cosa")], "i int, s string, o string")
    got = {r["i"]: (r["score"], r["passed"]) for r in quality.fidelity(p, "s", "o").collect()}
    assert got == {1: (1.0, True), 2: (1.0, True), 3: (0.0, False)}
    m = spark.createDataFrame([("[ECUACION_RECONSTRUIDA: a] [ECUACION_RECONSTRUIDA: b] [ECUACION] [TEXTO_ILEGIBLE]",)], "text string")
    r = quality.count_markers(m).first()
    assert (r["reconstructed"], r["problems"], r["review"]) == (2, 2, 2)


def test_curve_jumps(spark):
    curves = {"jump": [(0, 0), (50, 1), (51, 90), (100, 91)], "smooth": [(i, i) for i in range(10)], "flat": [(1, 5)] * 3, "short": [(0, 0), (1, 100)]}
    pts = spark.createDataFrame([(s, float(x), float(y)) for s, c in curves.items() for x, y in c], "s string, x double, y double")
    got = {r["s"]: (r["idx"], r["rule"]) for r in quality.curve_jumps(pts, ["s"]).collect()}
    assert got == {"jump": (2, "vertical")}


def test_markdown_tables_in_three_layouts(spark):
    text = ["## Bloque 1 — Fuerzas · 8h", "| Subtema | Horas | Evidencia | Origen |", "|---|---|---|---|", "| Rozamiento | 4h | p. 2 | Guía |", "## Bloque 2 - Energía • 2,5 h", "| Subtema | Horas | Origen |", "|---|---|---|", "| Trabajo | 2h | Guía |"]
    blocks, topics = quality.markdown_to_blocks(spark.createDataFrame([("d", i, x) for i, x in enumerate(text)], "doc string, line_no int, line string"), "doc")
    assert [(r["no"], r["name"], r["hours"]) for r in blocks.orderBy("no").collect()] == [(1, "Fuerzas", 8.0), (2, "Energía", 2.5)]
    assert [(r["name"], r["evidence"], r["origin"]) for r in topics.orderBy("no", "ord").collect()] == [("Rozamiento", "p. 2", "Guía"), ("Trabajo", "", "Guía")]


def test_greedy_matching_equals_one_after_the_other(spark):
    rng = random.Random(2)
    pairs = [(a, b, rng.randint(0, 5) / 5) for a in range(12) for b in range(12) if rng.random() < 0.5]
    got = {(r["a"], r["b"]) for r in matching.greedy_one_to_one(spark.createDataFrame(pairs, "a int, b int, score double"), S.stored).collect()}
    want, used = set(), (set(), set())
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used[0] and b not in used[1]:
            want.add((a, b)), used[0].add(a), used[1].add(b)
    assert got == want


def test_monotone_anchors_and_fragments(spark):
    s = spark.createDataFrame([("d", 0, 5, 0.9), ("d", 0, 7, 0.9), ("d", 1, 3, 0.99), ("d", 1, 6, 0.8), ("d", 2, 9, 0.5)], "doc string, ord int, pos int, score double")
    assert [(r["ord"], r["pos"]) for r in matching.monotone_anchors(s, "doc").orderBy("ord").collect()] == [(0, 5), (1, 6), (2, None)]
    a = spark.createDataFrame([("d", 0, 10, 100), ("d", 1, None, 100), ("d", 2, 50, 100), ("d", 3, None, 100)], "doc string, ord int, start int, length int")
    starts = assembly.interpolate_starts(a, "doc")
    assert [r["start"] for r in starts.orderBy("ord").collect()] == [10, 30, 50, 75]
    assert [(r["begin"], r["end"]) for r in assembly.split_by_anchors(starts, "doc").orderBy("ord").collect()] == [(0, 30), (30, 50), (50, 75), (75, 100)]


def test_five_guide_layouts(spark):
    text = ["3. Contenidos", "Bloque 1: Fuerzas", "1.1 Rozamiento", "2.- Energía", "2.1 Trabajo", "Tema 3. Calor: Conducción. Convección.", "4. Evaluación", "Bloque 9: no"]
    got = guides.guide_structure(spark.createDataFrame([("d", i, x) for i, x in enumerate(text)], "doc string, line_no int, line string"), "doc")
    assert [(r["block_no"], r["kind"], r["name"]) for r in got.orderBy("block_no", "kind", "ord").collect()] == [(1, "block", "Fuerzas"), (1, "topic", "Rozamiento"), (2, "block", "Energía"), (2, "topic", "Trabajo"), (3, "block", "Calor"), (3, "topic", "Conducción"), (3, "topic", "Convección")]


def test_chunks_lose_nothing(spark):
    rng = random.Random(4)
    text = [" ".join("palabra" * rng.randint(1, 2) for _ in range(rng.randint(1, 300))) + "." for _ in range(30)]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(text)], "doc string, line_no int, line string")
    out = [r["chunk"] for r in assembly.chunk_documents(df, "doc", target_tokens=300).orderBy("chunk_no").collect()]
    assert "".join("".join(out).split()) == "".join("".join(text).split()) and max(map(len, out)) <= 2 * 1200


def test_oversized_paragraphs():
    sentences = ("Una frase corta. " * 100).strip()
    parts = assembly.cut_oversized(sentences, 100, 400)
    assert all(p.endswith("corta.") for p in parts) and " ".join(parts) == sentences
    table = "Antes\n" + "| a | b |\n" * 20 + "Después " * 30
    parts = assembly.cut_oversized(table, 50, 400)
    assert sum("| a | b |" in p for p in parts) == 1 and parts[0].count("| a | b |") in (0, 20)
    assert any("| a | b |" in p for p in assembly.cut_oversized("| a | b |\n" * 20, 50, 60)[1:])  # too long to stay whole
    assert assembly.cut_oversized("x" * 250, 100, 200) == ["x" * 100, "x" * 100, "x" * 50]
    assert assembly.cut_oversized(" \n " * 80, 100, 200) == []


def test_chunks_of_sections(spark):
    """Headers begin chunks, are repeated above the parts of a long section, and short sections are packed."""
    long_ = "\n\n".join(f"Párrafo {k} " + "palabra " * 40 for k in range(12))
    docs = {"a": f"Texto inicial\n# Uno\n{'corto ' * 20}\n# Dos\n{'corto ' * 60}\n# Tres\n{long_}\n# Cuatro\nfin", "b": "solo\n\n" + "p " * 450 + "\n\n" + "q " * 80, "c": "", "d": None}
    lines = [(d, i, x) for d, t in docs.items() for i, x in enumerate((t or "").split("\n"))]
    got = {}
    for r in assembly.chunk_documents(spark.createDataFrame([*lines, ("e", 0, None)], "doc string, line_no int, line string"), "doc", target_tokens=250).orderBy("doc", "chunk_no").collect():
        got.setdefault(r["doc"], []).append(r["chunk"])
    assert set(got) == {"a", "b"}
    first, *middle, last = got["a"]
    assert first.startswith("Texto inicial\n\n# Uno") and "# Dos" in first and last == "# Cuatro\nfin"
    assert len(middle) > 2 and all(c.startswith("# Tres\nPárrafo") and len(c) <= 1000 for c in middle)
    assert "\n\n".join(c.removeprefix("# Tres\n") for c in middle).split() == long_.split()
    assert [c[:4] for c in got["b"]] == ["solo", "q q "] and got["b"][0].endswith("p p")


def test_keys(spark):
    r = spark.range(1).select(T.topic_key(F.lit("3.2. Presión – Éxito")).alias("k"), T.slugify(F.lit("¡Año Nuevo!")).alias("s"), T.slugify(F.lit("--")).alias("e")).first()
    assert (r["k"], r["s"], r["e"]) == ("presion exito", "ano-nuevo", "elemento")


def test_mirrored_lines(spark):
    r = spark.range(1).select(cleaning.mirrored(F.lit("saniuqám ed ametsis le")).alias("a"), cleaning.mirrored(F.lit("el sistema de máquinas")).alias("b"), cleaning.mirrored(F.lit("xyz")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (True, False, False)
