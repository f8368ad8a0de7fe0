"""Fragments at anchors, against following the topics one by one."""

import difflib
import random
import re

import pytest

from tessella.operators import anchors as A


def key(s):
    import unicodedata

    s = "".join(c for c in unicodedata.normalize("NFD", (s or "").lower()) if unicodedata.category(c) != "Mn")
    return re.sub(r"[^a-z0-9 ]", " ", s).strip()


def score(name, evidence, heading, level):
    a, b = key(name), key(heading)
    if not a:
        return 0.0
    base = difflib.SequenceMatcher(None, a, b).ratio()
    m = re.match(r"secci[oó]n\s+([\d.]+)", (evidence or "").strip(), re.I)
    bonus = (0.15 if a in b or b in a else 0) + (0.15 if m and re.match(re.escape(m[1]) + r"\b", heading) else 0)
    return min(1.0, base + bonus + (({1: 0.1, 3: 0.05}.get(level, 0)) if base > 0.6 else 0))


def follow(text, topics, least):
    """start, end, anchor, score and confidence of each topic."""
    text = (text or "").strip()
    theme = None
    if text.startswith("---") and len(text.split("---", 2)) == 3:
        m = re.search(r"^tema_detectado: *(.*)$", text.split("---", 2)[1], re.M)
        theme, text = m and m[1], text.split("---", 2)[2].lstrip("\n")
    heads, at = [], 0
    for line in text.split("\n"):
        m = re.match(r"^(#{1,4})\s+(.+)$", line.strip())
        if m:
            level, h = len(m[1]), m[2].strip()
            if not (level == 1 and theme and key(h) == key(theme)) and key(h) != "notas del presentador" and not (level == 2 and key(h) in {key(s) for s in A.STANDARD}):
                heads.append((at, level, h))
        at += len(line) + 1
    last, found = -1, []
    for name, evidence in topics:
        best = max(((score(name, evidence, h, n), -p, h) for p, n, h in heads if p > last), default=(0, 0, None))
        if best[0] >= least:
            last = -best[1]
            found.append((last, best[2], best[0]))
        else:
            found.append((None, None, 0.0))
    n, size = len(topics), len(text)
    known = [f[0] for f in found]
    if all(k is None for k in known):
        starts = [0] * n
    else:
        known[0] = known[0] or 0
        starts, marks = [], [i for i in range(n) if known[i] is not None]
        for i in range(n):
            lo = max(m for m in marks if m <= i)
            hi = min((m for m in marks if m >= i), default=None)
            if hi is not None:
                starts.append(known[lo] + (known[hi] - known[lo]) * (i - lo) // max(1, hi - lo))
            else:
                starts.append(starts[-1] + (size - known[lo]) * (i - lo) // (n - lo))
    level = lambda f: "sin_ancla" if f[0] is None else "alta" if f[2] >= 0.78 else "media" if f[2] >= 0.65 else "baja"
    return [(starts[i], max(starts[i], starts[i + 1] if i + 1 < n else size), found[i][1], round(found[i][2], 3), level(found[i])) for i in range(n)]


@pytest.mark.parametrize("least", [0.78, 0.5])
def test_random_blocks(spark, least):
    rng = random.Random(6)
    names = ["Ejes y árboles", "2.1 Ejes lisos", "Soldadura", "Soldadura por arco", "Uniones", "Resumen", "Notas del presentador", "Tornillos", "Cojinetes de bolas"]
    docs, topics = [], []
    for d in range(30):
        lines = [rng.choice(["texto", "", f"{'#' * rng.randint(1, 5)} {rng.choice(names)}", "más texto aquí"]) for _ in range(rng.randint(0, 14))]
        front = rng.choice(["", "", f"---\ntema_detectado: {rng.choice(names)}\n---\n"])
        docs.append((d, rng.choice([front + "\n".join(lines)] * 5 + [None, "  "])))
        topics += [(d, k, rng.choice([*names, "Nada", "soldadura arco"]), rng.choice([None, "Sección 2.1", "—"])) for k in range(rng.randint(0, 5))]
    d, t = spark.createDataFrame(docs, "doc int, markdown string"), spark.createDataFrame(topics, "doc int, ord int, name string, evidence string")
    made = A.split_at_anchors(d, t, "doc", least=least)
    got = {(r["doc"], r["ord"]): r for r in made.collect()}
    assert len(got) == len(topics)
    for number, text in docs:
        own = [(n, e) for k, _, n, e in topics if k == number]
        for k, want in enumerate(follow(text, own, least)):
            r = got[number, k]
            assert (r["start"], r["end"], r["anchor"], r["confidence"]) == (want[0], want[1], want[2], want[4])
            assert r["score"] == pytest.approx(want[3], abs=1.1e-3)
    summary = {r["doc"]: r for r in A.split_summary(made, d, "doc").collect()}
    assert len(summary) == 30 and all(summary[k]["review"] and summary[k]["score"] == 0 for k in range(30) if not any(t[0] == k for t in topics))


def test_outcomes(spark):
    """Three anchors found; a middle one missing; an introduction joined; a weak one; an empty stretch; a blank text."""
    docs = [(1, "intro\n\n# Ejes\nA\n## Contenido\nB\n# Soldadura\nC\n# Uniones\nD"), (2, "# Ejes\n# Uniones\nD"), (3, " ")]
    topics = [(1, 1, "Ejes", ""), (1, 2, "Soldadura", ""), (1, 3, "Uniones", ""), (2, 1, "Ejes", ""), (2, 2, "Cadenas", ""), (2, 3, "Uniones", ""), (3, 1, "Ejes", "")]
    d, t = spark.createDataFrame(docs, "doc int, markdown string"), spark.createDataFrame(topics, "doc int, ord int, name string, evidence string")
    made = A.split_at_anchors(d, t, "doc")
    got = {(r["doc"], r["ord"]): r for r in made.collect()}
    assert got[1, 1]["markdown"] == "# Ejes\n\nintro\n\n# Ejes\nA\n## Contenido\nB" and not got[1, 1]["review"] and got[1, 3]["markdown"] == "# Uniones\n\n# Uniones\nD"
    assert [got[2, k]["confidence"] for k in (1, 2, 3)] == ["alta", "sin_ancla", "alta"]
    assert got[2, 2]["warnings"] == ["No se localizó título para «Cadenas»; contenido inferido por posición."]
    assert got[3, 1]["markdown"] == "# Ejes\n\n*Sin contenido.*" and got[3, 1]["warnings"] == ["El markdown del bloque está vacío."]
    summary = {r["doc"]: (r["n"], r["score"], r["review"]) for r in A.split_summary(made, d, "doc").collect()}
    assert summary == {1: (3, 1.0, False), 2: (3, 0.667, True), 3: (1, 0.0, True)}
    weak = A.split_at_anchors(d.filter("doc = 2"), t.filter("doc = 2 and ord = 2").replace("Cadenas", "Unir"), "doc", least=0.5).first()
    assert weak["confidence"] == "baja" and weak["warnings"][0].startswith("Coincidencia débil (0.") and weak["review"]
