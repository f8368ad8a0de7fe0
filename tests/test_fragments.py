"""Placing fragments and figures, against going through the sections one by one."""

import random
import re

from tessella.operators import matching as M


def brute(fragments, sections, nested):
    def end(body, at, level):
        for m in re.finditer(r"^(#{1,6})\s", body, re.M):
            if m.start() >= at and (not nested or len(m.group(1)) <= level):
                return m.start()
        return len(body)

    def spot(body, anchor):
        heads = [(m.end(), len(m.group(1)), m.group(2).strip().lower()) for m in re.finditer(r"^(#{2,4}) +(.+)$", body, re.M)]
        held = [h for h in heads if anchor in h[2]]
        deep = [h for h in held if h[1] >= 3]
        best = next((h for h in deep if h[2] == anchor), deep[0] if deep else None)
        return bool(held), end(body, best[0], best[1]) if best else len(body)

    out = []
    for doc, number, anchor, html in fragments:
        anchor = (anchor or "").strip().lower()
        mine = [s for s in sections if s[0] == doc]
        if not (html or "").strip() or anchor.startswith("[figura:") or not mine:
            continue
        by_title = next((s for s in mine if anchor and (s[2] or "").strip().lower() == anchor), None)
        by_heading = next((s for s in mine if anchor and spot(s[3] or "", anchor)[0]), None)
        if by_title:
            out.append((doc, number, by_title[1], len(by_title[3] or ""), "title"))
        elif by_heading:
            out.append((doc, number, by_heading[1], spot(by_heading[3], anchor)[1], "heading"))
        else:
            out.append((doc, number, mine[-1][1], len(mine[-1][3] or ""), "last"))
    return sorted(out)


def test_nested_headings(spark):
    rng = random.Random(4)
    names = ["Ejes", "ejes lisos", "Árbol", "Ab", "a", "Soldadura por arco", "arco"]
    sections, fragments = [], []
    for doc in range(12):
        for k in range(rng.randint(0, 4)):
            lines = [rng.choice(["texto", "", f"{'#' * rng.randint(1, 6)} {rng.choice(names)}", "#nada"]) for _ in range(rng.randint(0, 9))]
            sections.append((doc, k, rng.choice([*names, None]), rng.choice(["\n".join(lines), "\n".join(lines), None])))
        fragments += [(doc, k, rng.choice([*names, "ARCO ", "x", "", None, "[FIGURA: Ejes]"]), rng.choice(["<p>", "<p>", " ", None])) for k in range(14)]
    f = spark.createDataFrame(fragments, "doc int, fragment int, anchor string, html string")
    s = spark.createDataFrame(sections, "doc int, section_no int, title string, body string")
    for nested in (False, True):
        got = sorted((r["doc"], r["fragment"], r["section_no"], r["offset"], r["how"]) for r in M.place_fragments(f, s, "doc", nested=nested).collect())
        assert got == brute(fragments, sections, nested)
    assert M.place_fragments(f.limit(0), s, "doc").count() == 0


def test_figures(spark):
    rows = [(1, 1, 5, "[FIGURA: Eje]", "<a>"), (1, 2, 5, "[figura:Eje ]", "<b>"), (1, 3, 1, "[FIGURA: Eje]", "<c>"), (1, 4, None, "[FIGURA: Otro]", "<d>"), (1, 5, 9, "[FIGURA: Otro]", "  "), (1, 6, 9, "Eje", "<e>"), (2, 7, 0, "[FIGURA: Eje]", "<f>"), (2, 8, 0, None, "<g>")]
    df = spark.createDataFrame(rows, "doc int, fragment int, ord int, anchor string, html string")
    assert sorted(tuple(r) for r in M.figure_overrides(df, "doc").collect()) == [(1, "Eje", 2), (1, "Otro", 4), (2, "Eje", 7)]
