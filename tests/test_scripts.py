"""Rules on fragments with scripts: one bad fragment a rule, and the order of rules."""

import pytest
from pyspark.sql import functions as F

from tessella import sources as S
from tessella.operators import scripts as R

INIT, START = "window['initBloque_a.b'] = f;", "addEventListener('DOMContentLoaded', () => window[`initBloque_a.b`]());"
LOOP = "for (let i = 0; i <= 100; i++) { d.push({x: i, y: f(i)}) }"


def page(script, canvas="<canvas>", library="new Chart(c)"):
    return f"{canvas}<script>{INIT} {script} {library} {START}</script></div>"


CASES = [
    ("good", page(LOOP), "una curva", "", ""),
    ("no init", page(LOOP).replace(" = f;", ";"), "una curva", "no_global_init", ""),
    ("other slug", page(LOOP).replace("a.b", "aXb"), "una curva", "no_global_init;no_start", ""),
    ("no start", page(LOOP).replace(START, ""), "una curva", "no_start", ""),
    ("cut", page(LOOP).replace("</script>", ""), "una curva", "script_cut", ""),
    ("first closed, last not", page(LOOP) + "<SCRIPT>", "una curva", "script_cut", ""),
    ("no script", "<p>", "texto", "no_global_init;no_start;script_cut", ""),
    ("broken", page(LOOP + "tension: 0.4.4"), "texto", "", "broken_tension"),
    ("mechanism", page("", "<svg>", ""), "un cilindro", "", ""),
    ("mechanism without svg", page("", "", ""), "un CILINDRO", "", "no_svg"),
    ("mechanism with canvas", page("", "<canvas><svg>", ""), "solo svg", "", "no_chart"),
    ("curve of a cylinder", page("", "<svg>", ""), "curva de un cilindro", "", "no_canvas"),
    ("no canvas", page(LOOP, ""), "haz un plot", "", "no_canvas"),
    ("no chart", page(LOOP, library=""), "haz un plot", "", "no_chart"),
    ("nothing asked", page("", ""), "texto", "", ""),
    ("canvas not asked", page("", library=""), "texto", "", "no_chart"),
    ("no loop", page("type: 'line'"), "haz un plot", "", "no_sampling"),
    ("flat", page("for (;;) { d.push(1) } tension: 0 }"), "una curva", "", "flat_tension"),
    ("flat but dense", page("N = 80; for (;;) { d.push(1) } tension: 0 }"), "una curva", "", ""),
    ("flat but long", page("for (i = 0; i <= 120; i++) { d.push(1) } tension: 0,"), "una curva", "", ""),
    ("few", page("data = [{x: 1, y: 2.5e1}]"), "haz un plot", "", "few_points"),
    ("no push", page("for (;;) {} datasets data:"), "una curva", "", "no_push"),
    ("nan", page(LOOP + "y =NaN;"), "una curva", "", "not_finite"),
    ("infinity", page(LOOP + "[1, Infinity]"), "una curva", "", "not_finite"),
    ("exponent", page(LOOP + "y = a - K * Math.pow(d, p.n); n: 0.5"), "una curva", "", "low_exponent"),
    ("exponent of one", page(LOOP + "y = a - K * Math.pow(d, p.n); n: 1.0; n: 0.5"), "una curva", "", ""),
    ("exponent of no number", page(LOOP + "y = a - K * Math.pow(d, p.n); n: 0.5.1"), "una curva", "", ""),
    ("jump", page("for (;;) {}" + "".join(f"d.push({{x: {x}, y: {y}}});" for x, y in ((0, 0), (50, 10), (51, 90), (100, 100)))), "una curva", "", "vertical"),
    ("slope", page("for (;;) {}" + "".join(f"d.push({{x: {x}, y: {y}}});" for x, y in ((0, 0), (40, 1), (50, 301), (100, 310)))), "una curva", "", "slope"),
    ("jump in a series", page("for (;;) {} const data_a = []; " + "".join(f"data_a.push({{x: {x}, y: {y}}});" for x, y in ((0, 0), (500, 900), (1000, 1800))) + " const data_b = []; " + "".join(f"data_b.push({{x: {x}, y: {y}}});" for x, y in ((1000, 1800), (1000.5, 1803), (1010, 1804), (1020, 1810)))), "una curva", "", "vertical"),
    ("null", None, None, "no_global_init;no_start;script_cut", ""),
]


def test_each_rule(spark):
    df = spark.createDataFrame([(n, h, "a.b", i, 5) for n, h, i, _, _ in CASES], "id string, html string, slug string, instruction string, series int")
    got = {r["id"]: (r["block"], r["chart"]) for r in R.fragment_rules(df, "id", S.stored).collect()}
    assert got == {n: (b, c) for n, _, _, b, c in CASES}
    at = {r["id"]: (r["series"], r["place"]) for r in R.fragment_rules(df, "id", S.stored).collect()}
    assert at["jump"] == (0, 2) and at["slope"] == (0, 2) and at["jump in a series"] == (2, 1) and at["good"] == (None, None)
    loose = {r["id"]: r["block"] for r in R.fragment_rules(df, "id", S.stored, starts_itself=False).collect()}
    assert loose["no start"] == "" and loose["other slug"] == "no_global_init"
    assert R.fragment_rules(df.limit(0), "id", S.stored).count() == 0


@pytest.mark.parametrize(("text", "mechanism", "chart"), [("SIN GRÁFICA", True, False), ("anima el pistón", True, False), ("pistón en chart.js", False, True), ("representa la tensión", False, True), ("representa algo", False, False), (None, False, False)])
def test_instructions(spark, text, mechanism, chart):
    df = spark.createDataFrame([(text,)], "i string")
    assert tuple(df.select(R.is_mechanism(F.col("i")), R.asks_for_chart(F.col("i"))).first()) == (mechanism, chart)
