"""Rules on HTML fragments with a script: whether it starts, is closed, draws what was asked for, and draws a smooth curve.

Every rule is a column; points that a script collects are rows (fragment, series, place, x, y), and jumps are found among them by
windows. Null fragments and instructions are empty ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import curve_jumps

# Words of instructions.
WITHOUT_CHART = ("sin gráfica", "sin grafica", "sin chart", "sin canvas", "sin curva", "no chart", "solo svg")
MECHANISM = (
    "actuador", "cilindro", "émbolo", "embolo", "vástago", "vastago", "mecanismo", "svg", "botón", "boton", "botones", "avanzar", "retroceder",
    "animación", "animacion", "pistón", "piston", "válvula de corredera", "valvula de corredera", "doble efecto", "simple efecto",
)
CURVE = ("curva de", "curva σ", "curva tensión", "curva tension", "curva sn", "curva p-v", "deformación", "deformacion")
CHART = ("gráfic", "grafic", "chart", "diagrama de fase", "trazar", "plot", "frente a", " versus ", " vs ", "tensión-deformación", "tension-deformacion", "σ-ε", "sigma-epsilon")
CHART_LIBRARY = ("chart.js", "chartjs", "new chart")
SHOWN = ("curva", "gráfic", "grafic", "tensión", "tension", "diagrama")
CURVE_ASKED = ("curva", "tensión", "tension", "deformación", "deformacion")
# Patterns of scripts.
READY = r"(?i)addEventListener\(\s*['\"`]DOMContentLoaded['\"`]"
BROKEN_TENSION = r"tension\s*:\s*0\.4\.4|tension\s*:\s*0\.0\.4"
NUMBER = r"[-+]?[\d.eE]+"
LITERAL_POINT = rf"\{{\s*x\s*:\s*{NUMBER}\s*,\s*y\s*:\s*{NUMBER}\s*\}}"
PUSHED_POINT = rf"\.push\s*\(\s*\{{\s*x\s*:\s*({NUMBER})\s*,\s*y\s*:\s*({NUMBER})\s*\}}"
SERIES = r"(?is)const\s+data_\w+\s*=\s*\[\s*\];(.*?)(?=const\s+data_\w+\s*=\s*\[\s*\];|const\s+chart\s*=|new\s+Chart)"
LOOP = r"for\s*\("
NOT_FINITE = r"(?:return|=|,\s*)(?:NaN|Infinity)\b"
FALLING_POWER = r"-\s*(?:\d+\.?\d*|[A-Za-z_][\w.]*)\s*\*\s*Math\.pow\s*\("
EXPONENT = r"-\s*\w+\s*\*\s*Math\.pow\s*\([^)]*,\s*(?:p\.|params\.)?(\w+)"
#: Pushes that are dense, points a loop must have, and literal points that are few.
DENSE, SAMPLED, FEW = 40, 80, 20


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def excludes_chart(instruction: Column) -> Column:
    return _any(F.lower(F.coalesce(instruction, F.lit(""))), WITHOUT_CHART)


def is_mechanism(instruction: Column) -> Column:
    """Whether an animated mechanism is asked for: by exclusion of charts, or by its words without those of curves."""
    low = F.lower(F.coalesce(instruction, F.lit("")))
    return excludes_chart(instruction) | (_any(low, MECHANISM) & ~_any(low, CURVE + CHART_LIBRARY))


def asks_for_chart(instruction: Column) -> Column:
    low = F.lower(F.coalesce(instruction, F.lit("")))
    named = _any(low, CHART + CURVE) | low.contains("curva") | (low.contains("representa") & _any(low, SHOWN))
    return ~is_mechanism(instruction) & named


def last_script_closed(html: Column) -> Column:
    """Whether the last script that opens is closed."""
    tail = F.element_at(F.split(F.lower(html), "<script"), -1)
    return F.lower(html).contains("<script") & tail.contains("</script>")


def block_rules(html: Column, slug: Column, *, starts_itself: bool = True) -> Column:
    """The names of broken rules: no_global_init, no_start (unless something else starts it), script_cut."""
    html = F.coalesce(html, F.lit(""))
    name = F.concat(F.lit("initBloque_"), F.regexp_replace(slug, r"([\\\[\]{}()*+?.^$|\-])", r"\\$1"))
    global_ = F.concat(F.lit(r"window\[\s*['\"`]"), name, F.lit(r"['\"`]\s*\]\s*"))
    rules = [F.when(~F.regexp_like(html, F.concat(global_, F.lit("="))), "no_global_init")]
    if starts_itself:
        rules.append(F.when(~(html.rlike(READY) & F.regexp_like(html, F.concat(global_, F.lit(r"\(")))), "no_start"))
    rules.append(F.when(~last_script_closed(html), "script_cut"))
    return F.array_compact(F.array(*rules))


def count_of(html: Column, piece: str) -> Column:
    return ((F.length(html) - F.length(F.replace(html, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def samples_densely(html: Column) -> Column:
    """Whether a loop evaluates the curve at many points."""
    n = F.expr("try_cast(nullif(regexp_extract(__html, '\\\\bN\\\\s*[:=]\\\\s*(\\\\d+)', 1), '') as double)")
    many = (F.coalesce(n, F.lit(0.0)) >= SAMPLED) | html.rlike(r"<=\s*P\.N|/\s*P\.N") | html.rlike(r"for\s*\([^)]*<=\s*(?:1[0-9]|[2-9]\d)\d")
    return (count_of(html, ".push(") >= DENSE) | (html.rlike(LOOP) & html.contains(".push(") & many)


def low_exponent(html: Column) -> Column:
    """Whether a decay y - K * pow(d, p) names an exponent that is set below 1."""
    names = F.regexp_extract_all(html, F.lit(f"(?U){EXPONENT}"), 1)
    value = lambda n: F.call_function("regexp_extract", html, F.concat(F.lit(r"(?U)\b"), n, F.lit(r"\s*[:=]\s*([\d.]+)")), F.lit(1))
    below = F.exists(names, lambda n: F.coalesce(value(n).try_cast("double") < 1.0, F.lit(False)))
    return html.rlike(FALLING_POWER) & below


def pushed_points(fragments: DataFrame, key: str) -> DataFrame:
    """fragments(key, html) -> key, series, place, x, y: the points that scripts push, in order. Series 0 are all of a fragment;
    from 1 on those of each data_ array, or all again if no array has any. Points that are no numbers are left out."""
    whole = fragments.select(key, F.lit(0).alias("series"), F.col("html").alias("part"))
    arrays = fragments.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(SERIES), 1)).alias("series", "part")).withColumn("series", F.col("series") + 1)
    found = whole.unionByName(arrays).select(key, "series", F.posexplode(F.regexp_extract_all("part", F.lit(PUSHED_POINT), 0)).alias("place", "p"))
    x, y = (F.regexp_extract("p", PUSHED_POINT, n).try_cast("double") for n in (1, 2))
    points = found.select(key, "series", "place", x.alias("x"), y.alias("y")).filter("x is not null and y is not null")
    own = points.filter("series > 0").select(key).distinct()
    alone = points.filter("series = 0").join(own.hint("shuffle_merge"), key, "left_anti").withColumn("series", F.lit(1))
    return points.unionByName(alone)


def fragment_rules(fragments: DataFrame, key: str, store, *, starts_itself: bool = True) -> DataFrame:
    """fragments(key, html, slug, instruction) -> key, block (names of all broken rules of start and end, joined by ;), chart (the
    first broken rule of charts and curves, empty without), series and place of the jump if that is it.

    Chart rules, in order: broken_tension; of a mechanism no_chart, no_svg; else, if a chart is asked for or there is a canvas:
    no_canvas, no_chart, no_sampling, flat_tension, few_points, no_push, not_finite, low_exponent, a jump among all points
    (vertical, slope), a jump within a series. key names a fragment; store writes a table out."""
    f = store(fragments.select(key, F.coalesce("html", F.lit("")).alias("html"), F.coalesce("slug", F.lit("")).alias("slug"), F.coalesce("instruction", F.lit("")).alias("instruction")))
    points = store(pushed_points(f, key))
    jumps = curve_jumps(points, [key, "series"], order="place").select(key, F.struct("series", F.col("idx").alias("place"), "rule").alias("jump"))
    first = jumps.groupBy(key).agg(F.min(F.when(F.col("jump.series") == 0, F.col("jump"))).alias("whole"), F.min(F.when(F.col("jump.series") > 0, F.col("jump"))).alias("part"))
    html, asked = F.col("html"), F.col("instruction")
    j = f.join(first.hint("shuffle_merge"), key, "left").withColumn("__html", html)
    canvas, chart, svg, loop, dense = html.rlike(r"(?i)<canvas\b"), html.contains("new Chart"), html.rlike(r"(?i)<svg\b"), html.rlike(LOOP), samples_densely(html)
    literal = F.regexp_count(html, F.lit(LITERAL_POINT))
    drawn = chart | F.lower(html).contains("<canvas")
    jump = F.coalesce(F.when(drawn, F.col("whole")), F.col("part"))
    curve = html.rlike(r"type\s*:\s*['\"]line['\"]") | _any(F.lower(asked), CURVE_ASKED)
    quality = (
        F.when(html.rlike(r"tension\s*:\s*0(\s*[,}])") & ~dense, "flat_tension")
        .when((literal > 0) & (literal < FEW) & ~loop & ~html.contains(".push("), "few_points")
        .when(loop & ~html.contains(".push(") & html.contains("data:") & html.contains("datasets"), "no_push")
        .when(html.rlike(NOT_FINITE), "not_finite")
        .when(drawn & low_exponent(html), "low_exponent")
        .otherwise(F.coalesce(jump["rule"], F.lit("")))
    )
    mechanism = F.when(canvas & ~chart, "no_chart").when(~svg, "no_svg").otherwise("")
    drawing = F.when(~canvas, "no_canvas").when(~chart, "no_chart").when(curve & ~loop, "no_sampling").otherwise(quality)
    rule = F.when(html.rlike(BROKEN_TENSION), "broken_tension").when(is_mechanism(asked), mechanism).when(asks_for_chart(asked) | canvas, drawing).otherwise("")
    made = j.withColumns({"chart": rule, "jump": jump})
    at = F.when(F.col("chart").isin("vertical", "slope"), F.col("jump"))
    return made.select(key, F.array_join(block_rules(html, F.col("slug"), starts_itself=starts_itself), ";").alias("block"), "chart", at["series"].alias("series"), at["place"].alias("place"))
