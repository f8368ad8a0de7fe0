"""Titles by style: rows with references, margins, noise, and an index page before all else."""

from tessella.operators import structure as O


def words(lines, doc="d"):
    """Rows of (page, top, font, size, line)."""
    return [(doc, page, float(top), float(x), font, size, w) for page, top, font, size, line in lines for x, w in enumerate(line.split())]


BODY = [(1, 300 + 10 * k, "Arial", 10.1, "texto corrido del cuerpo de la pagina") for k in range(6)]
SCHEMA = "doc string, page int, top double, x0 double, font string, size double, text string"


def found(spark, rows, heights=((1, 800.0), (2, 800.0))):
    df = spark.createDataFrame(rows, SCHEMA)
    pages = spark.createDataFrame([("d", p, h) for p, h in heights], "doc string, page int, height double")
    return [(r["title"], r["reference"]) for r in O.visual_title_rows(df, pages, "doc").orderBy("doc", "ord").collect()]


def test_styles_margins_noise(spark):
    lines = [
        *BODY,
        (1, 20, "Arial", 20.0, "Cabecera de pagina"), (1, 790, "Arial", 20.0, "Pie de pagina"),
        (1, 100, "Arial", 14.0, "Ejes y chavetas"), (2, 100, "Arial", 14.2, "EJES y chavetas"), (1, 120, "Arial-Bold", 10.0, "• Uniones soldadas"),
        (1, 130, "Arial-Bold", 8.6, "Demasiado pequeño"), (1, 140, "Arial", 12.0, "No mucho mayor"), (1, 150, "Arial", 14.0, "minúscula inicial"),
        (1, 160, "Arial", 14.0, "Para terminar ahora"), (1, 170, "Arial", 14.0, "Temario"), (1, 180, "Arial", 14.0, "Nota breve:"), (1, 190, "Arial", 14.0, "e transfieren energía"),
        (1, 200, "Arial", 14.0, "Una línea con más de doce palabras que por eso no puede ser título"), (1, 210, "Arial", 14.0, "Tema 3"), (2, 300, "Calibri", 13.0, "Frenos"),
    ]
    mixed = [("d", 1, 220.0, float(x), font, 14.0, w) for x, (font, w) in enumerate([("A", "Mitad"), ("B", "de"), ("A", "cada"), ("B", "estilo")])]
    formulas = [("d", 2, 400.0, float(k), "CambriaMath", 10.0, "x") for k in range(90)]
    assert found(spark, words(lines) + mixed + formulas) == [("Ejes y chavetas", "Visual: «Ejes y chavetas» (p. 1, 14.0pt)"), ("Uniones soldadas", "Visual: «Uniones soldadas» (p. 1, 10.0pt)"), ("Frenos", "Visual: «Frenos» (p. 2, 13.0pt)")]
    # A page of unknown height, and one so low that all is margin.
    assert ("Frenos", "Visual: «Frenos» (p. 2, 13.0pt)") in found(spark, words(lines), heights=((1, 100.0),))
    assert not any(t == "Ejes y chavetas" and "p. 1" in r for t, r in found(spark, words(lines), heights=((1, 100.0),)))


def test_index_page_first(spark):
    lines = [*BODY, (1, 100, "Arial", 14.0, "Introducción general"), (2, 50, "Arial", 20.0, "Índice"), (2, 60, "Arial", 10.1, "Ejes lisos"), (2, 70, "Arial", 10.1, "Chavetas")]
    assert found(spark, words(lines)) == [("Ejes lisos", "Índice: «Ejes lisos» (p. 2)"), ("Chavetas", "Índice: «Chavetas» (p. 2)")]


def test_nothing_to_see(spark):
    assert found(spark, words([(1, 100, "Arial", 14.0, "Pocas palabras")])) == []
    bare = [("d", 1, float(k), 0.0, None, None, "palabra") for k in range(30)]
    assert found(spark, bare) == []
    assert found(spark, words([*BODY, (1, 500, "Arial", 14.0, "Ñu " + "x" * 130)])) == []
