"""Queries of assembly. Documents of a source are the items of one document."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import sources as S
from tessella.sources import versions as V
from tessella.operators import assembly as A

from .cleaning import LINES, _lines
from .quality import marked_documents
from .registry import query
from .structure import H2, MD, markdown

_KINDS = ("mixto", "teoria", "procedimiento", "tabla", "ejemplo_resuelto", "ejercicio_propuesto", "resumen")
_KIND_SQL = "['" + "', '".join(_KINDS) + "'][doc_id % 7 + 1]"


def items(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 7 + 1).cast("int"))
    first = F.element_at(F.split("text", "\n"), 1)
    return d.select("source", F.col("doc_id").alias("pos"), kind.alias("kind"), F.when(F.length(first) < 40, first).alias("title"), "lang", F.col("text").alias("body"))


_META = f"""it AS (SELECT source, doc_id AS pos, {_KIND_SQL} AS kind, CASE WHEN length(string_split(text, chr(10))[1]) < 40 THEN string_split(text, chr(10))[1] END AS title, lang, text AS body FROM documents),
la AS (SELECT source, lang FROM (SELECT source, lang, count(*) AS n, min(pos) AS f FROM it WHERE lang IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1),
me AS (SELECT it.source, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixto' ELSE max(kind) END AS kind, coalesce(arg_min(title, pos) FILTER (title IS NOT NULL), 'No detectado') AS title, CASE WHEN any_value(la.lang) IN ('es', 'en') THEN any_value(la.lang) ELSE 'es' END AS lang FROM it LEFT JOIN la USING (source) GROUP BY 1)"""


@query(f"WITH {_META} SELECT * FROM me")
def doc_metadata(spark, sf_dir):
    return A.doc_metadata(items(spark, sf_dir), "source")


@query(f"WITH {MD} SELECT doc_id, md5(string_agg(CASE WHEN starts_with(line, '## ') THEN '#' || line ELSE line END, chr(10) ORDER BY line_no)) AS text_md5 FROM md WHERE NOT starts_with(line, '# ') GROUP BY 1")
def clean_item_headings(spark, sf_dir):
    from tessella.operators.structure import ordered

    return A.clean_item_headings(markdown(spark, sf_dir)).groupBy("doc_id").agg(F.md5(ordered("line_no", "line")).alias("text_md5"))


_NAME = "CASE me.lang WHEN 'en' THEN CASE k WHEN 'teoria' THEN 'Theory' WHEN 'ejemplo_resuelto' THEN 'Solved examples' WHEN 'ejercicio_propuesto' THEN 'Practice problems' WHEN 'tabla' THEN 'Reference tables' WHEN 'procedimiento' THEN 'Procedures' ELSE 'Summary' END ELSE CASE k WHEN 'teoria' THEN 'Contenido teórico' WHEN 'ejemplo_resuelto' THEN 'Ejemplos resueltos' WHEN 'ejercicio_propuesto' THEN 'Ejercicios propuestos' WHEN 'tabla' THEN 'Tablas de referencia' WHEN 'procedimiento' THEN 'Procedimientos' ELSE 'Resumen' END END"
_DOCS = f"""{_META}, bo AS (SELECT source, CASE WHEN kind = 'mixto' THEN 'teoria' ELSE kind END AS k, string_agg(trim(body), chr(10) || chr(10) ORDER BY pos) AS body FROM it WHERE trim(body) <> '' GROUP BY ALL),
pt AS (SELECT source, list_position(['teoria', 'procedimiento', 'tabla', 'ejemplo_resuelto', 'ejercicio_propuesto', 'resumen'], k) AS place, '## ' || {_NAME} || chr(10) || chr(10) || body AS part FROM bo JOIN me USING (source)),
wh AS (SELECT source, string_agg(part, chr(10) || chr(10) || '---' || chr(10) ORDER BY place) AS sections FROM pt GROUP BY 1)"""


def _assembled(spark, sf_dir):
    i = items(spark, sf_dir)
    return A.assemble_sections(i, A.doc_metadata(i, "source"), "source")


@query(f"""WITH {_DOCS} SELECT me.source, md5(concat_ws(chr(10) || chr(10), '---' || chr(10) || 'archivo_origen: ' || me.source || chr(10) || 'tipo_documento: ' || kind || chr(10) || 'tema_detectado: ' || title || chr(10) || 'idioma: ' || lang || chr(10) || '---', CASE WHEN title <> 'No detectado' THEN '# ' || title END, sections)) AS markdown_md5 FROM me LEFT JOIN wh USING (source)""")
def assemble_sections(spark, sf_dir):
    return _assembled(spark, sf_dir).select("source", F.md5("markdown").alias("markdown_md5"))


@query(f"WITH {_META} SELECT source, kind AS tipo_documento, lang AS idioma FROM me")
def front_matter_fields(spark, sf_dir):
    d = _assembled(spark, sf_dir)
    return d.select("source", A.front_matter_field(F.col("markdown"), "tipo_documento").alias("tipo_documento"), A.front_matter_field(F.col("markdown"), "idioma").alias("idioma"))


@query(f"WITH {MD}, x AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM md), y AS (SELECT *, max(CASE WHEN NOT starts_with(line, '## ') AND trim(line) NOT IN ('', '---') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, s) AS r FROM x) SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY line_no)) AS markdown_md5 FROM y WHERE s = 0 OR r = 1 GROUP BY 1")
def remove_empty_sections(spark, sf_dir):
    from tessella.operators.structure import ordered

    return A.remove_empty_sections(markdown(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.md5(ordered("line_no", "line")).alias("markdown_md5"))


@query("SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS ord, max(l_returnflag) AS state, 'Pieza ' || max(l_partkey) AS name, CASE WHEN max(l_linestatus) = 'O' THEN '_Pendiente de generar._' ELSE 'Texto ' || max(l_suppkey) END AS body FROM lineitem GROUP BY ALL")
def delimited_subblocks(spark, sf_dir):
    g = S.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("ord"))
    parts = g.agg(F.max("l_returnflag").alias("state"), F.concat(F.lit("Pieza "), F.max("l_partkey")).alias("name"), F.when(F.max("l_linestatus") == "O", None).otherwise(F.concat(F.lit("Texto "), F.max("l_suppkey"))).alias("body"))
    return A.read_subblocks(A.write_subblocks(parts, "l_orderkey"), "l_orderkey").select("l_orderkey", "ord", "state", "name", "body")


def _anchors(spark, sf_dir):
    """The lines of a document as topics; those of more than three words have lost their place."""
    lines = S.explode_lines(S.table(spark, sf_dir, "documents"), "doc_id")
    total = S.table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("length"))
    return lines.join(total.hint("shuffle_merge"), "doc_id").select("doc_id", F.col("line_no").alias("ord"), F.when(F.size(F.split("line", " ")) <= 3, F.col("start")).alias("start"), "length")


@query(rf"""WITH {LINES}, o AS (SELECT doc_id, line_no AS ord, line, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 - length(raw) AS s0 FROM (SELECT l.*, l0.raw FROM l JOIN l0 USING (source, doc_id, line_no))),
a AS (SELECT o.doc_id, ord, CASE WHEN len(string_split(line, ' ')) <= 3 THEN s0 END AS s, length(text) AS length, count(*) OVER (PARTITION BY o.doc_id) AS n FROM o JOIN documents d ON o.doc_id = d.doc_id),
w AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER b, 0) AS lo, coalesce(last_value(CASE WHEN s IS NOT NULL THEN ord END IGNORE NULLS) OVER b, -1) AS lo_ord, coalesce(first_value(s IGNORE NULLS) OVER f, length) AS hi, coalesce(first_value(CASE WHEN s IS NOT NULL THEN ord END IGNORE NULLS) OVER f, n) AS hi_ord
  FROM a WINDOW b AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(CASE WHEN s IS NOT NULL THEN s ELSE floor(lo + (hi - lo) * (ord - lo_ord) / (hi_ord - lo_ord)) END AS BIGINT) AS start, CAST(length AS INTEGER) AS length FROM w""")
def interpolate_starts(spark, sf_dir):
    return A.interpolate_starts(_anchors(spark, sf_dir), "doc_id")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS covered FROM documents WHERE text IS NOT NULL")
def split_by_anchors(spark, sf_dir):
    parts = A.split_by_anchors(A.interpolate_starts(_anchors(spark, sf_dir), "doc_id"), "doc_id")
    return parts.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).alias("covered"))


@query("SELECT doc_id, md5(substr(text, 1, 10) || '[a]' || substr(text, 11, 20) || '[b]' || '[c]' || substr(text, 31)) AS text_md5 FROM documents WHERE length(text) >= 30 UNION ALL SELECT doc_id, md5(substr(text, 1, 10) || '[a]' || substr(text, 11) || '[b]' || '[c]') FROM documents WHERE length(text) < 30")
def interleave(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("text").alias("body"))
    spots = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(o).alias("offset"), F.lit(t).alias("piece")) for p, o, t in ((0, 10, "[a]"), (1, 30, "[b]"), (2, 5, "[c]"))])
    pieces = d.select("doc_id", F.explode(spots).alias("s")).select("doc_id", "s.pos", "s.offset", "s.piece")
    return A.interleave(d, pieces, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query()
def split_oversized(spark, sf_dir):
    return A.split_oversized(_lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("no"), F.col("line").alias("text")), "doc_id", most=1000)


@query()
def chunk_documents(spark, sf_dir):
    return A.chunk_documents(_lines(spark, sf_dir), "doc_id")


@query(r"SELECT doc_id, CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS letters, true AS bounded FROM documents WHERE regexp_matches(text, '\S')")
def chunk_invariants(spark, sf_dir):
    """Chunks lose no letter, if headers aren't repeated, and are at most twice the target long."""
    c = A.chunk_documents(_lines(spark, sf_dir), "doc_id", repeat=False)
    return c.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("chunk", r"\s", ""))).alias("letters"), (F.max(F.length("chunk")) <= 2 * 6000).alias("bounded"))


@query("WITH k AS (SELECT doc_id, replace(text, 'les ', '[FIGURA: b] ') AS text FROM documents) SELECT doc_id, 'b' AS figure FROM k WHERE contains(text, '[FIGURA: b]')")
def extract_figures(spark, sf_dir):
    return A.extract_figures(marked_documents(spark, sf_dir), "doc_id").select("doc_id", "figure")


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(span, '[A-Za-zÀ-ÿ]{4,}')) >= 3 THEN 'prose' WHEN regexp_matches(span, '[=+*/^_<>-]') OR contains(span, chr(92)) THEN 'valid' ELSE 'invalid' END AS kind, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(replace(text, 'the ', '$$a = b$$ '), '(?s)\\$\\$(.*?)\\$\\$', 1)) AS span FROM documents) GROUP BY ALL")
def math_spans(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("the "), F.lit("$$a = b$$ ")).alias("text"))
    return A.math_spans(d, "doc_id").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT p_brand, 'p_' || p_size AS symbol, arg_min(p_name, p_partkey) AS description FROM part GROUP BY ALL")
def variable_glossary(spark, sf_dir):
    p = S.table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("line_no"), F.concat(F.lit("| $p_"), "p_size", F.lit("$ | "), "p_name", F.lit(" |")).alias("line"))
    return A.variable_glossary(p, "p_brand")


_ELEMENTS = r"""e AS (SELECT doc_id, 0 AS element, NULL AS heading, string_split(text, ' ')[6] AS expression FROM documents UNION ALL SELECT doc_id, 1, 'no such heading', '$none$' FROM documents
UNION ALL SELECT doc_id, 2 + section_no, upper(title), regexp_split_to_array(body, '\s+')[2] FROM h2 WHERE section_no > 0 AND len(regexp_split_to_array(body, '\s+')) > 1)"""


@query(f"""WITH {MD}, {H2}, {_ELEMENTS}, s AS (SELECT doc_id, section_no, lower(title) AS t, body FROM h2 WHERE section_no > 0 OR body <> ''),
j AS (SELECT e.doc_id, element, section_no, contains(body, expression) AS has, contains(body, expression) AND t = lower(coalesce(heading, '')) AS named FROM e JOIN s USING (doc_id) WHERE expression IS NOT NULL)
SELECT doc_id, CAST(element AS BIGINT) AS element, CAST(section_no AS BIGINT) AS section_no FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, element ORDER BY has DESC, named DESC, CASE WHEN has THEN section_no ELSE -section_no END) = 1""")
def place_equations(spark, sf_dir):
    """Expressions are words of the documents: one of each text, one of each section with its heading, and one that is nowhere."""
    from tessella.operators.structure import split_h2_sections

    s = split_h2_sections(markdown(spark, sf_dir), "doc_id")
    d = S.table(spark, sf_dir, "documents")
    word = F.get(F.split("body", r"\s+"), F.lit(1))
    own = s.filter("section_no > 0").select("doc_id", (F.col("section_no") + 2).cast("long").alias("element"), F.upper("title").alias("heading"), word.alias("expression"))
    one = d.select("doc_id", F.lit(0).cast("long").alias("element"), F.lit(None).cast("string").alias("heading"), F.get(F.split("text", " "), F.lit(5)).alias("expression"))
    none = d.select("doc_id", F.lit(1).cast("long").alias("element"), F.lit("no such heading").alias("heading"), F.lit("$none$").alias("expression"))
    e = own.unionByName(one).unionByName(none).filter("expression is not null")
    return A.place_equations(e, s, "doc_id").select("doc_id", "element", F.col("section_no").cast("long").alias("section_no"))


@query("""WITH d AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL)
SELECT source, md5(string_agg(CASE WHEN r = 1 THEN text ELSE '## ' || doc_id || chr(10) || chr(10) || text END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS markdown_md5 FROM d GROUP BY 1""")
def assemble_multiple(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").filter("text is not null").select("source", "doc_id", F.col("text").alias("markdown"), F.col("doc_id").cast("string").alias("name"))
    return A.assemble_multiple(d, "source", "doc_id", "name").select("source", F.md5("markdown").alias("markdown_md5"))


@query("""WITH b AS (SELECT source, doc_id, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t, CASE WHEN doc_id % 3 = 0 THEN 'Tema' || doc_id ELSE 'Bloque ' || doc_id END AS label FROM documents)
SELECT v AS version, source AS doc, CASE WHEN doc_id % 3 = 0 THEN 'bloque-tema' || doc_id || '.md' ELSE 'bloque-' || doc_id || '.md' END AS file, label, md5(t) AS markdown_md5 FROM b, (SELECT unnest([1, 2]) AS v) WHERE t <> '' AND (v = 1 OR doc_id % 2 = 0)""")
def write_outputs(spark, sf_dir):
    """All documents as one version and those of even number as the next one; both are read again."""
    import uuid

    label = F.concat(F.when(F.col("doc_id") % 3 == 0, "Tema").otherwise("Bloque "), F.col("doc_id").cast("string"))
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("doc"), label.alias("label"), F.col("text").alias("markdown"))
    where = f"{S.shared_folder(spark)}/outputs-{uuid.uuid4().hex}"
    first, second = V.write_version(d, where), V.write_version(d.filter("doc_id % 2 = 0"), where)
    both = V.read_version(spark, where, first).unionByName(V.read_version(spark, where, second))
    return both.select("version", "doc", "file", "label", F.md5("markdown").alias("markdown_md5"))
