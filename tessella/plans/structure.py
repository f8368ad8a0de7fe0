"""Queries of structure, chunking and routing. Short lines of documents serve as headings where Markdown is needed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import sources as S
from tessella.functions import text as T
from tessella.operators import structure as O

from .cleaning import LINES, NORM, _lines
from .registry import query

MD = f"{LINES}, md AS (SELECT doc_id, line_no, CASE WHEN line <> '' AND len(string_split(line, ' ')) <= 3 THEN '## ' || line ELSE line END AS line FROM l)"
H2 = r"""x AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM md),
h2 AS (SELECT doc_id, section_no, coalesce(max(CASE WHEN starts_with(line, '## ') THEN trim(substr(line, 4)) END), 'Introducción') AS title,
  regexp_replace(coalesce(string_agg(CASE WHEN NOT starts_with(line, '## ') AND NOT (section_no = 0 AND starts_with(line, '# ')) THEN line END, chr(10) ORDER BY line_no), ''), '^\s+|\s+$', '', 'g') AS body FROM x GROUP BY ALL)"""


def markdown(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).withColumn("line", F.when((line != "") & (F.size(F.split(line, " ")) <= 3), F.concat(F.lit("## "), line)).otherwise(line))


def words_of(spark, sf_dir):
    """Styled words of documents: a line is a height, a word's place its left edge; short lines are large and bold."""
    lines = _lines(spark, sf_dir).filter("line <> ''").withColumn("w", F.split("line", r"\s+"))
    short = F.size("w") <= 3
    return lines.select("doc_id", F.lit(1).alias("page"), F.col("line_no").cast("double").alias("top"), F.when(short, "Arial-Bold").otherwise("Arial").alias("font"), F.when(short, 10.0 + F.length("line") % 8).otherwise(10.1).alias("size"), F.posexplode("w").alias("x0", "text"))


WORDS = r"""w0 AS (SELECT doc_id, line_no, line, regexp_split_to_array(line, '\s+') AS w FROM l WHERE line <> ''),
wd AS (SELECT doc_id, line_no AS y, len(w) <= 3 AS short, CASE WHEN len(w) <= 3 THEN 10.0 + length(line) % 8 ELSE 10.0 END AS size, CASE WHEN len(w) <= 3 THEN 'Arial-Bold' ELSE 'Arial' END AS font, unnest(w) AS text, generate_subscripts(w, 1) AS x0 FROM w0),
st AS (SELECT doc_id, font, size, count(*) AS n, min((y, x0)) AS first FROM wd GROUP BY ALL), bs AS (SELECT doc_id, font, size FROM st QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1)"""


@query(rf"WITH {MD} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(2 AS INTEGER) AS level, regexp_extract(line, '^#+\s+(.*)$', 1) AS text FROM md WHERE starts_with(line, '## ') AND {NORM.format('substr(line, 4)')} NOT IN ('the', 'on')")
def extract_headings(spark, sf_dir):
    return O.headings(markdown(spark, sf_dir), "doc_id", without=("the", "on")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "level", "text")


@query(f"WITH {MD}, {H2} SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, title, md5(body) AS body_md5 FROM h2 WHERE section_no > 0 OR body <> ''")
def split_h2_sections(spark, sf_dir):
    return O.split_h2_sections(markdown(spark, sf_dir), "doc_id").select("doc_id", "section_no", "title", F.md5("body").alias("body_md5"))


_SECTION = r"""(line <> '' AND (regexp_matches(line, '^\d+(?:\.\d+)*\.?\s+\S') OR regexp_matches(line, '^#{1,6}\s+.*[a-zA-Z]{2,}')
 OR regexp_matches(line, '(?i)^(Chapter|Section|Topic|Tema|Capitulo|Capítulo|Seccion|Sección|Introduccion|Introducción|Introduction|Summary|Resumen|Ejercicios|Exercises|Problems|Ejemplos|Examples)')
 OR (length(line) > 4 AND length(line) < 80 AND line = upper(line) AND NOT contains(line, '=') AND NOT regexp_matches(line, '^\[(?:PAGINA|SLIDE)\s+\d+\]') AND NOT regexp_matches(line, '^#{1,6}\s'))))"""


@query(f"WITH {LINES}, x AS (SELECT doc_id, line_no, line, {_SECTION} AS h, sum(CASE WHEN {_SECTION} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM l), y AS (SELECT doc_id, section_no, max(CASE WHEN h THEN line END) AS header, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM x GROUP BY ALL) SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, header, n_lines, chars FROM y QUALIFY max(section_no) OVER (PARTITION BY doc_id) > 0")
def split_semantic_sections(spark, sf_dir):
    return O.split_semantic_sections(_lines(spark, sf_dir), "doc_id")


@query(f"WITH {MD}, {H2}, k AS (SELECT * FROM h2 WHERE section_no > 0 OR body <> '') SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, lag(title) OVER w AS previous, lead(title) OVER w AS next, row_number() OVER w || ' / ' || count(*) OVER (PARTITION BY doc_id) AS label FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY section_no)")
def section_nav(spark, sf_dir):
    return O.section_nav(O.split_h2_sections(markdown(spark, sf_dir), "doc_id"), "doc_id", "section_no", "title")


@query("SELECT l_orderkey, l_partkey, CASE WHEN n > 1 THEN l_returnflag || ' (' || n || ')' ELSE l_returnflag END AS label FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, l_suppkey, l_linenumber) AS n FROM lineitem)")
def disambiguate_labels(spark, sf_dir):
    return O.disambiguate_labels(S.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["l_partkey", "l_suppkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "label")


@query(rf"WITH {LINES}, c AS (SELECT doc_id, count(*) AS n_lines, count(CASE WHEN len(regexp_split_to_array(line, '\s+')) <= 3 THEN 1 END) AS n_short FROM l WHERE line <> '' GROUP BY 1) SELECT *, n_lines >= 5 AND n_short >= n_lines * 0.1 AS slide_like FROM c")
def detect_slide_like(spark, sf_dir):
    return O.detect_slide_like(_lines(spark, sf_dir), "doc_id", least=5, share=0.1)


@query(f"WITH {LINES}, {WORDS} SELECT doc_id, font, CAST(size AS DOUBLE) AS size FROM bs")
def body_style(spark, sf_dir):
    return O.body_style(words_of(spark, sf_dir), "doc_id")


@query(rf"WITH {LINES} SELECT doc_id, CAST(line_no AS DOUBLE) AS y, regexp_replace(line, '\s+', ' ', 'g') AS line FROM l WHERE line <> ''")
def group_words_into_lines(spark, sf_dir):
    return O.group_words_into_lines(words_of(spark, sf_dir), "doc_id").select("doc_id", "y", "line")


@query(f"WITH {LINES}, {WORDS}, p AS (SELECT DISTINCT wd.doc_id, wd.y, wd.font, wd.size, wd.size / bs.size AS ratio, wd.font <> bs.font OR wd.size <> bs.size AS other FROM wd JOIN bs ON wd.doc_id = bs.doc_id) SELECT doc_id, CAST(y AS DOUBLE) AS y, CASE WHEN ratio >= 1.45 THEN '#' WHEN ratio >= 1.2 THEN '##' ELSE '###' END AS prefix FROM p WHERE other AND (ratio >= 1.2 OR (font = 'Arial-Bold' AND ratio >= 0.9))")
def heading_prefix(spark, sf_dir):
    return O.heading_prefix(words_of(spark, sf_dir), "doc_id").select("doc_id", "y", "prefix")


@query(rf"""WITH a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' AND NOT contains(text, chr(10)) AND length(text) <= 300)
SELECT conv_id, text AS title FROM a WHERE r = 1""")
def slide_titles(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations").select("conv_id", F.lit(0).alias("slide"), F.col("turn").alias("shape_no"), F.lit(False).alias("is_title"), "text")
    return O.slide_titles(c, "conv_id", "slide", longest=300).select("conv_id", "title")


def topic_key_sql(c: str) -> str:
    return NORM.format(rf"regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '^\d+(\.\d+)*\.?\s*', '')")


def valid_topic_sql(c: str) -> str:
    """The rules of a valid topic, for a column c."""
    k = topic_key_sql(c)
    names = lambda values: ", ".join(f"'{v}'" for v in values)
    return f"""(length({k}) >= 4 AND {k} NOT IN ({names(O.ADMIN_EXACT)}) AND NOT regexp_matches({k}, '^({"|".join(O.ADMIN_PREFIXES)})') AND NOT regexp_matches({k}, '^({"|".join(O.PROSE_OPENINGS)})( |$)')
 AND NOT starts_with({k}, 'contexto') AND {k} NOT IN ({names(O.VISUAL_NOISE)}) AND NOT regexp_matches({k}, '{O.COURSE_PART}') AND NOT regexp_matches(replace({k}, ' ', ''), '^[0-9]+$') AND NOT (contains({c}, '/') AND length({k}) < 12) AND len(list_filter(string_split({k}, ' '), lambda x: regexp_matches(x, '[0-9]'))) < 3
 AND NOT (length({k}) <= 80 AND string_split({k}, ' ')[-1] IN ({names(O.FUNCTION_WORDS)})))"""


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE {valid_topic_sql('line')}")
def valid_topic(spark, sf_dir):
    return _lines(spark, sf_dir).filter(O.valid_topic(F.col("line"))).select("doc_id", "line_no", "line")


def numbered_lines(spark, sf_dir):
    """'order.line Part name' lines: a document for each order."""
    parts = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.initcap("p_name").alias("name"))
    items = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct().join(parts, "l_partkey")
    return items.select("l_orderkey", F.col("l_partkey").alias("line_no"), F.concat(F.lit("1."), F.col("l_linenumber"), F.lit(" "), F.col("name")).alias("line"))




NUMBERED_SQL = rf"""n0 AS (SELECT DISTINCT l_orderkey, l_partkey AS line_no, '1.' || l_linenumber AS prefix, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
n1 AS (SELECT *, {topic_key_sql('name')} AS key FROM n0 WHERE {valid_topic_sql('name')} AND NOT regexp_matches(name, '(?i)^(figura|tabla|ecuaci[oó]n|figure|table)\b'))"""


@query(f"WITH {NUMBERED_SQL} SELECT l_orderkey, count(DISTINCT key) AS n_keys FROM n1 GROUP BY 1")
def numbered_candidates(spark, sf_dir):
    """How many different titles each order's numbered lines give: as many as there are keys, whatever number each keeps."""
    once = O.numbered_candidates(numbered_lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", r"^1\.\d+", F.concat(F.lit("1."), F.col("line_no")))), "l_orderkey")
    return once.groupBy("l_orderkey").agg(F.count("*").alias("n_keys"))


@query("WITH n AS (SELECT l_orderkey, count(*) AS raw FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1) SELECT l_orderkey, raw FROM n")
def numbering_quality(spark, sf_dir):
    return O.numbering_quality(numbered_lines(spark, sf_dir), "l_orderkey").select("l_orderkey", "raw")


def _tag_sql(tag: str, strategy: str, priority: int) -> str:
    found = f"regexp_extract_all(html, '(?is)<{tag}>([^<]+)', 1)"
    return f"SELECT page_id, '{strategy}' AS strategy, {priority} AS priority, unnest({found}) AS name, generate_subscripts({found}, 1) - 1 AS pos FROM pages"


@query(f"""WITH c AS ({_tag_sql('h1', 'numeracion', 0)} UNION ALL {_tag_sql('title', 'titulo_slide', 1)} UNION ALL {_tag_sql('p', 'titulo_visual', 2)}), n AS (SELECT *, count(CASE WHEN priority = 0 THEN 1 END) OVER (PARTITION BY page_id) AS numbered, {topic_key_sql('name')} AS key FROM c)
SELECT page_id, strategy, CAST(pos AS INTEGER) AS pos, name FROM n WHERE (numbered < 2 OR priority = 0) AND key <> '' QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY priority, pos) = 1""")
def candidate_cascade(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages")
    def of(tag, strategy, priority):
        return p.select("page_id", F.lit(strategy).alias("strategy"), F.lit(priority).alias("priority"), F.posexplode(F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}>([^<]+)"), 1)).alias("pos", "name"))
    return O.candidate_cascade(of("h1", "numeracion", 0).unionByName(of("title", "titulo_slide", 1)).unionByName(of("p", "titulo_visual", 2)), "page_id")


@query("""WITH s AS (SELECT c_nationkey, list(DISTINCT c_mktsegment) AS a FROM customer GROUP BY 1), t AS (SELECT s_nationkey, list(DISTINCT CAST(s_suppkey AS VARCHAR)) AS b FROM supplier GROUP BY 1)
SELECT n_nationkey, len(coalesce(a, [])) > 0 AND len(coalesce(b, [])) > 0 AND NOT list_has_any(coalesce(a, []), coalesce(b, [])) AS apart FROM nation LEFT JOIN s ON n_nationkey = c_nationkey LEFT JOIN t ON n_nationkey = s_nationkey""")
def topic_sets_disjoint(spark, sf_dir):
    a = S.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set("c_mktsegment").alias("a"))
    b = S.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_set(F.col("s_suppkey").cast("string")).alias("b"))
    n = S.table(spark, sf_dir, "nation").select("n_nationkey").join(a, "n_nationkey", "left").join(b, "n_nationkey", "left")
    none = F.array().cast("array<string>")
    return n.select("n_nationkey", O.topic_sets_disjoint(F.coalesce("a", none), F.coalesce("b", none)).alias("apart"))


@query("""WITH g AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT *, 'Guía docente' AS origin FROM g UNION ALL SELECT *, 'Detectado' FROM m WHERE l_orderkey NOT IN (SELECT l_orderkey FROM g)""")
def guide_first_merge(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem")
    return O.guide_first_merge(rows.filter("l_returnflag = 'A'").select("l_orderkey", "l_partkey").distinct(), rows.select("l_orderkey", "l_partkey").distinct(), "l_orderkey")


def _chunks(spark, sf_dir, most=1000):
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("p"))
    return O.pack_paragraphs(d, "doc_id", "p", most=most)


PACKED = rf"""{LINES}, p AS (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l0 WHERE trim(raw) <> ''),
f AS (SELECT doc_id, k, raw AS chunk, 0 AS no FROM p WHERE k = 1 UNION ALL
  SELECT f.doc_id, p.k, CASE WHEN length(f.chunk) + 2 + length(p.raw) <= 1000 THEN f.chunk || chr(10) || chr(10) || p.raw ELSE p.raw END, CASE WHEN length(f.chunk) + 2 + length(p.raw) <= 1000 THEN f.no ELSE f.no + 1 END FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
packed AS (SELECT doc_id, no AS chunk_no, arg_max(chunk, k) AS chunk FROM f GROUP BY ALL)"""


@query(f"WITH RECURSIVE {PACKED} SELECT doc_id, chunk_no, md5(chunk) AS chunk_md5 FROM packed")
def pack_paragraphs(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@query(f"WITH RECURSIVE {PACKED} SELECT doc_id, count(*) AS n, round(avg(length(chunk)), 3) AS mean_size, CAST(min(length(chunk)) AS INTEGER) AS least, CAST(max(length(chunk)) AS INTEGER) AS most FROM packed GROUP BY 1")
def chunk_stats(spark, sf_dir):
    return O.chunk_stats(_chunks(spark, sf_dir), "doc_id")


_MATH = "(length(text) - length(translate(text, '∫∑∂∇×·√ΔΩαβγδεζηθλμνξπρστφχψω=<>≤≥±', '')))"


@query(f"SELECT doc_id, CASE WHEN length(text) >= 200 AND ({_MATH} / length(text) > 0.001 OR contains(text, 'd/dt') OR contains(text, 'd²') OR contains(text, '∫') OR contains(text, 'Σ')) THEN 'smart' ELSE 'fast' END AS route FROM documents")
def route_by_math_density(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", O.route(F.col("text"), density=0.001).alias("route"))


@query("""WITH t AS (SELECT source, regexp_extract_all(lower(substr(coalesce(text, ''), 1, 500)), '[a-zA-Záéíóúñü]+') AS w FROM documents),
v AS (SELECT source, CAST(sum(len(list_filter(w, lambda x: x IN ('de','la','el','y','en','los','las','para','con','una','un','por','del','que','tema','teoria','horas','bloque','subtema')))) AS BIGINT) AS es,
 CAST(sum(len(list_filter(w, lambda x: x IN ('the','and','of','to','in','for','with','is','are','on','from','this','that','topic','theory','hours','block','section','subtopic')))) AS BIGINT) AS en FROM t GROUP BY 1)
SELECT *, CASE WHEN en > 0.60 * (es + en) THEN 'english' ELSE 'spanish' END AS language FROM v""")
def detect_language(spark, sf_dir):
    return O.detect_language(S.table(spark, sf_dir, "documents"), "source")


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title>\s*(.*?)\s*</title>', 1) AS title, regexp_extract(html, '(?is)<h1>\s*(.*?)\s*</h1>', 1) AS h1 FROM pages")
def parse_tagged_responses(spark, sf_dir):
    return S.table(spark, sf_dir, "pages").select("page_id", O.tagged(F.col("html"), "title").alias("title"), O.tagged(F.col("html"), "h1").alias("h1"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'sin ') OR contains(lower(text), 'without') THEN 'exclude' WHEN contains(lower(text), 'tion') OR contains(lower(text), 'ción') THEN 'mechanism' WHEN contains(lower(text), 'ing') THEN 'curve' ELSE 'none' END AS rule FROM conversations WHERE role = 'user'")
def keyword_rules(spark, sf_dir):
    rules = [("exclude", ("sin ", "without")), ("mechanism", ("tion", "ción")), ("curve", ("ing",))]
    return S.table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", O.keyword_rule(F.col("text"), rules, "none").alias("rule"))


@query("""WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user')
SELECT conv_id, md5(string_agg(CASE WHEN back = 1 THEN 'PRIORIDAD: ' || text ELSE '- ' || text END, chr(10) ORDER BY turn)) AS instruction_md5 FROM u GROUP BY 1""")
def combine_history(spark, sf_dir):
    u = S.table(spark, sf_dir, "conversations").filter("role = 'user'")
    return O.combine_history(u, "conv_id", "turn", "text").select("conv_id", F.md5("instruction").alias("instruction_md5"))


_CELL = "regexp_extract_all(html, '(?is)<(?:h1|li|p)>(?:<a[^>]*>|<b>)?([^<]+)', 1)"


@query(f"""WITH c AS (SELECT page_id, unnest({_CELL}) AS line, generate_subscripts({_CELL}, 1) - 1 AS k FROM pages), f AS (SELECT page_id FROM c WHERE k = 0 AND regexp_matches(line, '(?i)^[a-z]')),
v AS (SELECT page_id, k, line FROM c WHERE page_id IN (SELECT page_id FROM f) AND k > 0 AND {valid_topic_sql('line')} QUALIFY row_number() OVER (PARTITION BY page_id, {topic_key_sql('line')} ORDER BY k) = 1)
SELECT page_id, CAST(1 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS ord, line AS name FROM v QUALIFY count(*) OVER (PARTITION BY page_id) >= 2""")
def index_page_topics(spark, sf_dir):
    c = S.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:h1|li|p)>(?:<a[^>]*>|<b>)?([^<]+)"), 1)).alias("line_no", "line"))
    lines = c.select("page_id", F.lit(1).alias("page"), "line_no", (F.col("line_no") == 0).alias("is_title"), "line")
    return O.index_page_topics(lines, "page_id", keyword="(?i)^[a-z]")


@query(rf"""WITH {LINES}, {WORDS}, p AS (SELECT DISTINCT wd.doc_id, wd.y, wd.font, wd.size, wd.size / bs.size AS ratio, wd.font <> bs.font OR wd.size <> bs.size AS other FROM wd JOIN bs ON wd.doc_id = bs.doc_id),
t AS (SELECT l.doc_id, l.line FROM p JOIN l ON p.doc_id = l.doc_id AND p.y = l.line_no WHERE other AND (ratio >= 1.2 OR (font = 'Arial-Bold' AND ratio >= 0.9))),
v AS (SELECT doc_id, count(DISTINCT {topic_key_sql('line')}) AS n FROM t WHERE {valid_topic_sql('line')} AND NOT regexp_matches(line, '^[a-záéíóúñ]') AND len(string_split(line, ' ')) <= 12 GROUP BY 1)
SELECT w.doc_id, CASE WHEN n IS NULL THEN 'sin_titulos' ELSE 'ok' END AS status, coalesce(n, 0) AS n_titles FROM (SELECT DISTINCT doc_id FROM wd) w LEFT JOIN v USING (doc_id)""")
def visual_titles(spark, sf_dir):
    return O.visual_titles(words_of(spark, sf_dir), "doc_id")


@query(rf"""WITH {LINES}, {WORDS}, n AS (SELECT doc_id, count(*) AS words, max(y) + 1 AS height FROM wd GROUP BY 1),
t AS (SELECT DISTINCT l.doc_id, l.line_no AS y, regexp_replace(l.line, '\s+', ' ', 'g') AS line, wd.size FROM wd JOIN bs ON wd.doc_id = bs.doc_id JOIN n ON wd.doc_id = n.doc_id AND words >= 20 JOIN l ON l.doc_id = wd.doc_id AND l.line_no = wd.y
  WHERE wd.y >= height * 0.06 AND wd.y <= height - height * 0.06 AND (wd.font <> bs.font OR wd.size <> bs.size) AND (wd.size > bs.size * 1.2 OR (wd.font <> bs.font AND wd.font = 'Arial-Bold' AND wd.size >= 0.9 * bs.size))),
b AS (SELECT doc_id, y, size, trim(regexp_replace(trim(line), '^[•▪●\-–*·]\s*', '')) AS line FROM t), k AS (SELECT *, {topic_key_sql('line')} AS key FROM b WHERE length(line) <= 120),
v AS (SELECT * FROM k WHERE {valid_topic_sql('line')} AND length(key) >= 3 AND NOT regexp_matches(key, '^(permiten|tienen|los |las |el |la |se |son |esta|este|como |para |ejemplo)') AND NOT (ends_with(line, ':') AND length(key) < 45)
  AND NOT regexp_matches(line, '^\p{{Ll}}') AND NOT regexp_matches(line, '^\p{{L}}(\s|$)') AND len(regexp_split_to_array(line, '\s+')) <= 12 AND NOT (NOT contains(line, ' ') AND length(line) <= 2) QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY y) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y) AS INTEGER) AS ord, line AS title, 'Visual: «' || CASE WHEN length(line) > 60 THEN substr(line, 1, 57) || '…' ELSE line END || '» (p. 1, ' || CAST(size AS DOUBLE) || 'pt)' AS reference FROM v""")
def visual_title_rows(spark, sf_dir):
    """Each document is one page, as high as it has lines."""
    words = words_of(spark, sf_dir)
    height = _lines(spark, sf_dir).filter("line <> ''").groupBy("doc_id").agg((F.max("line_no").cast("double") + 1).alias("height"))
    pages = height.select("doc_id", F.lit(1).alias("page"), "height")  # as high as its last line, which needs no words
    return O.visual_title_rows(words, pages, "doc_id")
