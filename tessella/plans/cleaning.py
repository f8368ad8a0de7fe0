"""Queries of sources, keys and cleaning. A document is a source, a section one of its texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import sources as S
from tessella.functions import text as T
from tessella.operators import cleaning as C

from .registry import query

# White space of lines is these six characters; what \s and \b mean to RE2 is another thing.
_WS, _NO_WS, _LETTER, _OTHER = r"[ \t\n\x0B\f\r]", r"[^ \t\n\x0B\f\r]", r"[\p{L}\p{N}_]", r"(?:[^\p{L}\p{N}_]|$)"
_TRIM = rf"regexp_replace({{}}, '^{_WS}+|{_WS}+$', '', 'g')"
LINES = rf"""l0 AS (SELECT source, doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10))) AS raw,
  generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT source, doc_id, line_no, {_TRIM.format("raw")} AS line FROM l0)"""
_UNITS = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() and c not in "kK" else "[kK\u212A]" if c in "kK" else c for c in "{}W|{}Pa|bar|psi|kg|g|mg|m|cm|mm|km|s|min|h|Hz|N|J|V|A|K|C").replace("{}", "[kK\u212AmMgGtT]?")
_UNIT = rf"(?:^|[^\p{{L}}\p{{N}}_])\d+(?:[.,]\d+)?{_WS}*(?:%{_LETTER}|(?:{_UNITS}){_OTHER})"
TECH = rf"(regexp_matches(line, '\t|\||\$|\\[fF][rR][aA][cC]|\\[iI][nN][tT]|\\[sS][uU][mM]|={_WS}*{_NO_WS}') OR regexp_matches(line, '{_UNIT}'))"
_MARK = rf"regexp_matches(line, '^{_WS}*\[(?:PAGINA|SLIDE){_WS}+\d+\]{_WS}*$')"
_HEAD = rf"regexp_matches(line, '^#{{1,4}}{_WS}+{_NO_WS}')"
_EQ = rf"regexp_matches(line, '^\[(?:ECUACION_PARCIAL|ECUACION_NO_EXTRAIBLE|TEXTO_ILEGIBLE){_OTHER}')"
_KEEP = rf"({_HEAD} OR {_EQ} OR regexp_matches(line, '(?i)(?:\d+\s*[a-záéíóúñ]|[a-záéíóúñ]+\s*\d+)') OR len(list_distinct(list_transform(regexp_extract_all(line, '[A-Za-zÀ-ÿ0-9]+'), lambda x: lower(x)))) > 3 OR regexp_matches(line, '[:,;()]'))"
TRIVIAL = rf"""CASE WHEN {TECH} THEN NULL WHEN regexp_matches(line, '^\s*\d+\s*$') THEN 'page_number' WHEN regexp_matches(line, '^\s*[-–—=_\.·•]{{3,}}\s*$') THEN 'filler'
  WHEN regexp_matches(line, '(?i)^\s*https?://\S+\s*$') THEN 'url' WHEN regexp_matches(line, '(?i)^\s*(?:Slide|Diapositiva)\s+\d+\s*$') THEN 'slide' END"""
NOISE = rf"""n0 AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE line <> '' AND length(line) <= 60 AND NOT {_MARK} AND NOT {_HEAD} AND NOT {TECH} AND NOT {_KEEP} GROUP BY source, line),
t0 AS (SELECT source, count(DISTINCT doc_id) AS total FROM l GROUP BY source),
noise AS (SELECT n0.source, line, n, total FROM n0 JOIN t0 USING (source) WHERE n > total * 0.05)"""
_GLYPH = rf"(line <> '' AND NOT {_HEAD} AND NOT {_EQ} AND NOT regexp_matches(line, '[=$#|]') AND NOT {TECH} AND len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: length(x) > 2)) = 0)"
REASONS = rf"""r AS (SELECT l.source, l.doc_id, l.line_no, l.line, CASE WHEN l.line = '' OR {_MARK.replace("(line", "(l.line")} THEN NULL ELSE coalesce({TRIVIAL.replace("(line", "(l.line")},
  CASE WHEN z.source IS NOT NULL AND NOT {TECH.replace("(line", "(l.line")} AND NOT {_HEAD.replace("(line", "(l.line")} AND length(l.line) <= 60 THEN 'frequency' END) END AS reason
  FROM l LEFT JOIN (SELECT DISTINCT source, lower(line) AS lowered FROM noise) z ON l.source = z.source AND lower(l.line) = z.lowered)"""


_TOKENS = r"regexp_split_to_array(line, '\s+')"
SHARD = rf"""(line <> '' AND NOT {_HEAD} AND NOT {_EQ} AND NOT ({TECH} AND regexp_matches(line, '=\s*\S') AND len(list_filter(regexp_extract_all(line, '[A-Za-zÀ-ÿ0-9]+'), lambda w: length(w) > 3)) >= 2)
 AND len({_TOKENS}) >= 4 AND len(list_filter({_TOKENS}, lambda t: length(t) > 6 AND regexp_matches(t, '^[A-Za-zÀ-ÿ]+$'))) < 2
 AND (len(list_filter({_TOKENS}, lambda t: length(t) <= 2)) / len({_TOKENS}) >= 0.55 OR (regexp_matches(line, '[ð¼½¾¿¡»›þÿ]|[^\x00-\x7F].*[^\x00-\x7F].*[^\x00-\x7F]') AND len(list_filter({_TOKENS}, lambda t: length(t) <= 2)) >= 3)
  OR len(regexp_extract_all(line, '(?:^|[^A-Za-zÀ-ÿ0-9_])[A-Za-záéíóúñ]\s+[A-Za-záéíóúñ]\s+[A-Za-záéíóúñ]')) >= 2))"""
_KEPT = rf"list_filter(list_transform({_TOKENS}, lambda t: regexp_replace(t, '^[.,;:]+|[.,;:]+$', '', 'g')), lambda t: t <> '' AND regexp_matches(t, '{C.SALVAGE}'))"
# The different kept tokens in order of first occurrence.
_SNIPPET = f"array_to_string(list_filter({_KEPT}, lambda t, i: list_position({_KEPT}, t) = i)[1:48], ' ')"
SALVAGED = f"CASE WHEN length({_SNIPPET}) >= 2 THEN '[ECUACION_PARCIAL: ' || {_SNIPPET} || ']' ELSE '[ECUACION_NO_EXTRAIBLE]' END"
CLEANED = rf"""fx AS (SELECT source, doc_id, line_no, CASE WHEN NOT {_MARK} AND {SHARD} THEN {SALVAGED} ELSE regexp_replace(line, '(\S)[ \t]{{2,}}(\S)', '\1 \2', 'g') END AS line FROM r WHERE reason IS NULL),
jn AS (SELECT source, doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM fx GROUP BY ALL),
cl AS (SELECT e.source, e.doc_id, regexp_replace(regexp_replace(coalesce(t, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM (SELECT DISTINCT source, doc_id FROM l) e LEFT JOIN jn ON e.source = jn.source AND e.doc_id = jn.doc_id)"""
GLYPHS = rf"""g0 AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE NOT {_MARK} AND {_GLYPH} GROUP BY source, line), t0 AS (SELECT source, count(DISTINCT doc_id) AS total FROM l GROUP BY source), noise AS (SELECT g0.source, line FROM g0 JOIN t0 USING (source) WHERE total >= 2 AND n * 5 >= total * 0.1)"""


def _lines(spark, sf_dir):
    return S.lines_of(S.table(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS recent FROM orders")
def load_tables(spark, sf_dir):
    from pyspark.sql.window import Window as W

    o = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return o.withColumn("recent", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).drop("o_orderdate")


@query("SELECT source, doc_id AS page, '[PAGINA ' || doc_id || ']' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def explode_sections(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").filter(T.stripped(F.col("text")) != "").select("source", "doc_id", F.concat(F.lit("[PAGINA "), F.col("doc_id"), F.lit("]\n"), T.stripped(F.col("text"))).alias("text"))
    whole, _ = S.concat_materials(d, "source", "doc_id", separator="\n")
    return S.explode_sections(whole, "source").select("source", F.col("page").cast("long").alias("page"), T.stripped(F.col("text")).alias("text"))


@query(rf"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 - length(raw) AS BIGINT) AS start_at, CAST(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS end_at, {_TRIM.format('raw')} AS line FROM l0")
def explode_lines(spark, sf_dir):
    d = S.explode_lines(S.table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), "line")


@query("SELECT source, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text_md5, count(*) AS n_materials FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY source")
def concat_materials(spark, sf_dir):
    whole, _ = S.concat_materials(S.table(spark, sf_dir, "documents"), "source", "doc_id")
    return whole.select("source", F.md5("text").alias("text_md5"), "n_materials")


@query("SELECT doc_id, md5(CASE WHEN sum(length(text)) OVER (PARTITION BY source) > 60000 THEN substr(text, 1, 2000) ELSE text END) AS text_md5 FROM documents")
def truncate_to_budget(spark, sf_dir):
    return S.truncate_to_budget(S.table(spark, sf_dir, "documents"), "source", budget=60_000, each=2_000).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, length(trim(coalesce(text, ''))) >= 50 AS usable FROM documents")
def min_text_guard(spark, sf_dir):
    good, bad = S.usable_texts(S.table(spark, sf_dir, "documents"))
    return good.select("doc_id", F.lit(True).alias("usable")).unionByName(bad.select("doc_id", F.lit(False).alias("usable")))


@query("""SELECT 'events' AS table_name, count(*) AS n_rows, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, 'event_id,ts,user_id,event_type,value,props' AS columns FROM events
UNION ALL SELECT 'orders', count(*), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S'), 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' FROM orders
UNION ALL SELECT 'part', count(*), NULL, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' FROM part""")
def table_profile(spark, sf_dir):
    return S.table_profile({"events": (S.table(spark, sf_dir, "events"), "ts"), "orders": (S.table(spark, sf_dir, "orders"), "o_orderdate"), "part": (S.table(spark, sf_dir, "part"), None)})


@query(rf"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, {TECH} AS technical, {_HEAD} AS heading, {_MARK} AS marker, {_EQ} AS equation_marker FROM l")
def flag_line_kinds(spark, sf_dir):
    return C.line_kinds(_lines(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "technical", "heading", "marker", "equation_marker")


@query(rf"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, {TRIVIAL} AS reason FROM l WHERE {TRIVIAL} IS NOT NULL")
def drop_trivial_lines(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("reason", C.trivial_reason(F.col("line"))).filter("reason is not null").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "reason")


@query(rf"WITH {LINES}, {NOISE} SELECT * FROM noise")
def structural_noise(spark, sf_dir):
    return C.structural_noise(_lines(spark, sf_dir), "source", "doc_id", share=0.05)


@query(rf"WITH {LINES}, g AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE NOT {_MARK} AND {_GLYPH} GROUP BY source, line), t0 AS (SELECT source, count(DISTINCT doc_id) AS total FROM l GROUP BY source) SELECT g.source, line, n, total FROM g JOIN t0 USING (source) WHERE total >= 2 AND n * 5 >= total * 0.1")
def glyph_headers(spark, sf_dir):
    return C.glyph_headers(_lines(spark, sf_dir), "source", "doc_id", fifths=0.1)


@query(rf"WITH {LINES}, n AS (SELECT source, doc_id, line_no, CASE WHEN (doc_id + line_no) % 3 = 0 THEN upper(source) ELSE line END AS line FROM l) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, md5(line) AS line_md5 FROM n WHERE lower(line) <> lower(trim(source))")
def drop_filename_lines(spark, sf_dir):
    """Every third line is the name of its source."""
    line = F.when((F.col("doc_id") + F.col("line_no")) % 3 == 0, F.upper("source")).otherwise(F.col("line"))
    return C.drop_filename_lines(_lines(spark, sf_dir).withColumn("line", line), "source").select("doc_id", "line_no", F.md5("line").alias("line_md5"))


_KNOWN = "len(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w IN ('" + "', '".join(C.KNOWN_WORDS) + "')))"


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE length(line) >= 4 AND {_KNOWN.format('reverse(line)')} > {_KNOWN.format('line')}")
def flag_mirrored_lines(spark, sf_dir):
    return _lines(spark, sf_dir).filter(C.mirrored(F.col("line"))).select("doc_id", "line_no", "line")


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {SALVAGED} AS line FROM l WHERE {SHARD}")
def salvage_equation_shards(spark, sf_dir):
    return _lines(spark, sf_dir).filter(C.equation_shard(F.col("line"))).select("doc_id", "line_no", C.salvaged(F.col("line")).alias("line"))


@query(rf"WITH {LINES} SELECT doc_id, md5(regexp_replace(regexp_replace(string_agg(regexp_replace(line, '(\S)[ \t]+(\S)', '\1 \2', 'g'), chr(10) ORDER BY line_no), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM l GROUP BY doc_id")
def reassemble_clean_text(spark, sf_dir):
    line = F.regexp_replace("line", r"(\S)[ \t]+(\S)", "$1 $2")
    joined = _lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))
    return joined.select("doc_id", F.md5(T.stripped(F.regexp_replace("text", r"\n{3,}", "\n\n"))).alias("text_md5"))


@query(rf"""WITH {LINES}, {NOISE}, {REASONS} SELECT source, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars_in, CAST(sum(CASE WHEN reason IS NULL THEN length(line) ELSE 0 END) AS BIGINT) AS chars_out,
  count(CASE WHEN reason = 'frequency' THEN 1 END) AS by_frequency, CAST(0 AS BIGINT) AS by_glyph, count(CASE WHEN reason <> 'frequency' THEN 1 END) AS by_rule FROM r GROUP BY source""")
def cleaning_audit(spark, sf_dir):
    return C.cleaning_audit(_lines(spark, sf_dir), "source", "doc_id", share=0.05)


@query(f"WITH {LINES}, {NOISE}, {REASONS}, {CLEANED} SELECT source, doc_id, CASE WHEN t = '' THEN '[TEXTO_ILEGIBLE]' ELSE t END AS text FROM cl")
def clean_corpus(spark, sf_dir):
    return C.clean_corpus(_lines(spark, sf_dir), "source", "doc_id", share=0.05)


@query(f"WITH {LINES}, {GLYPHS}, {REASONS.replace(' AND length(l.line) <= 60', '')}, {CLEANED} SELECT source, doc_id, CASE WHEN t = '' THEN '[TEXTO_ILEGIBLE]' ELSE t END AS text FROM cl")
def clean_corpus_light(spark, sf_dir):
    return C.clean_corpus(_lines(spark, sf_dir), "source", "doc_id", light=True, fifths=0.1)


NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({})), '[–—]', '-', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS norm_md5 FROM documents")
def normalize_for_matching(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_for_matching(F.col("text"))).alias("norm_md5"))


@query(f"SELECT p_partkey, {NORM.format('p_name')} AS topic FROM part")
def topic_key(spark, sf_dir):
    return S.table(spark, sf_dir, "part").select("p_partkey", T.topic_key(F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey"), F.lit(" "), F.col("p_name"))).alias("topic"))


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'elemento') AS slug FROM part")
def slugify(spark, sf_dir):
    return S.table(spark, sf_dir, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


@query(rf"SELECT doc_id, CAST(len(list_distinct(list_filter(string_split({NORM.format('text')}, ' '), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ('the', 'and', 'que', 'les', 'der')))) AS INTEGER) AS n_tokens FROM documents")
def significant_tokens(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", F.size(T.significant_tokens(F.col("text"), 3, ("the", "and", "que", "les", "der"))).alias("n_tokens"))
