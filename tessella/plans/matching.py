"""Queries of matching. Parts stand for topics and materials, brands and nations for what they are matched within."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import sources as S
from tessella.functions import text as T
from tessella.operators import anchors as N
from tessella.operators import matching as M

from .ratio_sql import ratio
from .registry import query
from .structure import H2, LINES

_TOK = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3))"


def _names(spark, sf_dir, id_):
    """The different names of each brand, numbered by their smallest part."""
    return S.table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_name").alias(f"{id_}_name")).agg(F.min("p_partkey").alias(id_))


_PAIRS = f"""n AS (SELECT p_brand, p_name, min(p_partkey) AS id, {_TOK} AS t FROM part GROUP BY ALL), e AS (SELECT p_brand, id, len(t) AS n, unnest(t) AS token FROM n),
pairs AS (SELECT x.p_brand, x.id AS a, y.id AS b, count(*) / greatest(1, least(x.n, y.n)) AS overlap FROM e x JOIN e y ON x.p_brand = y.p_brand AND x.token = y.token WHERE x.id < y.id GROUP BY x.p_brand, x.id, y.id, x.n, y.n)"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def token_overlap_pairs(spark, sf_dir):
    return M.token_overlap_pairs(_names(spark, sf_dir, "a"), _names(spark, sf_dir, "b"), "p_brand").filter("a < b")


def _store(spark):
    from tessella.sources import stored

    return stored


# Pairs cand(grp, a, b, score) taken one after the other: greedy(grp, a, b, score).
GREEDY = """ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, a, b) AS r FROM cand),
steps AS (SELECT grp, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS us, CAST([] AS BIGINT[]) AS vs, CAST([] AS DOUBLE[]) AS ss FROM (SELECT DISTINCT grp FROM ranked)
UNION ALL SELECT s.grp, k.r, CASE WHEN list_contains(us, a) OR list_contains(vs, b) THEN us ELSE list_append(us, a) END, CASE WHEN list_contains(us, a) OR list_contains(vs, b) THEN vs ELSE list_append(vs, b) END, CASE WHEN list_contains(us, a) OR list_contains(vs, b) THEN ss ELSE list_append(ss, score) END
  FROM steps s JOIN ranked k ON s.grp = k.grp AND k.r = s.r + 1),
greedy AS (SELECT grp, unnest(us) AS a, unnest(vs) AS b, unnest(ss) AS score FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY grp ORDER BY r DESC) = 1))"""


@query(f"WITH RECURSIVE {_PAIRS}, cand AS (SELECT p_brand AS grp, a, b, overlap AS score FROM pairs), {GREEDY} SELECT a, b, score FROM greedy")
def greedy_one_to_one(spark, sf_dir):
    return M.greedy_one_to_one(token_overlap_pairs(spark, sf_dir).select("a", "b", F.col("overlap").alias("score")), _store(spark))


_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_GROUP = "p_brand || '/' || (p_size % 5)"


@query(f"""WITH RECURSIVE l AS (SELECT {_GROUP} AS grp, p_name, min(p_partkey) AS a, any_value({_KEY.format('p_name')}) AS k FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2),
f AS (SELECT {_GROUP} AS grp, p_name, min(p_partkey) AS b, any_value({_KEY.format('p_name')}) AS k FROM part WHERE p_size % 2 = 1 GROUP BY 1, 2),
pr AS (SELECT l.k AS x, f.k AS y FROM l JOIN f USING (grp)), {ratio('pr')},
best AS (SELECT grp, a, max(r) AS score, arg_min(b, (-r, b)) AS b FROM l JOIN f USING (grp) JOIN ratio ON x = l.k AND y = f.k WHERE r >= 0.35 GROUP BY ALL),
lp AS (SELECT grp, a, row_number() OVER (PARTITION BY grp ORDER BY a) AS place FROM l), fp AS (SELECT grp, b, min(b) OVER (PARTITION BY grp) AS first, row_number() OVER (PARTITION BY grp ORDER BY b) AS place FROM f)
SELECT lp.grp, lp.a, coalesce(best.b, fp.b, firsts.first) AS b, round_even(score, 6) AS score, CASE WHEN score IS NOT NULL THEN 'similar' WHEN firsts.first IS NOT NULL THEN 'position' END AS how
FROM lp LEFT JOIN best ON lp.grp = best.grp AND lp.a = best.a LEFT JOIN fp ON lp.grp = fp.grp AND lp.place = fp.place LEFT JOIN (SELECT DISTINCT grp, first FROM fp) firsts ON lp.grp = firsts.grp""")
def fuzzy_best_match(spark, sf_dir):
    """Blocks are the names of parts of even size, files those of odd size, of one brand and a fifth of the sizes."""
    def names(id_, odd):
        part = S.table(spark, sf_dir, "part").filter(F.col("p_size") % 2 == odd).withColumn("grp", F.concat("p_brand", F.lit("/"), F.col("p_size") % 5))
        return part.groupBy("grp", F.col("p_name").alias(f"{id_}_name")).agg(F.min("p_partkey").alias(id_))

    return M.fuzzy_best_match(names("a", 0), names("b", 1), "grp", _store(spark))


@query(f"""WITH RECURSIVE t AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, CASE WHEN max(l_returnflag) = 'N' THEN ' Sin señal' ELSE max(l_returnflag) END AS evidence FROM lineitem GROUP BY ALL),
j AS (SELECT t.*, {_KEY.format('p_name')} AS key FROM t JOIN part ON l_partkey = p_partkey),
f AS (SELECT l_orderkey, {_KEY.format("CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, 2) ELSE p_name END")} AS key, arg_max(p_type, p_partkey) AS new FROM (SELECT DISTINCT l_orderkey, p_name, p_type, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'A') GROUP BY ALL),
o AS (SELECT DISTINCT l_orderkey, key FROM j WHERE evidence = ' Sin señal'), pr AS (SELECT o.key AS x, f.key AS y FROM o JOIN f USING (l_orderkey)), {ratio('pr')},
s AS (SELECT o.l_orderkey, o.key, f.new, f.key AS other, r AS score FROM o JOIN f USING (l_orderkey) JOIN ratio ON x = o.key AND y = f.key),
n AS (SELECT l_orderkey, key, arg_min(new, (-score, other)) AS near FROM s WHERE score >= 0.85 GROUP BY ALL),
m AS (SELECT j.l_orderkey, l_linenumber, evidence, evidence = ' Sin señal' AS gone, f.new, n.near FROM j LEFT JOIN f ON j.l_orderkey = f.l_orderkey AND j.key = f.key LEFT JOIN n ON j.l_orderkey = n.l_orderkey AND j.key = n.key)
SELECT l_orderkey, l_linenumber, CASE WHEN gone THEN coalesce(new, near, evidence) ELSE evidence END AS evidence, CASE WHEN gone AND new IS NOT NULL THEN 'Detectado' WHEN gone AND near IS NOT NULL THEN 'Detectado (aprox.)' ELSE 'Propio' END AS origin FROM m""")
def enrich_evidence(spark, sf_dir):
    line = S.table(spark, sf_dir, "lineitem")
    name = F.col("p_name")
    part = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", name.alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.expr("substr(p_name, 2)")).otherwise(name).alias("spelled"))
    part = part.withColumns({"key": T.topic_key(F.col("name")), "spelled_key": T.topic_key(F.col("spelled"))})  # once a part
    flag = F.max("l_returnflag")
    topics = line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.when(flag == "N", " Sin señal").otherwise(flag).alias("evidence")).join(part, "l_partkey").select("l_orderkey", "l_linenumber", "name", "key", "evidence")
    found = line.filter("l_returnflag <> 'A'").select("l_orderkey", "l_partkey").distinct().join(part, "l_partkey").select("l_orderkey", F.col("spelled").alias("name"), F.col("spelled_key").alias("key"), F.col("p_type").alias("evidence"), F.col("l_partkey").alias("pos"))
    return M.enrich_evidence(topics, found, "l_orderkey").drop("name")


def _page_headings(spark, sf_dir):
    """Paragraphs stand for headings, numbered, and a page's first heading for its topic."""
    p = S.table(spark, sf_dir, "pages")
    topic = F.regexp_extract("html", r"(?is)<h1>([^<]*)", 1)
    found = p.select("page_id", topic.alias("topic"), F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<p>(?:<b>)?([^<.]+)"), 1)).alias("pos", "text"))
    return found.select("page_id", "topic", F.concat(F.lit("Sección "), F.col("page_id") % 4).alias("evidence"), "pos", F.concat("pos", F.lit(". "), F.col("text")).alias("heading"))


_TITLE = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9 ]', ' ', 'g'))"
_SCORES = rf"""h AS (SELECT page_id, regexp_extract(html, '(?is)<h1>([^<]*)', 1) AS topic, unnest(regexp_extract_all(html, '(?is)<p>(?:<b>)?([^<.]+)', 1)) AS text, generate_subscripts(regexp_extract_all(html, '(?is)<p>(?:<b>)?([^<.]+)', 1), 1) - 1 AS pos FROM pages),
n AS (SELECT page_id, pos, pos = page_id % 4 AS numbered, {_TITLE.format('topic')} AS a, {_TITLE.format("pos || '. ' || text")} AS b FROM h), pr AS (SELECT a AS x, b AS y FROM n), {ratio('pr')},
sc AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, round_even(CASE WHEN a = '' THEN 0 ELSE least(1e0, r + (CASE WHEN contains(b, a) OR contains(a, b) THEN 0.15 ELSE 0 END + CASE WHEN numbered THEN 0.15 ELSE 0 END) + CASE WHEN r > 0.6 THEN CASE WHEN pos = 0 THEN 0.1 ELSE 0.05 END ELSE 0 END) END, 6) AS score FROM n JOIN ratio ON x = a AND y = b)"""


@query(f"WITH RECURSIVE {_SCORES} SELECT * FROM sc")
def score_heading_match(spark, sf_dir):
    h = _page_headings(spark, sf_dir)
    return h.select("page_id", "pos", F.bround(M.heading_score(F.col("topic"), F.col("evidence"), F.col("heading"), F.when(F.col("pos") == 0, 1).otherwise(3)), 6).alias("score"))


@query(f"""WITH RECURSIVE {_SCORES}, one AS (SELECT page_id, arg_min(pos, (-score, pos)) FILTER (score >= 0.2) AS pos FROM sc GROUP BY 1),
two AS (SELECT sc.page_id, arg_min(sc.pos, (-score, sc.pos)) FILTER (score >= 0.2 AND sc.pos > coalesce(one.pos, -1)) AS pos FROM sc JOIN one ON sc.page_id = one.page_id GROUP BY 1)
SELECT page_id, CAST(0 AS BIGINT) AS ord, CAST(pos AS BIGINT) AS pos FROM one UNION ALL SELECT page_id, 1, pos FROM two""")
def monotone_anchors(spark, sf_dir):
    s = score_heading_match(spark, sf_dir)
    twice = s.select("page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), "pos", "score")
    return M.monotone_anchors(twice, "page_id", least=0.2)


@query(r"""WITH f AS (SELECT c_nationkey, CAST(regexp_extract(c_name, '(\d+)\s*$', 1) AS BIGINT) % 100 AS no, min(c_custkey) AS file FROM customer GROUP BY ALL), b AS (SELECT s_nationkey, s_suppkey AS block, s_suppkey % 100 AS no FROM supplier)
SELECT s_nationkey AS n_nationkey, block, file FROM b LEFT JOIN f ON s_nationkey = c_nationkey AND b.no = f.no""")
def match_by_number(spark, sf_dir):
    no = F.regexp_extract("c_name", r"(\d+)\s*$", 1).cast("long") % 100
    files = S.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("file"), F.concat(F.lit("tema "), no).alias("stem"))
    blocks = S.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("block"), F.concat(F.lit("Bloque "), F.col("s_suppkey") % 100).alias("label"))
    return M.match_by_number(blocks, files, "n_nationkey")


@query(r"""WITH u AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1), o AS (SELECT conv_id, turn AS pos, text AS option FROM conversations WHERE role <> 'user'),
m AS (SELECT conv_id, pos, option, contains(lower(text), lower(option)) OR len(list_filter(regexp_split_to_array(lower(option), '\s+'), lambda w: length(w) > 6 AND contains(lower(text), w))) > 0 AS met FROM u JOIN o USING (conv_id))
SELECT conv_id, md5(coalesce(arg_max(option, (length(option), -pos)) FILTER (met), arg_min(option, pos))) AS anchor_md5 FROM m GROUP BY 1""")
def suggest_anchor(spark, sf_dir):
    from tessella.operators.structure import ordered

    c = S.table(spark, sf_dir, "conversations")
    asks = c.filter("role = 'user'").groupBy("conv_id").agg(ordered("turn", "text", " ").alias("text"))
    options = c.filter("role <> 'user'").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("option"))
    return M.suggest_anchor(asks, options, "conv_id", longer=6).select("conv_id", F.md5("anchor").alias("anchor_md5"))


def _blocks_and_files(spark, sf_dir):
    """Blocks are the names of parts of even size, files those of odd size above 20, of one brand and a fifth of the sizes."""
    part = S.table(spark, sf_dir, "part").withColumn("grp", F.concat("p_brand", F.lit("/"), F.col("p_size") % 5))
    names = lambda df, i, n: df.groupBy("grp", F.col("p_name").alias(n)).agg(F.min("p_partkey").alias(i))
    return names(part.filter("p_size % 2 = 0"), "block", "name"), names(part.filter("p_size % 2 = 1 and p_size > 20"), "file", "stem")


def _assigned(blocks: str) -> str:
    return f"""f0 AS (SELECT {_GROUP} AS grp, p_name AS stem, min(p_partkey) AS file, any_value({_TOK}) AS t FROM part WHERE p_size % 2 = 1 AND p_size > 20 GROUP BY 1, 2),
b0 AS (SELECT {_GROUP} AS grp, p_name AS name, min(p_partkey) AS block, any_value({_TOK}) AS t FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2), b1 AS (SELECT * FROM b0 WHERE {blocks}),
cand AS (SELECT b1.grp, block AS a, file AS b, len(list_intersect(b1.t, f0.t)) / greatest(1, least(len(b1.t), len(f0.t))) AS score FROM b1 JOIN f0 ON b1.grp = f0.grp WHERE len(list_intersect(b1.t, f0.t)) > 0), {GREEDY},
bp AS (SELECT grp, block, row_number() OVER (PARTITION BY grp ORDER BY block) AS place FROM b1), fp AS (SELECT grp, file, row_number() OVER (PARTITION BY grp ORDER BY file) AS place, min(file) OVER (PARTITION BY grp) AS first FROM f0),
lb AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY block) AS nth FROM bp WHERE (grp, block) NOT IN (SELECT grp, a FROM greedy)), lf AS (SELECT grp, file, row_number() OVER (PARTITION BY grp ORDER BY file) AS nth FROM f0 WHERE (grp, file) NOT IN (SELECT grp, b FROM greedy)),
assigned AS (SELECT grp, a AS block, b AS file, 'overlap' AS how FROM greedy UNION ALL SELECT lb.grp, block, coalesce(lf.file, fp.file, o.first), CASE WHEN lf.file IS NOT NULL THEN 'free' WHEN o.first IS NOT NULL THEN 'place' END
  FROM lb LEFT JOIN lf ON lb.grp = lf.grp AND lb.nth = lf.nth LEFT JOIN fp ON lb.grp = fp.grp AND lb.place = fp.place LEFT JOIN (SELECT DISTINCT grp, first FROM fp) o ON lb.grp = o.grp)"""


@query(f"WITH RECURSIVE {_assigned('true')} SELECT * FROM assigned")
def assign_files(spark, sf_dir):
    return M.assign_files(*_blocks_and_files(spark, sf_dir), "grp", _store(spark))


@query(f"""WITH RECURSIVE {_assigned('block % 3 <> 0')} SELECT grp, block, k AS ord, name || ' ' || k AS name, 'Guía docente — Contenidos' AS evidence, 'Guía docente' AS origin FROM b0, (SELECT unnest([1, 2]) AS k) WHERE block % 3 = 0
UNION ALL SELECT a.grp, block, CAST(1 AS INTEGER), stem, 'Sección ' || a.file, 'Detectado' FROM assigned a JOIN f0 ON a.grp = f0.grp AND a.file = f0.file""")
def guide_first_topics(spark, sf_dir):
    """Each third block has two topics of its own; each file has its stem as one."""
    from tessella.operators import guides as G

    blocks, files = _blocks_and_files(spark, sf_dir)
    k = F.explode(F.array(F.lit(1), F.lit(2)))
    topics = blocks.filter("block % 3 = 0").withColumn("ord", k).select("grp", "block", "ord", F.concat_ws(" ", "name", F.col("ord").cast("string")).alias("name"))
    found = files.select("grp", "file", F.lit(1).alias("ord"), F.col("stem").alias("name"), F.concat(F.lit("Sección "), F.col("file").cast("string")).alias("evidence"))
    return G.guide_first_topics(blocks, topics, files, found, "grp", _store(spark))


# Documents as sections: each line of up to three words is a heading, in turn of level 2, 3, 4 and 3.
_LEVELS = ["##", "###", "####", "###"]
_DEEP = f"""{LINES}, md AS (SELECT doc_id, line_no, CASE WHEN short THEN {_LEVELS}[CAST(1 + (nth - 1) % 4 AS INTEGER)] || ' ' || line ELSE line END AS line
  FROM (SELECT *, sum(CASE WHEN short THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS nth FROM (SELECT *, line <> '' AND len(string_split(line, ' ')) <= 3 AS short FROM l)))"""
_FRAGMENTS = r"""hd AS (SELECT doc_id, line_no, regexp_replace(line, '^#+ ', '') AS h FROM md WHERE starts_with(line, '##')),
fr AS (SELECT doc_id, line_no * 4 + k AS fragment, k AS ord, '<p>' AS html, CASE k WHEN 0 THEN lower(h) WHEN 1 THEN substr(h, 2, 4) WHEN 2 THEN 'no such heading' ELSE '[FIGURA: ' || substr(h, 1, 2) || ']' END AS anchor FROM hd, (SELECT unnest(range(4)) AS k))"""


def _deep_lines(spark, sf_dir):
    from pyspark.sql.window import Window as W

    from .structure import _lines

    line = F.col("line")
    short = (line != "") & (F.size(F.split(line, " ")) <= 3)
    nth = F.sum(short.cast("int")).over(W.partitionBy("doc_id").orderBy("line_no"))
    level = F.element_at(F.array(*map(F.lit, _LEVELS)), ((nth - 1) % 4 + 1).cast("int"))
    return _lines(spark, sf_dir).withColumn("short", short).withColumn("line", F.when(F.col("short"), F.concat(level, F.lit(" "), line)).otherwise(line)).select("doc_id", "line_no", "line")


def _sections_and_fragments(spark, sf_dir):
    """Of each heading four fragments: one in small letters, one with a part of it, one that is nowhere, and one of a figure."""
    from tessella.operators.structure import split_h2_sections

    deep = _deep_lines(spark, sf_dir)
    k, h = F.col("k"), F.expr("regexp_replace(line, '^#+ ', '')")
    anchor = F.when(k == 0, F.lower(h)).when(k == 1, F.substring(h, 2, 4)).when(k == 2, "no such heading").otherwise(F.concat(F.lit("[FIGURA: "), F.substring(h, 1, 2), F.lit("]")))
    made = deep.filter("line like '##%'").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    fragments = made.select("doc_id", (F.col("line_no") * 4 + k).cast("long").alias("fragment"), k.alias("ord"), F.lit("<p>").alias("html"), anchor.alias("anchor"))
    return split_h2_sections(deep, "doc_id"), fragments


@query(rf"""WITH {_DEEP}, {H2}, {_FRAGMENTS}, s AS (SELECT doc_id, section_no, lower(title) AS title, body, length(body) AS size FROM h2 WHERE section_no > 0 OR body <> ''),
bl AS (SELECT doc_id, section_no, size, generate_subscripts(string_split(body, chr(10)), 1) AS n, unnest(string_split(body, chr(10))) AS line FROM s),
bp AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id, section_no ORDER BY n) - length(line) - 1 AS pos FROM bl),
bh AS (SELECT doc_id, section_no, pos, length(regexp_extract(line, '^(#+)', 1)) AS level, lower(trim(regexp_replace(line, '^#+', ''))) AS h, coalesce(lead(pos) OVER (PARTITION BY doc_id, section_no ORDER BY pos), size) AS ends FROM bp WHERE regexp_matches(line, '^#{{1,6}}\s')),
f AS (SELECT doc_id, fragment, lower(trim(anchor)) AS anchor FROM fr WHERE NOT starts_with(anchor, '[FIGURA')),
t AS (SELECT fragment, f.doc_id, arg_min((section_no, size), section_no) AS spot FROM f JOIN s ON f.doc_id = s.doc_id AND f.anchor = s.title WHERE anchor <> '' GROUP BY ALL),
hh AS (SELECT fragment, f.doc_id, section_no, arg_min(ends, (h <> anchor, pos)) FILTER (level >= 3) AS off FROM f JOIN bh ON f.doc_id = bh.doc_id AND contains(h, anchor) WHERE anchor <> '' AND level BETWEEN 2 AND 4 GROUP BY ALL),
hf AS (SELECT fragment, doc_id, arg_min((section_no, off), section_no) AS spot FROM hh GROUP BY ALL),
z AS (SELECT doc_id, arg_max((section_no, size), section_no) AS spot FROM s GROUP BY ALL)
SELECT f.doc_id, f.fragment, CAST(coalesce(t.spot[1], hf.spot[1], z.spot[1]) AS BIGINT) AS section_no, CAST(coalesce(t.spot[2], CASE WHEN hf.spot IS NOT NULL THEN coalesce(hf.spot[2], s.size) ELSE z.spot[2] END) AS BIGINT) AS "offset",
CASE WHEN t.spot IS NOT NULL THEN 'title' WHEN hf.spot IS NOT NULL THEN 'heading' ELSE 'last' END AS how
FROM f JOIN z ON f.doc_id = z.doc_id LEFT JOIN t ON f.doc_id = t.doc_id AND f.fragment = t.fragment LEFT JOIN hf ON f.doc_id = hf.doc_id AND f.fragment = hf.fragment LEFT JOIN s ON s.doc_id = f.doc_id AND s.section_no = hf.spot[1]""")
def place_fragments(spark, sf_dir):
    sections, fragments = _sections_and_fragments(spark, sf_dir)
    made = M.place_fragments(fragments, sections, "doc_id")
    return made.withColumns({c: F.col(c).cast("long") for c in ("section_no", "offset")})


@query(f"WITH {_DEEP}, {_FRAGMENTS} SELECT doc_id, trim(regexp_extract(anchor, '^\\[FIGURA: (.*)\\]$', 1)) AS figure, max(fragment) AS fragment FROM fr WHERE starts_with(anchor, '[FIGURA: ') GROUP BY ALL")
def figure_overrides(spark, sf_dir):
    return M.figure_overrides(_sections_and_fragments(spark, sf_dir)[1], "doc_id")


def _blocks_and_topics(spark, sf_dir):
    """Documents as blocks; topics are the second heading with a letter more, a name that is nowhere, and the fourth heading."""
    from tessella.operators.structure import ordered

    docs = S.stored(_deep_lines(spark, sf_dir).groupBy("doc_id").agg(ordered("line_no", "line").alias("markdown")))
    heads = F.transform(F.filter(F.split("markdown", "\n"), lambda x: x.startswith("##")), lambda x: F.regexp_replace(x, "^#+ ", ""))
    topic = lambda o, name: F.struct(F.lit(o).alias("ord"), name.alias("name"))
    three = docs.select("doc_id", heads.alias("h")).select("doc_id", F.array(topic(1, F.concat(F.get("h", F.lit(1)), F.lit(" x"))), topic(2, F.lit("zzz")), topic(3, F.get("h", F.lit(3)))).alias("t"))
    topics = three.select("doc_id", F.explode("t").alias("t")).select("doc_id", "t.*").filter("name is not null")
    return docs, topics.withColumn("evidence", F.lit(None).cast("string"))


_SPLIT = f"""{_DEEP}, hd AS (SELECT doc_id, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_replace(line, '^#+ ', '')) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS nth, pos
  FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS pos FROM md) WHERE starts_with(line, '##')),
b AS (SELECT doc_id, trim(string_agg(line, chr(10) ORDER BY line_no), chr(10) || chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM md GROUP BY 1),
tp AS (SELECT doc_id, 1 AS ord, h || ' x' AS name FROM hd WHERE nth = 2 UNION ALL SELECT doc_id, 2, 'zzz' FROM b UNION ALL SELECT doc_id, 3, h FROM hd WHERE nth = 4),
k AS (SELECT tp.doc_id, ord, pos, h, level, {_TITLE.format('name')} AS x, {_TITLE.format('h')} AS y FROM tp JOIN hd ON tp.doc_id = hd.doc_id), pr AS (SELECT x, y FROM k WHERE x <> ''), {ratio('pr')},
sc AS (SELECT doc_id, ord, pos, h, least(1e0, r + CASE WHEN contains(k.x, k.y) OR contains(k.y, k.x) THEN 0.15 ELSE 0 END + CASE WHEN r > 0.6 AND level = 3 THEN 0.05 ELSE 0 END) AS score FROM k JOIN ratio ON k.x = ratio.x AND k.y = ratio.y),
o1 AS (SELECT doc_id, arg_min((pos, h, score), (-score, pos)) AS m FROM sc WHERE ord = 1 AND score >= 0.78 GROUP BY 1),
o2 AS (SELECT sc.doc_id, arg_min((pos, h, score), (-score, pos)) AS m FROM sc LEFT JOIN o1 USING (doc_id) WHERE ord = 2 AND score >= 0.78 AND pos > coalesce(o1.m[1], -1) GROUP BY 1),
o3 AS (SELECT sc.doc_id, arg_min((pos, h, score), (-score, pos)) AS m FROM sc LEFT JOIN o1 USING (doc_id) LEFT JOIN o2 USING (doc_id) WHERE ord = 3 AND score >= 0.78 AND pos > coalesce(o2.m[1], o1.m[1], -1) GROUP BY 1),
an AS (SELECT tp.*, body, length(body) AS size, coalesce(o1.m, o2.m, o3.m) AS m, row_number() OVER (PARTITION BY tp.doc_id ORDER BY ord) - 1 AS i FROM tp JOIN b USING (doc_id)
  LEFT JOIN o1 ON tp.doc_id = o1.doc_id AND ord = 1 LEFT JOIN o2 ON tp.doc_id = o2.doc_id AND ord = 2 LEFT JOIN o3 ON tp.doc_id = o3.doc_id AND ord = 3),
fx AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, max(m[1]) OVER (PARTITION BY doc_id) AS anywhere, coalesce(m[1], CASE WHEN i = 0 THEN 0 END) AS spot FROM an),
lh AS (SELECT *, last_value(spot IGNORE NULLS) OVER back AS p0, last_value(CASE WHEN spot IS NOT NULL THEN i END IGNORE NULLS) OVER back AS i0, first_value(spot IGNORE NULLS) OVER ahead AS p1, first_value(CASE WHEN spot IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS i1 FROM fx
  WINDOW back AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
st AS (SELECT *, CAST(CASE WHEN anywhere IS NULL THEN 0 WHEN spot IS NOT NULL THEN spot WHEN p1 IS NOT NULL THEN p0 + (p1 - p0) * (i - i0) // (i1 - i0)
  ELSE p0 + sum(CASE WHEN i1 IS NULL THEN (size - p0) * (i - i0) // (n - i0) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) END AS BIGINT) AS start FROM lh),
en AS (SELECT *, CAST(greatest(start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY ord), size)) AS BIGINT) AS stop FROM st),
pc AS (SELECT *, trim(substr(body, start + 1, stop - start), chr(10) || ' ') AS own, CASE WHEN i = 0 AND m[1] > 0 THEN trim(substr(body, 1, CAST(m[1] AS BIGINT)), chr(10) || ' ') ELSE '' END AS intro FROM en),
fr AS (SELECT *, CASE WHEN intro <> '' AND NOT contains(own, intro) THEN trim(intro || chr(10) || chr(10) || own, chr(10) || ' ') ELSE own END AS text FROM pc)"""


@query(f"""WITH RECURSIVE {_SPLIT} SELECT doc_id, CAST(ord AS BIGINT) AS ord, start, stop AS "end", m[2] AS anchor, round_even(coalesce(m[3], 0), 3) AS score, CASE WHEN m IS NULL THEN 'sin_ancla' ELSE 'alta' END AS confidence,
md5('# ' || name || chr(10) || chr(10) || CASE WHEN body = '' THEN '*Sin contenido.*' WHEN text = '' THEN '*Sin contenido detectado para este apartado.*' ELSE text END) AS markdown_md5,
CASE WHEN body = '' THEN 'El markdown del bloque está vacío.' ELSE concat_ws('|', CASE WHEN m IS NULL THEN 'No se localizó título para «' || name || '»; contenido inferido por posición.' END, CASE WHEN m IS NOT NULL AND text = '' THEN 'Ancla encontrada pero el tramo asignado está vacío.' END) END AS warnings FROM fr""")
def split_at_anchors(spark, sf_dir):
    made = N.split_at_anchors(*_blocks_and_topics(spark, sf_dir), "doc_id")
    return made.select("doc_id", "ord", "start", "end", "anchor", "score", "confidence", F.md5("markdown").alias("markdown_md5"), F.array_join("warnings", "|").alias("warnings"))


@query(f"""WITH RECURSIVE {_SPLIT} SELECT doc_id, count(*) AS n, round_even(avg(coalesce(m[3], 0)), 3) AS score, bool_or(body = '' OR m IS NULL OR text = '') AS review FROM fr GROUP BY 1""")
def split_summary(spark, sf_dir):
    docs, topics = _blocks_and_topics(spark, sf_dir)
    return N.split_summary(N.split_at_anchors(docs, topics, "doc_id"), docs, "doc_id")


@query("SELECT c_custkey, o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def material_of_block(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")
    o = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return o.join(c, "c_custkey")
