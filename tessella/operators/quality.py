"""Quality scores, validation, and tables and quantities inside texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as T
from tessella.functions.blocks import block_ratio
from tessella.functions.tokens import tokens_absent, tokens_found

from .structure import ordered


def fidelity(pairs: DataFrame, source: str, output: str, *, longer: int = 4, passing: float = 0.85, show: int = 10) -> DataFrame:
    """pairs with n_terms, score, missing and passed: the share of the source's key terms that occur in the output, also across
    its spaces. Key terms are different words of more than longer letters that are no stopwords and stand in no marker; missing
    has the first ones as the source spells them. The score is rounded, passing is not; without terms the score is 1."""
    # Normal forms are columns of their own, so that they are made once a row and not once a term.
    normal = pairs.withColumn("__all", T.term_norms(F.col(source))).withColumn("__terms", _key_terms(F.col("__all"), longer))
    ready = normal.withColumns({"n_terms": F.size("__terms"), "__line": _line("__terms"), "__letters": _letters(output)})
    spelled = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(source), F.lit("")), T.STRUCTURE_MARKER, " "), rf"[^{T.TERM[1:-2]}]+", "\n"), "\n")
    first = F.transform(F.slice("__absent", 1, show), lambda k: F.element_at(spelled, F.array_position("__all", F.get("__terms", k)).cast("int")))
    return _scored(ready, passing, missing=first).drop("__all", "__terms", "__line", "__letters", "__absent")


def fidelity_in_groups(outputs: DataFrame, sources: DataFrame, group: str, doc: str, source: str, output: str, n: str = "n", *, longer: int = 4, passing: float = 0.85, together: int = 256) -> DataFrame:
    """outputs(group, doc, output, n), sources(group, source, n) -> outputs without output and n, with n_terms, score and passed of
    each output against each source of its group, as fidelity gives them, but null where the source is null. n is about how many
    outputs the group has.

    Key terms are taken once a source, and a large group's outputs are dealt by doc to parts of about together, each with the
    terms beside it, so that no task has a whole group. Texts leave their task as letters and digits."""
    parts = F.greatest(F.lit(1), F.ceil(F.col(n) / together)).cast("int")
    own = [c for c in outputs.columns if c not in (group, output, n)]
    texts = outputs.select(group, *own, F.pmod(F.xxhash64(doc), parts).cast("int").alias("__part"), _letters(output).alias("__letters"))
    terms = sources.select(group, n, F.col(source).isNotNull().alias("__known"), _key_terms(T.term_norms(F.col(source)), longer).alias("__terms"))
    terms = terms.select(group, n, F.when(F.col("__known"), F.size("__terms")).alias("n_terms"), _line("__terms").alias("__line"))
    every = terms.select(group, "n_terms", "__line", F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"))
    met = texts.join(every.hint("shuffle_merge"), [group, "__part"])  # sorted, so that outputs of a source follow one another
    return _scored(met, passing).select(group, *own, "n_terms", "score", "passed")


def _key_terms(norms: Column, longer: int) -> Column:
    return F.filter(F.array_distinct(norms), lambda t: (F.length(t) > longer) & ~t.isin(*T.TERM_STOPWORDS))


def _line(terms: str) -> Column:
    """Terms without the spaces inside them, in a line: one that occurs in an output does so without its spaces too."""
    return F.array_join(F.transform(terms, lambda t: F.replace(t, F.lit(" "), F.lit(""))), " ")


def _letters(output: str) -> Column:
    return T.letters_and_digits(F.coalesce(F.col(output), F.lit("")))


def _scored(ready: DataFrame, passing: float, **more: Column) -> DataFrame:
    """ready(n_terms, __line, __letters) with __absent, score, more and passed."""
    ready.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")  # so that memory doesn't follow the texts
    n = F.col("n_terms")
    share = F.when(n == 0, 1.0).otherwise((n - F.size("__absent")) / n)
    return ready.withColumn("__absent", tokens_absent(F.col("__letters"), F.col("__line"))).withColumns({"score": F.bround(share, 3), **more, "passed": share >= passing})


def fidelity_rollup(scores: DataFrame, block: str, *, passing: float = 0.85) -> DataFrame:
    """block, mean score and whether it warns."""
    mean = F.avg("score")
    return scores.groupBy(block).agg(F.bround(mean, 3).alias("mean_score"), (mean < passing).alias("warns"))


def coverage(docs: DataFrame, topics: DataFrame, within: str, doc: str, item: str, store, *, together: int = 64, parts: int = 64) -> DataFrame:
    """docs(doc, within, norm: normalized content), topics(item, within, tokens) -> doc, item, within, tokens, told (covered, found),
    for all documents and topics of a group. A topic is covered if half of its tokens, rounded up, occur in the content, also
    inside words, or if it has none; repeated ones count each time. Tokens have no white space; store writes a table out. Null
    contents hold nothing.

    Topics, so many together, are brought to the documents, whose contents are normalized once and not shuffled. Topics that are
    too many to be broadcast go to parts tasks for each group, among which the group's documents are dealt."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")  # so that memory doesn't follow the texts
    placed = topics.select(within, item, "tokens").withColumn("__set", F.floor((F.row_number().over(W.partitionBy(within).orderBy(item)) - 1) / together))
    sets = placed.groupBy(within, "__set").agg(F.array_sort(F.collect_list(F.struct(item, "tokens"))).alias("__items"))  # of so many topics
    named = store(sets.select(within, "__items", F.array_join(F.transform("__items", lambda x: F.array_join(x["tokens"], " ")), "\n").alias("__lines")))
    hint = size_hint(named, "__lines")
    texts = docs.select(doc, within, "norm")
    if hint == "broadcast":
        pairs = texts.join(named.hint(hint), within)
    else:
        dealt = texts.withColumn("__part", F.pmod(F.xxhash64(doc, "norm"), F.lit(parts)).cast("int"))
        every = named.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = dealt.join(every.hint(hint), [within, "__part"])
    counted = pairs.withColumn("found", tokens_found(F.col("norm"), F.col("__lines")))
    told = counted.select(doc, within, F.explode(F.arrays_zip("__items", "found")).alias("x")).select(doc, F.col(f"x.__items.{item}").alias(item), within, "x.__items.tokens", "x.found")
    covered = (F.size("tokens") == 0) | (F.col("found") >= F.greatest(F.lit(1), F.floor((F.size("tokens") + 1) / 2)))
    return told.select(doc, item, within, "tokens", F.struct(covered.alias("covered"), "found").alias("told"))


def size_hint(df: DataFrame, *texts: Column | str, most: int = 64 << 20) -> str:
    """How to join df, a stored table: broadcast while its texts and 64 bytes a row, which are counted, are at most so many bytes."""
    size = sum((F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c in texts), F.lit(64).cast("long"))
    return "broadcast" if (df.agg(F.sum(size)).first()[0] or 0) <= most else "shuffle_merge"


def coverage_detail(tokens: Column, told: Column) -> Column:
    """The finding in words."""
    few = F.concat(F.lit("Solo "), told["found"], F.lit("/"), F.size(tokens), F.lit(" términos clave ("), F.array_join(tokens, ", "), F.lit(")"))
    return F.when(F.size(tokens) == 0, "Sin términos evaluables").when(told["covered"], "Detectado en el contenido curado").otherwise(few)


# The markers that cleaning leaves.
MARKERS = {"equation": r"\[ECUACION\]", "partial": r"\[ECUACION_PARCIAL:[^\]]+\]", "reconstructed": r"\[ECUACION_RECONSTRUIDA:[^\]]+\]", "unreadable": r"\[TEXTO_ILEGIBLE\]", "figure": r"\[FIGURA:[^\]]+\]"}


def count_markers(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a count of each marker, and problems and review."""
    counted = df.withColumns({k: F.regexp_count(F.col(text), F.lit(p)) for k, p in MARKERS.items()})
    return counted.withColumns({"problems": F.col("equation") + F.col("partial") + F.col("unreadable"), "review": F.col("reconstructed")})


# The keys of an item, in order, those that hold texts, and messages.
ITEM_KEYS = ("contenido_markdown", "tipo", "titulo_detectado")
MISSING_KEYS, NO_TEXT, NO_TEXT_OR_NULL, NO_OBJECT = "Bloque %s: faltan claves [%s]", "Bloque %s: contenido_markdown no es string", "Bloque %s: titulo_detectado no es string/null", "Bloque %s: no es un objeto"


def validate_items(items: DataFrame, chunks: DataFrame, doc: str, *, passing: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """items(doc, idx from 1, item: JSON), chunks(doc, idx, chunk) -> reports (doc, n_items, errors in order, n_failed, ok) and
    fidelities (doc, idx, score, missing, passed).

    Items are parsed as variants, so a value of a wrong type is an error of its own and not a null. An item must have all of
    ITEM_KEYS, contenido_markdown a text, titulo_detectado a text or null. What is no JSON object is an error and has no keys. An
    item with a chunk is measured against it (fidelity); ok: no errors, and all that are measured pass."""
    parsed = items.select(doc, "idx", F.try_parse_json("item").alias("v"))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "variant")
    kind = lambda k: F.schema_of_variant(get(k))
    object_ = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    absent = F.array_join(F.array_compact(F.array(*[F.when(get(k).isNull(), F.lit(f"'{k}'")) for k in ITEM_KEYS])), ", ")
    told = lambda message, *more: F.format_string(message, F.col("idx").cast("string"), *more)
    errors = F.array(
        F.when(~object_, told(NO_OBJECT)),
        F.when(object_ & (absent != ""), told(MISSING_KEYS, absent)),
        F.when(object_ & (kind("contenido_markdown") != "STRING"), told(NO_TEXT)),
        F.when(object_ & ~kind("titulo_detectado").isin("STRING", "VOID"), told(NO_TEXT_OR_NULL)),
    )
    text = F.coalesce(F.try_variant_get("v", "$.contenido_markdown", "string"), F.when(kind("contenido_markdown") == "VOID", "None"), F.lit(""))
    checked = parsed.select(doc, "idx", F.array_compact(errors).alias("errors"), text.alias("text"))
    met = checked.select(doc, "idx", "text").join(chunks.select(doc, "idx", "chunk").filter("chunk is not null").hint("shuffle_merge"), [doc, "idx"])
    fidelities = fidelity(met, "chunk", "text", passing=passing).select(doc, "idx", "score", "missing", "passed")
    failed = fidelities.groupBy(doc).agg(F.count_if(~F.col("passed")).alias("n_failed"))
    all_ = checked.groupBy(doc).agg(F.count("*").alias("n_items"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "errors"))), lambda x: x["errors"])).alias("errors"))
    reports = all_.join(failed.hint("shuffle_merge"), doc, "left").withColumn("n_failed", F.coalesce("n_failed", F.lit(0)))
    return reports.withColumn("ok", (F.size("errors") == 0) & (F.col("n_failed") == 0)), fidelities


def detect_truncation(lines: DataFrame, doc: str) -> DataFrame:
    """doc, truncated: has the last table row fewer cells than the first one, or an empty last cell?"""
    rows = lines.filter(F.col("line").startswith("|")).withColumn("cells", F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"))
    ends = rows.groupBy(doc).agg(F.min_by(F.size("cells"), "line_no").alias("width"), F.max_by("cells", "line_no").alias("last"))
    return ends.select(doc, ((F.size("last") < F.col("width")) | (F.trim(F.element_at("last", -1)) == "")).alias("truncated"))


def cardinality_check(expected: DataFrame, generated: DataFrame, key: str) -> DataFrame:
    """key, expected, generated, uncovered."""
    e, g = expected.groupBy(key).agg(F.count("*").alias("expected")), generated.groupBy(key).agg(F.count("*").alias("generated"))
    j = e.join(g, key, "full").na.fill(0, ["expected", "generated"])
    return j.withColumn("uncovered", F.greatest(F.lit(0), F.col("expected") - F.col("generated")))


def curve_jumps(points: DataFrame, series: list[str], *, near: float = 0.08, high: float = 0.18, floor: float = 80.0, tall: float = 0.28, steep: float = 6.0, least: float = 0.12, order: str = "x") -> DataFrame:
    """series, idx, rule: the first place where a curve jumps - a large rise within a small step, or a slope far above the one
    before. Points stand in the order given. Series of fewer than three points have none."""
    by, whole = W.partitionBy(*series).orderBy(order), W.partitionBy(*series)
    span = lambda c: F.max(c).over(whole) - F.min(c).over(whole)
    p = points.withColumns({"idx": F.row_number().over(by) - 1, "n": F.count("*").over(whole), "dx": F.abs(F.col("x") - F.lag("x").over(by)), "dy": F.abs(F.col("y") - F.lag("y").over(by)), "xs": span("x"), "ys": span("y")})
    p = p.withColumns({c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c).cast("double")) for c in ("xs", "ys")}).withColumn("slope", F.when(F.col("dx") > 0, F.col("dy") / F.col("dx")))
    p = p.withColumn("before", F.lag(F.col("dy") / F.when(F.col("dx") == 0, 1e-9).otherwise(F.col("dx"))).over(by))
    jump = (F.col("dx") <= near * F.col("xs")) & (F.col("dy") >= high * F.col("ys"))
    bend = (F.col("idx") >= 2) & (F.col("dx") > 0) & (F.col("dy") > F.greatest(F.lit(floor), tall * F.col("ys"))) & (F.col("slope") > steep * F.greatest(F.coalesce("before", F.lit(0.0)), F.lit(0.5))) & (F.col("dy") > least * F.col("ys"))
    found = p.filter("n >= 3").withColumn("rule", F.when(jump, "vertical").when(bend, "slope")).filter("rule is not null")
    return found.groupBy(*series).agg(F.min("idx").alias("idx"), F.min_by("rule", "idx").alias("rule"))


def range_conformance(ranges: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """ranges(key, low, high), values(key, value) -> key, outside, n, known: values beyond their range; keys on one side only."""
    counted = values.join(ranges, key, "left").groupBy(key).agg(F.count(F.when((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), 1)).alias("outside"), F.count("*").alias("n"))
    j = counted.join(ranges.select(key, F.lit(True).alias("declared")), key, "full")
    known = F.when(F.col("n").isNull(), "unused").when(F.col("declared").isNull(), "undeclared").otherwise("both")
    return j.select(key, F.coalesce("outside", F.lit(0)).alias("outside"), F.coalesce("n", F.lit(0)).alias("n"), known.alias("known"))


def edit_percentage(draft: Column, final: Column) -> Column:
    """How much of a draft was changed, in percent, by matching blocks; the final text without surrounding white space. Two empty
    texts: 0; a null final text is empty, a null draft gives null."""
    return F.bround((1 - block_ratio(draft, T.stripped(F.coalesce(final, F.lit(""))))) * 100, 1)


def normalize_hours(topics: DataFrame, group: str, hours: str, order: list[str], *, total: float, tolerance: float = 0.01) -> DataFrame:
    """topics with new_hours: scaled to sum to total and rounded to halves, half-even; no hours at all are dealt evenly; what
    rounding leaves goes to the first of the largest."""
    g = W.partitionBy(group)
    t = topics.withColumns({"sum": F.sum(hours).over(g), "n": F.count("*").over(g)})
    scaled = F.when(F.col("sum") == 0, F.lit(total) / F.col("n")).otherwise(F.col(hours) * total / F.col("sum"))
    t = t.withColumn("new", F.bround(scaled * 2) / 2).withColumns({"rest": F.lit(total) - F.sum("new").over(g), "first": F.row_number().over(g.orderBy(F.desc("new"), *order))})
    changed = F.abs(F.col("sum") - total) > tolerance
    return t.withColumn("new_hours", F.when(changed, F.col("new") + F.when(F.col("first") == 1, F.col("rest")).otherwise(0.0)).otherwise(F.col(hours))).drop("sum", "n", "new", "rest", "first")


def blocks_to_markdown(blocks: DataFrame, topics: DataFrame, doc: str) -> DataFrame:
    """blocks(doc, no, name, hours), topics(doc, no, ord, name, evidence, origin) -> doc, markdown: a heading and a table each."""
    hours = F.when(F.col("hours") == F.floor("hours"), F.floor("hours").cast("string")).otherwise(F.col("hours").cast("string"))
    row = F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.coalesce("evidence", F.lit("Manual")), F.lit(" | "), F.col("origin"), F.lit(" |"))
    rows = topics.groupBy(doc, "no").agg(ordered("ord", row).alias("rows"))
    head = F.concat(F.lit("## Bloque "), F.col("no"), F.lit(" — "), F.col("name"), F.lit(" · "), hours, F.lit("h\n\n| Subtema | Evidencia | Origen |\n|---|---|---|"))
    parts = blocks.join(rows, [doc, "no"], "left").select(doc, "no", F.concat_ws("\n", head, "rows").alias("part"))
    return parts.groupBy(doc).agg(ordered("no", "part", "\n\n").alias("markdown"))


def markdown_to_blocks(lines: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """lines(doc, line_no, line) -> blocks(doc, no, name, hours), topics(doc, no, ord, name, evidence, origin)."""
    head = r"^##\s+Bloque\s+(\d+)\s*[—–-]\s*(.*?)\s*[·•]\s*(\d+(?:[.,]\d+)?)\s*h"
    is_head = F.col("line").rlike(head)
    by = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    no = F.when(is_head, F.regexp_extract("line", head, 1).cast("int"))
    marked = lines.withColumn("no", F.last(no, ignorenulls=True).over(by))
    blocks = marked.filter(is_head).select(doc, "no", F.regexp_extract("line", head, 2).alias("name"), F.regexp_replace(F.regexp_extract("line", head, 3), ",", ".").cast("double").alias("hours"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|\s*|\s*\|$", ""), r"\s*\|\s*"), lambda x: F.trim(x))
    rows = marked.filter(F.col("line").startswith("|") & ~F.col("line").rlike(r"^\|[\s:|-]+\|$") & ~F.col("line").startswith("| Subtema")).withColumn("cells", cells)
    four = (F.size("cells") >= 4)
    hours_second = F.element_at("cells", 2).rlike(r"^\d+(?:[.,]\d+)?\s*h?$")
    evidence = F.when(four, F.element_at("cells", 3)).when(hours_second, F.lit("")).otherwise(F.element_at("cells", 2))
    topics = rows.select(doc, "no", F.row_number().over(W.partitionBy(doc, "no").orderBy("line_no")).alias("ord"), F.element_at("cells", 1).alias("name"), evidence.alias("evidence"), F.element_at("cells", -1).alias("origin"))
    return blocks, topics


def cells_to_markdown_table(cells: DataFrame, table: str) -> DataFrame:
    """cells(table, row, col, text) -> table, markdown, with backslashes and bars escaped and a rule after the first row."""
    safe = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    rows = cells.groupBy(table, "row").agg(F.concat(F.lit("| "), ordered("col", safe, " | "), F.lit(" |")).alias("line"), F.count("*").alias("n"))
    first = F.row_number().over(W.partitionBy(table).orderBy("row")) == 1
    ruled = rows.withColumn("line", F.when(first, F.concat("line", F.lit("\n|"), F.repeat(F.lit("---|"), F.col("n").cast("int")))).otherwise(F.col("line")))
    return ruled.groupBy(table).agg(ordered("row", "line").alias("markdown"))


def equations(c: Column, *, most: int = 12) -> Column:
    """The first different equations of a text: displayed ones, then inline ones."""
    shown = F.regexp_extract_all(c, F.lit(r"(?s)\$\$(.+?)\$\$"), 1)
    inline = F.regexp_extract_all(F.regexp_replace(c, r"(?s)\$\$.+?\$\$", " "), F.lit(r"\$([^$\n]+)\$"), 1)
    return F.slice(F.array_distinct(F.filter(F.transform(F.concat(shown, inline), lambda x: F.trim(x)), lambda e: e != "")), 1, most)


def equation_variables(df: DataFrame, key: str, equation: str) -> DataFrame:
    """key, pos, symbol: the different symbols of an equation - Greek commands and single letters with their index - in order."""
    found = df.select(key, F.posexplode(F.regexp_extract_all(equation, F.lit(r"(\\[a-zA-Z]+|(?<![A-Za-z\\])[A-Za-z](?:_\{[^}]*\}|_[A-Za-z0-9])?(?![A-Za-z]))"), 1)).alias("pos", "symbol"))
    named = found.filter(~F.col("symbol").isin("\\frac", "\\int", "\\sum", "\\cdot", "\\sqrt", "\\left", "\\right"))
    return named.withColumn("r", F.row_number().over(W.partitionBy(key, "symbol").orderBy("pos"))).filter("r = 1").select(key, "pos", "symbol")


def equation_markers(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, kind, pos, payload: equation markers by kind and place."""
    kinds = {"parcial": r"\[ECUACION_PARCIAL:\s*([^\]]*)\]", "reconstruida": r"\[ECUACION_RECONSTRUIDA:\s*([^\]]*)\]", "no_extraible": r"(\[ECUACION_NO_EXTRAIBLE\])"}
    parts = [df.select(key, F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all(text, F.lit(p), 1)).alias("pos", "payload")) for kind, p in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
