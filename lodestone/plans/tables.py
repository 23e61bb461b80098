"""Queries on tables inside the stream: where they are, what they hold, rendering, parsing, checks and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import tables as tb
from lodestone.plans import oracle as o
from lodestone.plans.registry import query
from lodestone.sources.overlay import paragraphs, read
from lodestone.sources.shared import stored


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = tb.classified(paragraphs(spark, sf_dir))
    return df, stored(tb.table_regions(df))


@query("table_starts", o.sql("SELECT * FROM starts", "starts"))
def table_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table_starts(paragraphs(spark, sf_dir))


@query("table_continuations", o.sql("SELECT stream, idx, tid AS table_id FROM kinds WHERE title AND after = 'Continued'", "kinds"))
def table_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.continuations(paragraphs(spark, sf_dir))


@query("table_regions", o.sql("SELECT * FROM regions", "regions"))
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table_regions(paragraphs(spark, sf_dir))


@query("raw_table_regions", o.sql(f"""SELECT s.stream, s.idx AS start, s.tid AS table_id, coalesce(min(x.idx) - 1, any_value(s.last)) AS finish
 FROM (SELECT *, least(idx + 300, max(idx) OVER (PARTITION BY stream)) AS last FROM kinds) s LEFT JOIN kinds x ON x.stream = s.stream AND x.idx > s.idx AND x.idx <= s.idx + 300
  AND ((x.title AND x.tid <> s.tid) OR ({o.m('x.content', '^[0-9]{2,}[.][0-9]+ [A-Z]')} AND length(x.content) > 20) OR {o.m('x.content', '^Part [IVX]+[.]')})
 WHERE s.title AND s.after IS DISTINCT FROM 'Continued' GROUP BY s.stream, s.idx, s.tid""", "kinds"))
def raw_table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.raw_regions(paragraphs(spark, sf_dir))


@query("leading_cells", o.sql(f"""SELECT s.stream, s.idx AS start, s.tid AS table_id, coalesce(min(x.idx) - 1, any_value(s.last)) - s.idx AS cells
 FROM (SELECT *, least(idx + 300, max(idx) OVER (PARTITION BY stream)) AS last FROM kinds) s LEFT JOIN kinds x ON x.stream = s.stream AND x.idx > s.idx AND x.idx <= s.idx + 300
  AND (length(x.content) >= 80 OR {o.m('x.content', '^[0-9]{2,}[.][0-9]+ [A-Z]')}) WHERE s.title AND s.after IS DISTINCT FROM 'Continued' GROUP BY s.stream, s.idx, s.tid""", "kinds"))
def leading_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.leading_cells(paragraphs(spark, sf_dir))


@query("table_fragments", o.sql("SELECT stream, start, table_id, array_to_string(fragments, '|') AS fragments, CAST(len(fragments) AS BIGINT) AS n FROM fragments", "fragments"))
def table_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tb.table_fragments(paragraphs(spark, sf_dir))
    return f.select("stream", "start", "table_id", F.array_join("fragments", "|").alias("fragments"), F.size("fragments").cast("bigint").alias("n"))


@query("interruptions", o.sql("SELECT * FROM cuts", "cuts"))
def interruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.interruptions(*_regions(spark, sf_dir))


@query("table_pass", o.sql("SELECT * FROM passed", "passed"))
def table_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table_pass(paragraphs(spark, sf_dir)).select("stream", "idx", "content", "page")


# A structure of two columns for every table: the first two cells are the header, an odd cell at the end is a note.


def paired(fragments: Column) -> Column:
    def table(cells: Column) -> Column:
        n = F.floor((F.greatest(F.size(cells), F.lit(2)) - 2) / 2).cast("int")
        rows = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(cells, i * 2 + 3, 2))
        return F.struct(F.trim(F.replace(F.element_at(fragments, 1), F.lit("*"), F.lit(""))).alias("title"), F.slice(cells, 1, 2).alias("column_headers"), rows.alias("data_rows"), F.slice(cells, n * 2 + 3, 1).alias("footnotes"))

    return t.let(F.transform(F.slice(fragments, 2, 1_000_000), lambda x: F.trim(x)), table)


PAIRED = """cleancells AS (SELECT stream, start, table_id, trim(replace(fragments[1], '*', '')) AS title, list_transform(fragments[2:], lambda x: trim(x)) AS cells FROM fragments),
paired AS (SELECT stream, start, table_id, title, cells[1:2] AS heads, list_transform(range((len(cells) - 2) // 2), lambda i: [cells[2 * i + 3], cells[2 * i + 4]]) AS data, CASE WHEN (len(cells) - 2) % 2 = 1 THEN cells[-1:] ELSE [] END AS notes FROM cleancells)"""
ROW = "'| ' || array_to_string({}, ' | ') || ' |'"
RULE = ROW.format("list_transform(heads, lambda h: '---')")
RENDERED = f"'**' || title || '**' || chr(10) || chr(10) || {ROW.format('heads')} || chr(10) || {RULE} || array_to_string(list_transform(data, lambda r: chr(10) || {ROW.format('r')}), '') || CASE WHEN len(notes) > 0 THEN chr(10) || chr(10) || array_to_string(list_transform(notes, lambda n: '> ' || n), chr(10)) ELSE '' END"


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, start, table_id, fragments and structure of every table, however small."""
    f = tb.table_fragments(paragraphs(spark, sf_dir))
    return stored(f.withColumn("structure", paired(F.col("fragments"))))


@query("table_render", o.sql(f"SELECT stream, start, {RENDERED} AS markdown FROM paired", "fragments", extra=PAIRED))
def table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structures(spark, sf_dir).select("stream", "start", tb.render(F.col("structure")).alias("markdown"))


SHOWN = f"'**' || title || '**' || CASE WHEN len(heads) > 0 THEN chr(10) || {ROW.format('heads')} || chr(10) || {RULE} || array_to_string(list_transform(data, lambda r: chr(10) || {ROW.format('r')}), '') ELSE '' END || array_to_string(list_transform(notes, lambda n: chr(10) || '> ' || n), '')"


@query("table_display", o.sql(f"SELECT stream, start, {SHOWN} AS markdown, title || CASE WHEN len(heads) > 0 THEN chr(10) || 'Columns: ' || array_to_string(heads, ' | ') ELSE '' END AS to_embed FROM paired", "fragments", extra=PAIRED))
def table_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("structure")
    return _structures(spark, sf_dir).select("stream", "start", tb.display(s).alias("markdown"), tb.embedding_text(s).alias("to_embed"))


@query("table_review", o.sql(f"SELECT stream, start, '| # | ' || array_to_string(heads, ' | ') || ' |' || chr(10) || '| --- ' || {RULE} || array_to_string(list_transform(data, lambda r, i: chr(10) || '| ' || i || ' | ' || array_to_string(r, ' | ') || ' |'), '') || array_to_string(list_transform(notes, lambda n: chr(10) || '- ' || n), '') AS listing FROM paired", "fragments", extra=PAIRED))
def table_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structures(spark, sf_dir).select("stream", "start", tb.numbered(F.col("structure")).alias("listing"))


@query("table_roundtrip", o.sql("SELECT stream, start, title, array_to_string(heads, '/') AS heads, CAST(len(data) AS BIGINT) AS n_rows, array_to_string(list_transform(data, lambda r: array_to_string(r, ';')), '/') AS cells, array_to_string(notes, '/') AS notes FROM paired", "fragments", extra=PAIRED))
def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structure rendered and parsed again."""
    p = F.col("p")
    rows = _structures(spark, sf_dir).select("stream", "start", tb.parse(tb.render(F.col("structure"))).alias("p"))
    return rows.select("stream", "start", p["title"].alias("title"), F.array_join(p["column_headers"], "/").alias("heads"), F.size(p["data_rows"]).cast("bigint").alias("n_rows"), F.array_join(F.transform(p["data_rows"], lambda r: F.array_join(r, ";")), "/").alias("cells"), F.array_join(p["footnotes"], "/").alias("notes"))


@query("table_text_block", o.sql("SELECT stream, idx AS start, formatted FROM blocks", "passed"))
def table_text_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.formatted(tb.table_fragments(paragraphs(spark, sf_dir))).select("stream", "start", "formatted")


@query("table_width_check", o.sql("SELECT stream, start, len(cells) % 3 <> 1 AS ok FROM (SELECT stream, start, fragments[2:] AS cells FROM fragments)", "fragments"))
def table_width_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of up to two cells under a two-column header, the last one left as it comes; a table is fine if none is short."""
    f = tb.table_fragments(paragraphs(spark, sf_dir))
    cells = F.slice("fragments", 2, 1_000_000)
    rows = F.transform(F.when(F.size(cells) > 0, F.sequence(F.lit(0), F.size(cells) - 1, F.lit(3))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(cells, i + 1, 2))
    s = F.struct(F.array(F.lit("a"), F.lit("b")).alias("column_headers"), rows.alias("data_rows"))
    return f.select("stream", "start", tb.widths_ok(s).alias("ok"))


@query("table_column_candidates", o.sql("SELECT stream, start, array_to_string(list_filter(range(1, greatest(h, 1) + 1), lambda n: d % n = 0 AND h - n BETWEEN 0 AND 5 AND h >= 1), ',') AS columns FROM (SELECT stream, start, len(fragments) // 3 AS h, len(fragments) - len(fragments) // 3 AS d FROM fragments)", "fragments"))
def table_column_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tb.table_fragments(paragraphs(spark, sf_dir))
    h = F.floor(F.size("fragments") / 3).cast("int")
    return f.select("stream", "start", F.array_join(F.transform(tb.column_counts(h, F.size("fragments") - h), lambda x: x.cast("string")), ",").alias("columns"))


@query("table_reconstruct")
def table_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table through cache (none here), deterministic reconstruction, text block."""
    f = tb.table_fragments(paragraphs(spark, sf_dir))
    return tb.formatted(f, None, tb.inferred(F.col("fragments"))).select("stream", "start", "table_id", "formatted")


TRIAGE = """, cached AS (SELECT table_id, CAST(max(len(data)) AS BIGINT) AS n_rows FROM paired GROUP BY table_id), shown AS (SELECT table_id, bool_or(len(fragments) > 8) AS has_grid FROM fragments WHERE len(fragments) < 12 GROUP BY table_id)"""


@query("table_triage", o.sql("SELECT table_id, coalesce(n_rows, -1) AS n_rows, coalesce(has_grid, false) AS has_grid, CASE WHEN n_rows BETWEEN 0 AND 1 THEN 'few_rows' WHEN NOT has_grid THEN 'no_grid' ELSE 'none' END AS problem FROM shown FULL JOIN cached USING (table_id)", "fragments", extra=PAIRED + TRIAGE))
def table_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tb.table_fragments(paragraphs(spark, sf_dir))
    output = f.where(F.size("fragments") < 12).select("table_id", F.when(F.size("fragments") > 8, F.array_join("fragments", " | ")).otherwise(F.array_join("fragments", "\n")).alias("content"))
    cache = f.withColumn("structure", paired(F.col("fragments")))
    cache = cache.groupBy("table_id").agg(F.max_by("structure", F.size("structure.data_rows")).alias("structure"))
    return tb.triage(output, cache)


@query("table_neighbours", o.sql("""SELECT a.stream, a.table_id AS target, b.table_id, b.seat - a.at AS distance FROM (SELECT stream, table_id, min(seat) AS at FROM seats GROUP BY ALL) a JOIN seats b ON b.stream = a.stream AND b.seat BETWEEN a.at - 3 AND a.at + 3""", "regions", extra="seats AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY start) AS seat FROM regions)"))
def table_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, regions = _regions(spark, sf_dir)
    return tb.neighbours(regions, regions.select("table_id").distinct())


@query("table_selection", o.sql("SELECT stream, start, table_id, wanted FROM regions, (VALUES ('Table100'), ('Table220.55(A)(note)')) w(wanted) WHERE contains(table_id, wanted) OR contains(wanted, table_id)", "regions"))
def table_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.selected(_regions(spark, sf_dir)[1], ["Table100", "Table220.55(A)(note)"]).select("stream", "start", "table_id", "wanted")


KIND = "CASE CAST(regexp_extract(table_id, '[0-9]+') AS BIGINT) % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'manual_override' WHEN 2 THEN 'stolen_data' WHEN 3 THEN 'multi_page_merge' WHEN 4 THEN 'llm_retry_with_instructions' END"


@query("corrections_apply", o.sql(f"""SELECT table_id, CASE coalesce(kind, 'ok') WHEN 'ok' THEN 'keep' WHEN 'manual_override' THEN 'skip' ELSE 'rebuild' END AS action,
 array_to_string(CASE WHEN kind = 'multi_page_merge' THEN list_concat(parts[1], flatten(list_transform(parts[2:], lambda p: list_filter(p, lambda y: y <> parts[1][1])))) ELSE parts[1] END, '|') AS fragments, CASE WHEN kind = 'llm_retry_with_instructions' THEN 'look again' END AS instructions
 FROM (SELECT table_id, {KIND} AS kind, list(fragments ORDER BY stream, start) AS parts FROM fragments GROUP BY table_id)""", "fragments"))
def corrections_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _structures(spark, sf_dir)
    no = F.lit(None).cast(tb.STRUCTURE)
    fixes = rows.select("table_id").distinct().select("table_id", F.expr(KIND.replace("regexp_extract(table_id, '[0-9]+')", "regexp_extract(table_id, '[0-9]+', 0)")).alias("fix_category"), F.lit("skip").alias("override_action"), no.alias("override_data"), F.lit("look again").alias("extra_instructions")).where("fix_category is not null")
    return tb.corrected(rows, fixes).select("table_id", "action", F.array_join("fragments", "|").alias("fragments"), "instructions")


@query("corrected_merge", o.sql(f"SELECT p.stream, p.idx, coalesce(x.markdown, p.content) AS content, p.page FROM passed p LEFT JOIN best x ON starts_with(p.content, '**Table') AND x.table_id = replace(regexp_extract(p.content, '^[*][*](Table\\s*[0-9]+[.][0-9]+(?:\\s*[(][^)]*[)])*)', 1), ' ', '')", "passed", extra=PAIRED + f", best AS (SELECT table_id, arg_max({RENDERED}, stream * 1000000 + start) AS markdown FROM paired GROUP BY table_id)"))
def corrected_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = _structures(spark, sf_dir).select("table_id", "structure", (F.col("stream") * 1_000_000 + F.col("start")).alias("priority"))
    return tb.merged_tables(tb.table_pass(paragraphs(spark, sf_dir)), fixed)


@query("cross_join_flatten", "SELECT p_brand AS trade_name, p_type AS insulation, p_size AS temp, p_partkey AS awg, p_retailprice AS mm, p_name AS mils FROM part")
def cross_join_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts nested by brand, type and size, and flattened again."""
    parts = read(spark, sf_dir, "part")
    sizes = parts.groupBy("p_brand", "p_type", "p_size").agg(F.collect_list(F.struct(F.col("p_partkey").alias("awg"), F.col("p_retailprice").alias("mm"), F.col("p_name").alias("mils"))).alias("triplets"))
    entry = F.struct(F.col("p_size").alias("temp"), F.lit("").alias("application"), F.lit("").alias("covering"), "triplets")
    types = sizes.groupBy("p_brand", "p_type").agg(F.collect_list(entry).alias("entries")).select(F.col("p_brand").alias("trade_name"), F.lit("").alias("type_letter"), F.col("p_type").alias("insulation"), "entries")
    return tb.flattened(types).select("trade_name", "insulation", "temp", "awg", "mm", "mils")
