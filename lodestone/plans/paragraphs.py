"""Queries on the paragraph stream: filters, predicates, repair of sentences, the cleaning chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import cleaning, tables
from lodestone.plans import oracle as o
from lodestone.plans.registry import query
from lodestone.sources.overlay import paragraphs

NEXT = "row_number() OVER (PARTITION BY stream ORDER BY idx) - 1 AS idx"


@query("junk_page_filter", o.sql(f"SELECT stream, {NEXT}, content, page FROM stream WHERE page BETWEEN 26 AND 717", "stream"))
def junk_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.content_pages(paragraphs(spark, sf_dir)).select("stream", "idx", "content", "page")


@query("furniture_filter", o.sql(f"SELECT stream, {NEXT}, content, page FROM stream WHERE NOT {o.furniture()}", "stream"))
def furniture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.without_furniture(paragraphs(spark, sf_dir)).select("stream", "idx", "content", "page")


@query("reindex", o.sql(f"SELECT stream, {NEXT}, idx AS old_idx FROM stream WHERE NOT {o.title()}", "stream"))
def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).where(~t.is_table_title(F.col("content"))).withColumn("old_idx", F.col("idx"))
    return cleaning.reindexed(rows).select("stream", "idx", "old_idx")


@query("dehyphenate", o.sql("SELECT stream, idx, regexp_replace(content, '([A-Za-z])- ', '\\1', 'g') AS content FROM stream", "stream"))
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.dehyphenated(paragraphs(spark, sf_dir)).select("stream", "idx", "content")


LATIN = "regexp_replace({}, '[^\\x00-\\xFF]', '', 'g')"


@query("charset_strip", o.sql(f"SELECT stream, idx, {LATIN.format('content')} AS content FROM stream", "stream"))
def charset_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("stream", "idx", t.latin(F.col("content")).alias("content"))


@query("plain_text_export", o.sql(f"SELECT stream, string_agg({LATIN.format('content')}, chr(10) ORDER BY idx) AS text FROM stream GROUP BY stream", "stream"))
def plain_text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.plain_text(paragraphs(spark, sf_dir))


def _flag(name: str, spark_expr, sql_expr: str) -> None:
    @query(name, o.sql(f"SELECT stream, idx, {sql_expr} AS flag FROM stream", "stream"))
    def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
        return paragraphs(spark, sf_dir).select("stream", "idx", spark_expr(F.col("content")).alias("flag"))


for _name, _f, _s in (
    ("furniture_flags", t.is_furniture, o.furniture()),
    ("page_marker_flags", t.is_page_marker, o.marker()),
    ("table_title_flags", t.is_table_title, o.title()),
    ("section_boundaries", t.is_section_boundary, o.boundary()),
    ("footnote_flags", t.is_footnote, o.footnote()),
    ("continuation_markers", t.is_continuation_marker, o.continuation()),
    ("data_like_cells", t.is_data_like, o.data_like()),
    ("subsection_starts", t.is_subsection_start, o.section_start()),
):
    _flag(_name, _f, _s)


@query("table_ids", o.sql(f"SELECT stream, idx, {o.tid()} AS table_id FROM stream", "stream"))
def table_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("stream", "idx", t.table_id(F.col("content")).alias("table_id"))


@query("paragraph_classes", o.sql(f"SELECT CASE WHEN {o.furniture()} THEN 'furniture' WHEN {o.title()} THEN 'title' WHEN {o.boundary()} THEN 'boundary' WHEN {o.continuation()} THEN 'continuation' WHEN {o.data_like()} THEN 'cell' ELSE 'text' END AS class, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM stream GROUP BY ALL", "stream"))
def paragraph_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    kind = F.when(t.is_furniture(c), "furniture").when(t.is_table_title(c), "title").when(t.is_section_boundary(c), "boundary").when(t.is_continuation_marker(c), "continuation").when(t.is_data_like(c), "cell").otherwise("text")
    return paragraphs(spark, sf_dir).groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.sum(F.length("content").cast("bigint")).alias("chars"))


@query("runover_predicate", o.sql(f"SELECT stream, idx, {o.runs_over('content', 'two')} AS goes_on FROM (SELECT *, lead(content) {o.W} AS two FROM stream) WHERE two IS NOT NULL", "stream"))
def runover_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).withColumn("two", F.lead("content").over(t.by_stream())).where("two is not null")
    return rows.select("stream", "idx", t.runs_over(F.col("content"), F.col("two")).alias("goes_on"))


@query("sentence_runover", o.sql("SELECT stream, idx, content, page FROM mended_stream", "stream", extra=o.runover("stream", "mended_stream")))
def sentence_runover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.sentence_runover(paragraphs(spark, sf_dir))


def cleaned(df: DataFrame) -> DataFrame:
    """The chain in its fixed order: pages, tables, sentences, hyphens, furniture."""
    df = tables.table_pass(cleaning.content_pages(df))
    df = cleaning.sentence_runover(df)
    df = cleaning.dehyphenated(df)
    return cleaning.without_furniture(df).select("stream", "idx", "content", "page")


#: ``raw`` is the overlay; the CTEs that follow read the pages kept of it under the name ``stream``.
ON_PAGES = o.CTE["stream"].replace("\nstream AS (", "\nraw AS (") + f",\nstream AS (SELECT stream, {NEXT}, content, page FROM raw WHERE page BETWEEN 26 AND 717)"
CLEANED = o.runover("passed", "joined_stream") + f""",
unhyphened AS (SELECT stream, idx, regexp_replace(content, '([A-Za-z])- ', '\\1', 'g') AS content, page FROM joined_stream),
cleaned AS (SELECT stream, {NEXT}, content, page FROM unhyphened WHERE NOT {o.furniture()})"""


@query("cleaning_pipeline", o.sql("SELECT * FROM cleaned", "passed", extra=CLEANED).replace(o.CTE["stream"], ON_PAGES))
def cleaning_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(paragraphs(spark, sf_dir))
