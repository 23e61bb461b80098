"""Readers, and a deterministic regulatory overlay on the documents table.

Hundred documents make a stream of paragraphs; fixed positions become article titles, Part headers, sections, tables,
page marks and so on, so the structural operators have something to find at any scale. The same arithmetic is written
once and read by Spark and, for the oracles, by DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PARAGRAPHS = "doc_id STRING, idx BIGINT, content STRING, page INT"

ART = "CASE WHEN DIV(idx, 40) % 9 = 4 THEN 100 ELSE 90 + (stream * 31 + DIV(idx, 40) * 7) % 905 END"
CONTENT = f"""CASE
 WHEN idx % 40 = 0 THEN 'ARTICLE ' || ({ART}) || ' Topic ' || DIV(idx, 40)
 WHEN idx % 40 = 1 THEN 'Part ' || CASE DIV(idx, 40) % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'IV' ELSE 'XI' END || '. Heading ' || (DIV(idx, 40) % 5)
 WHEN idx % 40 = 9 OR (idx % 40 = 18 AND DIV(idx, 40) % 3 = 0) THEN 'Table ' || ({ART}) || '.' || (DIV(idx, 40) % 3 + 1) || CASE WHEN DIV(idx, 40) % 2 = 0 THEN ' (A)' ELSE '' END || ' Ratings of ' || substr(body, 1, 12)
 WHEN idx % 40 = 8 AND DIV(idx, 40) % 3 = 0 THEN body || ' with the'
 WHEN idx % 40 = 12 AND DIV(idx, 40) % 3 = 0 THEN 'rest of a sentence that a table at the page end has cut in two halves, ' || lower(body)
 WHEN idx % 40 BETWEEN 10 AND 16 THEN CASE idx % 3 WHEN 0 THEN CAST(idx % 97 AS VARCHAR(20)) WHEN 1 THEN (idx % 50) || '/' || (idx % 7) ELSE substr(body, 1, 14) END
 WHEN idx % 40 = 17 THEN CASE DIV(idx, 40) % 3 WHEN 0 THEN '(continues)' WHEN 1 THEN '1 Footnote in Column ' || substr(body, 1, 60) ELSE lower(body) END
 WHEN idx % 40 = 19 AND DIV(idx, 40) % 3 = 0 THEN 'Continued'
 WHEN idx % 40 = 30 THEN CASE WHEN DIV(idx, 40) % 2 = 0 THEN '2023 Edition STANDARD CODE' ELSE 'STANDARD CODE 2023 Edition' END
 WHEN idx % 40 = 31 THEN '70-' || page
 WHEN idx % 40 = 32 THEN 'ARTICLE ' || ({ART}) || ' - SCOPE RULES'
 WHEN idx % 40 = 33 THEN lower(body)
 WHEN idx % 40 = 34 AND DIV(idx, 40) % 5 = 1 THEN 'Copyright @Press 2023'
 WHEN idx % 40 = 34 AND DIV(idx, 40) % 5 = 2 THEN 'Chapter 3 Wiring'
 WHEN idx % 40 = 36 AND DIV(idx, 40) % 4 = 1 THEN 'Informational Note: ' || body
 WHEN idx % 40 = 37 AND DIV(idx, 40) % 4 = 1 THEN '[' || body || ']'
 WHEN idx % 8 = 3 THEN ({ART}) || '.' || (DIV(idx, 8) % 5 + 1) || ' Rule ' || body
 WHEN idx % 8 = 4 THEN '(' || chr(65 + CAST(DIV(idx, 8) % 3 AS INT)) || ') ' || body
 WHEN idx % 8 = 5 THEN '(1) Item. ' || body
 WHEN idx % 8 = 6 THEN body || ' see Table ' || ({ART}) || '.1 (A) and Table 220.55'
 WHEN idx % 8 = 7 THEN 'pro- ' || body || '– co- operate 3- wire'
 ELSE body END"""


def overlay_sql(dialect: str) -> str:
    """The content expression for spark or duckdb."""
    out = CONTENT
    while "DIV(" in out:
        i = out.rindex("DIV(")
        j = out.index(")", i)
        a, b = out[i + 4 : j].split(", ")
        out = f"{out[:i]}({a} {'div' if dialect == 'spark' else '//'} {b}){out[j + 1 :]}"
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, idx, content and page of the overlay."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = W.partitionBy("stream").orderBy("doc_id", "pos")
    rows = docs.select(F.expr("doc_id div 100").alias("stream"), "doc_id", "pos", F.replace("line", F.lit("|"), F.lit("/")).alias("body"))
    rows = rows.withColumn("idx", F.row_number().over(w).cast("bigint") - 1).withColumn("page", F.expr("20 + idx div 12"))
    # through a generator, so that the long expression isn't copied into every predicate that reads it
    return rows.select("stream", "idx", F.inline(F.array(F.struct(F.expr(overlay_sql("spark")).alias("content"), "page"))))


DUCK_STREAM = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
numbered AS (SELECT doc_id // 100 AS stream, replace(line, '|', '/') AS body, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id, pos) - 1 AS idx FROM lines),
paged AS (SELECT *, 20 + idx // 12 AS page FROM numbered),
stream AS (SELECT stream, idx, {overlay_sql('duckdb')} AS content, page FROM paged)"""


def paragraph_json(spark: SparkSession, path: str) -> DataFrame:
    """A file that maps running numbers to content and page, one file a document: doc_id, idx, content, page."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.from_json("value", "map<string,struct<content:string,page:int>>").alias("m"))
    return raw.select("doc_id", F.explode("m").alias("k", "p")).select("doc_id", F.col("k").cast("bigint").alias("idx"), "p.content", "p.page")


def save_paragraph_json(df: DataFrame, path: str) -> None:
    """The same form, one JSON object a document (doc_id, idx, content, page)."""
    entry = F.struct(F.col("idx").cast("string").alias("key"), F.struct("content", "page").alias("value"))
    one = df.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("idx", entry.alias("e")))), lambda x: x["e"]))).alias("value"))
    one.select("value").write.mode("overwrite").text(path)


def save_collection(df: DataFrame, path: str, model: str, reset: bool = False) -> bool:
    """Vectors of one model under their own partition; one that is there already stays, unless reset. True if written."""
    spark = df.sparkSession
    target = f"{path}/model_key={model}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) and not reset:
        return False
    df.write.mode("overwrite").parquet(target)
    return True
