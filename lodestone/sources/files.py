"""JSON files of paragraphs, structured documents and tables: what one job leaves for another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STREAMS = "stream bigint, paragraphs map<string, struct<content:string, page:int>>"


def save_streams(df: DataFrame, path: str) -> None:
    """One JSON object a line for each stream: its number, and a map from running numbers to content and page."""
    entry = F.struct(F.col("idx").cast("string").alias("key"), F.struct("content", F.col("page").cast("int").alias("page")).alias("value"))
    by = F.transform(F.array_sort(F.collect_list(F.struct("idx", entry.alias("e")))), lambda x: x["e"])
    df.groupBy("stream").agg(F.map_from_entries(by).alias("paragraphs")).write.mode("overwrite").json(path)


def streams(spark: SparkSession, path: str) -> DataFrame:
    """stream, idx, content and page of what save_streams() wrote."""
    rows = spark.read.schema(STREAMS).json(path).select("stream", F.explode("paragraphs").alias("k", "p"))
    return rows.select("stream", F.col("k").cast("bigint").alias("idx"), "p.content", "p.page")


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Rows of ``like``'s schema from JSON files."""
    return spark.read.schema(like.schema).json(path)


def corrected_tables(spark: SparkSession, path: str, like: DataFrame, skip: tuple[str, ...] = (), last: str = "") -> DataFrame:
    """table_id, structure and priority of all table_<name>.json under path (folders or files) but those of the names to
    skip; what comes from the file named ``last`` wins."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"table_([^/]*)\.json", 1)
    rows = spark.read.schema(like.schema).json(f"{path}/table_*.json").select("*", name.alias("name"))
    return rows.where(~F.col("name").isin(*skip) if skip else F.lit(True)).withColumn("priority", (F.col("name") == last).cast("bigint")).drop("name")
