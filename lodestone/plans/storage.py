"""Queries that write files and read them again, that call model slots, and that keep what has been said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import cleaning, models
from lodestone.operators import sessions as ss
from lodestone.operators import structure as st
from lodestone.operators import tables as tb
from lodestone.plans import oracle as o
from lodestone.plans import tables as tp
from lodestone.plans.registry import query
from lodestone.sources import files, overlay
from lodestone.sources.overlay import paragraphs, read
from lodestone.sources.shared import folder
from lodestone.streaming import events as ev


@query("paragraph_files", o.sql("SELECT stream, idx, content, page FROM stream", "stream"))
def paragraph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs, through JSON files."""
    at = folder(spark)
    files.save_streams(paragraphs(spark, sf_dir), at)
    return files.streams(spark, at)


def probed(df: DataFrame) -> DataFrame:
    """Streams with page furniture among their first hundred paragraphs, cleaned of it; the others as they are."""
    bad = t.is_furniture(F.col("content"))
    dirty = df.where("idx < 100").where(bad).select("stream").distinct().withColumn("dirty", F.lit(True))
    rows = df.join(dirty, "stream", "left").where(F.col("dirty").isNull() | ~bad).drop("dirty")
    return cleaning.reindexed(rows)


PROBED = f"probed AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY idx) - 1 AS idx, content, page FROM (SELECT *, bool_or(idx < 100 AND {o.furniture()}) OVER (PARTITION BY stream) AS dirty FROM stream) WHERE NOT dirty OR NOT {o.furniture()})"
ON_PROBED = PROBED + ",\n" + o.CTE["rows"].replace("FROM stream)", "FROM probed)")
SHOWN = """heads AS (SELECT stream, article, part.num AS num, part.title AS title, min(idx) AS ord FROM rows WHERE kind = 'part' GROUP BY ALL),
arts AS (SELECT DISTINCT stream, article FROM rows WHERE kind = 'article' AND {chapter} IS NOT NULL),
leads AS (SELECT DISTINCT stream, article, NULL::VARCHAR AS num, NULL::VARCHAR AS title, -1 AS ord FROM (SELECT stream, article FROM subs WHERE part IS NULL UNION ALL SELECT stream, article FROM arts ANTI JOIN heads USING (stream, article))),
held AS (SELECT stream, article, coalesce(part, '') AS key, string_agg(section, ',' ORDER BY ord) AS ids, list_sort(list_distinct(flatten(list(refs)))) AS refs FROM subs GROUP BY ALL),
plines AS (SELECT p.stream, p.article, p.ord, p.title, coalesce(p.num, '-') || ' ' || coalesce(p.title, '-') || ': ' || coalesce(h.ids, '') || ' [' || coalesce(array_to_string(h.refs, ','), '') || ']' AS line
 FROM (SELECT * FROM heads UNION ALL SELECT * FROM leads) p SEMI JOIN arts USING (stream, article) LEFT JOIN held h ON h.stream = p.stream AND h.article = p.article AND h.key = coalesce(p.num, ''))""".format(chapter=o.chapter("article"))
LINES = "SELECT stream, article, string_agg(line, ' / ' ORDER BY ord, title) AS parts FROM plines GROUP BY stream, article"


def _lines(tree: DataFrame) -> DataFrame:
    """The nested parts as one line an article."""
    no = lambda x: F.coalesce(x, F.lit("-"))
    one = F.transform("parts", lambda p: F.concat(no(p["num"]), F.lit(" "), no(p["title"]), F.lit(": "), F.array_join(F.transform(p["subsections"], lambda s: s["id"]), ","), F.lit(" ["), F.array_join(p["refs"], ","), F.lit("]")))
    return tree.select("stream", "article", F.array_join(one, " / ").alias("parts"))


@query("part_tree", o.sql(LINES, "subs", extra=SHOWN))
def part_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.classified(paragraphs(spark, sf_dir))
    return _lines(st.part_tree(rows, st.subsections(rows)))


@query("structure_files", o.sql(LINES, "subs", extra=SHOWN).replace(o.CTE["rows"], ON_PROBED))
def structure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean files in, furniture looked for, parsed, the tree written as JSON and read again."""
    at = folder(spark)
    files.save_streams(paragraphs(spark, sf_dir), f"{at}/clean")
    rows = st.classified(probed(files.streams(spark, f"{at}/clean")))
    tree = st.part_tree(rows, st.subsections(rows))
    files.save_json(tree, f"{at}/structured")
    return _lines(files.json(spark, f"{at}/structured", tree))


# tables: cache, corrected files, corrections


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp._structures(spark, sf_dir)


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("table_id").agg(F.max_by("structure", F.struct("stream", "start")).alias("structure"))


NUMBER = "CAST(regexp_extract(table_id, '[0-9]+', 0) AS BIGINT)"
BEST = f", best AS (SELECT table_id, arg_max({tp.RENDERED}, stream * 1000000000 + start) AS markdown FROM paired GROUP BY table_id)"


@query("table_cached", o.sql(f"SELECT f.stream, f.start, CASE WHEN {NUMBER.replace('table_id', 'f.table_id')} % 2 = 0 THEN b.markdown ELSE k.formatted END AS formatted FROM fragments f JOIN blocks k ON k.stream = f.stream AND k.idx = f.start JOIN best b USING (table_id)", "passed", extra=tp.PAIRED + BEST))
def table_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of even articles from the cache's files, the others as blocks of text."""
    at, rows = folder(spark), _tables(spark, sf_dir)
    cache = _last(rows).where(F.expr(NUMBER) % 2 == 0)
    files.save_json(cache, at)
    return tb.formatted(rows.select("stream", "start", "table_id", "fragments"), files.json(spark, at, cache)).select("stream", "start", "formatted")


@query("corrected_files", o.sql(f"SELECT table_id, CASE WHEN {NUMBER} % 5 = 0 THEN 'Again ' || title ELSE title END AS title, CAST(len(data) AS BIGINT) AS n_rows FROM (SELECT table_id, arg_max(title, stream * 1000000000 + start) AS title, arg_max(data, stream * 1000000000 + start) AS data FROM paired GROUP BY table_id) WHERE {NUMBER} % 7 <> 0", "fragments", extra=tp.PAIRED))
def corrected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected tables in three files: one isn't to be read, and of what stands in two the reconstructed one wins."""
    at, rows = folder(spark), _last(_tables(spark, sf_dir))
    n = F.expr(NUMBER)
    again = rows.where((n % 5 == 0) & (n % 7 != 0)).withColumn("structure", F.col("structure").withField("title", F.concat(F.lit("Again "), "structure.title")))
    for name, part in (("all", rows.where(n % 7 != 0)), ("raw", rows), ("reconstructed", again)):
        files.save_json(part, f"{at}/table_{name}.json")
    best = files.corrected_tables(spark, at, rows, ("raw",), "reconstructed").groupBy("table_id").agg(F.max_by("structure", "priority").alias("s"))
    return best.select("table_id", "s.title", F.size("s.data_rows").cast("bigint").alias("n_rows"))


KIND = f"CASE {NUMBER} % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'manual_override' WHEN 2 THEN 'stolen_data' WHEN 3 THEN 'multi_page_merge' WHEN 4 THEN 'llm_retry_with_instructions' WHEN 5 THEN 'no such fix' END"
ACTION = f"CASE {KIND} WHEN 'manual_override' THEN CASE {NUMBER} // 7 % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'override' ELSE 'invalid' END WHEN 'no such fix' THEN 'unknown' WHEN 'ok' THEN 'keep' ELSE 'rebuild' END"
PARTS = f"""parted AS (SELECT table_id, list(fragments ORDER BY stream, start) AS parts FROM fragments GROUP BY table_id),
dealt AS (SELECT table_id, CASE WHEN {KIND} IS NULL THEN 'keep' ELSE {ACTION} END AS action, CASE WHEN {KIND} = 'multi_page_merge' THEN list_concat(parts[1], flatten(list_transform(parts[2:], lambda p: list_filter(p, lambda y: y <> parts[1][1])))) ELSE parts[1] END AS f, parts[1] AS old FROM parted)"""


@query("corrections_cache", o.sql("""SELECT table_id, action, CASE WHEN action = 'override' THEN 'By hand' ELSE trim(replace(old[1], '*', '')) END AS title,
 CAST(CASE WHEN action = 'override' THEN 1 WHEN action = 'rebuild' AND len(f) >= 2 AND len(f) <> 2 THEN greatest(len(f) - 3, 0) // 2 ELSE greatest(len(old) - 3, 0) // 2 END AS BIGINT) AS n_rows FROM dealt""", "fragments", extra=PARTS))
def corrections_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of every kind, by the table's number: what is done with each, and the cache that they leave."""
    rows = _tables(spark, sf_dir)
    made = lambda *data: F.struct(F.lit("By hand").alias("title"), F.array(F.lit("a"), F.lit("b")).alias("column_headers"), F.array(*(F.array(*map(F.lit, r)) for r in data)).alias("data_rows"), F.array().cast("array<string>").alias("footnotes")).cast(tb.STRUCTURE)
    which = F.expr(f"{NUMBER} div 7 % 3")
    fixes = rows.select("table_id").distinct().select("table_id", F.expr(KIND).alias("fix_category"), F.when(which == 0, "skip").alias("override_action"), F.when(which == 1, made(("1", "2"))).when(which == 2, made(("1",))).alias("override_data"), F.lit("look again").alias("extra_instructions")).where("fix_category is not null")
    cache = tb.after_corrections(rows, fixes, tp.paired(F.col("fragments")))
    done = tb.corrected(rows, fixes).select("table_id", "action")
    return cache.join(done, "table_id").select("table_id", "action", "structure.title", F.size("structure.data_rows").cast("bigint").alias("n_rows"))


@query("grid_counts", o.sql("SELECT count(*) FILTER (len(fragments) > 8) AS grids, count(*) FILTER (len(fragments) <= 8) AS blocks FROM fragments", "fragments"))
def grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with over eight fragments rendered as a grid, the others as text."""
    rows = _tables(spark, sf_dir)
    return tb.grid_counts(rows.select("table_id", F.when(F.size("fragments") > 8, tb.render(F.col("structure"))).otherwise(tb.text_block(F.element_at("fragments", 1), F.col("fragments"))).alias("content")))


# vectors and models


@query("vector_collection", "SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 0")
def vector_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written for one model, not written again while it is there, read by its key."""
    at, v = folder(spark), read(spark, sf_dir, "embeddings")
    overlay.save_collection(v.where("vec_id % 2 = 0"), at, "even")
    overlay.save_collection(v, at, "even")
    overlay.save_collection(v, at, "all")
    return spark.read.schema(v.schema).parquet(f"{at}/model_key=even").select("vec_id", "label")


VOWELS = " || ',' || ".join(f"(length(text) - length(replace(text, '{v}', '')))" for v in "aeiou")


@query("batch_embedding", f"SELECT item_id, {VOWELS} AS vector FROM benchmark")
def batch_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model in the embedding slot, over all passages."""
    v = models.embedding("text", models.letters)
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query("pair_scores", "SELECT a.conv_id, a.turn, round(1 / (1 + exp(-(length(b.text) - length(a.text)) / 100.0)), 9) AS score FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model in the cross-encoder slot, over neighbouring turns; scores from 0 to 1."""
    a = read(spark, sf_dir, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(models.pair_score("text", "other", models.longer), 9).alias("score"))


# messages and logs


@query("message_records", """SELECT conv_id, turn, '{"role":"' || CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE 'tool' END || '","content":' || to_json(coalesce(text, '')) || CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN ',"tool_calls":[{"name":"lookup","args":{"ids":["' || conv_id || '"]},"id":"c' || turn || '"}]' WHEN role = 'system' THEN ',"tool_call_id":"c' || (turn + 1) || '","name":"lookup"' ELSE '' END || '}' AS record FROM conversations""")
def message_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with content, tool calls and what answers them; system turns stand for tools."""
    role = F.when(F.col("role") == "system", "tool").otherwise(F.col("role"))
    call = F.struct(F.lit("lookup").alias("name"), F.struct(F.array(F.col("conv_id").cast("string")).alias("ids")).alias("args"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"))
    calls = F.when(F.col("turn") % 3 == 1, F.array(call)).otherwise(F.array().cast("array<struct<name:string,args:struct<ids:array<string>>,id:string>>"))
    back = F.concat(F.lit("c"), (F.col("turn") + 1).cast("string"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", ss.serialized(role, F.col("text"), calls, back, F.lit("lookup")).alias("record"))


@query("feedback_log", "SELECT conv_id AS session_id, arg_min(text, turn) AS feedback_text, count(*) AS message_count FROM conversations WHERE conv_id % 4 > 0 GROUP BY conv_id HAVING trim(coalesce(arg_min(text, turn), '')) <> ''")
def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback with its conversation, appended in two batches; blank feedback isn't taken."""
    at = folder(spark)
    c = read(spark, sf_dir, "conversations")
    talk = F.transform(F.array_sort(F.collect_list(F.struct("turn", ss.serialized(F.col("role"), F.col("text")).alias("m")))), lambda x: x["m"])
    rows = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.min_by("text", "turn").alias("first"), F.count("*").alias("message_count"), talk.alias("conversation"))
    rows = rows.select("session_id", F.when(F.col("session_id") % 4 == 0, "  ").otherwise(F.col("first")).alias("feedback_text"), "message_count", "conversation")
    for k in (0, 1):
        ev.feedback_sink(at)(rows.where(F.col("session_id") % 2 == k), k)
    return spark.read.schema("session_id long, feedback_text string, message_count long, conversation array<string>, timestamp timestamp").json(at).where("timestamp is not null and size(conversation) = message_count").select("session_id", "feedback_text", "message_count")


@query("result_log", "SELECT 'result' AS kind, CAST(doc_id AS VARCHAR) AS name, quality AS passed, 1 - quality AS failed FROM labels UNION ALL SELECT 'summary', 'all', sum(quality), count(*) - sum(quality) FROM labels")
def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of results, line by line, and a summary line computed from it."""
    at = folder(spark)
    schema = "kind string, name string, passed long, failed long"
    one = read(spark, sf_dir, "labels").select(F.lit("result").alias("kind"), F.col("doc_id").cast("string").alias("name"), F.col("quality").cast("long").alias("passed"), (1 - F.col("quality")).cast("long").alias("failed"))
    one.write.mode("append").json(f"{at}/log")
    total = spark.read.schema(schema).json(f"{at}/log").where("kind = 'result'").agg(F.lit("summary").alias("kind"), F.lit("all").alias("name"), F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))
    total.write.mode("append").json(f"{at}/summary")
    return spark.read.schema(schema).json([f"{at}/log", f"{at}/summary"])


@query("base64_texts", "SELECT item_id, to_base64(encode(text)) AS body, length(text) AS n FROM benchmark")
def base64_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in base64, decoded again for their length."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.base64(F.encode("text", "UTF-8")).alias("b"))
    rows = rows.withColumn("body", F.regexp_replace("b", r"\s", ""))
    return rows.select("item_id", "body", F.length(F.decode(F.unbase64("body"), "UTF-8")).cast("bigint").alias("n"))


@query("name_uuids", "SELECT conv_id, turn, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT conv_id, turn, md5(conv_id || '/' || turn) AS h FROM conversations)")
def name_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", ss.name_uuid(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("uuid"))
