"""Queries on conversations and events: histories, usage, folding and pairing of events, windows, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import sessions as ss
from lodestone.plans.registry import query
from lodestone.sources.overlay import read
from lodestone.sources.shared import folder
from lodestone.streaming import events as ev


@query("session_history", "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.history(read(spark, sf_dir, "conversations"))


@query("session_reset", "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM (SELECT *, max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS reset FROM conversations) WHERE reset IS NULL OR turn > reset GROUP BY conv_id")
def session_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every system turn starts a new session."""
    rows = read(spark, sf_dir, "conversations")
    return ss.history(rows, rows.where("role = 'system'").select("conv_id", "turn"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("bigint")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", n).otherwise(0).alias("prompt_tokens"), F.when(F.col("role") == "assistant", n).otherwise(0).alias("completion_tokens"))


@query("token_usage", "SELECT conv_id AS session_id, CAST(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS completion_tokens, CAST(sum(CASE WHEN role IN ('user', 'assistant') THEN length(text) ELSE 0 END) AS BIGINT) AS total_tokens FROM conversations GROUP BY conv_id")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.usage(_calls(spark, sf_dir))


@query("last_prompt_tokens", "SELECT session_id, coalesce(arg_max(n, turn) FILTER (n IS NOT NULL), 0) AS prompt_tokens FROM (SELECT conv_id AS session_id, turn, coalesce(nullif(CASE WHEN role = 'user' THEN length(text) ELSE 0 END, 0), CASE WHEN role = 'assistant' THEN turn END) AS n FROM conversations) GROUP BY session_id")
def last_prompt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).withColumns({"usage_a": F.col("prompt_tokens"), "usage_b": F.when(F.col("completion_tokens") > 0, F.col("seq"))})
    return ss.last_prompt(calls)


@query("message_json", """SELECT conv_id, turn, '{"role":"' || role || '","n":' || length(text) || '}' AS message FROM conversations""")
def message_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.length("text").alias("n"))).alias("message"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parts of a response: views and clicks are deltas, a purchase is a final text."""
    kind = F.when(F.col("event_type").isin("view", "click"), "text_delta").when(F.col("event_type") == "purchase", "final").when(F.col("event_type") == "signup", "tool_start").otherwise("tool_end")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat("event_type", F.col("event_id").cast("string")).alias("content"), F.expr("event_id div 40").cast("string").alias("call_id"))


STREAM = "es AS (SELECT user_id AS session_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'text_delta' WHEN event_type = 'purchase' THEN 'final' WHEN event_type = 'signup' THEN 'tool_start' ELSE 'tool_end' END AS type, event_type || event_id AS content, CAST(event_id // 40 AS VARCHAR) AS call_id FROM events)"


@query("delta_fold", f"WITH {STREAM} SELECT session_id, coalesce(arg_max(content, seq) FILTER (type = 'final'), string_agg(content, '' ORDER BY seq) FILTER (type = 'text_delta'), '') AS response FROM es GROUP BY session_id")
def delta_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.folded(_stream(spark, sf_dir))


@query("tool_pairing", f"WITH {STREAM} SELECT session_id, call_id, min(seq) FILTER (type = 'tool_start') AS started, min(seq) FILTER (type = 'tool_end') AS ended FROM es WHERE type LIKE 'tool%' GROUP BY ALL HAVING started IS NOT NULL")
def tool_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.paired(_stream(spark, sf_dir))


@query("event_descriptions", "SELECT event_id, CASE event_type WHEN 'view' THEN 'Looking up ' || array_to_string(ids[1:3], ', ') || CASE WHEN len(ids) > 3 THEN ', ...' ELSE '' END WHEN 'click' THEN 'Browsing the structure' WHEN 'purchase' THEN 'Searching' ELSE 'Calling ' || event_type END AS description FROM (SELECT event_id, event_type, list_transform(range(1, event_id % 5 + 2), lambda x: CAST(x AS VARCHAR)) AS ids FROM events)")
def event_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.when(F.col("event_type") == "view", "lookup").when(F.col("event_type") == "click", "browse").when(F.col("event_type") == "purchase", "search").otherwise(F.col("event_type"))
    ids = F.transform(F.sequence(F.lit(1), (F.col("event_id") % 5 + 1).cast("int")), lambda x: x.cast("string"))
    return read(spark, sf_dir, "events").select("event_id", ss.describe(tool, ids).alias("description"))


@query("sse_round_trip", f"WITH {STREAM} SELECT session_id, seq, type, content AS payload FROM es")
def sse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's events written as data lines, with a broken one among them, and read again."""
    line = ss.sse_encode(F.struct("seq", "type", F.col("content").alias("payload")))
    rows = _stream(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "data: {broken\n\n").alias("stream"))
    return ss.sse_decode(rows)


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS from_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.windowed(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("event_sliding", "SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL (30 * k) MINUTE AS from_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(2) r(k) GROUP BY ALL")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.windowed(read(spark, sf_dir, "events"), "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


SESSIONS = "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts > lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)"


@query("event_sessions", SESSIONS + " SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY user_id, k")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.sessions_of(read(spark, sf_dir, "events"))


def _streamed(spark: SparkSession, sf_dir: str, made, schema: str, mode: str) -> DataFrame:
    """The events table as a stream, run over all that is there; the sink's rows."""
    at = folder(spark)
    source = ev.source(spark, f"{sf_dir}/events.parquet*")
    ev.to_table(made(source), f"{at}/checkpoint", lambda rows, batch: rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/rows"), mode).awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/rows")


@query("stream_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS from_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, ev.windowed, "from_ts timestamp, event_type string, n long, total double", "complete").withColumn("total", F.round("total", 4))


@query("stream_distinct", "SELECT DISTINCT event_id, user_id FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: ev.distinct(s).select("event_id", "user_id"), "event_id long, user_id long", "append")


@query("stream_usage", "SELECT user_id AS session_id, CAST(sum(length(event_type)) AS BIGINT) AS prompt_tokens, CAST(sum(length(props)) AS BIGINT) AS completion_tokens FROM events GROUP BY user_id")
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lambda s: ev.usage(s.select(F.col("user_id").alias("session_id"), F.length("event_type").cast("long").alias("prompt_tokens"), F.length("props").cast("long").alias("completion_tokens")))
    return _streamed(spark, sf_dir, tokens, "session_id long, prompt_tokens long, completion_tokens long", "complete")


@query("stream_unseen", "SELECT DISTINCT user_id AS session_id, event_type AS section_id FROM events")
def stream_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplication across calls as keyed state: what a session has seen isn't returned again."""
    calls = lambda s: ev.unseen(s.select(F.col("user_id").alias("session_id"), "ts", F.col("event_type").alias("section_id"))).drop("ts")
    return _streamed(spark, sf_dir, calls, "session_id long, section_id string", "append")


def _late(spark: SparkSession, sf_dir: str, made, schema: str) -> DataFrame:
    """Two thirds of the events first, then the last third, most of which is late: two runs of one stream, by its checkpoint."""
    at = folder(spark)
    for late in (False, True):
        part = read(spark, sf_dir, "events").where(f"(event_id % 3 = 0) = {late}")
        part.coalesce(1).write.mode("append").parquet(f"{at}/events")
        ev.to_table(made(ev.source(spark, f"{at}/events")), f"{at}/checkpoint", lambda rows, batch: rows.write.mode("append").parquet(f"{at}/rows")).awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/rows")


LATE = """marks AS (SELECT max(ts) FILTER (event_id % 3 <> 0) - INTERVAL 10 MINUTE AS one, max(ts) - INTERVAL 10 MINUTE AS two FROM events)"""


@query("stream_late_windows", f"WITH {LATE} SELECT from_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS from_ts FROM events), marks WHERE (event_id % 3 <> 0 OR from_ts + INTERVAL 1 HOUR > one) AND from_ts + INTERVAL 1 HOUR <= two GROUP BY ALL")
def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: a window comes out once when the watermark has passed it, and what is later than that is left out."""
    return _late(spark, sf_dir, ev.windowed, "from_ts timestamp, event_type string, n long, total double").withColumn("total", F.round("total", 4))


@query("stream_sessions", SESSIONS.replace("WITH e AS", "WITH top AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events), e AS") + " SELECT user_id, min(ts) AS from_ts, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT mark FROM top)")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows on a stream: those that the watermark has closed."""
    return _streamed(spark, sf_dir, ev.sessions, "user_id long, from_ts timestamp, n long", "append")
