"""Conversations and event streams in batch form: histories, usage, folding of deltas, pairing, wire format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as t

EVENT = "seq bigint, type string, payload string"


def history(messages: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """conv_id, turns and the messages (conv_id, turn, role, text) as one text; from the last reset (conv_id, turn) on."""
    rows = messages
    if resets is not None:
        rows = rows.join(resets.groupBy("conv_id").agg(F.max("turn").alias("from")), "conv_id", "left").where("from is null or turn > from")
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), t.ordered_join(F.col("turn"), line, "\n").alias("history"))


def usage(calls: DataFrame) -> DataFrame:
    """Sums of prompt, completion and total tokens of each session_id."""
    return calls.groupBy("session_id").agg(*(F.sum(x).cast("bigint").alias(x) for x in ("prompt_tokens", "completion_tokens")), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint").alias("total_tokens"))


def last_prompt(calls: DataFrame) -> DataFrame:
    """The prompt tokens (either of two fields, the first that isn't 0) of each session's last call that has any, else 0."""
    n = F.coalesce(F.nullif("usage_a", F.lit(0)), F.nullif("usage_b", F.lit(0)))
    return calls.groupBy("session_id").agg(F.coalesce(F.max_by(n, F.when(n.isNotNull(), F.col("seq"))), F.lit(0)).cast("bigint").alias("prompt_tokens"))


def folded(events: DataFrame) -> DataFrame:
    """session_id and response: the last final text, else all deltas in order. events: session_id, seq, type, content."""
    final = F.max_by(F.when(F.col("type") == "final", F.col("content")), F.when(F.col("type") == "final", F.col("seq")))
    deltas = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "text_delta", F.struct("seq", "content")))), lambda x: x["content"]), "")
    return events.groupBy("session_id").agg(F.coalesce(final, deltas).alias("response"))


def paired(events: DataFrame) -> DataFrame:
    """session_id, call_id, started, ended (null while it runs) of tool calls; events: session_id, seq, type, call_id."""
    one = events.where(F.col("type").isin("tool_start", "tool_end")).groupBy("session_id", "call_id")
    return one.agg(F.min(F.when(F.col("type") == "tool_start", F.col("seq"))).alias("started"), F.min(F.when(F.col("type") == "tool_end", F.col("seq"))).alias("ended")).where("started is not null")


def describe(tool: Column, ids: Column) -> Column:
    """A line about a call; it names the first three ids at most."""
    more = F.when(F.size(ids) > 3, ", ...").otherwise("")
    return F.when(tool == "lookup", F.concat(F.lit("Looking up "), F.array_join(F.slice(ids, 1, 3), ", "), more)).when(tool == "browse", F.lit("Browsing the structure")).when(tool == "search", F.lit("Searching")).otherwise(F.concat(F.lit("Calling "), tool))


def sse_encode(event: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def sse_decode(df: DataFrame, column: str = "stream") -> DataFrame:
    """The events of a text of data lines; what isn't JSON is skipped."""
    parts = F.filter(F.split(column, "\n\n"), lambda x: x.startswith("data: "))
    keep = [x for x in df.columns if x != column]
    rows = df.select(*keep, F.explode(parts).alias("raw")).withColumn("e", F.from_json(F.substring("raw", 7, 1_000_000_000), EVENT))
    return rows.where(F.col("e.type").isNotNull()).select(*keep, "e.*")


def sessions_of(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, first and last time and number of events of each run of events without a longer gap."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.col("ts") > F.lag("ts").over(w) + F.expr(f"interval {gap}")).cast("int"), F.lit(1))
    rows = events.withColumn("new", new).withColumn("n", F.sum("new").over(w))
    return rows.groupBy("user_id", "n").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events")).drop("n")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left with the ``value`` of the latest row of right at or before ``at``, for the same ``by``: both sides in one
    stream, filled forward, so there is one shuffle and no product of rows."""
    one = left.select(by, at, *(x for x in left.columns if x not in (by, at)), F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"))
    two = right.select(by, at, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    rows = one.unionByName(two, allowMissingColumns=True)
    w = W.partitionBy(by).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*left.columns, F.col("__last").alias(f"last_{value}"))


ROLES = {"user": "human", "assistant": "ai"}


def serialized(role: Column, content: Column, calls: Column | None = None, call_id: Column | None = None, name: Column | None = None) -> Column:
    """A message as JSON: role and content; of an answer the tool calls (array of name, args, id) if it has any; of a
    tool's message the call that it answers, and the tool's name."""
    kind = role
    for k, v in ROLES.items():
        kind = F.when(role == k, v).otherwise(kind)
    fields = [kind.alias("role"), F.coalesce(content, F.lit("")).alias("content")]
    if calls is not None:
        fields.append(F.when((role == "assistant") & (F.size(calls) > 0), calls).alias("tool_calls"))
    if call_id is not None:
        fields.append(F.when(role == "tool", call_id).alias("tool_call_id"))
    if name is not None:
        fields.append(F.when(role == "tool", name).alias("name"))
    return F.to_json(F.struct(*fields))


def name_uuid(name: Column) -> Column:
    """A name's own identifier, in the form of a UUID."""
    h = F.md5(name)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
