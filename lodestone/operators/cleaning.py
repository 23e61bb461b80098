"""Cleaning of paragraph streams (stream, idx, content, page): filters, repair of sentences over a page's end, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.functions.profile import DEFAULT, Profile
from lodestone.sources.shared import stored


def reindexed(df: DataFrame) -> DataFrame:
    """Numbers run from 0 without gaps again."""
    return df.withColumn("idx", F.row_number().over(t.by_stream()).cast("bigint") - 1)


def content_pages(df: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    return reindexed(df.where(F.col("page").between(p.first_page, p.last_page)))


def without_furniture(df: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    return reindexed(df.where(~t.is_furniture(F.col("content"), p)))


def dehyphenated(df: DataFrame) -> DataFrame:
    return df.withColumn("content", t.dehyphenated(F.col("content")))


def _marked(df: DataFrame, p: Profile) -> DataFrame:
    """The rows with what the search for page breaks asks of each: stop (of a page mark, the row before which a page ended),
    header, first (can it be a sentence's first half?) and second."""
    c = F.col("content")
    stop = F.when(c == p.forward, F.col("idx")).when(c == p.reverse, F.col("idx") - 1)
    return df.withColumns({"stop": stop, "header": F.lower(c).contains("article") & t.upper_only(c), "first": t.may_run_over(c), "second": t.may_go_on(c)})


def _page_breaks(rows: DataFrame) -> DataFrame:
    """rows of _marked() with at (the row of the first half), hit (does the sentence there go on behind this header?) and
    gone (is this row the second half?). With a column ``dropped``, marks that have it don't count."""
    alive = F.col("dropped").isNull() if "dropped" in rows.columns else F.lit(True)
    by = t.by_stream()
    here = F.struct("idx", "first")
    rows = rows.withColumns({"one": F.lag(here).over(by), "two": F.lag(here, 2).over(by), "behind": F.lead(F.struct("idx", "second")).over(by)})
    at = F.col("stop") - 1
    half = F.when(F.col("one.idx") == at, F.col("one.first")).when(F.col("two.idx") == at, F.col("two.first"))
    mark = F.when(alive & F.col("stop").isNotNull(), F.struct("stop", half.alias("first")))
    # without a mark before a page ends at row 99
    rows = rows.withColumns({"mark": F.last(mark, ignorenulls=True).over(by), "early": F.last(F.when(F.col("idx") == 98, here), ignorenulls=True).over(by)})
    last = F.coalesce("mark", F.struct(F.lit(99).cast("bigint").alias("stop"), F.col("early.first").alias("first")))
    hit = alive & F.col("header") & (F.col("idx") > last["stop"]) & F.col("behind.second") & last["first"]
    rows = rows.withColumns({"at": last["stop"] - 1, "hit": F.coalesce(hit, F.lit(False))})
    gone = F.lag(F.struct("idx", "hit")).over(by)
    rows = rows.withColumn("last", gone).withColumn("gone", F.coalesce(F.col("last.hit") & (F.col("last.idx") == F.col("idx") - 1), F.lit(False)))
    return rows.drop("one", "two", "behind", "mark", "early", "last")


def sentence_runover(df: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """Joins the halves of a sentence on either side of a page break. A half that goes may itself be a page mark, which
    then no longer counts; such streams are gone over again until nothing changes (one pass, almost always). The passes
    read no contents; these move once more, by stream, when all is known."""
    df = stored(_marked(df, p))
    narrow, dropped = df.select("stream", "idx", "stop", "header", "first", "second"), None
    without = lambda rows: rows if dropped is None else rows.join(dropped.withColumn("dropped", F.lit(True)), ["stream", "idx"], "left")
    while True:
        rows = _page_breaks(without(narrow)).where(F.col("gone") & F.col("stop").isNotNull())
        marks = stored((rows if dropped is None else rows.where("dropped is null")).select("stream", "idx"))
        if marks.isEmpty():
            break
        dropped = marks if dropped is None else dropped.unionAll(marks)
    rows = _page_breaks(without(df))
    half = F.when(F.col("hit"), F.struct(F.lead("content").over(t.by_stream()).alias("content"), (F.col("page") - 1).alias("page")))
    rows = rows.withColumn("half", half).withColumn("key", F.when(F.col("hit"), F.col("at")).otherwise(F.col("idx")))
    # a header is no first half, so a row without a hit finds here the halves that belong to it; the last one counts
    one = W.partitionBy("stream", "key").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("m", F.last("half", ignorenulls=True).over(one)).withColumn("m", F.when(~F.col("hit"), F.col("m")))
    rows = rows.where(~F.col("gone") | F.col("m").isNotNull())
    content = F.when(F.col("m").isNotNull(), F.concat_ws(" ", "content", "m.content")).otherwise(F.col("content"))
    return reindexed(rows.select("stream", "idx", content.alias("content"), F.coalesce("m.page", "page").alias("page")))


def plain_text(df: DataFrame, separator: str = "\n") -> DataFrame:
    """stream and its text, without characters above U+00FF."""
    return df.groupBy("stream").agg(t.ordered_join(F.col("idx"), t.latin(F.col("content")), separator).alias("text"))
