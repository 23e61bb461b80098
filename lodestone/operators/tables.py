"""Tables inside a paragraph stream: where they start and end, their fragments, repair of what they interrupt; then
rendering, parsing, checks and corrections. All of it windows, joins and higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.functions.profile import DEFAULT, Profile
from lodestone.operators.cleaning import reindexed
from lodestone.sources.shared import stored

MAX_SCAN = 300
#: A table's structure: header cells, rows of as many cells, notes.
STRUCTURE = "struct<title:string,column_headers:array<string>,data_rows:array<array<string>>,footnotes:array<string>>"


def _kinds(df: DataFrame, p: Profile) -> DataFrame:
    """Adds marker, title, tid, after (the raw next content), goes_on (a mark of continuation), bound and note. What has
    been through here stays as it is, so a stored table of it is classified once for all that reads it."""
    if "goes_on" in df.columns:
        return df
    c = F.col("content")
    return df.withColumns({
        "marker": t.is_page_marker(c, p), "title": t.is_table_title(c), "tid": t.table_id(c), "after": F.lead("content").over(t.by_stream()),
        "goes_on": t.is_continuation_marker(c), "bound": t.is_section_boundary(c), "note": t.is_footnote(c),
    })


def classified(df: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """The stream with what table detection asks of each paragraph, stored."""
    return stored(_kinds(df, p))


def _own() -> WindowSpec:
    """A stream's rows in order, page marks apart from the others."""
    return W.partitionBy("stream", "marker").orderBy("idx")


def _titled(df: DataFrame, p: Profile) -> DataFrame:
    """The rows with real: a title (on a row that is no page mark) that isn't a mere continuation and has short rows behind
    it, page marks not counted."""
    short = F.coalesce(F.sum((F.length("content") < 80).cast("int")).over(_own().rowsBetween(1, 5)), F.lit(0))
    real = ~F.col("marker") & F.col("title") & ~F.col("after").eqNullSafe(F.lit("Continued")) & (F.col("short") >= 2)
    return _kinds(df, p).withColumn("short", short).withColumn("real", F.coalesce(real, F.lit(False)))


def table_starts(df: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """stream, start, table_id, page: titles that aren't mere continuations and have short rows behind them."""
    return _titled(df, p).where("real").select("stream", F.col("idx").alias("start"), F.col("tid").alias("table_id"), "page")


def continuations(df: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """stream, idx and table_id of the titles that only go on with a table from the page before."""
    return _kinds(df, p).where(F.col("title") & (F.col("after") == "Continued")).select("stream", "idx", F.col("tid").alias("table_id"))


def _until(df: DataFrame, stops: Column, p: Profile) -> tuple[DataFrame, Column]:
    """The rows with next (the first stop among the MAX_SCAN rows behind) and end (where the scan ends anyway); and the
    last row before either."""
    rows = _kinds(df, p)
    ahead = t.by_stream().rowsBetween(1, MAX_SCAN)
    end = F.least(F.col("idx") + MAX_SCAN, F.max("idx").over(W.partitionBy("stream")))
    rows = rows.withColumn("next", F.min(F.when(stops, F.col("idx"))).over(ahead)).withColumn("end", end)
    return rows, F.coalesce(F.col("next") - 1, F.col("end"))


_HEAD = r"^[0-9]{2,}\.[0-9]+ [A-Z]"


def raw_regions(df: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """The simpler rule for maintenance: from a title to the row before another table's title, a section or a Part."""
    c = F.col("content")
    other = F.when(F.col("title"), F.struct("tid", "idx"))
    ahead = t.by_stream().rowsBetween(1, MAX_SCAN)
    rows, _ = _until(df, (c.rlike(_HEAD) & (F.length(c) > 20)) | c.rlike(r"^Part [IVX]+\."), p)
    # of the titles ahead, the first with another id than this row's: collected within the bounded frame only
    rows = rows.withColumn("others", F.when(F.col("title"), F.collect_list(other).over(ahead)))
    first = F.array_min(F.transform(F.filter("others", lambda x: x["tid"] != F.col("tid")), lambda x: x["idx"]))
    stop = F.least(F.col("next"), first)
    return rows.where(F.col("title") & ~F.col("after").eqNullSafe(F.lit("Continued"))).select("stream", F.col("idx").alias("start"), F.col("tid").alias("table_id"), F.coalesce(stop - 1, F.col("end")).alias("finish"))


def leading_cells(df: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """How many short rows that don't look like a section follow each title."""
    c = F.col("content")
    rows, last = _until(df, (F.length(c) >= 80) | c.rlike(_HEAD), p)
    return rows.where(F.col("title") & ~F.col("after").eqNullSafe(F.lit("Continued"))).select("stream", F.col("idx").alias("start"), F.col("tid").alias("table_id"), (last - F.col("idx")).alias("cells"))


def _bounded(df: DataFrame, p: Profile) -> DataFrame:
    """The rows with real, start (of the table that they may belong to), finish (that table's last row) and behind (does a
    mark of continuation stand before the row?). One partitioning by stream carries all windows."""
    head = F.when(F.col("real"), F.struct("idx", "tid", "page"))
    rows = _titled(df, p).withColumn("head", F.last(head, ignorenulls=True).over(_own()))
    rows = rows.withColumn("start", F.when(~F.col("marker") & (F.col("idx") < F.col("head.idx") + MAX_SCAN), F.col("head.idx")))
    again = F.col("title") & (F.col("tid") == F.col("head.tid"))
    pair = again & F.col("after").eqNullSafe(F.lit("Continued"))
    c = F.col("content")
    kind = F.when(F.col("real"), "H").when(pair, "P").when(F.col("title"), "T").when(F.col("goes_on"), "M").when(F.col("bound"), "S").otherwise("C")
    whole = W.partitionBy("stream", "start")
    by = whole.orderBy("idx")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"kind": kind, "again": again})
    content = F.col("kind") == "C"
    rows = rows.withColumn("jumps", F.sum(F.col("kind").isin("P", "M").cast("int")).over(by))
    rows = rows.withColumns({
        "prev_page": F.coalesce(F.last(F.when(content, F.col("page")), ignorenulls=True).over(before), F.col("head.page")),
        "prev_jumps": F.coalesce(F.last(F.when(content, F.col("jumps")), ignorenulls=True).over(before), F.lit(0)),
        "seen": F.coalesce(F.max((content & (F.length(c) < 60)).cast("int")).over(before), F.lit(0)) > 0,
        "behind": F.coalesce(F.last(F.when(~F.col("again"), F.col("goes_on")), ignorenulls=True).over(before), F.lit(False)),
    })
    jump = content & (F.length(c) >= 60) & F.col("seen") & ~F.col("note") & (F.col("page") != F.col("prev_page")) & (F.col("jumps") == F.col("prev_jumps"))
    rows = rows.withColumn("stops", F.sum(F.coalesce(F.col("kind").isin("T", "S") | jump, F.lit(False)).cast("int")).over(by))
    inside = F.col("kind").isin("H", "C", "M") & (F.col("stops") == 0)
    return rows.withColumn("finish", F.max(F.when(inside, F.col("idx"))).over(whole)).drop("short", "kind", "jumps", "prev_page", "prev_jumps", "seen", "stops")


def table_regions(df: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """stream, start, finish, table_id, page of every table."""
    return _bounded(df, p).where("real").select("stream", "start", "finish", F.col("tid").alias("table_id"), "page")


def _in_regions(df: DataFrame, regions: DataFrame, p: Profile) -> DataFrame:
    """Paragraphs of the regions, with the region's start and id; regions don't overlap, so a running last finds them."""
    r = regions.select("stream", F.col("start").alias("idx"), F.struct("start", "finish", F.col("table_id").alias("region_id")).alias("r"))
    rows = _kinds(df, p).join(r, ["stream", "idx"], "left").withColumn("r", F.last("r", ignorenulls=True).over(t.by_stream()))
    return rows.where(F.col("r").isNotNull() & (F.col("idx") <= F.col("r.finish"))).select("*", "r.start", "r.finish", "r.region_id").drop("r")


def _contents(x: Column) -> Column:
    """The contents of a group's rows (idx and content, or null) in order."""
    return F.transform(F.array_sort(F.collect_list(x)), lambda x: x["content"])


def table_fragments(df: DataFrame, regions: DataFrame | None = None, p: Profile = DEFAULT) -> DataFrame:
    """stream, start, table_id and the region's cells in order, without page marks, marks of continuation and titles
    that such a mark makes a repetition. Without regions those of table_regions(), found in the same partitioning."""
    if regions is None:
        rows = _bounded(df, p).where(F.col("start").isNotNull() & (F.col("idx") <= F.col("finish")) & ~F.col("goes_on") & ~(F.col("again") & F.col("behind")))
        return rows.groupBy("stream", "start", F.col("head.tid").alias("table_id")).agg(_contents(F.struct("idx", "content")).alias("fragments"))
    rows = _in_regions(df, regions, p).where(~F.col("marker"))
    again = F.col("title") & (F.col("tid") == F.col("region_id"))
    m = F.col("goes_on")
    before = W.partitionBy("stream", "start").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("behind", F.coalesce(F.last(F.when(~again, m), ignorenulls=True).over(before), F.lit(False)))
    rows = rows.where(~m & ~(again & F.col("behind")))
    return rows.groupBy("stream", "start", F.col("region_id").alias("table_id")).agg(_contents(F.struct("idx", "content")).alias("fragments"))


def interruptions(df: DataFrame, regions: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """stream, start, finish, pre_idx, post_idx, joined of the tables that cut a sentence in two."""
    real = F.when(~F.col("marker"), F.struct("idx", "content"))
    back = W.partitionBy("stream").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, -1)
    rows = _kinds(df, p).withColumn("pre", F.last(real, ignorenulls=True).over(t.by_stream().rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("post", F.last(real, ignorenulls=True).over(back))
    pre = rows.select("stream", F.col("idx").alias("start"), "pre")
    post = rows.select("stream", F.col("idx").alias("finish"), "post")
    cut = regions.join(pre, ["stream", "start"]).join(post, ["stream", "finish"]).where(F.col("pre").isNotNull() & F.col("post").isNotNull())
    cut = cut.where(t.interrupted(F.col("pre.content"), F.col("post.content")))
    return cut.select("stream", "start", "finish", F.col("pre.idx").alias("pre_idx"), F.col("post.idx").alias("post_idx"), F.concat_ws(" ", "pre.content", "post.content").alias("joined"))


def text_block(title: Column, fragments: Column) -> Column:
    return F.array_join(F.concat(F.array(F.concat(F.lit("**"), title, F.lit("**")), F.lit("")), F.slice(fragments, 2, 1_000_000)), "\n")


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def render(s: Column) -> Column:
    """Markdown with blank lines around the grid; s is a STRUCTURE."""
    head = F.array(F.concat(F.lit("**"), s["title"], F.lit("**")), F.lit(""), _row(s["column_headers"]), _row(F.transform(s["column_headers"], lambda x: F.lit("---"))))
    notes = F.when(F.size(s["footnotes"]) > 0, F.concat(F.array(F.lit("")), F.transform(s["footnotes"], lambda x: F.concat(F.lit("> "), x)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(s["data_rows"], _row), notes), "\n")


def display(s: Column) -> Column:
    """Markdown without blank lines; without a header the rows are left out."""
    grid = F.concat(F.array(_row(s["column_headers"]), _row(F.transform(s["column_headers"], lambda x: F.lit("---")))), F.transform(s["data_rows"], _row))
    body = F.when(F.size(s["column_headers"]) > 0, grid).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.concat(F.lit("**"), s["title"], F.lit("**"))), body, F.transform(s["footnotes"], lambda x: F.concat(F.lit("> "), x))), "\n")


def numbered(s: Column) -> Column:
    """For review: rows with their number in front, notes as a list."""
    head = F.array(F.concat(F.lit("| # "), _row(s["column_headers"])), F.concat(F.lit("| --- "), _row(F.transform(s["column_headers"], lambda x: F.lit("---")))))
    rows = F.transform(s["data_rows"], lambda r, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" "), _row(r)))
    return F.array_join(F.concat(head, rows, F.transform(s["footnotes"], lambda x: F.concat(F.lit("- "), x))), "\n")


def selected(regions: DataFrame, wanted: list[str]) -> DataFrame:
    """Regions whose id holds a wanted string or is part of it; all of them without any. Adds ``wanted``."""
    if not wanted:
        return regions.withColumn("wanted", F.lit(None).cast("string"))
    w = F.explode(F.array(*map(F.lit, wanted)))
    return regions.withColumn("wanted", w).where(F.col("table_id").contains(F.col("wanted")) | F.col("wanted").contains(F.col("table_id")))


def embedding_text(s: Column) -> Column:
    return F.when(F.size(s["column_headers"]) > 0, F.concat(s["title"], F.lit("\nColumns: "), F.array_join(s["column_headers"], " | "))).otherwise(s["title"])


def widths_ok(s: Column) -> Column:
    return F.forall(s["data_rows"], lambda r: F.size(r) == F.size(s["column_headers"]))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(_strip(line), r"^\|+|\|+$", ""), r"\|"), _strip)


def parse(c: Column) -> Column:
    """id, title, column_headers, data_rows and footnotes of a markdown table paragraph."""
    lines = F.filter(F.split(c, "\n"), lambda x: _strip(x) != "")
    title = _strip(F.replace(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), F.lit("**"), F.lit("")))
    second = F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit(""))
    has = second.contains("|")
    headers = F.when(has, _cells(second)).otherwise(F.array().cast("array<string>"))
    rest = F.slice(lines, F.when(has, 3).otherwise(2), 1_000_000)
    rule = _strip(F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit(""))).rlike(r"^\|[\s\-|]+\|$")
    rest = F.transform(F.slice(rest, F.when(rule, 2).otherwise(1), 1_000_000), _strip)
    note = lambda x: x.startswith(">")
    from_ = F.coalesce(F.array_position(F.transform(rest, note), True), F.lit(0))
    data = F.when(from_ > 0, F.slice(rest, 1, (from_ - 1).cast("int"))).otherwise(rest)
    rows = F.transform(F.filter(data, lambda x: x.contains("|")), _cells)
    notes = F.transform(F.filter(rest, note), lambda x: _strip(F.regexp_replace(x, "^>+", "")))
    bold = F.regexp_extract(c, r"^\*\*(" + t.TABLE_ID + r")\s*(.*?)\*\*", 1)
    bare = _strip(F.replace(c, F.lit("**"), F.lit("")))
    plain = F.regexp_extract(bare, "^(" + t.TABLE_ID + ")", 1)
    ident = F.when(bold != "", F.replace(bold, F.lit(" "), F.lit(""))).when(plain != "", F.replace(plain, F.lit(" "), F.lit(""))).otherwise(bare)
    return F.struct(ident.alias("id"), title.alias("title"), headers.alias("column_headers"), rows.alias("data_rows"), notes.alias("footnotes"))


def formatted(fragments: DataFrame, cache: DataFrame | None = None, rebuild: Column | None = None) -> DataFrame:
    """fragments with ``formatted``: a valid cached structure, else what ``rebuild`` makes of the fragments (a column of
    STRUCTURE, or null), else a text block. cache: table_id and structure."""
    title = F.coalesce(F.try_element_at("fragments", F.lit(1)), F.lit(""))
    block = text_block(title, F.col("fragments"))
    rows = fragments
    best = F.lit(None).cast("string")
    if cache is not None:
        rows = rows.join(cache.select("table_id", "structure"), "table_id", "left")
        best = F.when(widths_ok(F.col("structure")), render(F.col("structure")))
    if rebuild is not None:
        best = F.coalesce(best, F.when(F.size("fragments") >= 2, t.let(rebuild, lambda s: F.when(widths_ok(s), render(s)))))
    return rows.withColumn("formatted", F.coalesce(best, block)).drop("structure")


def table_pass(df: DataFrame, cache: DataFrame | None = None, rebuild: Column | None = None, p: Profile = DEFAULT) -> DataFrame:
    """The stream with every table as one paragraph at its start, once for each id, and cut sentences whole again. Nothing
    is joined or stored (but for a cache): the partitioning by stream that finds the tables carries all of it."""
    c = F.col("content")
    rows = _kinds(df, p)
    rows = rows.withColumns({
        "before": F.lag(F.struct(t.stays_open(c).alias("open"), t.hangs(c).alias("hangs"))).over(_own()),
        "next": F.lead(F.struct("idx", (~F.col("bound") & ~F.col("title")).alias("fits"), t.starts_low(c).alias("low"))).over(_own()),
    })
    rows = _bounded(rows, p).withColumn("post", F.max(F.when(F.col("idx") == F.col("finish"), F.col("next"))).over(W.partitionBy("stream", "start")))
    cut = F.coalesce(F.col("before.open") & F.col("post.fits") & (F.col("post.low") | F.col("before.hangs")), F.lit(False))
    region = F.when(F.col("real"), F.struct("start", "finish", F.col("tid").alias("id"), cut.alias("cut"), F.when(cut, F.col("post.idx")).otherwise(F.col("finish")).alias("end")))
    rows = rows.withColumn("r", F.last(region, ignorenulls=True).over(t.by_stream()))
    rows = rows.withColumn("gone", F.coalesce(F.col("idx") <= F.col("r.end"), F.lit(False)))
    cell = (F.col("start") == F.col("r.start")) & (F.col("idx") <= F.col("r.finish")) & ~F.col("goes_on") & ~(F.col("again") & F.col("behind"))
    one = rows.groupBy("stream", F.when(F.col("gone"), F.col("r.start")).otherwise(F.col("idx")).alias("at")).agg(
        F.min_by(F.struct("content", "page", "marker", "gone", F.when(F.col("gone"), F.col("r.id")).alias("table_id"), (F.col("gone") & F.col("r.cut")).alias("cut")), "idx").alias("h"),
        _contents(F.when(F.col("gone") & cell, F.struct("idx", "content"))).alias("fragments"), F.max_by("content", "idx").alias("tail"),
    )
    one = one.select("stream", F.col("at").alias("idx"), "h.*", "fragments", "tail")
    one = one.withColumn("n", F.row_number().over(W.partitionBy("stream", "table_id").orderBy("idx")))
    one = one.withColumn("rest", F.lead(F.when(F.col("cut"), F.col("tail"))).over(_own()))
    if cache is None:
        one = formatted(one, None, rebuild)
    else:
        one = stored(one)
        made = formatted(one.where("gone"), cache, rebuild).select("stream", "idx", "formatted")
        one = one.join(made, ["stream", "idx"], "left")
    one = one.where("not gone or n = 1")
    content = F.when(F.col("gone"), F.col("formatted")).when(F.col("rest").isNotNull(), F.concat_ws(" ", "content", "rest")).otherwise(F.col("content"))
    return reindexed(one.select("stream", "idx", content.alias("content"), "page"))


def column_counts(headers: Column, cells: Column) -> Column:
    """Possible numbers of columns for so many leading header cells and data cells: divisors, at most five short."""
    return F.filter(F.sequence(F.greatest(headers - 5, F.lit(1)), F.greatest(headers, F.lit(1))), lambda n: (cells % n == 0) & (headers - n).between(0, 5) & (headers >= 1))


def inferred(fragments: Column) -> Column:
    """A deterministic stand-in for a reconstructing model: the largest possible number of columns, data from the first
    pure number on; null where the cells don't divide."""
    number = r"^-?[0-9]+$|^-?[0-9]+\.[0-9]+$|^[0-9]+/[0-9]+$"

    def divided(cells: Column, heads: Column) -> Column:
        return t.let(F.array_max(column_counts(heads, F.size(cells) - heads)), lambda n: F.when((F.size(cells) > 2) & n.isNotNull() & (F.size(cells) - heads >= n), table(cells, heads, n)))

    def table(cells: Column, heads: Column, n: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.floor((F.size(cells) - heads) / n).cast("int") - 1), lambda i: F.slice(cells, (heads + i * n + 1).cast("int"), n))
        return F.struct(F.try_element_at(fragments, F.lit(1)).alias("title"), F.slice(cells, 1, n).alias("column_headers"), rows.alias("data_rows"), F.array().cast("array<string>").alias("footnotes"))

    def headed(cells: Column) -> Column:
        first = F.array_position(F.transform(cells, lambda x: x.rlike(number)), True)
        return t.let(first, lambda x: t.let(F.least(F.when(x > 1, x - 1).otherwise(F.lit(2)).cast("int"), F.size(cells)), lambda heads: divided(cells, heads)))

    return t.let(F.filter(F.slice(fragments, 2, 1_000_000), lambda x: ~t.is_footnote(x) | t.is_data_like(x)), headed)


def triage(output: DataFrame, cache: DataFrame) -> DataFrame:
    """table_id, n_rows (-1: not cached), has_grid, problem (few_rows, no_grid or none) for all tables of output
    (table_id, content) and of cache (table_id, structure)."""
    one = output.groupBy("table_id").agg(F.max(F.col("content").contains("|")).alias("has_grid"))
    rows = one.join(cache.select("table_id", F.size("structure.data_rows").alias("n_rows")), "table_id", "full")
    n = F.coalesce("n_rows", F.lit(-1)).cast("bigint")
    problem = F.when(n.between(0, 1), "few_rows").when(~F.col("has_grid"), "no_grid").otherwise("none")
    return rows.select("table_id", n.alias("n_rows"), F.coalesce("has_grid", F.lit(False)).alias("has_grid"), problem.alias("problem"))


def neighbours(regions: DataFrame, ids: DataFrame, reach: int = 3) -> DataFrame:
    """The tables up to ``reach`` places before and behind the first occurrence of each id of the same stream."""
    seat = regions.withColumn("seat", F.row_number().over(W.partitionBy("stream").orderBy("start")).cast("bigint"))
    own = seat.join(ids.select("table_id"), "table_id", "left_semi").groupBy("stream", F.col("table_id").alias("target")).agg(F.min("seat").alias("at"))
    near = own.select("stream", "target", "at", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)).alias("seat"))
    return near.join(seat, ["stream", "seat"]).select("stream", "target", "table_id", (F.col("seat") - F.col("at")).alias("distance"))


def corrected(tables: DataFrame, corrections: DataFrame) -> DataFrame:
    """tables (stream, start, table_id, fragments, structure) with the action that a correction (table_id, fix_category,
    override_action, override_data, extra_instructions) asks for: structure, action, fragments and instructions."""
    first = tables.groupBy("table_id").agg(F.min_by(F.struct("fragments", "structure"), F.struct("stream", "start")).alias("first"))
    # only what is to be merged is gathered whole
    long = tables.select("stream", "start", "table_id", "fragments").join(corrections.where("fix_category = 'multi_page_merge'").select("table_id").distinct(), "table_id", "left_semi")
    long = long.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stream", "start", "fragments"))), lambda x: x["fragments"]).alias("all"))
    title = F.try_element_at(F.col("first.fragments"), F.lit(1))
    merged = F.concat("first.fragments", t.let(title, lambda name: F.flatten(F.transform(F.slice("all", 2, 1_000_000), lambda x: F.filter(x, lambda y: y != name)))))
    rows = first.join(corrections, "table_id", "left").join(long, "table_id", "left")
    kind = F.coalesce("fix_category", F.lit("ok"))
    action = (
        F.when(kind == "ok", "keep").when((kind == "manual_override") & (F.col("override_action") == "skip"), "skip")
        .when((kind == "manual_override") & widths_ok(F.col("override_data")), "override").when(kind == "manual_override", "invalid")
        .when(kind.isin("stolen_data", "multi_page_merge", "llm_retry", "llm_retry_with_instructions"), "rebuild").otherwise("unknown")
    )
    parts = F.when(kind == "multi_page_merge", merged).otherwise(F.col("first.fragments"))
    structure = F.when(action == "override", F.col("override_data")).when(action.isin("keep", "invalid", "unknown"), F.col("first.structure"))
    return rows.select("table_id", action.alias("action"), parts.alias("fragments"), structure.alias("structure"), F.when(kind == "llm_retry_with_instructions", F.col("extra_instructions")).alias("instructions"))


def merged_tables(df: DataFrame, fixed: DataFrame) -> DataFrame:
    """Markdown paragraphs of the stream replaced by the rendered structure of the same id (table_id, structure, priority;
    the highest priority wins)."""
    last = fixed.groupBy("table_id").agg(F.max_by("structure", "priority").alias("structure"))
    found = F.regexp_extract("content", r"^\*\*(Table\s*[0-9]+\.[0-9]+(?:\s*\([^)]*\))*)", 1)
    rows = df.withColumn("table_id", F.when(found != "", F.replace(found, F.lit(" "), F.lit(""))))
    last = stored(last)
    if last.limit(10_001).count() <= 10_000:
        last = F.broadcast(last)
    else:  # what is no table finds nothing, but mustn't all meet in one partition
        rows = rows.withColumn("table_id", F.coalesce("table_id", F.concat_ws("/", F.lit(""), "stream", "idx")))
    return rows.join(last, "table_id", "left").select("stream", "idx", F.coalesce(render(F.col("structure")), "content").alias("content"), "page")


def flattened(types: DataFrame) -> DataFrame:
    """One row for each size of each entry of each type (trade_name, type_letter, insulation, entries)."""
    e = types.select("trade_name", "type_letter", "insulation", F.explode("entries").alias("e"))
    return e.select("trade_name", "type_letter", "insulation", "e.temp", "e.application", "e.covering", F.explode("e.triplets").alias("s")).select("*", "s.awg", "s.mm", "s.mils").drop("s")


def updated(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache (table_id, structure) with fresh rows in place of those of the same id; what has ragged rows isn't taken."""
    good = fresh.where(F.col("structure").isNotNull() & widths_ok(F.col("structure"))).select("table_id", "structure")
    return cache.select("table_id", "structure").join(good, "table_id", "left_anti").unionByName(good)


def after_corrections(tables: DataFrame, corrections: DataFrame, rebuild: Column) -> DataFrame:
    """The cache behind corrected(): validated override data, or what ``rebuild`` (a column over fragments) makes of two
    fragments or more; where neither gives a table of even rows, and for what is kept, skipped, invalid or unknown, the
    structure that was there."""
    asked = corrected(tables, corrections)
    fresh = asked.withColumn("structure", F.when(F.col("action") == "override", F.col("structure")).when((F.col("action") == "rebuild") & (F.size("fragments") >= 2), rebuild))
    old = tables.groupBy("table_id").agg(F.min_by("structure", F.struct("stream", "start")).alias("structure"))
    return updated(old, fresh.select("table_id", "structure"))


def grid_counts(output: DataFrame) -> DataFrame:
    """How many tables of output (table_id, content) are a grid, and how many a block of text."""
    grid = F.col("content").contains("|")
    return output.agg(F.count_if(grid).alias("grids"), F.count_if(~grid).alias("blocks"))
