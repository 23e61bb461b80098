"""From a clean paragraph stream to articles, parts, subsections, sub-items, tables, definitions; and to chunks.

Each paragraph is classified once; what it belongs to is filled forward with windows, so the whole parse is one shuffle
by stream. Flat tables are the storage; ``tree`` nests them on demand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.functions.profile import DEFAULT, Profile
from lodestone.operators import tables
from lodestone.sources.shared import stored

SPLIT_AT = 3000


def classified(df: DataFrame) -> DataFrame:
    """Adds kind (article, preamble, definition, part, section, table, body) and the context filled forward: article,
    article_title, part, part_title, section, section_title, section_page and flush (the number of openings so far)."""
    c = F.col("content")
    article = F.regexp_extract(c, t.ARTICLE, 1)
    rows = df.withColumn("new_article", F.when(article != "", article.cast("bigint")))
    rows = rows.withColumns({"article": F.last("new_article", ignorenulls=True).over(t.by_stream()), "article_title": F.last(F.when(article != "", F.trim(F.regexp_extract(c, t.ARTICLE, 2))), ignorenulls=True).over(t.by_stream()), "visit": F.count("new_article").over(t.by_stream())})
    kind = (
        F.when(F.col("new_article").isNotNull(), "article").when(F.col("article").isNull(), "preamble").when(F.col("article") == 100, "definition")
        .when(c.rlike(t.PART), "part").when(t.is_subsection_start(c), "section").when(c.rlike(r"^\*\*Table [0-9]+"), "table").otherwise("body")
    )
    rows = rows.withColumn("kind", kind)
    is_part = F.col("kind") == "part"
    title = F.regexp_extract(c, t.PART, 2)
    embedded = is_part & title.rlike(t.SECTION)  # only at the start of the Part's title
    opens = (F.col("kind") == "section") | embedded
    source = F.when(embedded, title).otherwise(c)
    visit = W.partitionBy("stream", "visit").orderBy("idx")
    last = lambda x: F.last(x, ignorenulls=True).over(visit)
    return rows.withColumns({
        "part": last(F.when(is_part, F.struct(F.regexp_extract(c, t.PART, 1).alias("num"), F.when(title != "", F.trim(title)).alias("title")))),
        "section": last(F.when(opens, F.struct(F.regexp_extract(source, t.SECTION, 1).alias("id"), F.trim(F.regexp_extract(source, t.SECTION, 2)).alias("title"), F.col("page").alias("page")))),
        "flush": F.sum(F.col("kind").isin("article", "part", "section").cast("int")).over(t.by_stream()),
        "member": F.col("kind").isin("section", "body") | embedded,
    }).drop("new_article")


def subsections(rows: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """stream, ord, chapter, article, part, part_title, section, title, page, paragraphs and refs of every subsection;
    rows come from classified(). A Part header doesn't end the section: what follows is a record of its own, same id."""
    one = rows.where(F.col("section").isNotNull() & F.col("member") & ~F.col("kind").isin("article", "definition", "preamble"))
    one = one.groupBy("stream", "flush").agg(
        F.min("idx").alias("ord"), F.first("article").alias("article"), F.min_by("part", "idx").alias("part"), F.min_by("section", "idx").alias("section"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda x: x["content"]).alias("paragraphs"),
    )
    chapter = t.chapter_of(F.col("article"), p)
    return one.select("stream", "ord", chapter.alias("chapter"), "article", F.col("part.num").alias("part"), F.col("part.title").alias("part_title"), F.col("section.id").alias("section"), F.col("section.title").alias("title"), F.col("section.page").alias("page"), "paragraphs", t.table_refs(F.array_join("paragraphs", "\n")).alias("refs"))


def subsection_ids(rows: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """id: the distinct section numbers of subsections() in a chapter, without their texts."""
    one = rows.where(F.col("section").isNotNull() & F.col("member") & ~F.col("kind").isin("article", "definition", "preamble"))
    return one.where(t.chapter_of(F.col("article"), p).isNotNull()).select(F.col("section.id").alias("id")).distinct()


def definitions(rows: DataFrame) -> DataFrame:
    """stream, ord, term, page and content of every definition of Article 100."""
    d = rows.where("kind = 'definition'")
    c = F.col("content")
    goes_on = c.startswith("Informational Note") | c.startswith("(") | c.startswith("[")
    by = W.partitionBy("stream", "visit").orderBy("idx")
    d = d.withColumn("n", F.sum((~goes_on).cast("int")).over(by)).where("n > 0")
    one = d.groupBy("stream", "visit", "n").agg(F.min("idx").alias("ord"), F.min_by("content", "idx").alias("head"), F.min_by("page", "idx").alias("page"), t.ordered_join(F.col("idx"), c, "\n").alias("content"))
    found = F.regexp_extract("head", r"^([^.]+)\.", 1)
    return one.select("stream", "ord", F.when(found != "", F.trim(found)).otherwise(F.substring("head", 1, 60)).alias("term"), "page", "content")


def _itemised(subs: DataFrame, *keep: str) -> DataFrame:
    """stream, ord, those columns, pos, content and n (of the sub-item; 0: front matter) of every paragraph."""
    rows = subs.select("stream", "ord", *keep, F.posexplode("paragraphs").alias("pos", "content"))
    by = W.partitionBy("stream", "ord").orderBy("pos")
    return rows.withColumn("n", F.sum(F.col("content").rlike(t.SUB_ITEM).cast("bigint")).over(by))


def sub_items(subs: DataFrame) -> DataFrame:
    """stream, ord, section, n (0: front matter), label, title and content of every sub-item."""
    rows = _itemised(subs, "section")
    one = rows.groupBy("stream", "ord", "section", "n").agg(F.min_by("content", "pos").alias("head"), t.ordered_join(F.col("pos"), F.col("content"), "\n").alias("content"))
    raw = F.trim(F.regexp_extract("head", t.SUB_ITEM, 2))
    title = F.when(raw.contains("."), F.trim(F.concat(F.substring_index(raw, ".", 1), F.lit(".")))).otherwise(raw)
    item = F.col("n") > 0
    return one.select("stream", "ord", "section", "n", F.when(item, F.concat(F.lit("("), F.regexp_extract("head", t.SUB_ITEM, 1), F.lit(")"))).alias("label"), F.when(item, title).alias("title"), "content")


def parts(rows: DataFrame) -> DataFrame:
    """stream, article, part, part_title and ord (of its first header) of every distinct Part header."""
    return rows.where("kind = 'part'").groupBy("stream", "article", F.col("part.num").alias("part"), F.col("part.title").alias("part_title")).agg(F.min("idx").alias("ord"))


def article_tables(rows: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """stream, ord, chapter, article, article_title and structure of the markdown tables."""
    one = rows.where("kind = 'table'").withColumn("structure", tables.parse(F.col("content")))
    return one.select("stream", F.col("idx").alias("ord"), t.chapter_of(F.col("article"), p).alias("chapter"), "article", "article_title", "structure")


def ref_rollup(subs: DataFrame) -> DataFrame:
    """Sorted distinct references at part, article and chapter level."""
    r = subs.select("stream", "chapter", "article", F.coalesce("part", F.lit("-")).alias("part"), F.explode("refs").alias("ref")).where("chapter is not null")
    up = r.rollup("stream", "chapter", "article", "part").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("refs"), F.grouping_id().alias("level"))
    return up.where("level in (0, 1, 3)").select("stream", "chapter", "article", "part", F.col("level").cast("bigint").alias("level"), "refs")


def tree(subs: DataFrame) -> DataFrame:
    """stream, chapter and its articles, each with its subsections in order (nested)."""
    sub = F.struct("ord", F.col("section").alias("id"), "title", "page", "part", "refs")
    art = subs.where("chapter is not null").groupBy("stream", "chapter", "article").agg(F.array_sort(F.collect_list(sub)).alias("subsections"))
    return art.groupBy("stream", "chapter").agg(F.array_sort(F.collect_list(F.struct("article", "subsections"))).alias("articles"))


def part_tree(rows: DataFrame, subs: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """stream, chapter, article and its parts in order, each with num, title, subsections and refs (nested). Every Part
    header makes a part, with all subsections under its number; subsections before the first one stand in a part without
    number in front, and an article without headers has that one only."""
    arts = rows.where("kind = 'article'").select("stream", "article").distinct().withColumn("chapter", t.chapter_of(F.col("article"), p)).where("chapter is not null")
    head = parts(rows).select("stream", "article", F.col("part").alias("num"), F.col("part_title").alias("title"), "ord")
    bare = arts.join(head, ["stream", "article"], "left_anti").select("stream", "article")
    lead = subs.where("part is null").select("stream", "article").union(bare).distinct()
    lead = lead.select("stream", "article", F.lit(None).cast("string").alias("num"), F.lit(None).cast("string").alias("title"), F.lit(-1).cast("bigint").alias("ord"))
    held = subs.groupBy("stream", "article", F.coalesce("part", F.lit("")).alias("key")).agg(
        F.array_sort(F.collect_list(F.struct("ord", F.col("section").alias("id"), F.col("title").alias("name"), "page"))).alias("subsections"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs")
    )
    none = F.array()
    one = head.unionByName(lead).withColumn("key", F.coalesce("num", F.lit(""))).join(held, ["stream", "article", "key"], "left")
    one = one.withColumns({"subsections": F.coalesce("subsections", none.cast(held.schema["subsections"].dataType)), "refs": F.coalesce("refs", none.cast("array<string>"))})
    nested = one.groupBy("stream", "article").agg(F.array_sort(F.collect_list(F.struct("ord", "num", "title", "subsections", "refs"))).alias("parts"))
    return arts.join(nested, ["stream", "article"]).select("stream", "chapter", "article", "parts")


def bounds(rows: DataFrame, subs: DataFrame, made: DataFrame, expected: dict[str, tuple[int, int | None]]) -> DataFrame:
    """name, value, low, high and ok of checks on the whole corpus: how many chapters, articles, definitions, tables and
    subsections there are, and how many subsections or tables lack what each must have. expected: name -> low, high."""
    a = rows.where("kind = 'article'").agg(F.countDistinct(t.chapter_of(F.col("article"))).alias("chapters"), F.countDistinct("article").alias("articles"))
    d = definitions(rows).agg(F.count("*").alias("definitions"))
    k = made.agg(F.count("*").alias("tables"), F.count_if(F.col("structure.id").isNull() | F.col("structure.title").isNull() | F.col("structure.column_headers").isNull()).alias("bad_tables"))
    s = subs.agg(F.count("*").alias("subsections"), F.count_if(F.col("section").isNull() | F.col("title").isNull() | (F.size("paragraphs") == 0)).alias("bad_subsections"))
    names = ("chapters", "articles", "definitions", "tables", "bad_tables", "subsections", "bad_subsections")
    values = None
    for df in (a, d, k, s):
        own = [x for x in df.columns if x in names]
        one = df.select(F.inline(F.array(*(F.struct(F.lit(x).alias("name"), F.col(x).cast("bigint").alias("value")) for x in own))))
        values = one if values is None else values.unionAll(one)
    low = F.create_map(*(F.lit(x) for n, (lo, _) in expected.items() for x in (n, lo)))
    high = F.create_map(*(x for n, (_, hi) in expected.items() for x in (F.lit(n), F.lit(hi).cast("bigint"))))
    values = values.select("name", "value", low[F.col("name")].cast("bigint").alias("low"), high[F.col("name")].alias("high")).where("low is not null")
    return values.withColumn("ok", (F.col("value") >= F.col("low")) & (F.col("high").isNull() | (F.col("value") <= F.col("high"))))


def tree_stats(rows: DataFrame, subs: DataFrame) -> DataFrame:
    a = rows.where("kind = 'article'").groupBy("stream").agg(F.countDistinct("article").alias("articles"))
    k = rows.groupBy("stream").agg(*(F.count_if(F.col("kind") == x).alias(f"n_{x}") for x in ("part", "table", "definition", "body")))
    s = subs.groupBy("stream").agg(F.count("*").alias("subsections"), F.count_if(F.size("refs") > 0).alias("with_refs"), F.countDistinct("chapter").alias("chapters"))
    return k.join(a, "stream", "left").join(s, "stream", "left").na.fill(0)


def _lettered(x: Column) -> Column:
    return F.regexp_replace(x["content"], r"^\s+", "").rlike(r"^\([A-Z]\)\s")


def with_items(items: DataFrame, split_at: int = SPLIT_AT) -> DataFrame:
    """stream, ord, front, items, full (the whole text) and split (is it long, and has it lettered items?)."""
    one = items.groupBy("stream", "ord").agg(F.max(F.when(F.col("n") == 0, F.col("content"))).alias("front"), F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "content")))).alias("items"))
    one = one.withColumn("front", F.coalesce("front", F.lit("")))
    full = F.array_join(F.concat(F.array("front"), F.transform("items", lambda x: x["content"])), "\n")
    return one.withColumns({"full": full, "split": (F.length(full) > split_at) & F.exists("items", _lettered)})


def letter_groups(one: DataFrame) -> DataFrame:
    """The items (i) of what is to be split, with the number g of their lettered group; those before the first letter
    belong to the first group."""
    it = one.where("split").select("stream", "ord", "front", F.explode("items").alias("i")).withColumn("is", _lettered(F.col("i")))
    by = W.partitionBy("stream", "ord").orderBy("i.n")
    return it.withColumn("g", F.greatest(F.sum(F.col("is").cast("bigint")).over(by), F.lit(1)))


def chunks(subs: DataFrame, items: DataFrame | None = None, split_at: int = SPLIT_AT) -> DataFrame:
    """chunk_id, text and the subsection's metadata: whole subsections, or one chunk for each lettered group of long ones,
    each with the front matter in front. Ids that repeat get _2, _3 and so on in document order. Without items those of
    sub_items(), with nothing shuffled if subs are partitioned by stream."""
    subs = subs.where("chapter is not null")
    meta = F.struct(*(x for x in subs.columns if x not in ("stream", "ord", "paragraphs")))
    if items is None:
        rows = _itemised(subs.withColumn("meta", meta), "meta").groupBy("stream", "ord", "n").agg(F.first("meta").alias("meta"), t.ordered_join(F.col("pos"), F.col("content"), "\n").alias("content"))
    else:
        rows = items.select("stream", "ord", "n", "content").join(subs.select("stream", "ord", meta.alias("meta")), ["stream", "ord"])
    whole = W.partitionBy("stream", "ord")
    item, n = F.col("n") > 0, F.length("content")
    rows = rows.withColumn("is", item & _lettered(F.struct("content")))
    rows = rows.withColumns({"long": F.sum(F.when(item, n + 1).otherwise(n)).over(whole), "any": F.max("is").over(whole), "letters": F.sum(F.col("is").cast("bigint")).over(whole.orderBy("n"))})
    rows = rows.withColumn("split", (F.col("long") > split_at) & F.col("any"))
    rows = rows.withColumn("front", F.max(F.when(F.col("split") & ~item, F.col("content"))).over(whole)).where(~F.col("split") | item)
    letter = F.when(F.col("split") & F.col("is"), F.substring(F.regexp_replace("content", r"^\s+", ""), 2, 1))
    rows = rows.groupBy("stream", "ord", F.when(F.col("split"), F.greatest("letters", F.lit(1))).otherwise(0).alias("g")).agg(
        F.first("meta").alias("meta"), F.first("front").alias("front"), F.min("n").alias("from"), F.min_by(letter, F.when(letter.isNotNull(), F.col("n"))).alias("letter"), t.ordered_join(F.col("n"), F.col("content"), "\n").alias("body"),
    )
    # front matter stands in front of every group of items, empty if there is none
    text = F.when(F.col("from") > 0, F.concat(F.coalesce("front", F.lit("")), F.lit("\n"), "body")).otherwise(F.col("body"))
    rows = rows.select("stream", "ord", "g", "letter", text.alias("text"), "meta.*")
    base = F.concat_ws("_", F.col("article").cast("string"), "section", "letter")
    rows = rows.withColumn("base", base)
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("stream", "base").orderBy("ord", "g")))
    ident = F.when(F.col("n") > 1, F.concat_ws("_", "base", F.col("n").cast("string"))).otherwise(F.col("base"))
    return rows.select("stream", ident.alias("chunk_id"), "text", F.col("section").alias("section_id"), F.substring("title", 1, 500).alias("title"), "page", "refs", F.lit("subsection").alias("chunk_type"), "part", "article", "chapter", "ord", "g")


def table_pages(subs: DataFrame) -> DataFrame:
    """stream, table_id, page and article of the first subsection that names each table (an id ends at a line's end)."""
    r = subs.where("chapter is not null").select("stream", "ord", "page", "article", F.explode("refs").alias("ref"))
    r = r.withColumn("table_id", F.trim(F.split_part(F.trim("ref"), F.lit("\n"), F.lit(1)))).where("table_id <> ''")
    return r.groupBy("stream", "table_id").agg(F.min_by("page", "ord").alias("page"), F.min_by("article", "ord").alias("article"))


def table_chunks(made: DataFrame, pages: DataFrame) -> DataFrame:
    """The chunks of tables: a compact text to embed, the whole table as document; page -1 where nothing names it."""
    s = F.col("structure")
    rows = made.where("chapter is not null").withColumn("table_id", F.col("structure.id")).join(pages.select("stream", "table_id", "page"), ["stream", "table_id"], "left")
    return rows.select("stream", F.concat(F.lit("table_"), "table_id").alias("chunk_id"), tables.embedding_text(s).alias("text"), tables.display(s).alias("document"), F.col("table_id").alias("section_id"), F.substring("structure.title", 1, 500).alias("title"), F.coalesce("page", F.lit(-1)).alias("page"), F.array("table_id").alias("refs"), F.lit("table").alias("chunk_type"), "article", "chapter", "ord")


def all_chunks(subs: DataFrame, made: DataFrame) -> DataFrame:
    """The chunks of stored subsections, which are shuffled once, and those of tables."""
    one = chunks(subs.repartition("stream")).drop("g", "part").withColumn("document", F.col("text"))
    return one.unionByName(table_chunks(made, table_pages(subs)))


def chunk_stats(c: DataFrame) -> DataFrame:
    n = F.length("text").cast("bigint")
    return c.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.floor(F.sum(n) / F.count("*")).cast("bigint").alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))


def chunk_sizes(c: DataFrame, share: float = 0.95, large: int = 5000) -> DataFrame:
    """chunk_type, the length that ``share`` of the chunks don't pass (an exact one), and how many are over ``large``."""
    n = F.length("text").cast("bigint")
    rows = c.select("chunk_type", n.alias("n"))
    by = rows.groupBy("chunk_type", "n").agg(F.count("*").alias("k"))  # lengths are few, whatever the number of chunks
    upto = by.withColumn("upto", F.sum("k").over(W.partitionBy("chunk_type").orderBy("n"))).withColumn("all", F.sum("k").over(W.partitionBy("chunk_type")))
    return upto.groupBy("chunk_type").agg(F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("n"))).alias("p95"), F.sum(F.when(F.col("n") > large, F.col("k")).otherwise(0)).alias("over"))


def id_check(c: DataFrame) -> DataFrame:
    """stream, its chunks, their distinct ids, and whether there are as many."""
    n, ids = F.count("*"), F.countDistinct("chunk_id")
    return c.groupBy("stream").agg(n.alias("chunks"), ids.alias("ids"), (n == ids).alias("fits"))


def with_unique_ids(c: DataFrame) -> DataFrame:
    """c, stored; an error if two chunks of a stream share an id, since a collection takes an id once."""
    c = stored(c)
    if bad := id_check(c).where("not fits").limit(5).collect():
        raise ValueError(f"chunk ids aren't unique in streams {', '.join(str(r.stream) for r in bad)}")
    return c
