"""Queries on the document's hierarchy, on chunks, and on lookups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import lookup as lk
from lodestone.operators import structure as st
from lodestone.operators import tables as tb
from lodestone.plans import oracle as o
from lodestone.plans.registry import query
from lodestone.sources.overlay import paragraphs
from lodestone.sources.shared import stored


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.classified(paragraphs(spark, sf_dir))


def _subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.subsections(_rows(spark, sf_dir))


@query("hierarchy_rows", o.sql("SELECT stream, idx, kind, article, article_title, part.num AS part, section.id AS section, flush FROM rows", "rows"))
def hierarchy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("stream", "idx", "kind", "article", "article_title", F.col("part.num").alias("part"), F.col("section.id").alias("section"), "flush")


@query("subsections", o.sql("SELECT stream, ord, chapter, article, part, part_title, section, title, page, array_to_string(paragraphs, chr(10)) AS text, array_to_string(refs, ',') AS refs FROM subs", "subs"))
def subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subs(spark, sf_dir).select("stream", "ord", "chapter", "article", "part", "part_title", "section", "title", "page", F.array_join("paragraphs", "\n").alias("text"), F.array_join("refs", ",").alias("refs"))


@query("definitions", o.sql("""SELECT stream, min(idx) AS ord, CASE WHEN regexp_matches(arg_min(content, idx), '^[^.]+[.]') THEN trim(regexp_extract(arg_min(content, idx), '^([^.]+)[.]', 1)) ELSE substr(arg_min(content, idx), 1, 60) END AS term, arg_min(page, idx) AS page, string_agg(content, chr(10) ORDER BY idx) AS content
 FROM (SELECT *, sum(CASE WHEN starts_with(content, 'Informational Note') OR starts_with(content, '(') OR starts_with(content, '[') THEN 0 ELSE 1 END) OVER (PARTITION BY stream, visit ORDER BY idx) AS n FROM rows WHERE kind = 'definition') WHERE n > 0 GROUP BY stream, visit, n""", "rows"))
def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.definitions(_rows(spark, sf_dir))


@query("sub_items", o.sql("SELECT * FROM items", "items"))
def sub_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.sub_items(_subs(spark, sf_dir))


@query("parts", o.sql("SELECT stream, article, part.num AS part, part.title AS part_title, min(idx) AS ord FROM rows WHERE kind = 'part' GROUP BY ALL", "rows"))
def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.parts(_rows(spark, sf_dir))


@query("chapter_buckets", o.sql(f"SELECT {o.chapter('article')} AS chapter, count(DISTINCT article) AS articles, count(*) AS n FROM rows WHERE article IS NOT NULL GROUP BY ALL", "rows"))
def chapter_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).where("article is not null")
    return rows.groupBy(t.chapter_of(F.col("article")).alias("chapter")).agg(F.countDistinct("article").alias("articles"), F.count("*").alias("n"))


@query("ref_extract", o.sql(f"SELECT stream, idx, array_to_string({o.refs('content')}, ',') AS refs FROM stream", "stream"))
def ref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("stream", "idx", F.array_join(t.table_refs(F.col("content")), ",").alias("refs"))


@query("ref_rollup", o.sql("""SELECT stream, chapter, article, part, CAST(grouping(chapter, article, part) AS BIGINT) AS level, array_to_string(list_sort(list_distinct(list(ref))), ',') AS refs
 FROM (SELECT stream, chapter, article, coalesce(part, '-') AS part, unnest(refs) AS ref FROM subs WHERE chapter IS NOT NULL) GROUP BY GROUPING SETS ((stream, chapter, article, part), (stream, chapter, article), (stream, chapter))""", "subs"))
def ref_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.ref_rollup(_subs(spark, sf_dir))


@query("tree_stats", o.sql("""SELECT stream, n_part, n_table, n_definition, n_body, coalesce(articles, 0) AS articles, coalesce(subsections, 0) AS subsections, coalesce(with_refs, 0) AS with_refs, coalesce(chapters, 0) AS chapters
 FROM (SELECT stream, count(*) FILTER (kind = 'part') AS n_part, count(*) FILTER (kind = 'table') AS n_table, count(*) FILTER (kind = 'definition') AS n_definition, count(*) FILTER (kind = 'body') AS n_body FROM rows GROUP BY stream)
 LEFT JOIN (SELECT stream, count(DISTINCT article) AS articles FROM rows WHERE kind = 'article' GROUP BY stream) USING (stream) LEFT JOIN (SELECT stream, count(*) AS subsections, count(*) FILTER (len(refs) > 0) AS with_refs, count(DISTINCT chapter) AS chapters FROM subs GROUP BY stream) USING (stream)""", "subs"))
def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return st.tree_stats(rows, st.subsections(rows))


@query("tree", o.sql("SELECT stream, chapter, count(DISTINCT article) AS articles, string_agg(article || ':' || section, ',' ORDER BY article, ord) AS outline FROM subs WHERE chapter IS NOT NULL GROUP BY ALL", "subs"))
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested form, read back as a line for each chapter."""
    named = F.flatten(F.transform("articles", lambda a: F.transform(a["subsections"], lambda s: F.concat(a["article"].cast("string"), F.lit(":"), s["id"]))))
    return st.tree(_subs(spark, sf_dir)).select("stream", "chapter", F.size("articles").cast("bigint").alias("articles"), F.array_join(named, ",").alias("outline"))


# chunks


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.chunks(_subs(spark, sf_dir))


@query("chunk_subsections", o.sql("SELECT stream, chunk_id, text, section AS section_id, substr(title, 1, 500) AS title, page, array_to_string(refs, ',') AS refs, part, article, chapter FROM chunks", "chunks"))
def chunk_subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("stream", "chunk_id", "text", "section_id", "title", "page", F.array_join("refs", ",").alias("refs"), "part", "article", "chapter")


@query("chunk_letters", o.sql("SELECT stream, ord, g, n, content FROM lettergroups", "chunks"))
def chunk_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = _subs(spark, sf_dir)
    return st.letter_groups(st.with_items(st.sub_items(subs))).select("stream", "ord", "g", F.col("i.n").alias("n"), F.col("i.content").alias("content"))


@query("chunk_ids", o.sql("SELECT stream, count(*) AS n, count(DISTINCT chunk_id) AS ids FROM chunks GROUP BY stream", "chunks"))
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"))


@query("table_page_index", o.sql("SELECT stream, table_id, arg_min(page, ord) AS page, arg_min(article, ord) AS article FROM (SELECT stream, ord, page, article, trim(split_part(trim(unnest(refs)), chr(10), 1)) AS table_id FROM subs WHERE chapter IS NOT NULL) WHERE table_id <> '' GROUP BY ALL", "subs"))
def table_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table_pages(_subs(spark, sf_dir))


def _tabled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows and subsections of the stream behind the table pass."""
    rows = stored(st.classified(tb.table_pass(paragraphs(spark, sf_dir))))
    return rows, stored(st.subsections(rows))


#: ``rows`` and what is built on it, read from the stream behind the table pass.
AFTER_PASS = o.CTE["rows"].replace("FROM stream)", "FROM passed)")
TAB = f"""tabs AS (SELECT stream, idx AS ord, {o.chapter('article')} AS chapter, article, trim(replace(split_part(ltrim(content, chr(10) || ' '), chr(10), 1), '**', '')) AS title, CASE WHEN {o.m('content', '^[*][*]' + o.TID)} THEN replace(regexp_extract(content, '^[*][*](' || {o.q(o.TID)} || ')', 1), ' ', '') ELSE trim(replace(content, '**', '')) END AS table_id FROM rows WHERE kind = 'table'),
pages_of AS (SELECT stream, table_id, arg_min(page, ord) AS page FROM (SELECT stream, ord, page, trim(split_part(trim(unnest(refs)), chr(10), 1)) AS table_id FROM subs WHERE chapter IS NOT NULL) WHERE table_id <> '' GROUP BY ALL),
tchunks AS (SELECT t.stream, 'table_' || t.table_id AS chunk_id, t.title AS text, '**' || t.title || '**' AS document, t.table_id AS section_id, substr(t.title, 1, 500) AS title, coalesce(p.page, -1) AS page, t.article, t.chapter FROM tabs t LEFT JOIN pages_of p USING (stream, table_id) WHERE t.chapter IS NOT NULL)"""


@query("chunk_tables", o.sql("SELECT * FROM tchunks", "passed", "chunks", extra=TAB).replace(o.CTE["rows"], AFTER_PASS))
def chunk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, subs = _tabled(spark, sf_dir)
    made = st.table_chunks(st.article_tables(rows), st.table_pages(subs))
    return made.select("stream", "chunk_id", "text", "document", "section_id", "title", "page", "article", "chapter")


BOTH = ", united AS (SELECT stream, chunk_id, 'subsection' AS chunk_type, text, text AS document, page, article FROM chunks UNION ALL SELECT stream, chunk_id, 'table', text, document, page, article FROM tchunks)"


@query("chunk_union", o.sql("SELECT * FROM united", "passed", "chunks", extra=TAB + BOTH).replace(o.CTE["rows"], AFTER_PASS))
def chunk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, subs = _tabled(spark, sf_dir)
    return st.all_chunks(subs, st.article_tables(rows)).select("stream", "chunk_id", "chunk_type", "text", "document", "page", "article")


@query("chunk_stats", o.sql("SELECT chunk_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total, CAST(sum(length(text)) // count(*) AS BIGINT) AS mean, min(length(text)) AS least, max(length(text)) AS most FROM united GROUP BY chunk_type", "passed", "chunks", extra=TAB + BOTH).replace(o.CTE["rows"], AFTER_PASS))
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, subs = _tabled(spark, sf_dir)
    return st.chunk_stats(st.all_chunks(subs, st.article_tables(rows)))


TRUTH = [(1, ["100.1", "200."], ["Table220.55"]), (2, ["905.2"], []), (3, [], ["Table100.1(A)"])]


@query("truth_matches", o.sql("SELECT qid, chunk_id, stream FROM chunks, (VALUES (1, ['100.1', '200.'], ['Table220.55']), (2, ['905.2'], []::VARCHAR[]), (3, []::VARCHAR[], ['Table100.1(A)'])) w(qid, prefixes, ids) WHERE len(list_filter(prefixes, lambda p: starts_with(section, p))) > 0 OR list_contains(ids, section) OR list_has_any(refs, ids)", "chunks"))
def truth_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir, TRUTH)


def _truth(spark: SparkSession, sf_dir: str, truth: list[tuple], strict: bool = False) -> DataFrame:
    from lodestone.operators.evaluate import chunk_matches

    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    asked = F.array(*(F.struct(F.lit(q).alias("qid"), texts(p).alias("prefixes"), texts(i).alias("ids")) for q, p, i in truth))
    rows = _chunks(spark, sf_dir).select("*", F.inline(asked))
    return rows.where(chunk_matches(F.col("section_id"), F.col("refs"), F.col("prefixes"), F.col("ids"), strict)).select("qid", "chunk_id", "stream")


# lookups

INDEX = """sindex AS (SELECT section, arg_max(article, stream * 1000000000 + ord) AS article, arg_max(page, stream * 1000000000 + ord) AS page, arg_max(array_to_string(paragraphs, chr(10)), stream * 1000000000 + ord) AS text FROM subs WHERE chapter IS NOT NULL GROUP BY section)"""


@query("section_index", o.sql("SELECT * FROM sindex", "subs", extra=INDEX))
def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.section_index(_subs(spark, sf_dir))


def _table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id and markdown: of repeated ids the last."""
    f = tb.formatted(tb.table_fragments(paragraphs(spark, sf_dir)))
    return f.groupBy("table_id").agg(F.max_by("formatted", F.struct("stream", "start")).alias("markdown"))


TABLE_TEXTS = "ttexts AS (SELECT f.table_id, arg_max(b.formatted, f.stream * 1000000000 + f.start) AS markdown FROM fragments f JOIN blocks b ON b.stream = f.stream AND b.idx = f.start GROUP BY f.table_id)"


@query("table_index", o.sql("SELECT * FROM ttexts", "passed", extra=TABLE_TEXTS))
def table_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_texts(spark, sf_dir)


REQUESTS = [(1, 0, "section", " 100.1 "), (1, 1, "table", "table 100.1 (A)"), (1, 2, "section", "999.9"), (2, 0, "section", "  "), (3, 0, "table", "nothing"), *((4, i, "section", f"90.{i}") for i in range(11)), *((5, i, "section", f"121.{i}") for i in range(10))]
VALUES = ", ".join(f"({a}, {b}, {o.q(c)}, {o.q(d)})" for a, b, c, d in REQUESTS)


@query("batch_lookup", o.sql("""SELECT req_id, CASE WHEN max(n) = 0 THEN 'Error: at least one id must be provided.' WHEN max(n) > 10 THEN 'Error: requested ' || max(n) || ' IDs but the maximum is 10 total per call.' ELSE string_agg(CASE WHEN id = '' THEN NULL WHEN kind = 'table' THEN coalesce(markdown, 'Error: table ''' || id || ''' not found.') ELSE coalesce('[Section ' || id || ', Article ' || article || ', page ' || page || ']' || chr(10) || text, 'Error: section ''' || id || ''' not found.') END, chr(10) || chr(10) ORDER BY kind = 'table', ord) END AS answer
 FROM keyed k LEFT JOIN sindex s ON k.kind = 'section' AND s.section = k.id LEFT JOIN ttexts t ON k.kind = 'table' AND t.table_id = k.key GROUP BY req_id""", "subs", "passed", extra=f"{INDEX}, {TABLE_TEXTS}, asked(req_id, ord, kind, raw) AS (VALUES {VALUES}), keyed AS (SELECT *, trim(raw) AS id, 'Table' || replace(regexp_replace(trim(raw), '(?i)^table\\s*', ''), ' ', '') AS key, count(*) FILTER (trim(raw) <> '') OVER (PARTITION BY req_id) AS n FROM asked)"))
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(REQUESTS, "req_id int, ord int, kind string, raw_id string")
    return lk.lookup(asked, lk.section_index(_subs(spark, sf_dir)), _table_texts(spark, sf_dir))


PREFIXES = ["Table 100", "Table 100.1", "table100.1(A)", "Table 12", "Table 999.9"]


@query("prefix_lookup", o.sql("""SELECT raw AS raw_id, string_agg(markdown, chr(10) || chr(10) ORDER BY table_id) AS markdown FROM (SELECT raw, table_id, markdown, table_id = key AS exact, bool_or(table_id = key) OVER (PARTITION BY raw) AS any_exact FROM keyed JOIN ttexts ON starts_with(table_id, key)) WHERE exact OR NOT any_exact GROUP BY raw""", "passed", extra=f"{TABLE_TEXTS}, keyed AS (SELECT raw, 'Table' || replace(regexp_replace(trim(raw), '(?i)^table\\s*', ''), ' ', '') AS key FROM (VALUES {', '.join(f'({o.q(x)})' for x in PREFIXES)}) v(raw))"))
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(x,) for x in PREFIXES], "raw_id string")
    return lk.prefix_lookup(asked, _table_texts(spark, sf_dir))


@query("normalized_ids", o.sql("SELECT stream, idx, 'Table' || replace(regexp_replace(trim(content), '(?i)^table\\s*', ''), ' ', '') AS key FROM stream WHERE " + o.title(), "stream"))
def normalized_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).where(t.is_table_title(F.col("content"))).select("stream", "idx", t.normalized_table_id(F.col("content")).alias("key"))


OUTLINE = """s AS (SELECT *, min(ord) OVER (PARTITION BY stream, article, part) AS part_ord, CASE WHEN length(title) > 120 THEN substr(title, 1, 117) || '...' ELSE title END AS short FROM subs WHERE chapter IS NOT NULL),
outlines AS (SELECT stream, article, part_ord, 1 AS k, ord, CASE WHEN part IS NULL THEN '  ' ELSE '      ' END || section || ' ' || short || ' (page ' || page || ')' AS line FROM s
 UNION ALL SELECT stream, article, part_ord, 0, part_ord, '  Part ' || part || ': ' || coalesce(arg_min(part_title, ord), 'None') FROM s WHERE part IS NOT NULL GROUP BY stream, article, part, part_ord),
bodies AS (SELECT stream, article, string_agg(line, chr(10) ORDER BY part_ord, k, ord, line) AS body FROM outlines GROUP BY ALL),
names AS (SELECT stream, article, arg_min(article_title, idx) AS name FROM rows WHERE kind = 'article' GROUP BY ALL),
scopes AS (SELECT stream, article, arg_min(array_to_string(paragraphs, chr(10)), ord) AS scope FROM s WHERE section = article || '.1' GROUP BY ALL)"""


@query("browse_outline", o.sql("SELECT stream, article, 'Article ' || article || ': ' || name || chr(10) || body || CASE WHEN scope IS NULL THEN '' ELSE chr(10) || chr(10) || '--- Scope ---' || chr(10) || scope END AS outline FROM bodies LEFT JOIN names USING (stream, article) LEFT JOIN scopes USING (stream, article)", "subs", extra=OUTLINE))
def browse_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return lk.outline(st.subsections(rows), rows)


CHAPTER_NAMES = "CASE chapter " + " ".join(f"WHEN {n} THEN {o.q(name)}" for n, name, _, _ in o.P.chapters) + " END"


@query("browse_chapters", o.sql(f"SELECT stream, chapter, 'Chapter ' || chapter || ': ' || {CHAPTER_NAMES} || chr(10) || string_agg('  Article ' || article || ': ' || name, chr(10) ORDER BY article) AS listing FROM (SELECT stream, article, {o.chapter('article')} AS chapter, arg_min(article_title, idx) AS name FROM rows WHERE kind = 'article' GROUP BY stream, article) WHERE chapter IS NOT NULL GROUP BY stream, chapter", "rows"))
def browse_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.chapters(_rows(spark, sf_dir))


LINK = "'Table [0-9]+\\.[0-9]+(?:\\([A-Za-z0-9]+\\))*|\\b(?:9[0-9]|[1-9][0-9]{2})\\.[0-9]+'"


@query("reference_links", o.sql(f"SELECT stream, idx, CAST(generate_subscripts(found, 1) - 1 AS BIGINT) AS pos, unnest(found) AS ref FROM (SELECT stream, idx, regexp_extract_all(content, {LINK}) AS found FROM stream) WHERE len(found) > 0", "stream"))
def reference_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.reference_links(paragraphs(spark, sf_dir))


@query("fuzzy_ids")
def fuzzy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for ids that no subsection has, from the stream's references."""
    df = paragraphs(spark, sf_dir)
    ids = stored(st.subsection_ids(st.classified(df)))
    asked = df.select(F.explode(F.regexp_extract_all("content", F.lit(r"\b[0-9]{2,3}\.[0-9]+"), F.lit(0))).alias("id")).distinct()
    return lk.suggestions(stored(asked.join(ids, "id", "left_anti")), ids)


@query("udtf_browse", o.sql(f"SELECT DISTINCT stream, {o.chapter('article')} AS chapter, article FROM rows WHERE kind = 'article' AND {o.chapter('article')} = 1", "rows"))
def udtf_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL surface: views and a table function that a query calls by name."""
    lk.register(spark, _rows(spark, sf_dir))
    return spark.sql("SELECT DISTINCT a.stream, c.chapter, a.article FROM lodestone_articles a, LATERAL chapter_of(a.article) c WHERE c.chapter = 1")


# browsing by request, hints, checks of the whole


BROWSED = [(1, 0, None, None, None), (2, 0, 1, None, None), (3, 0, 55, None, None), (4, 0, None, 97, None), (5, 0, None, 97, 2), (6, 0, None, 97, 11), (7, 0, None, 5, None), (8, 0, 1, 97, 1), (9, 0, None, None, 3), (10, 1, 2, None, None), (11, 1, None, 121, 1)]
_null = lambda x: "NULL" if x is None else str(x)
ASKED = ", ".join("(" + ", ".join(map(_null, r)) + ")" for r in BROWSED)
ROMANS = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in lk.ROMAN.items()) + ") r(n, roman)"
BROWSE = f"""{OUTLINE},
whole AS (SELECT stream, article, 'Article ' || article || ': ' || name || chr(10) || body || CASE WHEN scope IS NULL THEN '' ELSE chr(10) || chr(10) || '--- Scope ---' || chr(10) || scope END AS outline FROM bodies LEFT JOIN names USING (stream, article) LEFT JOIN scopes USING (stream, article)),
plines AS (SELECT stream, article, part, part_ord, 1 AS k, ord, '      ' || section || ' ' || short || ' (page ' || page || ')' AS line FROM s WHERE part IS NOT NULL
 UNION ALL SELECT stream, article, part, part_ord, 0, part_ord, '  Part ' || part || ': ' || coalesce(arg_min(part_title, ord), 'None') FROM s WHERE part IS NOT NULL GROUP BY stream, article, part, part_ord),
pwhole AS (SELECT stream, article, part, 'Article ' || article || ': ' || name || chr(10) || body || CASE WHEN scope IS NULL THEN '' ELSE chr(10) || chr(10) || '--- Scope ---' || chr(10) || scope END AS outline FROM (SELECT stream, article, part, string_agg(line, chr(10) ORDER BY part_ord, k, ord, line) AS body FROM plines GROUP BY ALL) LEFT JOIN names USING (stream, article) LEFT JOIN scopes USING (stream, article)),
listings AS (SELECT stream, chapter, 'Chapter ' || chapter || ': ' || {CHAPTER_NAMES} || chr(10) || string_agg('  Article ' || article || ': ' || name, chr(10) ORDER BY article) AS listing FROM (SELECT stream, article, {o.chapter('article')} AS chapter, name FROM names) WHERE chapter IS NOT NULL GROUP BY stream, chapter),
valid AS (SELECT stream, '[' || string_agg(article, ', ' ORDER BY article) || ']' AS articles FROM (SELECT DISTINCT stream, article FROM s) GROUP BY stream),
vparts AS (SELECT stream, article, '[' || coalesce(string_agg(n, ', ' ORDER BY n), '') || ']' AS parts FROM (SELECT DISTINCT stream, article, n FROM s LEFT JOIN {ROMANS} ON roman = part) GROUP BY ALL),
vchapters AS (SELECT stream, '[' || string_agg(chapter, ', ' ORDER BY chapter) || ']' AS all_chapters, string_agg(listing, chr(10) || chr(10) ORDER BY chapter) || chr(10) AS everything FROM listings GROUP BY stream),
asked(req_id, stream, chapter, article, part) AS (VALUES {ASKED})"""


@query("browse_requests", o.sql(f"""SELECT req_id, CASE WHEN q.article IS NOT NULL AND w.outline IS NULL THEN 'Error: Article ' || q.article || ' not found. Valid articles: ' || articles
 WHEN q.article IS NOT NULL AND q.part IS NOT NULL THEN coalesce(p.outline, 'Error: Part ' || q.part || ' not found in Article ' || q.article || '. Valid parts: ' || parts)
 WHEN q.article IS NOT NULL THEN w.outline WHEN q.chapter IS NOT NULL THEN coalesce(listing, 'Error: Chapter ' || q.chapter || ' not found. Valid chapters: ' || all_chapters) ELSE everything END AS answer
 FROM asked q LEFT JOIN valid v ON v.stream = q.stream LEFT JOIN vchapters c ON c.stream = q.stream LEFT JOIN vparts vp ON vp.stream = q.stream AND vp.article = q.article LEFT JOIN listings l ON l.stream = q.stream AND l.chapter = q.chapter
 LEFT JOIN whole w ON w.stream = q.stream AND w.article = q.article LEFT JOIN {ROMANS} ON r.n = q.part LEFT JOIN pwhole p ON p.stream = q.stream AND p.article = q.article AND p.part = r.roman""", "subs", extra=BROWSE))
def browse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for all of browsing: article and part, article, chapter or everything; and what isn't there."""
    asked = spark.createDataFrame(BROWSED, "req_id int, stream long, chapter long, article long, part int")
    rows = stored(_rows(spark, sf_dir))
    return lk.browse(asked, stored(st.subsections(rows)), rows)


@query("lookup_hints")
def lookup_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_lookup with similar ids for what isn't found (difflib has no SQL; tests compare it)."""
    asked = spark.createDataFrame(REQUESTS, "req_id int, ord int, kind string, raw_id string")
    return lk.hinted_lookup(asked, lk.section_index(_subs(spark, sf_dir)), stored(_table_texts(spark, sf_dir)))


UNLIKE = [(1, 0, "section", "qq"), (1, 1, "section", " zz "), (2, 0, "section", "")]


@query("lookup_unlike", "SELECT * FROM (VALUES (1, 'Error: section ''qq'' not found. Similar section IDs: (no similar IDs found)' || chr(10) || chr(10) || 'Error: section ''zz'' not found. Similar section IDs: (no similar IDs found)'), (2, 'Error: at least one id must be provided.')) v(req_id, answer)")
def lookup_unlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for ids that are like none."""
    asked = spark.createDataFrame(UNLIKE, "req_id int, ord int, kind string, raw_id string")
    return lk.hinted_lookup(asked, lk.section_index(_subs(spark, sf_dir)), spark.createDataFrame([], "table_id string, markdown string"))


@query("sql_lookup", o.sql("SELECT v.id, s.article, s.page, s.text AS body FROM (VALUES ('90.1'), (' 97.3 '), ('121.2'), ('none')) v(id) JOIN sindex s ON s.section = trim(v.id)", "subs", extra=INDEX))
def sql_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by name from SQL."""
    lk.register_lookup(spark, lk.section_index(_subs(spark, sf_dir)), spark.createDataFrame([], "table_id string, markdown string"))
    return spark.sql("SELECT v.id, s.article, s.page, s.body FROM VALUES ('90.1'), (' 97.3 '), ('121.2'), ('none') v(id), LATERAL section_text(v.id) s")


@query("chunk_sizes", o.sql("SELECT chunk_type, quantile_disc(length(text), 0.95) AS p95, count(*) FILTER (length(text) > 5000) AS over FROM united GROUP BY chunk_type", "passed", "chunks", extra=TAB + BOTH).replace(o.CTE["rows"], AFTER_PASS))
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, subs = _tabled(spark, sf_dir)
    return st.chunk_sizes(st.all_chunks(subs, st.article_tables(rows)))


@query("chunk_id_check", o.sql("SELECT stream, count(*) AS chunks, count(DISTINCT chunk_id) AS ids, count(*) = count(DISTINCT chunk_id) AS fits FROM united GROUP BY stream", "passed", "chunks", extra=TAB + BOTH).replace(o.CTE["rows"], AFTER_PASS))
def chunk_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a collection would take each stream's chunks as they are."""
    rows, subs = _tabled(spark, sf_dir)
    return st.id_check(st.all_chunks(subs, st.article_tables(rows)))


EXPECTED = {"chapters": (1, None), "articles": (2, 150), "definitions": (10, None), "tables": (1, 217), "subsections": (1, None), "bad_tables": (0, 0), "bad_subsections": (0, 0)}
LIMITS = ", ".join(f"('{k}', {a}, {'NULL' if b is None else b})" for k, (a, b) in EXPECTED.items())


@query("structure_bounds", o.sql(f"SELECT name, value, low, high, value >= low AND (high IS NULL OR value <= high) AS ok FROM counted_all JOIN (VALUES {LIMITS}) v(name, low, high) USING (name)", "passed", "subs", extra=f"""defs AS (SELECT stream, visit, sum(CASE WHEN starts_with(content, 'Informational Note') OR starts_with(content, '(') OR starts_with(content, '[') THEN 0 ELSE 1 END) OVER (PARTITION BY stream, visit ORDER BY idx) AS n FROM rows WHERE kind = 'definition'),
counted_all AS (SELECT 'articles' AS name, count(DISTINCT article) AS value FROM rows WHERE kind = 'article' UNION ALL SELECT 'chapters', count(DISTINCT {o.chapter('article')}) FROM rows WHERE kind = 'article' UNION ALL SELECT 'definitions', count(DISTINCT (stream, visit, n)) FROM defs WHERE n > 0
 UNION ALL SELECT 'tables', count(*) FROM rows WHERE kind = 'table' UNION ALL SELECT 'bad_tables', 0 UNION ALL SELECT 'subsections', count(*) FROM subs UNION ALL SELECT 'bad_subsections', count(*) FILTER (section IS NULL OR title IS NULL) FROM subs)""").replace(o.CTE["rows"], AFTER_PASS))
def structure_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the parsed whole against expected bounds."""
    rows, subs = _tabled(spark, sf_dir)
    return st.bounds(rows, subs, st.article_tables(rows), EXPECTED)


@query("truth_matches_strict", o.sql("SELECT qid, chunk_id, stream FROM chunks, (VALUES (1, ['90'], ['Table220.55']), (2, ['12', '97.3'], []::VARCHAR[])) w(qid, prefixes, ids) WHERE len(list_filter(prefixes, lambda p: starts_with(section, p) AND NOT regexp_matches(substr(section, length(p) + 1, 1), '[0-9]'))) > 0 OR list_contains(ids, section) OR list_has_any(refs, ids)", "chunks"))
def truth_matches_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """truth_matches with whole numbers only."""
    return _truth(spark, sf_dir, [(1, ["90"], ["Table220.55"]), (2, ["12", "97.3"], [])], True)
