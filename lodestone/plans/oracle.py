"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from lodestone.functions.profile import CONTINUING, DEFAULT
from lodestone.sources.overlay import DUCK_STREAM

P = DEFAULT
q = lambda s: "'" + s.replace("'", "''") + "'"
UPPER = "(regexp_matches({0}, '\\p{{Lu}}') AND NOT regexp_matches({0}, '\\p{{Ll}}'))"
up = lambda c: UPPER.format(c)
m = lambda c, p: f"regexp_matches({c}, {q(p)})"
starts = lambda c, xs: "(" + " OR ".join(f"starts_with({c}, {q(x)})" for x in xs) + ")"
TID = r"Table [0-9]+\.[0-9]+(?:\s*\([^)]*\))*"


def furniture(c: str = "content") -> str:
    exact = ", ".join(map(q, (P.forward, P.reverse, *P.watermarks)))
    return f"({c} IN ({exact}) OR {starts(c, P.copyrights)} OR {m(c, P.page_number)} OR ({m(c, '^ARTICLE [0-9]+' + chr(92) + 's*[-]?' + chr(92) + 's*[A-Z]')} AND {up(c)}) OR {m(c, '^CHAPTER [0-9]+$')} OR {m(c, '^Chapter [0-9]+ [A-Z]')} OR {m(c, '^[0-9]{2,}[.][0-9]+$')})"


def marker(c: str = "content") -> str:
    return f"({starts(c, (P.forward, P.reverse, *P.copyrights, *P.watermarks))} OR {m(c, P.page_number)} OR (starts_with({c}, 'ARTICLE ') AND {up(c)}) OR {m(c, '^[0-9]{2,}[.][0-9]+$')})"


def title(c: str = "content") -> str:
    return m(c, "^Table [0-9]+[.][0-9]+")


def tid(c: str = "content") -> str:
    return f"replace(CASE WHEN {m(c, '^' + TID)} THEN regexp_extract({c}, {q('^(' + TID + ')')}, 1) ELSE {c} END, ' ', '')"


def boundary(c: str = "content") -> str:
    return f"({m(c, '^Part [IVX]+[.]')} OR ({m(c, '^[0-9]+[.][0-9]+ [A-Z]')} AND length({c}) > 20) OR ({m(c, '^[(][A-Z0-9]+[)] [A-Z]')} AND length({c}) > 80))"


def footnote(c: str = "content") -> str:
    words = " OR ".join(f"contains({c}, {q(w)})" for w in ("Column ", "column ", "subheading ", "ampacit"))
    return f"({m(c, chr(94) + '[0-9¹²³⁰-⁹?' + chr(39) + '+*]')} OR (({words}) AND length({c}) < 400))"


def continuation(c: str = "content") -> str:
    return f"(lower(trim({c})) IN ('(continues)', 'continued', '(continued)'))"


def data_like(c: str = "content") -> str:
    return f"({m(c, '^-?[0-9]+$|^-?[0-9]+[.][0-9]+$|^[0-9]+/[0-9]+$')} OR length(trim({c})) <= 20)"


SECTION = r"^([0-9]{2,}\.[0-9]+)\s+(.+)"
PART = r"^Part ([IVX]+)\.\s*(.*)"
ARTICLE = r"^ARTICLE ([0-9]+) ([A-Z].+)"
SUB = r"^\(([A-Za-z0-9]+)\)\s*(.*)"


def section_start(c: str = "content") -> str:
    return f"({m(c, SECTION)} AND NOT starts_with({c}, 'Table ') AND NOT {m(c, '^[*][*]Table [0-9]+')})"


def refs(c: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({c}, {q('Table' + chr(92) + 's+[0-9]+[.][0-9]+(?:' + chr(92) + 's*[(][^)]*[)])*')}), lambda x: replace(x, ' ', ''))))"


def chapter(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} BETWEEN {a} AND {b} THEN {n}" for n, _, a, b in P.chapters) + " END"


def runs_over(a: str, b: str) -> str:
    return f"({a} <> '' AND NOT {m(f'split_part({b}, chr(32), 1)', '(?i)^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+|inf|infinity|nan)$')} AND right({a}, 1) NOT IN ('.', '?', '!') AND NOT contains({a}, chr(10)) AND NOT contains({b}, chr(10)) AND NOT {starts(b, ('(', 'Informational', 'Part', 'Table', 'Figure'))} AND NOT {up(a)} AND NOT {up(b)})"


def interrupted(pre: str, post: str) -> str:
    return f"((right({pre}, 1) NOT IN ('.', '?', '!', ':', ')') OR {pre} = '') AND NOT {boundary(post)} AND NOT {title(post)} AND ({m(post, '^' + chr(92) + 'p{Ll}')} OR {m(pre, ' (?:' + '|'.join(CONTINUING) + ')$')}))"


W = "OVER (PARTITION BY stream ORDER BY idx)"
CTE: dict[str, str] = {"stream": DUCK_STREAM}
CTE["kinds"] = f"kinds AS (SELECT *, {marker()} AS marker, {title()} AS title, {tid()} AS tid, lead(content) {W} AS after FROM stream)"
CTE["starts"] = f"""starts AS (SELECT stream, idx AS start, tid AS table_id, page FROM (SELECT *, sum(CASE WHEN length(content) < 80 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS short FROM kinds WHERE NOT marker)
 WHERE title AND after IS DISTINCT FROM 'Continued' AND short >= 2)"""
CTE["regions"] = f"""nexts AS (SELECT *, lead(start) OVER (PARTITION BY stream ORDER BY start) AS next_start FROM starts),
inside AS (SELECT s.stream, s.start, s.table_id, s.page AS start_page, k.idx, k.content, k.page,
  CASE WHEN k.title AND k.tid = s.table_id AND k.after IS NOT DISTINCT FROM 'Continued' THEN 'P' WHEN k.title THEN 'T' WHEN {continuation('k.content')} THEN 'M' WHEN {boundary('k.content')} THEN 'S' ELSE 'C' END AS kind
  FROM nexts s JOIN kinds k ON k.stream = s.stream AND k.idx > s.start AND k.idx < s.start + 300 AND (s.next_start IS NULL OR k.idx < s.next_start) WHERE NOT k.marker),
jumped AS (SELECT *, sum(CASE WHEN kind IN ('P', 'M') THEN 1 ELSE 0 END) OVER (PARTITION BY stream, start ORDER BY idx) AS jumps FROM inside),
looked AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'C' THEN page END IGNORE NULLS) OVER v, start_page) AS prev_page, coalesce(last_value(CASE WHEN kind = 'C' THEN jumps END IGNORE NULLS) OVER v, 0) AS prev_jumps,
  coalesce(max(CASE WHEN kind = 'C' AND length(content) < 60 THEN 1 ELSE 0 END) OVER v, 0) AS seen FROM jumped WINDOW v AS (PARTITION BY stream, start ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stops AS (SELECT stream, start, min(idx) AS stop FROM looked WHERE kind IN ('T', 'S') OR (kind = 'C' AND length(content) >= 60 AND seen = 1 AND NOT {footnote()} AND page <> prev_page AND jumps = prev_jumps) GROUP BY ALL),
ends AS (SELECT l.stream, l.start, max(l.idx) AS finish FROM looked l LEFT JOIN stops s USING (stream, start) WHERE l.kind IN ('C', 'M') AND (s.stop IS NULL OR l.idx < s.stop) GROUP BY ALL),
regions AS (SELECT s.stream, s.start, coalesce(e.finish, s.start) AS finish, s.table_id, s.page FROM starts s LEFT JOIN ends e USING (stream, start))"""
CTE["fragments"] = f"""cells AS (SELECT r.stream, r.start, r.table_id, k.idx, k.content, k.title AND k.tid = r.table_id AS again, {continuation('k.content')} AS cont FROM regions r JOIN kinds k ON k.stream = r.stream AND k.idx BETWEEN r.start AND r.finish WHERE NOT k.marker),
behind AS (SELECT *, coalesce(last_value(CASE WHEN NOT again THEN cont END IGNORE NULLS) OVER (PARTITION BY stream, start ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS behind FROM cells),
fragments AS (SELECT stream, start, table_id, list(content ORDER BY idx) AS fragments FROM behind WHERE NOT cont AND NOT (again AND behind) GROUP BY ALL)"""
CTE["cuts"] = f"""real AS (SELECT stream, idx, content FROM kinds WHERE NOT marker),
pre AS (SELECT r.stream, r.start, max(x.idx) AS pre_idx FROM regions r JOIN real x ON x.stream = r.stream AND x.idx < r.start GROUP BY ALL),
post AS (SELECT r.stream, r.start, min(x.idx) AS post_idx FROM regions r JOIN real x ON x.stream = r.stream AND x.idx > r.finish GROUP BY ALL),
cuts AS (SELECT r.stream, r.start, r.finish, pre_idx, post_idx, a.content || ' ' || b.content AS joined FROM regions r JOIN pre USING (stream, start) JOIN post USING (stream, start) JOIN stream a ON a.stream = r.stream AND a.idx = pre_idx JOIN stream b ON b.stream = r.stream AND b.idx = post_idx WHERE {interrupted('a.content', 'b.content')})"""
CTE["passed"] = """blocks AS (SELECT stream, start AS idx, '**' || fragments[1] || '**' || chr(10) || CASE WHEN len(fragments) > 1 THEN chr(10) || array_to_string(fragments[2:], chr(10)) ELSE '' END AS formatted FROM fragments),
firsts AS (SELECT stream, min(start) AS idx FROM regions GROUP BY stream, table_id),
gone AS (SELECT DISTINCT r.stream, unnest(range(r.start, coalesce(c.post_idx, r.finish) + 1)) AS idx FROM regions r LEFT JOIN cuts c USING (stream, start)),
mended AS (SELECT stream, pre_idx AS idx, arg_max(joined, start) AS joined FROM cuts GROUP BY ALL),
kept AS (SELECT s.stream, s.idx, CASE WHEN g.idx IS NOT NULL THEN b.formatted ELSE coalesce(j.joined, s.content) END AS content, s.page FROM stream s LEFT JOIN gone g ON g.stream = s.stream AND g.idx = s.idx
 LEFT JOIN (SELECT * FROM blocks SEMI JOIN firsts USING (stream, idx)) b ON b.stream = s.stream AND b.idx = s.idx LEFT JOIN mended j ON j.stream = s.stream AND j.idx = s.idx WHERE g.idx IS NULL OR b.formatted IS NOT NULL),
passed AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY idx) - 1 AS idx, content, page FROM kept)"""


def runover(src: str, out: str) -> str:
    """CTEs that turn the stream ``src`` into ``out``."""
    return f"""{out}_s AS (SELECT *, coalesce(last_value(CASE WHEN content = {q(P.forward)} THEN idx WHEN content = {q(P.reverse)} THEN idx - 1 END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 99) AS stop, lead(content) OVER (PARTITION BY stream ORDER BY idx) AS two FROM {src}),
{out}_h AS (SELECT h.stream, h.stop - 1 AS place, h.idx + 1 AS dropped, h.two, h.page - 1 AS to_page, a.content AS one FROM {out}_s h JOIN {src} a ON a.stream = h.stream AND a.idx = h.stop - 1 WHERE contains(lower(h.content), 'article') AND {up('h.content')} AND h.idx > h.stop AND h.two IS NOT NULL AND {runs_over('a.content', 'h.two')}),
{out}_m AS (SELECT stream, place AS idx, arg_max(one || ' ' || two, dropped) AS content, arg_max(to_page, dropped) AS page FROM {out}_h GROUP BY ALL),
{out}_g AS (SELECT DISTINCT stream, dropped AS idx FROM {out}_h),
{out} AS (SELECT s.stream, row_number() OVER (PARTITION BY s.stream ORDER BY s.idx) - 1 AS idx, coalesce(x.content, s.content) AS content, coalesce(x.page, s.page) AS page FROM {src} s LEFT JOIN {out}_m x USING (stream, idx) LEFT JOIN {out}_g g USING (stream, idx) WHERE g.stream IS NULL OR x.stream IS NOT NULL)"""


V = "OVER (PARTITION BY stream, visit ORDER BY idx)"
CTE["rows"] = f"""parsed AS (SELECT *, CASE WHEN {m('content', ARTICLE)} THEN CAST(regexp_extract(content, {q(ARTICLE)}, 1) AS BIGINT) END AS new_article FROM stream),
visited AS (SELECT *, last_value(new_article IGNORE NULLS) {W} AS article, last_value(CASE WHEN new_article IS NOT NULL THEN trim(regexp_extract(content, {q(ARTICLE)}, 2)) END IGNORE NULLS) {W} AS article_title, count(new_article) {W} AS visit FROM parsed),
kinded AS (SELECT *, CASE WHEN new_article IS NOT NULL THEN 'article' WHEN article IS NULL THEN 'preamble' WHEN article = 100 THEN 'definition' WHEN {m('content', PART)} THEN 'part' WHEN {section_start()} THEN 'section' WHEN {m('content', '^[*][*]Table [0-9]+')} THEN 'table' ELSE 'body' END AS kind FROM visited),
opened AS (SELECT *, kind = 'part' AND {m(f'regexp_extract(content, {q(PART)}, 2)', SECTION)} AS embedded FROM kinded),
sourced AS (SELECT *, CASE WHEN embedded THEN regexp_extract(content, {q(PART)}, 2) ELSE content END AS src FROM opened),
rows AS (SELECT *, last_value(CASE WHEN kind = 'part' THEN {{'num': regexp_extract(content, {q(PART)}, 1), 'title': nullif(trim(regexp_extract(content, {q(PART)}, 2)), '')}} END IGNORE NULLS) {V} AS part,
 last_value(CASE WHEN kind = 'section' OR embedded THEN {{'id': regexp_extract(src, {q(SECTION)}, 1), 'title': trim(regexp_extract(src, {q(SECTION)}, 2)), 'page': page}} END IGNORE NULLS) {V} AS section,
 sum(CASE WHEN kind IN ('article', 'part', 'section') THEN 1 ELSE 0 END) {W} AS flush, kind IN ('section', 'body') OR embedded AS member FROM sourced)"""
CTE["subs"] = f"""subs AS (SELECT stream, min(idx) AS ord, {chapter('any_value(article)')} AS chapter, any_value(article) AS article, arg_min(part, idx).num AS part, arg_min(part, idx).title AS part_title, arg_min(section, idx).id AS section, arg_min(section, idx).title AS title, arg_min(section, idx).page AS page, list(content ORDER BY idx) AS paragraphs, {refs('array_to_string(list(content ORDER BY idx), chr(10))')} AS refs
 FROM rows WHERE section IS NOT NULL AND member GROUP BY stream, flush)"""
CTE["items"] = f"""spread AS (SELECT stream, ord, section, unnest(paragraphs) AS content, generate_subscripts(paragraphs, 1) AS pos FROM subs),
counted AS (SELECT *, sum(CASE WHEN {m('content', SUB)} THEN 1 ELSE 0 END) OVER (PARTITION BY stream, ord ORDER BY pos) AS n FROM spread),
grouped AS (SELECT stream, ord, section, n, arg_min(content, pos) AS head, string_agg(content, chr(10) ORDER BY pos) AS content FROM counted GROUP BY ALL),
items AS (SELECT stream, ord, section, CAST(n AS BIGINT) AS n, CASE WHEN n > 0 THEN '(' || regexp_extract(head, {q(SUB)}, 1) || ')' END AS label, CASE WHEN n > 0 THEN CASE WHEN contains(trim(regexp_extract(head, {q(SUB)}, 2)), '.') THEN trim(split_part(trim(regexp_extract(head, {q(SUB)}, 2)), '.', 1) || '.') ELSE trim(regexp_extract(head, {q(SUB)}, 2)) END END AS title, content FROM grouped)"""
CTE["chunks"] = """gathered AS (SELECT stream, ord, coalesce(max(content) FILTER (n = 0), '') AS front, coalesce(list({'n': n, 'content': content} ORDER BY n) FILTER (n > 0), []) AS items FROM items GROUP BY ALL),
sized AS (SELECT *, front || CASE WHEN len(items) > 0 THEN chr(10) || array_to_string(list_transform(items, lambda x: x.content), chr(10)) ELSE '' END AS full_text FROM gathered),
cutting AS (SELECT *, length(full_text) > 3000 AND len(list_filter(items, lambda x: regexp_matches(ltrim(x.content), '^[(][A-Z][)]\\s'))) > 0 AS split FROM sized),
lettered AS (SELECT stream, ord, front, u.n AS n, u.content AS content, regexp_matches(ltrim(u.content), '^[(][A-Z][)]\\s') AS is_letter FROM (SELECT stream, ord, front, unnest(items) AS u FROM cutting WHERE split)),
lettergroups AS (SELECT *, greatest(sum(CASE WHEN is_letter THEN 1 ELSE 0 END) OVER (PARTITION BY stream, ord ORDER BY n), 1) AS g FROM lettered),
pieces AS (SELECT stream, ord, CAST(0 AS BIGINT) AS g, NULL AS letter, full_text AS text FROM cutting WHERE NOT split
 UNION ALL SELECT stream, ord, CAST(g AS BIGINT), arg_min(substr(ltrim(content), 2, 1), n) FILTER (is_letter), front || chr(10) || string_agg(content, chr(10) ORDER BY n) FROM lettergroups GROUP BY stream, ord, front, g),
based AS (SELECT p.*, s.* EXCLUDE (stream, ord, paragraphs), s.article || '_' || s.section || CASE WHEN p.letter IS NULL THEN '' ELSE '_' || p.letter END AS base FROM pieces p JOIN subs s USING (stream, ord) WHERE s.chapter IS NOT NULL),
chunks AS (SELECT *, base || CASE WHEN rn > 1 THEN '_' || rn ELSE '' END AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY stream, base ORDER BY ord, g) AS rn FROM based))"""

_CHAIN = {"kinds": ("stream",), "starts": ("kinds",), "regions": ("starts",), "fragments": ("regions",), "cuts": ("regions",), "passed": ("fragments", "cuts"), "rows": ("stream",), "subs": ("rows",), "items": ("subs",), "chunks": ("items",)}


def sql(select: str, *needs: str, extra: str = "") -> str:
    """WITH the named CTEs and what they need, then the select."""
    seen: list[str] = []

    def add(name: str) -> None:
        for x in _CHAIN.get(name, ()):
            add(x)
        if name not in seen:
            seen.append(name)

    for x in needs:
        add(x)
    parts = [CTE[x] for x in seen] + ([extra] if extra else [])
    return f"WITH {', '.join(parts)} {select}" if parts else select
