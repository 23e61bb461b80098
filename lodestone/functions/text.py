"""Predicates and projections on a paragraph's content, all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.profile import CONTINUING, DEFAULT, Profile

TABLE_ID = r"Table [0-9]+\.[0-9]+(?:\s*\([^)]*\))*"
SECTION = r"^([0-9]{2,}\.[0-9]+)\s+(.+)"
PART = r"^Part ([IVX]+)\.\s*(.*)"
ARTICLE = r"^ARTICLE ([0-9]+) ([A-Z].+)"
SUB_ITEM = r"^\(([A-Za-z0-9]+)\)\s*(.*)"
#: Python's float(): signs, digits with single underscores, exponents, inf and nan.
NUMBER = r"(?i)^\s*[+-]?(?:(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:e[+-]?[0-9](?:_?[0-9])*)?|inf|infinity|nan)\s*$"


def by_stream() -> WindowSpec:
    """Paragraphs of a stream in order. (A function, as windows need a running session.)"""
    return W.partitionBy("stream").orderBy("idx")


def upper_only(c: Column) -> Column:
    """At least one upper-case letter and no lower-case one."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def starts_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(or_, (c.startswith(p) for p in prefixes))


def is_furniture(c: Column, p: Profile = DEFAULT) -> Column:
    """Exact markers first, then prefixes, then patterns."""
    return (
        c.isin(p.forward, p.reverse, *p.watermarks)
        | starts_any(c, p.copyrights)
        | c.rlike(p.page_number)
        | (c.rlike(r"^ARTICLE [0-9]+\s*[-]?\s*[A-Z]") & upper_only(c))
        | c.rlike(r"^CHAPTER [0-9]+$")
        | c.rlike(r"^Chapter [0-9]+ [A-Z]")
        | c.rlike(r"^[0-9]{2,}\.[0-9]+$")
    )


def is_page_marker(c: Column, p: Profile = DEFAULT) -> Column:
    return starts_any(c, (p.forward, p.reverse, *p.copyrights, *p.watermarks)) | c.rlike(p.page_number) | (c.startswith("ARTICLE ") & upper_only(c)) | c.rlike(r"^[0-9]{2,}\.[0-9]+$")


def is_table_title(c: Column) -> Column:
    return c.rlike(r"^Table [0-9]+\.[0-9]+")


def table_id(c: Column) -> Column:
    """The identifier that a title starts with, without spaces; without one, the whole content without spaces."""
    found = F.regexp_extract(c, "^(" + TABLE_ID + ")", 1)
    return F.replace(F.when(found != "", found).otherwise(c), F.lit(" "), F.lit(""))


def is_section_boundary(c: Column) -> Column:
    return c.rlike(r"^Part [IVX]+\.") | (c.rlike(r"^[0-9]+\.[0-9]+ [A-Z]") & (F.length(c) > 20)) | (c.rlike(r"^\([A-Z0-9]+\) [A-Z]") & (F.length(c) > 80))


def is_footnote(c: Column) -> Column:
    words = reduce(or_, (c.contains(w) for w in ("Column ", "column ", "subheading ", "ampacit")))
    return c.rlike("^[0-9¹²³⁰-⁹?'+*]") | (words & (F.length(c) < 400))


def is_continuation_marker(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("(continues)", "continued", "(continued)")


def is_data_like(c: Column) -> Column:
    return c.rlike(r"^-?[0-9]+$|^-?[0-9]+\.[0-9]+$|^[0-9]+/[0-9]+$") | (F.length(F.trim(c)) <= 20)


def is_subsection_start(c: Column) -> Column:
    return c.rlike(SECTION) & ~c.startswith("Table ") & ~c.rlike(r"^\*\*Table [0-9]+")


def may_run_over(one: Column) -> Column:
    return (one != "") & ~F.right(one, F.lit(1)).isin(".", "?", "!") & ~one.contains("\n") & ~upper_only(one)


def may_go_on(two: Column) -> Column:
    structural = starts_any(two, ("(", "Informational", "Part", "Table", "Figure"))
    number = F.split_part(two, F.lit(" "), F.lit(1)).rlike(NUMBER)
    return ~number & ~two.contains("\n") & ~structural & ~upper_only(two)


def runs_over(one: Column, two: Column) -> Column:
    """Does the sentence at the end of a page go on in the next page's first paragraph? An empty first one never does."""
    return may_run_over(one) & may_go_on(two)


def stays_open(pre: Column) -> Column:
    return ~F.right(pre, F.lit(1)).isin(*".?!:)") | (pre == "")


def hangs(pre: Column) -> Column:
    return pre.rlike(" (?:" + "|".join(CONTINUING) + ")$")


def starts_low(post: Column) -> Column:
    return post.rlike(r"^\p{Ll}")


def interrupted(pre: Column, post: Column) -> Column:
    """Does the paragraph before a table go on in the one behind it?"""
    return stays_open(pre) & ~is_section_boundary(post) & ~is_table_title(post) & (starts_low(post) | hangs(pre))


def dehyphenated(c: Column) -> Column:
    return F.regexp_replace(c, "([A-Za-z])- ", "$1")


def latin(c: Column) -> Column:
    """Only characters up to U+00FF."""
    return F.regexp_replace(c, r"[^\x00-\xFF]", "")


def table_refs(c: Column) -> Column:
    """Sorted distinct identifiers of the tables that a text names."""
    found = F.regexp_extract_all(c, F.lit(r"Table\s+[0-9]+\.[0-9]+(?:\s*\([^)]*\))*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit("")))))


def normalized_table_id(c: Column) -> Column:
    return F.concat(F.lit("Table"), F.replace(F.regexp_replace(F.trim(c), r"(?i)^table\s*", ""), F.lit(" "), F.lit("")))


def chapter_of(article: Column, p: Profile = DEFAULT) -> Column:
    out = F.lit(None).cast("bigint")
    for number, _, low, high in reversed(p.chapters):
        out = F.when(article.between(low, high), F.lit(number).cast("bigint")).otherwise(out)
    return out


def ordered_join(order: Column, text: Column, separator: str) -> Column:
    """Texts of a group in an explicit order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once. Otherwise it is computed in each place where f has it, and in a lambda for each
    element."""
    return F.element_at(F.transform(F.array(value), f), 1)
