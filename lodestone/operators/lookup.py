"""Keyed lookup of sections and tables, prefix and fuzzy search, outlines."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.functions.profile import DEFAULT, Profile
from lodestone.sources.shared import stored

MAX_IDS = 10
ROMAN = {1: "I", 2: "II", 3: "III", 4: "IV", 5: "V", 6: "VI", 7: "VII", 8: "VIII", 9: "IX", 10: "X"}


def section_index(subs: DataFrame) -> DataFrame:
    """section and what it holds; of repeated ids the last in document order."""
    text = F.array_join("paragraphs", "\n")
    s = F.max_by(F.struct("article", "page", text.alias("text")), F.struct("stream", "ord"))
    return subs.where("chapter is not null").groupBy("section").agg(s.alias("s")).select("section", "s.*")


def lookup(requests: DataFrame, sections: DataFrame, tables: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """req_id and answer for requests (req_id, ord, kind: section or table, raw_id): sections first, then tables, each in
    the order asked for. Blank ids don't count; none, or more than MAX_IDS, is an error.
    sections: section, article, page, text; tables: table_id, markdown. With hints (kind, key, similar), what isn't found
    says how its id was read and which ids are like it."""
    r = requests.withColumn("id", F.trim("raw_id"))
    n = r.groupBy("req_id").agg(F.count_if((F.col("id") != "")).alias("n"))
    hit = _keyed(requests).join(sections.withColumn("kind", F.lit("section")).withColumnRenamed("section", "key"), ["kind", "key"], "left").join(tables.withColumn("kind", F.lit("table")).withColumnRenamed("table_id", "key"), ["kind", "key"], "left")
    found = F.when(F.col("kind") == "table", F.col("markdown")).otherwise(F.concat(F.lit("[Section "), "key", F.lit(", Article "), F.col("article").cast("string"), F.lit(", page "), F.col("page").cast("string"), F.lit("]\n"), "text"))
    missing = F.concat(F.lit("Error: "), "kind", F.lit(" '"), "id", F.lit("' not found."))
    if hints is not None:
        hit = hit.join(hints.select("kind", "key", "similar"), ["kind", "key"], "left")
        read = F.when(F.col("kind") == "table", F.concat(F.lit(" (normalised: '"), "key", F.lit("')"))).otherwise("")
        some = F.when(F.size(F.coalesce("similar", F.array().cast("array<string>"))) > 0, F.array_join("similar", ", ")).otherwise("(no similar IDs found)")
        missing = F.concat(F.lit("Error: "), "kind", F.lit(" '"), "id", F.lit("'"), read, F.lit(" not found. Similar "), "kind", F.lit(" IDs: "), some)
    part = F.struct((F.col("kind") == "table").alias("last"), "ord", F.coalesce(found, missing).alias("t"))
    one = hit.groupBy("req_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("answer"))
    too_many = F.concat(F.lit("Error: requested "), F.col("n").cast("string"), F.lit(f" IDs but the maximum is {MAX_IDS} total per call."))
    return n.join(one, "req_id", "left").select("req_id", F.when(F.col("n") == 0, F.lit("Error: at least one id must be provided.")).when(F.col("n") > MAX_IDS, too_many).otherwise(F.col("answer")).alias("answer"))


def _keyed(requests: DataFrame) -> DataFrame:
    r = requests.withColumn("id", F.trim("raw_id")).where("id <> ''")
    return r.withColumn("key", F.when(F.col("kind") == "table", t.normalized_table_id(F.col("id"))).otherwise(F.col("id")))


def hinted_lookup(requests: DataFrame, sections: DataFrame, tables: DataFrame) -> DataFrame:
    """lookup() with similar ids for what isn't found."""
    hints = None
    for kind, ids in (("section", sections.select(F.col("section").alias("id"))), ("table", tables.select(F.col("table_id").alias("id")))):
        missing = _keyed(requests).where(F.col("kind") == kind).select(F.col("key").alias("id")).distinct().join(ids, "id", "left_anti")
        one = suggestions(missing, ids).select(F.lit(kind).alias("kind"), F.col("id").alias("key"), "similar")
        hints = one if hints is None else hints.unionAll(one)
    return lookup(requests, sections, tables, hints)


#: Valid ids that are compared with all missing ones in one pass; the driver holds so many at once.
MAX_VALID = 100_000
SIMILAR = "id string, other string, ratio double"
#: Characters are told apart up to so many classes; missing ids whose suggestions go out together.
CLASSES, EACH, SHORT = 64, 256, 16


class Closest:
    """difflib's get_close_matches for many ids against the same valid ones. Two ids can't be more alike than the characters
    that they share, and among ids of up to SHORT characters their longest common subsequence, allow; so valid ids are
    compared from the largest such bound down, until none can come among the n best."""

    def __init__(self, valid: list[str]):
        self.valid = sorted(valid, reverse=True)  # of equal ratios the larger id comes first
        self.size = np.array([len(x) for x in self.valid], np.int64)
        classes = sorted({ord(c) % CLASSES for x in self.valid for c in x})
        self.at = {c: i for i, c in enumerate(classes)}
        self.held = np.zeros((len(classes), len(self.valid)), np.int32)
        for j, x in enumerate(self.valid):
            for c in x:
                self.held[self.at[ord(c) % CLASSES], j] += 1
        self.codes = np.full((min(SHORT, int(self.size.max(initial=0))), len(self.valid)), -1, np.int32)
        for j, x in enumerate(self.valid):
            if len(x) <= SHORT:
                self.codes[: len(x), j] = [ord(c) for c in x]

    def common(self, x: str, which: np.ndarray) -> np.ndarray:
        """The length of the longest common subsequence of x and each of ``which``, all of them short."""
        codes = self.codes[:, which]
        row = np.zeros((len(codes) + 1, len(which)), np.int8)
        for c in x:
            was, row, same = row, row.copy(), codes == ord(c)
            for k in range(len(codes)):
                np.maximum(np.maximum(was[k + 1], row[k]), was[k] + same[k], out=row[k + 1])
        return row[-1]

    def to(self, x: str, n: int, cutoff: float) -> list[tuple[str, float]]:
        own: dict[int, int] = {}
        for c in x:
            if (k := self.at.get(ord(c) % CLASSES)) is not None:
                own[k] = own.get(k, 0) + 1
        shared = np.zeros(len(self.valid), np.int64)
        for k, most in own.items():
            shared += np.minimum(self.held[k], most)
        both = self.size + len(x)
        bound = np.where(both > 0, 2.0 * shared / np.maximum(both, 1), 1.0)
        near = np.flatnonzero(bound >= cutoff)
        if len(x) <= SHORT:
            short = near[(self.size[near] <= SHORT) & (both[near] > 0)]
            bound[short] = 2.0 * self.common(x, short) / both[short]
            near = near[bound[near] >= cutoff]
        near = near[np.argsort(-bound[near], kind="stable")]
        match = SequenceMatcher()
        match.set_seq2(x)
        best: list[tuple[float, str]] = []
        for j in near:
            y = self.valid[j]
            if len(best) == n and (bound[j], y) < best[-1]:
                break
            match.set_seq1(y)
            if (r := match.ratio()) >= cutoff and (len(best) < n or (r, y) > best[-1]):
                best = sorted([*best, (r, y)], reverse=True)[:n]
        return [(y, r) for r, y in best]


def suggestions(missing: DataFrame, ids: DataFrame, n: int = 5, cutoff: float = 0.4) -> DataFrame:
    """missing (id) with ``similar``: up to n of ids (id) by difflib's ratio of ``cutoff`` or more, the best first, equal
    ones in falling order. Valid ids go in blocks of MAX_VALID, and each pass keeps n for each missing id. Missing ids are
    dealt out over all cores, few as their bytes are."""
    spark = missing.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = missing.select("id").where("id is not null").distinct().repartition(parts, F.xxhash64("id"))  # by the id itself it would be left out
    found = spark.createDataFrame([], SIMILAR)

    def one(valid: list[str]) -> DataFrame:
        def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            among = None
            for p in batches:
                for i in range(0, len(p), EACH):
                    among = among or Closest(valid)
                    rows = [(x, y, r) for x in p["id"][i : i + EACH] for y, r in among.to(x, n, cutoff)]
                    yield pd.DataFrame(rows, columns=["id", "other", "ratio"])

        return asked.mapInPandas(close, SIMILAR)

    block: list[str] = []
    for r in ids.select("id").where("id is not null").distinct().orderBy("id").toLocalIterator():
        block.append(r.id)
        if len(block) == MAX_VALID:
            found = found.unionAll(stored(one(block)))
            block = []
    found = found.unionAll(one(block)) if block else found
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("ratio"), F.desc("other")))
    best = found.withColumn("place", place).where(F.col("place") <= n).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]).alias("similar"))
    return missing.join(best, "id", "left").withColumn("similar", F.coalesce("similar", F.array().cast("array<string>")))


def prefix_lookup(requests: DataFrame, tables: DataFrame) -> DataFrame:
    """raw_id and markdown of tables (table_id, markdown): the exact one, else all whose id starts with it, in order."""
    r = requests.select("raw_id", t.normalized_table_id(F.col("raw_id")).alias("key")).distinct()
    exact = r.join(tables, r.key == tables.table_id).select("raw_id", "table_id", "markdown")
    rest = r.join(exact, "raw_id", "left_anti")
    starts = F.transform(F.sequence(F.lit(1), F.length("table_id")), lambda n: F.substring("table_id", F.lit(1), n))  # an id is short: an equal join instead of a product
    near = tables.withColumn("start", F.explode(starts)).join(rest, F.col("start") == F.col("key")).select("raw_id", "table_id", "markdown")
    return exact.unionAll(near).groupBy("raw_id").agg(t.ordered_join(F.col("table_id"), F.col("markdown"), "\n\n").alias("markdown"))


def outline(subs: DataFrame, rows: DataFrame, by_part: bool = False) -> DataFrame:
    """stream, article and its outline: parts, subsections (titles cut at 120), then the text of section n.1. by_part:
    one outline for each part that has a number instead, with ``part``."""
    s = subs.where("chapter is not null")
    keys = ["stream", "article", "part"] if by_part else ["stream", "article"]
    named = F.col("part").isNotNull()
    title = F.when(F.length("title") > 120, F.concat(F.substring("title", 1, 117), F.lit("..."))).otherwise(F.col("title"))
    line = F.concat(F.when(named, "      ").otherwise("  "), "section", F.lit(" "), title, F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))
    first = F.min("ord").over(W.partitionBy("stream", "article", "part"))
    s = s.withColumn("part_ord", first)
    lines = s.select("stream", "article", "part", "part_ord", F.lit(1).alias("k"), "ord", line.alias("line"))
    heads = s.where(named).groupBy("stream", "article", "part", "part_ord").agg(F.min_by("part_title", "ord").alias("pt")).select("stream", "article", "part", "part_ord", F.lit(0).alias("k"), F.col("part_ord").alias("ord"), F.concat(F.lit("  Part "), "part", F.lit(": "), F.coalesce("pt", F.lit("None"))).alias("line"))
    both = lines.unionByName(heads)
    body = (both.where(named) if by_part else both).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_ord", "k", "ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    names = rows.where("kind = 'article'").groupBy("stream", "article").agg(F.min_by("article_title", "idx").alias("name"))
    scope = s.where(F.col("section") == F.concat(F.col("article").cast("string"), F.lit(".1"))).groupBy("stream", "article").agg(F.min_by(F.array_join("paragraphs", "\n"), "ord").alias("scope"))
    out = body.join(names, ["stream", "article"], "left").join(scope, ["stream", "article"], "left")
    tail = F.when(F.col("scope").isNotNull(), F.concat(F.lit("\n\n--- Scope ---\n"), "scope")).otherwise("")
    return out.select(*keys, F.concat(F.lit("Article "), F.col("article").cast("string"), F.lit(": "), "name", F.lit("\n"), "body", tail).alias("outline"))


def _listed(c: F.Column) -> F.Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ", "), F.lit("]"))


def browse(requests: DataFrame, subs: DataFrame, rows: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """req_id and answer for requests (req_id, stream, chapter, article, part): an article's outline, all of it or one
    part (by number, 1 to 10); else a chapter's articles; else all chapters. A part without an article doesn't count.
    What isn't there is an error that names what is."""
    of = chapters(rows, p)
    subs = subs.where("chapter is not null")
    number = F.create_map(*(F.lit(x) for k, v in ROMAN.items() for x in (v, k)))
    arts = subs.groupBy("stream").agg(_listed("article").alias("articles"))
    chaps = of.groupBy("stream").agg(_listed("chapter").alias("all_chapters"), F.concat(t.ordered_join(F.col("chapter"), F.col("listing"), "\n\n"), F.lit("\n")).alias("everything"))
    parts = subs.groupBy("stream", "article").agg(_listed(number[F.col("part")]).alias("parts"))
    roman = F.create_map(*(F.lit(x) for k, v in ROMAN.items() for x in (k, v)))
    r = requests.withColumn("roman", F.when(F.col("article").isNotNull(), roman[F.col("part").cast("int")])).withColumnRenamed("part", "asked")
    r = r.join(arts, "stream", "left").join(chaps, "stream", "left").join(parts, ["stream", "article"], "left").join(of, ["stream", "chapter"], "left")
    r = r.join(outline(subs, rows).withColumnRenamed("outline", "whole"), ["stream", "article"], "left")
    one = outline(subs, rows, by_part=True).select("stream", "article", F.col("part").alias("roman"), F.col("outline").alias("some"))
    r = r.join(one, ["stream", "article", "roman"], "left")
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    a, c, k = F.col("article"), F.col("chapter"), F.col("asked")
    answer = (
        F.when(a.isNotNull() & F.col("whole").isNull(), text("Error: Article ", a, " not found. Valid articles: ", F.col("articles")))
        .when(a.isNotNull() & k.isNotNull(), F.coalesce("some", text("Error: Part ", k, " not found in Article ", a, ". Valid parts: ", F.col("parts"))))
        .when(a.isNotNull(), F.col("whole")).when(c.isNotNull(), F.coalesce("listing", text("Error: Chapter ", c, " not found. Valid chapters: ", F.col("all_chapters"))))
        .otherwise(F.col("everything"))
    )
    return r.select("req_id", answer.alias("answer"))


def chapters(rows: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """stream, chapter and its list of articles."""
    a = rows.where("kind = 'article'").groupBy("stream", "article").agg(F.min_by("article_title", "idx").alias("name")).withColumn("chapter", t.chapter_of(F.col("article"), p)).where("chapter is not null")
    line = F.concat(F.lit("  Article "), F.col("article").cast("string"), F.lit(": "), "name")
    one = a.groupBy("stream", "chapter").agg(t.ordered_join(F.col("article"), line, "\n").alias("body"))
    title = F.create_map(*(x for n, name, _, _ in p.chapters for x in (F.lit(n), F.lit(name))))
    return one.select("stream", "chapter", F.concat(F.lit("Chapter "), F.col("chapter").cast("string"), F.lit(": "), title[F.col("chapter").cast("int")], F.lit("\n"), "body").alias("listing"))


def reference_links(df: DataFrame) -> DataFrame:
    """stream, idx, pos and ref of every table or section that a text names, tables first where both fit."""
    found = F.regexp_extract_all("content", F.lit(r"Table [0-9]+\.[0-9]+(?:\([A-Za-z0-9]+\))*|\b(?:9[0-9]|[1-9][0-9]{2})\.[0-9]+"), F.lit(0))
    return df.select("stream", "idx", F.posexplode(found).alias("pos", "ref")).withColumn("pos", F.col("pos").cast("bigint"))


def register(spark: SparkSession, rows: DataFrame, p: Profile = DEFAULT) -> None:
    """For SQL: the view lodestone_articles and the table function chapter_of(article)."""
    rows.where("kind = 'article'").select("stream", "article", "article_title").distinct().createOrReplaceTempView("lodestone_articles")
    case = " ".join(f"WHEN article BETWEEN {a} AND {b} THEN {n}L" for n, _, a, b in p.chapters)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION chapter_of(article BIGINT) RETURNS TABLE (chapter BIGINT) RETURN SELECT CASE {case} END")


def register_lookup(spark: SparkSession, sections: DataFrame, tables: DataFrame) -> None:
    """For SQL: the table functions section_text(id) and table_text(id), which give no row for an unknown id."""
    sections.createOrReplaceTempView("lodestone_sections")
    tables.createOrReplaceTempView("lodestone_tables")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION section_text(id STRING) RETURNS TABLE (article BIGINT, page INT, body STRING) RETURN SELECT article, page, text FROM lodestone_sections WHERE section = trim(section_text.id)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION table_text(id STRING) RETURNS TABLE (body STRING) RETURN SELECT markdown FROM lodestone_tables WHERE table_id = concat('Table', replace(regexp_replace(trim(table_text.id), '(?i)^table\\\\s*', ''), ' ', ''))")
