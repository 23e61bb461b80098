"""Exact vector search, re-ranking, lexical scores, context assembly, de-duplication across calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.shared import stored

#: Queries that one pass over the data carries along; more go in several passes.
MAX_QUERIES, MAX_TEXTS = 4096, 512
HITS = "query_id long, vec_id long, distance double"
FOUND = "query_id long, doc_id long, n long, both long, m long"


def _passes(queries: DataFrame, most: int) -> Iterator[list]:
    """Query rows in batches of ``most``; the driver holds one at a time."""
    batch = []
    for row in queries.orderBy("query_id").toLocalIterator():
        batch.append(row)
        if len(batch) == most:
            yield batch
            batch = []
    if batch:
        yield batch


def _united(queries: DataFrame, most: int, one: Callable[[list], DataFrame], schema: str) -> DataFrame:
    """What ``one`` makes of each batch. A full batch's result is stored, so that its queries can go."""
    out = queries.sparkSession.createDataFrame([], schema)
    for rows in _passes(queries, most):
        out = out.unionAll(stored(one(rows)) if len(rows) == most else one(rows))
    return out


class Best:
    """The k smallest by (value, id) of each of n queries, over all that has been added. One step looks at no more than
    ROWS queries and COLUMNS ids, so what it needs besides the k held doesn't grow with the number of queries."""

    ROWS, COLUMNS = 256, 1024

    def __init__(self, n: int, k: int):
        self.k = k
        self.worst, self.last = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)
        self.parts = [[np.zeros(0, x) for x in (np.int64, float, np.int64, np.int64)] for _ in range(0, max(n, 1), self.ROWS)]

    @property
    def held(self) -> list[np.ndarray]:
        """Query, value, id and more, in order."""
        return [np.concatenate(x) for x in zip(*self.parts, strict=True)]

    def add(self, value: np.ndarray, ids: np.ndarray, more: np.ndarray, at: int = 0) -> None:
        """value: a row for each query from the one numbered ``at`` (a multiple of ROWS), a column for each id; ``more``
        goes along with the id."""
        for a in range(0, len(value), self.ROWS):
            for j in range(0, len(ids), self.COLUMNS):
                self._step(at + a, value[a : a + self.ROWS, j : j + self.COLUMNS], ids[j : j + self.COLUMNS], more[j : j + self.COLUMNS])

    def _step(self, at: int, value: np.ndarray, ids: np.ndarray, more: np.ndarray) -> None:
        worst, last = self.worst[at : at + len(value)], self.last[at : at + len(value)]
        w = worst[:, None]
        q, j = np.nonzero((value < w) | ((value == w) & (ids[None, :] < last[:, None]) & np.isfinite(value)))
        if not len(q):
            return
        part = at // self.ROWS
        q, v, i, m = (np.concatenate(x) for x in zip(self.parts[part], (at + q, value[q, j], ids[j], more[j]), strict=True))
        order = np.lexsort((i, v, q))
        q, v, i, m = q[order], v[order], i[order], m[order]
        first = np.searchsorted(q, at + np.arange(len(worst) + 1))
        place = np.arange(len(q)) - first[q - at]
        full = np.flatnonzero(np.diff(first) >= self.k)
        end = first[full] + self.k - 1
        worst[full], last[full] = v[end], i[end]
        self.parts[part] = [x[place < self.k] for x in (q, v, i, m)]


def topk(vectors: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """query_id, rank, vec_id and cosine distance of the k nearest of vectors (vec_id, embedding) to each query
    (query_id, embedding). Every partition keeps k for each query, so little is shuffled; ties go by id."""
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding").where("embedding is not null")

    def one(rows: list) -> DataFrame:
        ids = np.array([r.query_id for r in rows], np.int64)
        q = np.array([r.embedding for r in rows], float).reshape(len(rows), -1)
        unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(ids), k)
            for whole in batches:
                for i in range(0, whole.num_rows, best.COLUMNS):
                    b = whole.slice(i, best.COLUMNS)
                    v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    vec = b.column(0).to_numpy()
                    for a in range(0, len(ids), best.ROWS):
                        best.add(np.round(1 - unit[a : a + best.ROWS] @ v.T, 9) + 0.0, vec, vec, a)
            n, d, vec, _ = best.held
            yield pa.RecordBatch.from_arrays([pa.array(ids[n]), pa.array(vec), pa.array(d)], ["query_id", "vec_id", "distance"])

        return vectors.mapInArrow(near, HITS)

    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id")).cast("bigint")
    return _united(queries, MAX_QUERIES, one, HITS).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def negative_l1(a: Column, b: Column) -> Column:
    """A second score that built-in functions express: minus the L1 distance."""
    return -F.round(F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x), 6)


def reranked(hits: DataFrame, top_rerank: int = 10, top_embed: int = 5) -> DataFrame:
    """hits (query_id, rank, score, ...) -> the best by score, then the best by rank that aren't among them; ``position``
    is the order of the union. Equal scores keep the order of the ranks."""
    rr = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "rank")).cast("bigint")
    rows = hits.withColumn("rerank", rr).where((F.col("rerank") <= top_rerank) | (F.col("rank") <= top_embed))
    first = F.col("rerank") > top_rerank
    pos = F.row_number().over(W.partitionBy("query_id").orderBy(first, F.when(first, F.col("rank")).otherwise(F.col("rerank")))).cast("bigint")
    return rows.withColumn("position", pos)


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def lexical(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """The k documents (doc_id, text) with the largest ``share`` of each query's (query_id, text) distinct words; score is
    the share of the document's words. A document meets a batch of queries at once, as a product of 0/1 matrices, and
    every partition keeps k for each query, so no pair of query and document is shuffled that can't be among the best."""
    asked = queries.select("query_id", tokens(F.col("text")).alias("qt")).where(F.size("qt") > 0)
    have = docs.select(F.col("doc_id").cast("long"), tokens(F.col("text")).alias("dt")).where("dt is not null")

    def one(rows: list) -> DataFrame:
        ids, size = np.array([r.query_id for r in rows], np.int64), np.array([len(r.qt) for r in rows], np.int64)
        words = sorted({w for r in rows for w in r.qt})
        number = {w: i for i, w in enumerate(words)}
        held = np.zeros((len(words), len(rows)), np.float32)
        for j, r in enumerate(rows):
            held[[number[w] for w in r.qt], j] = 1
        step = max(1, min((16 << 20) // len(words), (1 << 20) // len(rows)))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, vocabulary = Best(len(ids), k), pa.array(words)
            for b in batches:
                for i in range(0, b.num_rows, step):
                    part = b.slice(i, step)
                    size_of = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                    at = pc.index_in(part.column(1).flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                    doc = np.repeat(np.arange(part.num_rows), size_of)
                    has = np.zeros((part.num_rows, len(words)), np.float32)
                    has[doc[at >= 0], at[at >= 0]] = 1
                    both = (has @ held).T
                    top.add(np.where(both > 0, -both, np.inf), part.column(0).to_numpy(), size_of)
            q, n, doc, m = top.held
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[q], doc, size[q], (-n).astype(np.int64), m)], ["query_id", "doc_id", "n", "both", "m"])

        return have.mapInArrow(best, FOUND)

    s = _united(asked, MAX_TEXTS, one, FOUND).select("query_id", "doc_id", F.round(F.col("both") / F.col("n"), 6).alias("share"), F.round(F.col("both") / F.col("m"), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("share"), "doc_id")).cast("bigint")
    return s.withColumn("rank", rank).where(F.col("rank") <= k)


def names_identifier(c: Column) -> Column:
    """Does a query name a section or table by number?"""
    return c.rlike(r"[0-9]+\.[0-9]+") | c.rlike(r"(?i)(section|table|article)\s+[0-9]")


def unseen(hits: DataFrame) -> DataFrame:
    """hits (session_id, call_no, section_id, ...) without sections that an earlier call of the session has returned;
    several hits of one section in one call stay."""
    first = F.min("call_no").over(W.partitionBy("session_id", "section_id"))
    return hits.withColumn("first_call", first).where("call_no = first_call").drop("first_call")


def context(hits: DataFrame) -> DataFrame:
    """query_id and the text to show: blocks in the order of position, then the tables that they name and don't hold.
    hits: query_id, position, chunk_type, section_id, article, page, refs, document."""
    table = F.col("chunk_type") == "table"
    head = F.concat(F.when(table, "[Table ").otherwise("[Section "), "section_id", F.lit(", Article "), F.col("article").cast("string"), F.lit(", page "), F.col("page").cast("string"), F.lit("]\n"), "document")
    one = hits.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", head.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"),
        F.array_distinct(F.flatten(F.collect_list("refs"))).alias("refs"), F.collect_set(F.when(table, F.col("section_id"))).alias("inline"),
    )
    rest = F.array_sort(F.array_except("refs", "inline"))
    tail = F.concat(F.lit("\n\n[Tables referenced by these sections: "), F.array_join(rest, ", "), F.lit(". Look them up by id if needed.]"))
    return one.select("query_id", F.concat("body", F.when(F.size(rest) > 0, tail).otherwise("")).alias("context"))


def hashed_embedding(df: DataFrame, column: str = "text", dim: int = 64) -> DataFrame:
    """df with ``embedding``: signed word counts in hashed slots, unit length; a stand-in wherever no model is at hand."""
    w = F.explode(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    key = df.withColumn("__key", F.xxhash64(*df.columns))
    slots = key.select("__key", w.alias("w")).select("__key", F.pmod(F.xxhash64("w"), F.lit(dim)).alias("slot"), F.when(F.pmod(F.hash("w"), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v"))
    s = slots.groupBy("__key", "slot").agg(F.sum("v").alias("v")).groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0.0)))
    out = key.join(s, "__key", "left").withColumn("raw", raw)
    norm = F.greatest(F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return out.select(*df.columns, F.transform("raw", lambda x: (F.coalesce(x, F.lit(0.0)) / norm).cast("float")).alias("embedding"))
