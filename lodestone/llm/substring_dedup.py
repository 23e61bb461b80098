"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``window // 2`` words, whose hashes form the index. Any window of
``window`` words holds at least one whole block, so a repeated window always shows up as a *rolling* stretch of another
document that equals an indexed block. Three passes over the same blocks of documents:

1. index and probe: all rolling stretches (48-bit hashes) against the index; one bit back for each: does an indexed
   block equal it, and do two documents hold it?
2. extension: only windows around such hits are hashed in full (64 bits) with the smallest doc_id of the block; one bit
   back: does another block of documents hold the window with a smaller doc_id?
3. removal: hits that follow one another run together into maximal exact repeats, and their words go.

Defined cases: null and empty texts have no words; rows with the same doc_id are not smaller than each other; a null
doc_id counts as larger than all others; an empty table gives an empty result; further columns are ignored.
Windows are compared by 64-bit hashes (at 1e12 candidate windows, about one in 1e7 would be taken for another).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common as c

WINDOW = 50
#: Bytes of text in a block: hashes of words, stretches and windows take about twenty times as much.
BLOCK = 8 << 20
_HIGH = np.uint64(0xFFFFFFFFFFFF0000)


def _words(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return c.words_of(*c.utf8(t["text"]))


def _probes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all rolling stretches, and their hashes."""
    at = np.flatnonzero(c.window_starts(first, size))
    return at, c.rolling(words, size)[at] & _HIGH if len(at) else np.zeros(0, np.uint64)


def _probe(size: int):
    def ask(t: pa.Table, heard: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        words, first = _words(t)
        at, h = _probes(words, first, size)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
        order, runs = c.grouped(h)
        d, indexed = doc[order], ((at - first[doc]) % size == 0)[order]
        if not len(runs):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        several = np.minimum.reduceat(d, runs) != np.maximum.reduceat(d, runs)
        return h[order][runs], several.astype(np.uint8) | np.logical_or.reduceat(indexed, runs).astype(np.uint8) << 1

    return ask


def _windows(t: pa.Table, heard: dict[int, np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate windows: their places and hashes; and where the documents begin, and the document of each place."""
    size = window // 2
    words, first = _words(t)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, h = _probes(words, first, size)
    order, runs = c.grouped(h)
    hits = np.zeros(len(words) + 1, np.int32)
    if len(runs):
        hits[1:][at] = c.spread(heard[1], order, runs)
    hits = np.cumsum(hits)
    ok = np.flatnonzero(c.window_starts(first, window))
    ok = ok[hits[ok + window - size + 1] > hits[ok]]
    return ok, c.rolling(words, window)[ok] if len(ok) else np.zeros(0, np.uint64), first, doc


def _extend(window: int):
    def ask(t: pa.Table, heard: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, h, _, doc = _windows(t, heard, window)
        order, runs = c.grouped(h)
        if not len(runs):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return h[order][runs], np.minimum.reduceat(c.doc_ids(t["doc_id"])[doc[at]][order], runs)

    return ask


def _smaller(keys: np.ndarray, extra: list[np.ndarray], owner: np.ndarray) -> list[np.ndarray]:
    order, first = c.grouped(keys)
    ids = np.concatenate(extra)
    least = c.spread(np.minimum.reduceat(ids[order], first), order, first)
    return c.split_lists((least < ids).astype(np.uint8), extra)


def _spans(t: pa.Table, heard: dict[int, np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word goes, and where the documents begin."""
    at, h, first, doc = _windows(t, heard, window)
    gone = np.zeros(int(first[-1]) + 1, np.int32)
    order, runs = c.grouped(h)
    if len(runs):
        ids = c.doc_ids(t["doc_id"])[doc[at]]
        own = c.spread(np.minimum.reduceat(ids[order], runs), order, runs)
        start = at[(c.spread(heard[2], order, runs) > 0) | (own < ids)]
        np.add.at(gone, start, 1)
        np.add.at(gone, start + window, -1)
    return np.cumsum(gone[:-1]) > 0, first


def spans(docs: DataFrame, columns: tuple[str, ...] = (), window: int = WINDOW, finish=None, schema: str = "") -> DataFrame:
    """Runs the three passes; finish(block's rows, word goes, where documents begin) makes the rows of ``schema``."""
    n = c.count_blocks(docs, size=BLOCK)
    docs = c.in_blocks(docs, n, *columns)
    one = c.census(docs, n, 1, _probe(window // 2), c.shared)
    two = c.census(docs, n, 2, _extend(window), _smaller, one)
    return docs.groupBy("block").cogroup(one.unionAll(two).groupBy("block")).applyInArrow(c.tidy(lambda t, a: finish(t, *_spans(t, c.answers(a), window))), schema)


def _digest(t: pa.Table, gone: np.ndarray, first: np.ndarray) -> pa.Table:
    sums, removed = [], np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
    for i, text in enumerate(t["text"]):
        words = (text.as_py() or "").encode().split()
        if removed[i]:
            words = [w for w, g in zip(words, gone[first[i] : first[i + 1]], strict=True) if not g]
        sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "n_words": np.diff(first), "n_removed": removed.astype(np.int64), "kept_sha256": sums})


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return spans(docs, (), window, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, every column kept, with repeated words cut from ``text``. White space before a kept word stays;
    documents that lose nothing stay as they are, and those that lose all words have an empty text."""
    plain, inner, schema = c.carried(docs)

    def cut(t: pa.Table, gone: np.ndarray, first: np.ndarray) -> pa.Table:
        data, off = c.utf8(t["text"])
        texts = t["text"].to_pylist()
        lose = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(gone)])[first]))
        for i in lose:
            body = data[off[i] : off[i + 1]]
            _, _, s, e = next(c.runs(body, np.array([0, len(body)]), ~c.SPACE))
            keep = np.flatnonzero(~gone[first[i] : first[i + 1]])
            before = np.concatenate([[0], e])
            raw = body.tobytes()
            texts[i] = b"".join(raw[before[k] : e[k]] for k in keep).strip().decode()
        t = t.drop_columns(["block"]).set_column(1, "text", pa.array(texts, pa.string()))
        return t.set_column(0, "doc_id", t["doc_id"].cast(pa.int64()))

    return c.renamed(spans(plain, tuple(inner), window, cut, schema), docs)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(c.table(spark, sf_dir, "documents"))
