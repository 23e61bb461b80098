"""Exact byte-level dedup: every byte covered by a 400-byte string that also starts elsewhere goes.

Each 400-byte window is named by its anchor: the 64-byte string in it with the smallest hash. Equal windows have equal
anchors at equal offsets, so only anchors that occur twice need a closer look; then stretches around those anchors
decide, in three rounds of the census over the same blocks of documents:

1. anchors: how often does each occur? (about one in 170 bytes is an anchor);
2. pieces: the offsets of an anchor's windows fall into 9 ranges; a range's *core* lies in all of its windows, its
   *hull* holds all of them. A core that occurs once ends the matter, a hull that occurs twice settles it;
3. windows: those of the ranges in between, by their own hashes.

Defined cases: null and empty texts, and texts under 400 bytes, lose nothing; rows with equal or null doc_id are
different places; an empty table gives an empty result; further columns are ignored. Strings are compared by 64-bit
hashes of which only those around shared anchors are ever compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common as c

LENGTH = 400
ANCHOR = 64
PIECE = 42
_LOW = np.uint64(0xFFFFFFFF)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n neighbours, by doubling."""
    k = 1
    while 2 * k <= n:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def _tally(keys: np.ndarray, extra: list[np.ndarray], owner: np.ndarray) -> list[np.ndarray]:
    """A tell() that adds up the counts of all blocks."""
    order, first = c.grouped(keys)
    n = np.add.reduceat(np.concatenate(extra)[order].astype(np.int64), first)
    return c.split_lists(c.spread(np.minimum(n, 2**32 - 1).astype(np.uint32), order, first), extra)


class Block:
    """The anchors of a block's texts, and their stretches' hashes."""

    def __init__(self, t: pa.Table, length: int):
        self.length, self.reach = length, length - ANCHOR
        self.data, self.off = c.utf8(t["text"])
        self.docs = np.flatnonzero(np.diff(self.off) >= length).tolist()
        parts = []
        for d in self.docs:
            h = self.hashes(d)[1]
            key = h & ~_LOW | np.arange(len(h), dtype=np.uint64)
            p = (sliding_min(key, self.reach + 1) & _LOW).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            parts.append((h[p[start]], np.full(len(start), d), p[start], start, np.append(start[1:], len(p)) - 1))
        cols = list(zip(*parts, strict=True)) if parts else [[np.zeros(0, k)] for k in ("u8", "i8", "i8", "i8", "i8")]
        #: Of each anchor: hash, document, place, and the first and last start of its windows.
        self.hash, self.doc, self.place, self.low, self.high = (np.concatenate(x) for x in cols)

    def hashes(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        pre = c.prefix(c.BYTE_CODE[self.data[self.off[d] : self.off[d + 1]]])
        _, down = c.powers(len(pre))
        return pre, c.mix((pre[ANCHOR:] - pre[:-ANCHOR]) * down[: len(pre) - ANCHOR] + np.uint64(ANCHOR))

    def shared(self, heard: dict[int, np.ndarray]) -> np.ndarray:
        order, first = c.grouped(self.hash)
        return c.spread(heard[1], order, first) > 1 if len(first) else np.zeros(0, bool)

    def pieces(self, heard: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Of the ranges of shared anchors: document, first and last window start, key of the core and of the hull (0: none)."""
        some = np.flatnonzero(self.shared(heard))
        doc, place, low, high = (x[some] for x in (self.doc, self.place, self.low, self.high))
        n = len(self.data) and self.reach // PIECE + 1
        out = []
        for k in range(n):
            s, e = np.maximum(low, place - k * PIECE - PIECE + 1), np.minimum(high, place - k * PIECE)
            at = np.flatnonzero(s <= e)
            out.append((at, doc[at], s[at], e[at], place[at] - k * PIECE, np.full(len(at), k)))
        if not out:
            return tuple(np.zeros(0, k) for k in ("i8", "i8", "i8", "u8", "u8"))
        at, doc, s, e, edge, k = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(doc, kind="stable")
        doc, s, e, edge, k = (x[order] for x in (doc, s, e, edge, k))
        core, hull = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else [0]
        for i, j in zip(cuts, cuts[1:], strict=False):
            pre = c.prefix(c.BYTE_CODE[self.data[self.off[doc[i]] : self.off[doc[i] + 1]]])
            core[i:j] = c.mix(c.stretch(pre, edge[i:j], edge[i:j] - PIECE + 1 + self.length) + (2 * k[i:j]).astype(np.uint64))
            a, b = edge[i:j] - PIECE + 1, edge[i:j] + self.length
            ok = (a >= 0) & (b < len(pre))
            hull[i:j][ok] = c.mix(c.stretch(pre, a[ok], b[ok]) + (2 * k[i:j][ok] + 1).astype(np.uint64)) | np.uint64(1)
        return doc, s, e, core, hull

    def settle(self, heard: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Document, first and last start of the ranges that are settled; and of those whose windows must be looked at."""
        doc, s, e, core, hull = self.pieces(heard)
        order, first = c.grouped(np.concatenate([core, hull]))
        if not len(first):
            return (doc, s, e), (doc, s, e)
        n = c.spread(heard[2], order, first)
        n_core, n_hull = n[: len(core)], np.where(hull == 0, 0, n[len(core) :])
        done, look = n_hull > 1, (n_core > 1) & (n_core != n_hull)
        return (doc[done], s[done], e[done]), (doc[look], s[look], e[look])

    def windows(self, look: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and hash of all windows of the given ranges."""
        doc, s, e = look
        size = e - s + 1
        starts = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)
        doc = np.repeat(doc, size)
        h = np.zeros(len(doc), np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else [0]
        for i, j in zip(cuts, cuts[1:], strict=False):
            pre = c.prefix(c.BYTE_CODE[self.data[self.off[doc[i]] : self.off[doc[i] + 1]]])
            h[i:j] = c.stretch(pre, starts[i:j], starts[i:j] + self.length)
        return doc, starts, h


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.unique(keys, return_counts=True)
    return u, n.astype(np.uint32)


def _anchors(length: int):
    return lambda t, heard: _count(Block(t, length).hash)


def _pieces(length: int):
    def ask(t: pa.Table, heard: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        _, _, _, core, hull = Block(t, length).pieces(heard)
        return _count(np.concatenate([core, hull]))

    return ask


def _windows(length: int):
    def ask(t: pa.Table, heard: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        block = Block(t, length)
        return _count(block.windows(block.settle(heard)[1])[2])

    return ask


def _covered(t: pa.Table, heard: dict[int, np.ndarray], length: int) -> tuple[Block, np.ndarray]:
    """Whether each byte of the block goes."""
    block = Block(t, length)
    gone = np.zeros(len(block.data) + 1, np.int32)
    (doc, s, e), look = block.settle(heard)
    np.add.at(gone, block.off[doc] + s, 1)
    np.add.at(gone, block.off[doc] + e + length, -1)
    doc, at, h = block.windows(look)
    order, first = c.grouped(h)
    if len(first):
        twice = c.spread(heard[3], order, first) > 1
        np.add.at(gone, block.off[doc[twice]] + at[twice], 1)
        np.add.at(gone, block.off[doc[twice]] + at[twice] + length, -1)
    return block, np.cumsum(gone[:-1]) > 0


def _edges(gone: np.ndarray) -> tuple[list[int], list[int]]:
    """Where maximal removed runs of a text start and end."""
    step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()


def _digest(t: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
    removed, spans, sums = [], [], []
    for s, e in zip(block.off.tolist(), block.off[1:].tolist(), strict=False):
        g, text = gone[s:e], block.data[s:e]
        n = int(np.count_nonzero(g))
        removed.append(n)
        spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + bool(g[0]) if n else 0)
        sums.append(hashlib.sha256(text[~g] if n else text).hexdigest())
    return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "n_bytes": np.diff(block.off), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sums, pa.string())})


def _listed(t: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
    owner, first, last = [], [], []
    for d in block.docs:
        s, e = _edges(gone[block.off[d] : block.off[d + 1]])
        owner += [d] * len(s)
        first += s
        last += e
    at = pa.array(owner, pa.int64())
    return pa.table({"doc_id": t["doc_id"].cast(pa.int64()).take(at), "at": t["at"].take(at), "start": pa.array(first, pa.int64()), "end": pa.array(last, pa.int64())})


def _cut(t: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
    texts = t["text"].to_pylist()
    for d in block.docs:
        g = gone[block.off[d] : block.off[d + 1]]
        if g.any():
            texts[d] = block.data[block.off[d] : block.off[d + 1]][~g].tobytes().decode(errors="ignore")
    t = t.drop_columns(["block"]).set_column(1, "text", pa.array(texts, pa.string()))
    return t.set_column(0, "doc_id", t["doc_id"].cast(pa.int64()))


def _rounds(docs: DataFrame, columns: tuple[str, ...], length: int, finish, schema: str) -> DataFrame:
    """The three rounds; finish(a block's rows, its Block, which bytes go) makes the rows of ``schema``."""
    n = c.count_blocks(docs)
    docs = c.in_blocks(docs, n, *columns)
    one = c.census(docs, n, 1, _anchors(length), _tally)
    two = c.census(docs, n, 2, _pieces(length), _tally, one)
    three = c.census(docs, n, 3, _windows(length), _tally, one.unionAll(two))
    told = one.unionAll(two).unionAll(three)
    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(c.tidy(lambda t, a: finish(t, *_covered(t, c.answers(a), length))), schema)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text)."""
    return _rounds(docs, (), length, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, at (the row's key, for ids that repeat), start and end (in bytes of the text) of every maximal removed run."""
    return _rounds(docs.select("doc_id", "text", c.row_key().alias("at")), ("at",), length, _listed, "doc_id long, at long, start long, end long")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, every column kept, without the repeated bytes; what a cut leaves of a character goes with it.
    Documents that lose nothing stay as they are, null texts too; those that lose all have an empty text."""
    plain, inner, schema = c.carried(docs)
    return c.renamed(_rounds(plain, tuple(inner), length, _cut, schema), docs)


def _bodies(t: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
    rows = _listed(t, block, gone)
    first = {(i, a): k for k, (i, a) in enumerate(zip(t["doc_id"].to_pylist(), t["at"].to_pylist(), strict=True))}
    body, left = [], []
    for r in rows.to_pylist():
        o = int(block.off[first[r["doc_id"], r["at"]]])
        body.append(block.data[o + r["start"] : o + r["end"]].tobytes())
        left.append(int(block.data[o + r["start"] - 1]) if r["start"] else -1)
    names = [hashlib.blake2b(x, digest_size=16).digest() for x in body]
    return rows.drop_columns(["end"]).append_column("name", pa.array(names, pa.binary())).append_column("left", pa.array(left, pa.int32())).append_column("body", pa.array(body, pa.binary()))


def _starts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of every window of the bodies: its start, its hash, and the byte before it (-1: before the first one there are several, or none)."""
    for b in batches:
        for name, left, body in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            data = np.frombuffer(body, np.uint8)
            at = np.arange(len(data) - length + 1)
            h = c.stretch(c.prefix(c.BYTE_CODE[data]), at, at + length)
            before = np.concatenate([[left], data[: len(at) - 1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(before)], ["name", "p", "hash", "before"])
        c.trim()


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))
    return int(differ[0]) if len(differ) else n


def maximal(suffixes: list[bytes], before: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the intervals of sorted suffixes that share at least ``length`` bytes and are preceded
    by different ones. The stack holds the open intervals: prefix, first suffix, smallest and largest byte before."""
    wide = lambda x: (-1, 256) if x < 0 else (x, x)
    stack = [[0, 0, 256, -1]]
    for i in range(1, len(suffixes) + 1):
        lcp = shared_prefix(suffixes[i - 1], suffixes[i]) if i < len(suffixes) else 0
        start, (low, high) = i - 1, wide(before[i - 1])
        while stack[-1][0] > lcp:
            depth, start, a, b = stack.pop()
            low, high = min(low, a), max(high, b)
            if depth >= length and low < high:
                yield depth, start, i - 1
        if stack[-1][0] < lcp:
            stack.append([lcp, start, low, high])
        else:
            stack[-1][2:] = min(low, stack[-1][2]), max(high, stack[-1][3])


def _tree(t: pa.Table, length: int) -> pa.Table:
    rows = []
    for name, n, places, body in zip(*(t[k].to_pylist() for k in ("name", "n", "places", "body")), strict=True):
        for x in places:
            rows += [(body[x["p"] :], name, x["p"], x["before"])] * min(n, 2)
    rows.sort(key=lambda r: r[:3])
    out = []
    for depth, first, last in maximal([r[0] for r in rows], [r[3] for r in rows], length):
        key = hashlib.blake2b(rows[first][0][:depth], digest_size=16).hexdigest()
        out += [(key, depth, name, p) for name, p in sorted({r[1:3] for r in rows[first : last + 1]})]
    return pa.table({k: pa.array([r[i] for r in out], kind) for i, (k, kind) in enumerate((("repeat", pa.string()), ("length", pa.int64()), ("name", pa.binary()), ("p", pa.int32())))})


def groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Maximal repeats of at least ``length`` bytes with all their occurrences: repeat (names its bytes), length, doc_id, at (the
    row's key) and start. A repeat is maximal if no byte before or behind it is the same at all its places; places overlap.

    Every such repeat lies inside removed runs. Equal runs are one body, however many documents hold it; suffixes of bodies
    that start with the same window, if different bytes stand before it, are sorted, and their common prefixes scanned with
    a stack: each interval of the tree is a repeat if what precedes it differs. One task holds the *different* bodies with a
    window, so a passage is there once for each way it goes on inside removed text, not once for each document; where
    these ways grow with the corpus, so does that task, and a long text of one period costs the square of its length.
    No registered query runs this."""
    runs = c.stored(_rounds(docs.select("doc_id", "text", c.row_key().alias("at")), ("at",), length, _bodies, "doc_id long, at long, start long, name binary, left int, body binary"))
    bodies = c.stored(runs.groupBy("name").agg(F.count("*").alias("n"), F.min("left").alias("left"), F.first("body").alias("body")))
    places = bodies.select("name", F.when(F.col("n") > 1, -1).otherwise(F.col("left")).alias("left"), "body").mapInArrow(lambda it: _starts(it, length), "name binary, p int, hash long, before int")
    differ = places.groupBy("hash").agg(F.min("before").alias("low"), F.max("before").alias("high")).where("low < high or low < 0").select("hash")
    found = places.join(differ, "hash", "left_semi").groupBy("hash", "name").agg(F.collect_list(F.struct("p", "before")).alias("places"))
    trees = found.join(bodies.select("name", "n", "body"), "name").groupBy("hash").applyInArrow(c.tidy(lambda t: _tree(t, length)), "repeat string, length long, name binary, p int")
    return trees.join(runs.select("name", "doc_id", "at", "start"), "name").select("repeat", "length", "doc_id", "at", (F.col("start") + F.col("p")).alias("start"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(c.table(spark, sf_dir, "documents"))
