"""Quality rules with a modified Kneser-Ney model.

The model is over 2-grams of words, one for each language and half of the documents (by a hash of the text, so exact
copies share a half); a document is scored by the half that it isn't in, so its own words don't explain it. Words are
known by BITS of their hash. A gram that the half doesn't hold backs off, and a word that it doesn't hold is of the
unknown class, which has the uniform share of what the words' discounts leave.

Everything is sorted hash arrays, cut into ranges; a range is what one reducer holds:

1. each chunk of documents (CHUNK bytes of text, in the order of the scan) sends its distinct grams once, with their
   counts in either half;
2. a range of grams adds the chunks' counts up, and sends for each word in front what follows it (how often, and how many
   grams of count 1, 2 and more), and for each word behind how many different words stand in front of it;
3. a range of words adds these up over all ranges of grams and sends the sums back; counts of counts, from which the
   discounts come, are a few numbers for each language;
4. each range of grams makes the probabilities and answers every chunk: surprise in STEPS of a bit, one for each gram of
   the chunk and half that has it;
5. the chunks' documents, which travel as numbers of words in a list of the chunk's words, are scored by binary search.

Distinct grams, and what is counted, shuffled and scored, grow with the input; no model is broadcast. A chunk is named by
its place in the scan, so documents that don't come straight from files are written to the shared folder first.

A document is rejected if its mean surprise (bits a word) lies outside its language's band, which are the quantiles LOW and
HIGH of all its language's documents that pass the base rules, exact to BIN of a bit; or by the base rules: under 50
words, or over half of the words in repeated 3-word windows.

Defined cases: null and empty texts have no words and fail; a null language is a language of its own; texts of one word
have no 2-gram and no surprise, and only the base rules count; equal rows have equal results, each its own; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import common as c

MIN_WORDS = 50
MAX_REPEAT = 50
#: Shares of a language's documents that pass the base rules below and up to the band.
LOW, HIGH = 0.01, 0.95
BIN = 0.01
#: Bits of a word's hash, and text bytes of a chunk.
BITS = 22
CHUNK = 12 << 20
STEPS = 8
_BITS = np.uint64(BITS)
_WORD = np.uint64((1 << BITS) - 1)
_GRAM = np.uint64((1 << 2 * BITS) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F5, 0xBF58476D1CD)]
_EVEN = [np.uint64(pow(int(x), -1, 1 << 2 * BITS)) for x in _ODD]
KEYS = "bucket int, block long, lang string, keys binary, counts binary"
STATS = "part int, bucket int, lang string, kind int, words binary, counts binary"
#: kind 0: contexts, 1: words behind; 2 and 3: counts of counts of grams and of words behind, which have no bucket.
SUMS = "bucket int, lang string, kind int, part int, counts binary, " + ", ".join(f"c{i} long" for i in range(12))
TOLD = "block long, lang string, bucket int, one binary, two binary"
BODY = "block long, docs binary, words binary, vocabulary binary"
SCORED = "doc_id long, at long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, surprise double"
_C = [f"c{i}" for i in range(12)]


def scatter(g: np.ndarray) -> np.ndarray:
    """A bijection of grams, so that ranges of it are even."""
    h = g * _ODD[0] & _GRAM
    h ^= h >> _BITS
    h = h * _ODD[1] & _GRAM
    return h ^ (h >> _BITS)


def gather(h: np.ndarray) -> np.ndarray:
    """What scatter() made h from."""
    h = h ^ (h >> _BITS)
    h = h * _EVEN[1] & _GRAM
    h ^= h >> _BITS
    return h * _EVEN[0] & _GRAM


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number below 2**BITS for every word, and where each document's words begin."""
    out, counts = [], np.zeros(len(off), np.int64)
    for i, j, s, e in c.runs(data, off, ~c.SPACE):
        lo = int(off[i])
        pre = c.prefix(c.BYTE_CODE[data[lo : int(off[j])]])
        _, down = c.powers(len(pre))
        out.append((c.mix((pre[e - lo] - pre[s - lo]) * down[s - lo]) >> np.uint64(64 - BITS)).astype(np.uint32))
        counts[i + 1 : j + 1] = np.diff(np.searchsorted(s, off[i : j + 1]))
    return np.concatenate(out) if out else np.zeros(0, np.uint32), np.cumsum(counts)


def grams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of neighbours of one document, scattered; and its document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[1:] == doc[:-1])
    return scatter(words[at].astype(np.uint64) << _BITS | words[at + 1].astype(np.uint64)), doc[at]


def distinct(h: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams, and how often each half has them (two columns)."""
    u, n = np.unique(h << np.uint64(1) | side, return_counts=True)
    k = u >> np.uint64(1)
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    counts = np.zeros((int(new.sum()), 2), np.int64)
    counts[np.cumsum(new) - 1, (u & np.uint64(1)).astype(np.int64)] = n
    return k[new], counts


def _cut(keys: np.ndarray, n: int, bits: int) -> list[int]:
    """Where sorted keys of so many bits pass from one of n equal ranges to the next."""
    width = -(-(1 << bits) // n)
    return np.searchsorted(keys, np.arange(n, dtype=np.uint64) * np.uint64(width)).tolist() + [len(keys)]


_NAMES = np.random.default_rng(5).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _pack(values: np.ndarray) -> bytes:
    """Rows of whole numbers, as numbers in a list of the distinct rows, the most frequent first."""
    name = (values.astype(np.uint64) * _NAMES[: values.shape[1]]).sum(1, dtype=np.uint64)
    _, first, inv, n = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    by = np.argsort(-n, kind="stable")
    rows = values[first[by]].astype(np.int64)
    number = np.empty(len(by), np.uint32)
    number[by] = np.arange(len(by), dtype=np.uint32)
    if not (rows[number[inv]] == values).all():  # two rows of one name
        rows, number, inv = values.astype(np.int64), np.arange(len(values), dtype=np.uint32), slice(None)
    head = c.pack_any(rows.reshape(-1))
    return len(head).to_bytes(8, "little") + head + c.pack_any(number[inv])


def _unpack(body: bytes, columns: int) -> np.ndarray:
    end = 8 + int.from_bytes(body[:8], "little")
    return c.unpack_any(body[8:end]).reshape(-1, columns)[c.unpack_any(body[end:])]


def _by_lang(langs: list[str | None]) -> list[tuple[str | None, np.ndarray]]:
    where: dict[str | None, list[int]] = {}
    for i, x in enumerate(langs):
        where.setdefault(x, []).append(i)
    return [(x, np.array(i)) for x, i in where.items()]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(x, types[t]) for x, (_, t) in zip(cols, fields, strict=True)], [f for f, _ in fields])


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[int, pa.Table]]:
    """Rows of about ``size`` bytes of text (column 0), and the chunk's number: first by partition, then in its order."""
    held, total, number = [], 0, TaskContext.get().partitionId() << 24
    for b in batches:
        _, off = c.utf8(b.column(0))
        for i, j in c.cuts(off, size):
            held.append(b.slice(i, j - i))
            total += int(off[j] - off[i])
            if total >= size // 2:
                yield number, pa.Table.from_batches(held)
                held, total, number = [], 0, number + 1
    if held:
        yield number, pa.Table.from_batches(held)


def _send(n: int):
    """Step 1, over text, lang and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in chunks(batches):
            h, doc = grams(*words_of(*c.utf8(t.column(0))))
            rows, side = [], t.column(2).to_numpy().astype(np.uint64)
            for lang, k, counts in _lists(h, doc, t.column(1).to_pylist(), side):
                at = _cut(k, n, 2 * BITS)
                rows += [(b, block, lang, c.pack(k[s:e]), _pack(counts[s:e])) for b, (s, e) in enumerate(zip(at, at[1:], strict=False)) if e > s]
            yield from _table(rows, KEYS).to_batches()
            c.trim()

    return run


def _lists(h: np.ndarray, doc: np.ndarray, langs: list[str | None], side: np.ndarray) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """The distinct grams of each language of a chunk."""
    for lang, rows in _by_lang(langs):
        own = np.zeros(len(langs), bool)
        own[rows] = True
        at = own[doc]
        yield lang, *distinct(h[at], side[doc[at]])


def _merged(t: pa.Table) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Of a range's rows of each language: places, grams, counts in both halves; and the lists that they came from."""
    keys, counts = t["keys"].to_pylist(), t["counts"].to_pylist()
    for lang, rows in _by_lang(t["lang"].to_pylist()):
        lists, own = [c.unpack(keys[i]) for i in rows], [_unpack(counts[i], 2) for i in rows]
        order, first = c.grouped(np.concatenate(lists))
        total = np.add.reduceat(np.concatenate(own)[order], first)
        yield lang, rows, np.concatenate(lists)[order[first]], total, lists, own


def _of_counts(n: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4 and above 2, and the sum."""
    return [*(int(np.count_nonzero(n == i)) for i in (1, 2, 3, 4)), int(np.count_nonzero(n > 2)), int(n.sum())]


def _contexts(keys: np.ndarray, n: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
    """Of the words in front and behind: sorted distinct words, counts (of both halves), and each gram's place in them."""
    g = gather(keys)
    v, at = np.unique(g >> _BITS, return_inverse=True)
    front = [np.bincount(at, x, len(v)) for s in (0, 1) for x in (n[:, s], n[:, s] == 1, n[:, s] == 2, n[:, s] > 2)]
    w, to = np.unique(g & _WORD, return_inverse=True)
    back = [np.bincount(to, n[:, s] > 0, len(w)) for s in (0, 1)]
    return (v, np.stack(front, 1).astype(np.int64), at), (w, np.stack(back, 1).astype(np.int64), to)


def _stats(n: int):
    """Step 2."""

    def run(t: pa.Table) -> pa.Table:
        rows, bucket = [], t["bucket"][0].as_py()
        for lang, _, keys, total, _, _ in _merged(t):
            for kind, (words, counts, _) in enumerate(_contexts(keys, total)):
                at = _cut(words, n, BITS)
                rows += [(p, bucket, lang, kind, c.pack(words[s:e]), _pack(counts[s:e])) for p, (s, e) in enumerate(zip(at, at[1:], strict=False)) if e > s]
            rows.append((bucket, -1, lang, 2, b"", _pack(np.array([_of_counts(total[:, 0]) + _of_counts(total[:, 1])]))))
        return _table(rows, STATS)

    return run


def _sums(t: pa.Table) -> pa.Table:
    """Step 3."""
    out, part = [], t["part"][0].as_py()
    bucket, words, counts = t["bucket"].to_pylist(), t["words"].to_pylist(), t["counts"].to_pylist()
    groups = list(zip(t["lang"].to_pylist(), t["kind"].to_pylist(), strict=True))
    for (lang, kind), rows in _by_lang(groups):
        if kind == 2:
            total = sum(_unpack(counts[i], 12) for i in rows)[0]
            out.append((None, lang, 2, part, None, *total.tolist()))
            continue
        lists, own = [c.unpack(words[i]) for i in rows], [_unpack(counts[i], 2 if kind else 8) for i in rows]
        order, first = c.grouped(np.concatenate(lists))
        total = np.add.reduceat(np.concatenate(own)[order], first)
        place = c.spread(np.arange(len(first)), order, first)
        out += [(bucket[i], lang, kind, part, _pack(total[p]), *[None] * 12) for i, p in zip(rows, c.split_lists(place, lists), strict=True)]
        if kind:
            out.append((None, lang, 3, part, None, *_of_counts(total[:, 0]), *_of_counts(total[:, 1])))
    return _table(out, SUMS)


def discounts(k: np.ndarray) -> np.ndarray:
    """For counts of 1, 2 and more, from how many counts are 1, 2, 3 and 4; kept off 0 and the count itself."""
    y = k[0] / (k[0] + 2 * k[1]) if k[0] + k[1] else 0.5
    return np.array([np.clip(i - (i + 1) * y * (k[i] / k[i - 1]) if k[i - 1] else i, 0.05 * i, 0.95 * i) for i in (1, 2, 3)])


def probabilities(n: np.ndarray, front: np.ndarray, back: np.ndarray, of_grams: np.ndarray, of_words: np.ndarray) -> np.ndarray:
    """Of grams with count n, whose word in front has the counts front (sum, ones, twos, more) and whose word behind stands
    behind ``back`` different words; with the counts of counts of either."""
    d, e = discounts(of_grams), discounts(of_words)
    total = max(float(of_words[5]), 1.0)
    left = (of_words[[0, 1, 4]] @ e) / total if of_words[5] else 1.0
    p = np.where(back > 0, back - e[np.clip(back, 1, 3) - 1], 0) / total + left / (1 << BITS)
    sums = np.maximum(front[:, 0], 1)
    rest = np.where(front[:, 0] > 0, (front[:, 1:] @ d) / sums, 1.0)
    return np.where(n > 0, n - d[np.clip(n, 1, 3) - 1], 0) / sums + rest * p


def _answer(t: pa.Table, sums: pa.Table) -> pa.Table:
    """Step 4."""
    out = []
    if not t.num_rows:
        return _table(out, TOLD)
    bucket, block = t["bucket"][0].as_py(), t["block"].to_pylist()
    sums = sums.sort_by("part")
    known = dict(_by_lang(list(zip(sums["lang"].to_pylist(), sums["kind"].to_pylist(), strict=True))))
    body, numbers = sums["counts"].to_pylist(), np.stack([sums[x].fill_null(0).to_numpy() for x in _C], 1)
    for lang, rows, keys, total, lists, own in _merged(t):
        (_, _, at), (_, _, to) = _contexts(keys, total)
        front = np.concatenate([_unpack(body[i], 8) for i in known[lang, 0]])[at]
        back = np.concatenate([_unpack(body[i], 2) for i in known[lang, 1]])[to]
        bits = []
        for s in (0, 1):
            g, w = (numbers[known[lang, k]].sum(0)[6 * s : 6 * s + 6] for k in (2, 3))
            p = probabilities(total[:, s], front[:, 4 * s : 4 * s + 4], back[:, s], g, w)
            bits.append(np.round(-STEPS * np.log2(p)).astype(np.uint16))
        for i, k, n in zip(rows, lists, own, strict=True):
            place = np.searchsorted(keys, k)
            out.append((block[i], lang, bucket, *(c.pack_any(bits[1 - s][place[n[:, s] > 0]]) for s in (0, 1))))
    return _table(out, TOLD)


def base_rules(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = text.translate(None, b" \t\n\r\x0b\x0c" + bytes(range(128, 192)))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeat = 0
    if len(ids) >= 3 and len(number) < len(ids):
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, inv, n = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = n[inv] > 1
        inside = np.zeros(len(ids), bool)
        for k in range(3):
            inside[k : len(ids) - 2 + k] |= twice
        repeat = int(inside.sum())
    return len(words), len(chars), len(text) - len(text.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeat


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks' documents, over text, lang, side, doc_id and at, without their texts."""
    for block, t in chunks(batches):
        data, off = c.utf8(t.column(0))
        words, first = words_of(data, off)
        u, inv, n = np.unique(words, return_inverse=True, return_counts=True)
        by = np.argsort(-n, kind="stable")  # frequent words have small numbers
        number = np.empty(len(u), np.uint32)
        number[by] = np.arange(len(u), dtype=np.uint32)
        base = np.array([base_rules(data[s:e].tobytes()) for s, e in zip(off, off[1:], strict=False)], np.int64).reshape(-1, 5)
        docs = pa.table([t.column(3).cast(pa.int64()), t.column(4), t.column(1).cast(pa.string()), t.column(2).cast(pa.int64()), *base.T, np.diff(first)], ["doc_id", "at", "lang", "side", *(x.split()[0] for x in SCORED.split(", ")[3:8]), "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(docs)
        yield from _table([(block, sink.getvalue().to_pybytes(), c.pack_any(number[inv]), c.pack_any(u[by]))], BODY).to_batches()
        c.trim()


def _score(bodies: pa.Table, told: pa.Table) -> pa.Table:
    """Step 5."""
    if told.num_rows and not bodies.num_rows:
        raise ValueError("the documents' order isn't the same in both scans")
    parts = [_scored(bodies.slice(i, 1), told) for i in range(bodies.num_rows)]
    return pa.concat_tables(parts) if parts else _table([], SCORED)


def _scored(body: pa.Table, told: pa.Table) -> pa.Table:
    docs = pa.ipc.open_stream(body["docs"][0].as_py()).read_all()
    words = c.unpack_any(body["vocabulary"][0].as_py())[c.unpack_any(body["words"][0].as_py())]
    n = docs["n"].to_numpy()
    h, doc = grams(words, np.concatenate([[0], np.cumsum(n)]))
    side, langs = docs["side"].to_numpy(), docs["lang"].to_pylist()
    told = told.sort_by("bucket")
    lists = dict(_by_lang(told["lang"].to_pylist()))
    bits = np.zeros(len(h))
    one, two = told["one"].to_pylist(), told["two"].to_pylist()
    for lang, keys, counts in _lists(h, doc, langs, side.astype(np.uint64)):
        if not len(keys):
            continue
        for s, answers in enumerate((one, two)):
            value = np.zeros(len(keys))
            value[counts[:, s] > 0] = np.concatenate([c.unpack_any(answers[i]) for i in lists[lang]])
            own = np.array([x == lang for x in langs]) & (side == s)
            at = own[doc]
            bits[at] = value[np.searchsorted(keys, h[at])]
    some = np.bincount(doc, minlength=len(n))
    s = np.bincount(doc, bits, len(n)) / np.maximum(some, 1) / STEPS
    out = docs.select([x.split()[0] for x in SCORED.split(", ")[:-1]])
    return out.append_column("surprise", pa.array(s, pa.float64(), mask=some == 0))


def scanned(docs: DataFrame) -> DataFrame:
    """docs, if its rows come straight from files, so that their order is the same each time; else written to some."""
    plan, kinds = [docs._jdf.queryExecution().optimizedPlan()], set()
    while plan:
        p = plan.pop()
        kinds.add(p.nodeName().split(" ")[0])
        children = p.children()
        plan += [children.apply(i) for i in range(children.size())]
    return docs if kinds <= {"Project", "Filter", "Relation", "LogicalRelation"} else c.stored(docs)


def scores(docs: DataFrame) -> DataFrame:
    """A row of SCORED for every document (columns doc_id, text, lang)."""
    docs = scanned(docs.select("text", "lang", F.col("doc_id").cast("long").alias("doc_id")))
    n = c.count_blocks(docs)
    rows = docs.select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(2)).alias("side"), "doc_id", c.row_key().alias("at"))
    sent = rows.select("text", "lang", "side").mapInArrow(_send(n), KEYS)
    stats = sent.groupBy("bucket").applyInArrow(c.tidy(_stats(n)), STATS)
    sums = stats.groupBy("part").applyInArrow(c.tidy(_sums), SUMS)
    totals = sums.where("kind > 1").groupBy("lang", "kind").agg(*(F.sum(x).alias(x) for x in _C))
    every = totals.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"), "lang", "kind", F.lit(0).alias("part"), F.lit(None).cast("binary").alias("counts"), *_C)
    heard = sums.where("kind < 2").unionAll(every)
    told = c.stored(sent.groupBy("bucket").cogroup(heard.groupBy("bucket")).applyInArrow(c.tidy(_answer), TOLD))
    bodies = rows.mapInArrow(_bodies, BODY)
    return bodies.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(c.tidy(_score), SCORED)


def bands(scored: DataFrame) -> DataFrame:
    """lang, low and high (in BINs) of every language, from all its documents that pass the base rules."""
    bins = scored.where(~_failed() & F.col("surprise").isNotNull()).groupBy("lang", _bin().alias("bin")).agg(F.count("*").alias("n"))
    w = W.partitionBy("lang").orderBy("bin")  # at most some thousand bins a language
    share = bins.select("lang", "bin", (F.sum("n").over(w) / F.sum("n").over(W.partitionBy("lang"))).alias("upto"))
    return share.groupBy("lang").agg(F.min(F.when(F.col("upto") >= LOW, F.col("bin"))).alias("low"), F.min(F.when(F.col("upto") >= HIGH, F.col("bin"))).alias("high"))


def _bin() -> F.Column:
    return F.round(F.col("surprise") / BIN).cast("long")


def _failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def verdicts(docs: DataFrame) -> DataFrame:
    """The scores, base_failed and kept of every document."""
    scored = c.stored(scores(docs))
    fine = F.coalesce(_bin().between(F.col("r.low"), F.col("r.high")), F.lit(True))
    return scored.alias("l").join(bands(scored).alias("r"), F.col("l.lang").eqNullSafe(F.col("r.lang")), "left").select("l.*", _failed().alias("base_failed"), (~_failed() & fine).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents, every column kept, that no rule rejects."""
    return c.without(docs, verdicts(docs).where("not kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(c.table(spark, sf_dir, "documents"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "surprise")
