"""Byte-pair encoding over a pair occurrence index.

The distinct pre-tokens of a batch lie in one array of symbols with links to their neighbours. An index maps each
merge rank to all places where its pair stands; ranks are taken in ascending order from a heap, all places of a rank
merge in one numpy step, and only the lists of the pairs that this makes or breaks change. Pre-tokens don't touch each
other, so the order over all of them gives each the same result as encoding it alone.

``encode`` and ``decode`` are the operator; ``op9_bpe_round_trip`` digests both. Null and empty texts have no tokens;
strings of special tokens inside a text become those tokens, as the library does by default.

Defined cases of the query besides: equal rows have equal results, each its own; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from lodestone.llm import common as c

#: Tokenizer files are sent to the executors; a larger one is refused.
MAX_FILE = 32 << 20
CHUNK = 24 << 20
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: The two pre-tokenizers' patterns, where every character is below U+0100.
BYTE_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = count(256)
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """A byte-level BPE model read from a tokenizer file's text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        assert model["type"] == "BPE" and not model["continuing_subword_prefix"] and not model["dropout"] and not model["ignore_merges"]
        self.vocab: dict[str, int] = model["vocab"]
        self.size = max(self.vocab.values()) + 1
        self.suffix = model["end_of_word_suffix"] or ""
        chars = byte_chars()
        self.first = np.array([self.vocab[x] for x in chars], np.int32)
        self.last = np.array([self.vocab[x + self.suffix] for x in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        key = self.left.astype(np.int64) * self.size + self.right
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.keys = key[self.order]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        back = {x: b for b, x in enumerate(chars)}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[x] for x in (s.removesuffix(self.suffix) if self.suffix else s)) for s, i in self.vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split = re.compile("|".join(f"({re.escape(s)})" for s in self.special)) if self.special else None
        self.library = Tokenizer.from_str(text)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's begin."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        sym = self.first[raw]
        full = sizes > 0
        sym[ends[full] - 1] = self.last[raw[ends[full] - 1]]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends[full] - 1] = -1
        prv[ends[full] - sizes[full]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(rank: np.ndarray, place: np.ndarray) -> None:
            known = rank >= 0
            rank, place = rank[known], place[known]
            if not len(rank):
                return
            if len(rank) == 1:
                groups = [(int(rank[0]), place)]
            else:
                o = np.argsort(rank, kind="stable")
                rank, place = rank[o], place[o]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                groups = zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(place, cuts), strict=True)
            for r, p in groups:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        i = np.flatnonzero(nxt >= 0).astype(np.int32)
        add(self.ranks(sym[i], sym[i + 1]), i)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            pos = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b, made = self.left[r], self.right[r], self.made[r]
            q = nxt[pos]
            ok = (sym[pos] == a) & (q >= 0) & (sym[q] == b)
            pos, q = pos[ok], q[ok]
            if not len(pos):
                continue
            if a == b:  # of a run of equal symbols, every other pair from the left
                fresh = np.concatenate([[True], pos[1:] != q[:-1]])
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
                ok = (np.arange(len(pos)) - start) % 2 == 0
                pos, q = pos[ok], q[ok]
            after = nxt[q]
            sym[pos], sym[q], nxt[pos] = made, -1, after
            more = after >= 0
            prv[after[more]] = pos[more]
            before = prv[pos]
            has = before >= 0
            left, right = before[has], pos[more]
            add(self.ranks(np.concatenate([sym[left], sym[right]]), np.concatenate([sym[pos[has]], sym[after[more]]])), np.concatenate([left, right]))
        alive = sym >= 0
        total = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], total[np.concatenate([[0], ends])]


_loaded: dict[int, Bpe] = {}


def broadcast(spark: SparkSession, path: str) -> Callable[[], Bpe]:
    """Sends a tokenizer file's text (of checked size) to the executors; there, call the result for the model."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_FILE + 1)
    if len(text) > MAX_FILE:
        raise ValueError(f"{path} has over {MAX_FILE} characters")
    sent = spark.sparkContext.broadcast(text)

    def model() -> Bpe:
        k = hash(sent.value)
        if k not in _loaded:
            _loaded.clear()
            _loaded[k] = Bpe(sent.value)
        return _loaded[k]

    return model


def narrow(text: str) -> bool:
    return text.isascii() or max(text) < "Ā"


def byte_words(bpe: Bpe, text: str) -> list[str]:
    """The library's byte-level pre-tokens, as parts of the text; special tokens whole."""
    parts = [text] if bpe.split is None or "<|" not in text else [x for x in bpe.split.split(text) if x]
    out: list[str] = []
    for part in parts:
        if part in bpe.special:
            out.append(part)
        elif narrow(part):
            out += BYTE_WORDS.findall(part)
        else:
            out += [part[s:e] for _, (s, e) in bpe.library.pre_tokenizer.pre_tokenize_str(part)]
    return out


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and whole texts (null: empty), up to about ``size`` bytes at a time."""
    for b in batches:
        _, off = c.utf8(b.column(1))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield b.column(0).slice(i, j - i), [x or "" for x in b.column(1).slice(i, j - i).to_pylist()]
            i = j


def encode_texts(bpe: Bpe, texts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """For each text the numbers of its pre-tokens; the ids of all distinct pre-tokens; where each one's begin."""
    number: dict[str, int] = defaultdict(count().__next__)
    placed = [list(map(number.__getitem__, byte_words(bpe, t))) for t in texts]
    words = list(number)
    ids, at = bpe.encode_words([b"" if w in bpe.special else w.encode() for w in words])
    for w, i in bpe.special.items():
        if w in number:  # an empty word so far
            k = number[w]
            ids = np.insert(ids, at[k], i)
            at[k + 1 :] += 1
    return placed, ids, at


def encode(df: DataFrame, path: str, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """id and ``ids`` (array of int) of every row."""
    model = broadcast(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches):
            placed, ids, at = encode_texts(model(), texts)
            flat = [np.concatenate([ids[at[w] : at[w + 1]] for w in p]) if p else ids[:0] for p in placed]
            yield pa.RecordBatch.from_arrays([keys, pa.array(flat, pa.list_(pa.int32()))], [id_column, "ids"])

    return df.select(id_column, column).mapInArrow(run, f"`{id_column}` {dict(df.dtypes)[id_column]}, ids array<int>")


def decode(df: DataFrame, path: str, id_column: str = "doc_id", column: str = "ids") -> DataFrame:
    """id and ``text`` of every row of ids; unknown ids give nothing, as in the library."""
    model = broadcast(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = model().bytes_of.get
            texts = [b"".join(get(i, b"") for i in x or ()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    return df.select(id_column, column).mapInArrow(run, f"`{id_column}` {dict(df.dtypes)[id_column]}, text string")


def digest(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the text decoded from them."""
    model = broadcast(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches):
            bpe = model()
            placed, ids, at = encode_texts(bpe, texts)
            listed, said = ids.tolist(), [str(i) for i in range(bpe.size + len(bpe.special))]
            spans = list(zip(at.tolist(), at[1:].tolist(), strict=False))
            strings = [",".join([said[i] for i in listed[s:e]]) for s, e in spans]
            get = bpe.bytes_of.__getitem__
            back = [b"".join([get(i) for i in listed[s:e]]) for s, e in spans]
            rows = []
            for p in placed:
                joined = ",".join(map(strings.__getitem__, p))
                text = b"".join(map(back.__getitem__, p)).decode("utf-8", "replace")
                rows.append((joined.count(",") + 1 if p else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(c.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
