"""What the operators of this subpackage share: blocks of documents, packed hash lists, word hashes, the census.

The census answers, for every key that a block of documents asks about, a small number that depends on all other
blocks (is it shared? is there a smaller document?). Each block sends its *distinct* keys once, as sorted and packed
lists cut by key range; a reducer for each range merges the lists and sends one byte a key back to each block. So a key
that a third of all rows hold costs one entry a block, not one a row, no list leaves the executors, and what a task
holds is one block or one range, both of bounded size at any input size.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one block of documents holds on average.
BLOCK_BYTES = 16 << 20
NO_ID = np.int64(2**63 - 1)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path in the cluster's shared checkpoint folder; tests without one get a folder of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = os.path.join(tempfile.gettempdir(), "lodestone-checkpoints")  # one machine: every task sees it
        sc.setCheckpointDir(path)
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


#: Lets a query's shuffle files go when the query ends, instead of when the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: the lineage ends there, and every executor sees it.
    What the writing shuffled is deleted behind it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove what stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def count_blocks(docs: DataFrame, column: str = "text", size: int = BLOCK_BYTES) -> int:
    """How many blocks of about ``size`` bytes the documents fill; one pass over one column. Small tables have smaller
    blocks, so that more than a few tasks share them."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return int(max(total // size, min(64, total // (size // 64)))) + 1


def in_blocks(docs: DataFrame, n: int, *columns: str) -> DataFrame:
    """doc_id, text and the given columns, with the block that each document falls in: by a hash, so blocks are even."""
    return docs.select("doc_id", "text", *columns, F.pmod(row_key(), F.lit(n)).cast("int").alias("block"))


def carried(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """doc_id, text and all other columns under names that clash with nothing; these names; and the schema as text."""
    others = [x for x in docs.columns if x not in ("doc_id", "text")]
    inner = [f"c{i}" for i in range(len(others))]
    types = dict(docs.dtypes)
    plain = docs.select("doc_id", "text", *(docs[f"`{x}`"].alias(y) for x, y in zip(others, inner, strict=True)))
    return plain, inner, ", ".join(["doc_id long", "text string", *(f"{y} {types[x]}" for x, y in zip(others, inner, strict=True))])


def renamed(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of carried(docs) with the columns of docs, in their order."""
    others = [x for x in docs.columns if x not in ("doc_id", "text")]
    named = {"doc_id": "doc_id", "text": "text"} | {x: f"c{i}" for i, x in enumerate(others)}
    return out.select(*(out[named[x]].alias(x) for x in docs.columns))


def row_key() -> F.Column:
    """Names a row by its id and text, also where ids repeat or are null."""
    return F.xxhash64("doc_id", "text")


#: Rejected rows whose keys may be broadcast; more are joined by a shuffle.
MAX_KEYS = 1_000_000


def few(keys: DataFrame) -> DataFrame:
    """A stored table of distinct long keys, marked for broadcast if it has MAX_KEYS rows at most: then what it is joined
    with (texts) stays where it is. A larger table joins by a shuffle, with the same result."""
    return F.broadcast(keys) if keys.limit(MAX_KEYS + 1).count() <= MAX_KEYS else keys


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents, every column kept, that aren't rejected (doc_id, at: the row's key). Both must agree, so a key that two
    rows happen to share drops none by mistake."""
    rejected = few(stored(rejected.select("doc_id", "at").distinct()))
    rejected = rejected.select(F.col("doc_id").alias("__id"), F.col("at").alias("__at"))
    return docs.join(rejected, (row_key() == F.col("__at")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left_anti")


def trim() -> None:
    """Gives memory that is free back to the system. Python workers serve one stage after another, and what one has
    freed would else count against the next."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """f, which takes one table or two, and trim() behind it. (Spark counts the arguments, so there are two forms.)"""

    def one(t: pa.Table) -> pa.Table:
        out = f(t)
        trim()
        return out

    def two(t: pa.Table, u: pa.Table) -> pa.Table:
        out = f(t, u)
        trim()
        return out

    return one if f.__code__.co_argcount == 1 else two


def cuts(off: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``size`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1))
        yield i, j
        i = j


def utf8(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets between them (null: empty)."""
    arr = pa.chunked_array(column).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def doc_ids(column: pa.ChunkedArray) -> np.ndarray:
    """As int64; a null stands behind every other id."""
    return np.asarray(column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False) if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False))


# ---------------------------------------------------------------- hashes

_RNG = np.random.default_rng(20_240_229)
BYTE_CODE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n at least."""
    if len(_pow[0]) < n:
        m = 1 << int(n - 1).bit_length()
        for k, r in enumerate((_R, _RINV)):
            a = np.full(m, r, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def unmix(h: np.ndarray) -> np.ndarray:
    """What mix() made h from."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h = h * np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
    h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums before each place of values[i] * R**i: the polynomial hash of any stretch is the difference of two."""
    up, _ = powers(len(values) + 1)
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def stretch(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end) by prefix sums; equal contents and lengths, equal hashes."""
    _, down = powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of k values; stretches over a document's end are the caller's to leave out."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    pre = prefix(values)
    _, down = powers(len(pre))
    return mix((pre[k:] - pre[:-k]) * down[: len(values) - k + 1] + np.uint64(k))


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, size: int = (1 << 20) - 64) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last + 1, starts, ends) of maximal runs of member bytes, for a few whole documents at a time."""
    for i, j in cuts(offsets, size):
        lo, hi = int(offsets[i]), int(offsets[j])
        inside = member[data[lo:hi]]
        before = np.empty(len(inside), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        first = offsets[i:j] - lo
        before[first[first < len(inside)]] = False
        after = np.empty(len(inside), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = offsets[i + 1 : j + 1] - lo - 1
        after[last[last >= 0]] = False
        yield i, j, np.flatnonzero(inside & ~before) + lo, np.flatnonzero(inside & ~after) + 1 + lo


def words_of(data: np.ndarray, offsets: np.ndarray, member: np.ndarray | None = None, code: np.ndarray = BYTE_CODE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and where each document's words begin in that list. A word is a run of member bytes."""
    member = ~SPACE if member is None else member
    hashes, counts = [], np.zeros(len(offsets), np.int64)
    for i, j, s, e in runs(data, offsets, member):
        lo = int(offsets[i])
        pre = prefix(code[data[lo : int(offsets[j])]])
        hashes.append(stretch(pre, s - lo, e - lo))
        counts[i + 1 : j + 1] = np.diff(np.searchsorted(s, offsets[i : j + 1]))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(counts)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Whether k values from each place on lie in one document; first: where each document begins."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    has = np.diff(first) >= k
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, first[1:][has] - k + 1, -1)
    return np.cumsum(ok[:n]) > 0


# ---------------------------------------------------------------- packed lists


def pack(values: np.ndarray) -> bytes:
    """A sorted uint64 list as differences, byte planes and zstandard."""
    v = values.astype(np.uint64)
    d = np.empty_like(v)
    d[:1] = v[:1]
    np.subtract(v[1:], v[:-1], out=d[1:])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(body: bytes) -> np.ndarray:
    d = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(d.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_any(values: np.ndarray) -> bytes:
    """A list in any order, by byte planes and zstandard; the type stands in front."""
    kind = values.dtype.str.encode().ljust(4)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T) if len(values) else values
    return kind + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_any(body: bytes) -> np.ndarray:
    kind = np.dtype(body[:4].strip().decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[4:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


# ---------------------------------------------------------------- the census

ASKED = "bucket int, block int, keys binary, extra binary"
TOLD = "block int, round int, bucket int, flags binary"
#: A block's answer to a key: uint8 for each of its keys.
Ask = Callable[[pa.Table, dict[int, np.ndarray]], tuple[np.ndarray, np.ndarray]]
Tell = Callable[[np.ndarray, list[np.ndarray], np.ndarray], list[np.ndarray]]


def cut(keys: np.ndarray, n: int) -> np.ndarray:
    """Where sorted 64-bit keys pass from one of n equal ranges to the next."""
    width = -(-(2**64) // n)
    return np.searchsorted(keys, np.array([min(k * width, 2**64 - 1) for k in range(n)], np.uint64)).tolist() + [len(keys)]


def answers(told: pa.Table | None) -> dict[int, np.ndarray]:
    """Flags of each round, in the order of the keys that the block had sent."""
    out: dict[int, list] = {}
    if told is not None:
        for r, b, f in zip(told["round"].to_pylist(), told["bucket"].to_pylist(), told["flags"].to_pylist(), strict=True):
            out.setdefault(r, []).append((b, unpack_any(f)))
    return {r: np.concatenate([x for _, x in sorted(v, key=lambda p: p[0])]) for r, v in out.items()}


def _asked(table_: pa.Table, n: int, ask: Ask, heard: dict[int, np.ndarray]) -> pa.Table:
    keys, extra = ask(table_, heard)
    at = cut(keys, n)
    rows = [(b, pack(keys[s:e]), pack_any(extra[s:e])) for b, (s, e) in enumerate(zip(at, at[1:], strict=False)) if e > s]
    block = table_["block"][0].as_py()
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "extra": pa.array([r[2] for r in rows], pa.binary())})


def census(docs: DataFrame, n: int, round_: int, ask: Ask, tell: Tell, told: DataFrame | None = None) -> DataFrame:
    """One round: ask(documents of a block, answers so far) gives sorted distinct uint64 keys and an array beside them;
    tell(keys, lists, owner) gives for each block's list a uint8 array. docs comes from in_blocks(); the answers come as
    rows of TOLD. ``keys`` in tell() are all blocks' keys in one array and ``owner`` is the list each one comes from."""
    if told is None:
        asked = docs.groupBy("block").applyInArrow(tidy(lambda t: _asked(t, n, ask, {})), ASKED)
    else:
        asked = docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tidy(lambda t, a: _asked(t, n, ask, answers(a)) if t.num_rows else pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())]).empty_table()), ASKED)

    def reduce(t: pa.Table) -> pa.Table:
        blocks, bucket = t["block"].to_pylist(), t["bucket"][0].as_py()
        lists = [unpack(x) for x in t["keys"].to_pylist()]
        extra = [unpack_any(x) for x in t["extra"].to_pylist()]
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        flags = tell(np.concatenate(lists), extra, owner)
        return pa.table({"block": pa.array(blocks, pa.int32()), "round": pa.array([round_] * len(blocks), pa.int32()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "flags": pa.array([pack_any(x) for x in flags], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(tidy(reduce), TOLD)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and where each run of equal ones starts in that order."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def spread(per_run: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A value of each run, given back to the places of its members."""
    out = np.empty(len(order), per_run.dtype)
    out[order] = np.repeat(per_run, np.diff(np.append(first, len(order))))
    return out


def split_lists(values: np.ndarray, lists: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(x) for x in lists])[:-1])


def shared(keys: np.ndarray, extra: list[np.ndarray], owner: np.ndarray) -> list[np.ndarray]:
    """A tell() for "more than one holder": extra has bit 1 where a block alone has several, bit 2 where the key is indexed."""
    order, first = grouped(keys)
    bits = np.concatenate(extra)[order]
    many = (np.diff(np.append(first, len(order))) > 1) | (np.bitwise_or.reduceat(bits, first) & 1 > 0)
    many &= np.bitwise_or.reduceat(bits, first) & 2 > 0
    return split_lists(spread(many.astype(np.uint8), order, first), extra)
