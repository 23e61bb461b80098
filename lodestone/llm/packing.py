"""Best-fit packing with several permitted sequence lengths.

Items of equal length are interchangeable, so the plan needs only how many there are of each length: a histogram of at
most ``max(sizes)`` rows, whatever the input. Lengths go from long to short. Each first fills the open bins that it fits
best; what is left opens bins of the size with the least cost for each word that the bin will hold, seen with the
lengths that are still to come; at the end every bin shrinks to the smallest permitted size that holds its contents.
Equal bins are planned as one group with a count, so the plan is bounded too.

Items then take their places by rank: the n-th item of a length has a fixed bin and offset. Ranks come from counts of
(length, hash bucket) and a numbering within the bucket, so a length that most items share spreads over all buckets.

A document longer than the largest size becomes full pieces and a rest; nothing is cut off. Defined cases: a document
without words (null, empty) has one row of length 0 with null bin, size and offset; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import common as c

SIZES = (512, 1024, 2048, 4096)
#: Items of one bucket of the ranking, about.
BUCKET = 100_000
Group = tuple[int, int, dict[int, int]]
"""Size, how many such bins, and how many items of each length one holds."""


def _fill(size: int, length: int, left: dict[int, int], lengths: list[int]) -> int:
    """How much of a bin a greedy filling would use, from this length down."""
    used, room, most = 0, size, length
    while room and most:
        i = bisect_left(lengths, min(room, most) + 1) - 1
        if i < 0:
            break
        x = lengths[i]
        n = min(left.get(x, 0), room // x)
        used, room, most = used + n * x, room - n * x, x - 1
    return used


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = float) -> list[Group]:
    """Groups of equal bins that hold exactly the items of the histogram (lengths from 1 to the largest size)."""
    sizes = tuple(sorted(sizes))
    left = {x: n for x, n in histogram.items() if n}
    lengths = sorted(left)
    rooms: list[int] = []  # of the open groups, sorted
    open_: dict[int, list[tuple[int, int, dict[int, int]]]] = {}
    done: list[Group] = []

    def put(size: int, n: int, items: dict[int, int], room: int) -> None:
        if not n:
            return
        if not room:
            done.append((size, n, items))
            return
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append((size, n, items))

    while lengths:
        x = lengths.pop()
        n = left.pop(x)
        while n and (i := bisect_left(rooms, x)) < len(rooms):
            room = rooms[i]
            size, bins, items = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            k = room // x
            full = min(bins, n // k)
            put(size, full, items | {x: items.get(x, 0) + k}, room - k * x)
            n -= full * k
            rest = bins - full
            if rest and n:
                put(size, 1, items | {x: items.get(x, 0) + n}, room - n * x)
                n, rest = 0, rest - 1
            put(size, rest, items, room)
        if n:
            left[x] = n
            size = min((s for s in sizes if s >= x), key=lambda s: (cost(s) / max(1, _fill(s, x, left, [*lengths, x])), -s))
            del left[x]
            k = size // x
            put(size, n // k, {x: k}, size - k * x)
            if n % k:
                put(size, 1, {x: n % k}, size - n % k * x)
    for groups in open_.values():
        done += groups
    small = lambda items: sizes[bisect_left(sizes, sum(x * k for x, k in items.items()))]
    return [(small(items), n, items) for _, n, items in done]


def places(groups: list[Group]) -> dict[str, np.ndarray]:
    """For ranges of (length, rank): the first bin, items of that length in a bin, offset in the bin, and the bin's size."""
    rows, taken, at = [], {}, 0
    for size, n, items in sorted(groups, key=lambda g: (-g[0], sorted(g[2].items(), reverse=True), g[1])):
        offset = 0
        for x, k in sorted(items.items(), reverse=True):
            rows.append((x, taken.get(x, 0), at, k, offset, size))
            taken[x] = taken.get(x, 0) + n * k
            offset += x * k
        at += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 6).T
    return dict(zip(("length", "rank", "bin", "per", "offset", "size"), cols, strict=True))


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """doc_id, piece, start and length (in words): full pieces of the largest size, then the rest."""
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), c.row_key().alias("at"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / largest) - 1).cast("int")
    rows = rows.select("doc_id", "n", "at", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(largest), F.col("n") - start).alias("length"), "at")


OUT = "doc_id long, piece int, start long, length long, bin_id long, bin_size long, offset long"


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = float) -> DataFrame:
    """A row of OUT for every piece of every document."""
    rows = c.stored(pieces(docs, max(sizes)))
    n = rows.count()
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("at", "piece"), F.lit(n // BUCKET + 64)).cast("int"))
    counts = c.stored(rows.where("length > 0").groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max(sizes) rows at most
    at = places(plan(histogram, sizes, cost))
    before = counts.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "at", "piece")) - 1
    ranked = rows.withColumn("within", within).join(before, ["length", "bucket"], "left").select("doc_id", "piece", "start", "length", (F.col("before") + F.col("within")).alias("rank"))
    key = at["length"] << 44 | at["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(4).fill_null(0).to_numpy()
            if not len(key):
                none = pa.nulls(len(length), pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], none, none, none], [x.split()[0] for x in OUT.split(", ")])
                continue
            i = np.maximum(np.searchsorted(key, length << 44 | rank, "right") - 1, 0)
            off = rank - at["rank"][i]
            empty = length == 0
            cols = at["bin"][i] + off // at["per"][i], at["size"][i], at["offset"][i] + off % at["per"][i] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(x, pa.int64(), mask=empty) for x in cols)], [x.split()[0] for x in OUT.split(", ")])

    return ranked.mapInArrow(place, OUT)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(c.table(spark, sf_dir, "documents"))
