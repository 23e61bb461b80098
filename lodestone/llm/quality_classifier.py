"""Compression classifier: one zstandard dictionary from good and one from bad labelled text.

A text is cut into pieces of PIECE bytes (all of it), each piece is compressed with either dictionary, and the
difference of the summed sizes over their sum becomes a score by a logistic curve. Dictionaries and curve come from two
disjoint halves of a bounded sample of the labelled rows (SAMPLE_ROWS and SAMPLE_BYTES a class, in the order of a hash of
the id); every row is scored. The label sides, and nothing else, decide; language, source and id are no inputs.

Defined cases: null and empty texts compress to the same size either way and get the curve's value at 0; without labels
of both classes every score is the share of good labels, or 0.5 without any; a null doc_id counts as the text '' when
rows are held out; doubled labels count once (the larger quality).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import common as c

PIECE = 1024
DICTIONARY = 64 << 10
LEVEL = 3
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 16 << 20
#: Pieces that train one dictionary.
TRAIN_PIECES = 4000


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, bytes]]:
    """(quality, text) of a bounded sample of labelled rows that aren't held out, in the order of the ids' hashes."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rank = F.xxhash64("doc_id")
    some = [known.where(F.col("quality") == q).orderBy(rank, "doc_id").limit(SAMPLE_ROWS) for q in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(some[0].unionAll(some[1])), "doc_id")  # at most 2 * SAMPLE_ROWS ids
    rows = rows.where(F.octet_length("text") <= SAMPLE_BYTES)  # neither null nor too long to ever fit
    order = ["quality", rank, "doc_id", F.xxhash64("text")]
    left, taken = [SAMPLE_BYTES, SAMPLE_BYTES], set()
    for r in rows.select("quality", c.row_key().alias("at"), F.octet_length("text").alias("size"), *order[1:]).orderBy(*order).toLocalIterator():
        if r["at"] not in taken and r["size"] <= left[r["quality"]]:  # what doesn't fit is passed over
            left[r["quality"]] -= r["size"]
            taken.add(r["at"])
    keys = docs.sparkSession.createDataFrame([(x,) for x in sorted(taken)], "at long")
    rows = rows.withColumn("at", c.row_key()).join(F.broadcast(keys), "at").dropDuplicates(["at"])
    return [(r.quality, r.text.encode()) for r in rows.orderBy(rank, "doc_id", F.xxhash64("text")).collect()]


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [b""]


def dictionary(texts: list[bytes]) -> bytes:
    parts = [p for t in texts for p in pieces(t)]
    parts = [parts[i] for i in np.linspace(0, len(parts) - 1, min(len(parts), TRAIN_PIECES)).astype(int)] if parts else []
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: its end, as it is
        return b"".join(parts)[-DICTIONARY:]


class Sizes:
    """Compressed sizes with two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d is not None:
                d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def difference(self, text: bytes) -> float:
        """Above 0 where the good dictionary fits better."""
        g, b = (sum(len(z.compress(p)) for p in pieces(text)) for z in self.by)
        return (b - g) / (b + g)


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with a weak pull to 0, by Newton's method."""
    scale = float(np.abs(x).mean()) or 1.0
    m = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        grad = m.T @ (p - y) + 0.1 * w
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 0.1 * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, float, float]:
    """Both dictionaries, and the curve's slope and offset."""
    rows = sample(docs, labels)
    by = {q: [t for k, t in rows if k == q] for q in (0, 1)}
    if not by[0] or not by[1]:
        share = (len(by[1]) + 1) / (len(rows) + 2)
        return b"", b"", 0.0, math.log(share / (1 - share))
    good, bad = dictionary(by[1][::2]), dictionary(by[0][::2])
    sizes = Sizes(good, bad)
    rest = [(q, t) for q in (0, 1) for t in (by[q][1::2] or by[q])]
    slope, offset = curve(np.array([sizes.difference(t) for _, t in rest]), np.array([q for q, _ in rest], float))
    # the sample is balanced only as far as its caps; the curve is moved to the labels' true shares
    total = dict(labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("quality").count().collect())
    now = [sum(q == k for q, _ in rest) for k in (0, 1)]
    return good, bad, slope, offset + math.log(total[1] / total[0]) - math.log(now[1] / now[0])


_sizes: dict[tuple[int, int], Sizes] = {}


def score(docs: DataFrame, model: tuple[bytes, bytes, float, float]) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    good, bad, slope, offset = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(good), hash(bad)
        if key not in _sizes:
            _sizes.clear()
            _sizes[key] = Sizes(good, bad)
        sizes = _sizes[key]
        for b in batches:
            data, off = c.utf8(b.column(1))
            raw = data.tobytes()
            x = np.array([sizes.difference(raw[s:e]) for s, e in zip(off.tolist(), off[1:].tolist(), strict=False)])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(slope * x + offset, -500, 500))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, every column kept, whose score is ``least`` or above."""
    model = fit(docs, labels)
    good, bad, slope, offset = model
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for b in batches:
            x = np.array([sizes.difference((t or "").encode()) for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(slope * x + offset, -500, 500))) >= least))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))
