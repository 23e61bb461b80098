"""Token counts with a whole-token shortcut.

``proven`` shows once, on the driver, which vocabulary strings encode alone as one token: the string is a pre-token of
its own and the merges end in a single symbol. Matching pre-tokens then count as one without any merging; only the
rest goes through the merges, once for each distinct one in a batch. Null and empty texts have 0 tokens.

Defined cases of the query besides: equal rows have equal results, each its own; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe as b
from lodestone.llm import common as c

LIMIT = 2048


def words(model: b.Bpe, text: str) -> list[str]:
    """Normalised pre-tokens; special tokens whole."""
    parts = [text] if "<|" not in text else [x for x in model.split.split(text) if x]
    out: list[str] = []
    for part in parts:
        if part in model.special:
            out.append(part)
        elif b.narrow(part):
            out += b.WORDS.findall(part.lower())
        else:
            plain = model.library.normalizer.normalize_str(part)
            out += b.WORDS.findall(plain) if b.narrow(plain) else [plain[s:e] for _, (s, e) in model.library.pre_tokenizer.pre_tokenize_str(plain)]
    return out


def proven(model: b.Bpe) -> frozenset[str]:
    """The vocabulary's strings that are one pre-token and end, merged alone, as one token."""
    texts = []
    for s, i in model.vocab.items():
        if s.endswith(model.suffix):
            try:
                texts.append(model.bytes_of[i].decode())
            except UnicodeDecodeError:
                continue
    texts = [t for t in dict.fromkeys(texts) if words(model, t) == [t] and t not in model.special]
    _, at = model.encode_words([t.encode() for t in texts])
    return frozenset(t for t, n in zip(texts, np.diff(at), strict=True) if n == 1)


def counts(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of doc_id, text."""
    spark = df.sparkSession
    model = b.broadcast(spark, path)
    one = spark.sparkContext.broadcast(proven(model()))  # no larger than the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in b.chunks(batches):
            m, whole = model(), one.value
            number: dict[str, int] = defaultdict(count().__next__)
            placed = [np.fromiter(map(number.__getitem__, w := words(m, t)), np.int64, len(w)) for t in texts]
            rest = [w for w in number if w not in whole and w not in m.special]
            n = np.ones(len(number), np.int64)
            n[[number[w] for w in rest]] = np.diff(m.encode_words([w.encode() for w in rest])[1])
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()), pa.array([int(n[p].sum()) for p in placed], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts(c.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
