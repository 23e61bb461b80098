"""Slots for models: a loader is called once in each Python worker, and the model gets batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Returns a function from texts to as many vectors.
Embedder = Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]
#: Returns a function from (query, document) pairs to as many raw scores.
Scorer = Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]]


def embedding(text: Column | str, load: Embedder, batch: int = 50, prompt: str = "") -> Column:
    """The model's vector of each text (null: empty), ``batch`` texts at a time in their order; ``prompt`` goes in front,
    as some models want it of queries."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            texts = [prompt + (x or "") for x in s]
            out = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.Series([np.asarray(v, np.float32).tolist() for v in out], dtype=object)

    return run(text)


def pair_score(query: Column | str, document: Column | str, load: Scorer, batch: int = 50) -> Column:
    """The model's score of each pair, brought to 0 to 1 by a logistic curve."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, d in parts:
            pairs = [(a or "", b or "") for a, b in zip(q, d, strict=True)]
            raw = [v for i in range(0, len(pairs), batch) for v in model(pairs[i : i + batch])]
            yield pd.Series(1 / (1 + np.exp(-np.asarray(raw, float))))

    return run(query, document)


def letters() -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for an embedding model: how often each vowel stands in a text."""
    return lambda texts: [[float(x.count(v)) for v in "aeiou"] for x in texts]


def longer() -> Callable[[list[tuple[str, str]]], list[float]]:
    """A stand-in for a cross-encoder: how many hundred characters the document is longer than the query."""
    return lambda pairs: [(len(d) - len(q)) / 100 for q, d in pairs]
