import os
import sys

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 9000}" for i in range(40_000))
EDGES = [
    (None, "a null id with words " * 30), (900_001, None), (900_002, ""), (900_003, " \t\n\r\x0b\x0c "), (900_004, "one two three four"), (900_005, "One TWO three four"),
    (900_006, LONG), (900_007, LONG), (900_008, "é" * 500 + " ü"), (900_009, "é" * 500 + " ü"), (900_010, "same " * 400), (900_011, "General  Public,LICENSE cc-by CC BY all\nrights reserved <|endoftext|> x"),
    (900_012, "line of words here\nline of words here\n\n  \nline of words here"), (900_013, "\x00\x01nul\x7f ends there now"), (900_014, "naïve 漢字 текст 😀 mixed İstanbul"),
]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def rows():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in t] + [(i, t, "en" if k % 2 else None, "edge") for k, (i, t) in enumerate(EDGES)]


@pytest.fixture(scope="session")
def pairs(rows):
    return [r[:2] for r in rows]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The documents of the smallest scale with edge cases behind them; columns with names that operators use inside."""
    at = str(tmp_path_factory.mktemp("docs") / "t")
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, block int, at string")
    df.write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
