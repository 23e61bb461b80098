"""What a query moves and computes follows its input: how often a plan shuffles, and how often an expression is computed."""

import random
import re
from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cleaning, lookup, tables
from lodestone.plans import registry
from lodestone.plans import structure as plans
from lodestone.plans.tables import paired

SF = "/root/testdata/sf0.001"


def plan(df):
    """The physical plan before it runs."""
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().sparkPlan().toString()), re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def exchanges(df):
    return len(re.findall(r"Exchange (?:hashpart|rangepart|RoundRobin|SinglePart)", plan(df)[1]))


@pytest.mark.parametrize("name", ["table_pass", "table_regions", "table_fragments", "table_text_block", "table_reconstruct"])
def test_tables_take_one_shuffle(spark, name):
    df = registry.queries()[name](spark, SF)
    assert exchanges(df) == 1 and "Join" not in plan(df)[0] and "lodestone-" not in plan(df)[0]  # what is stored stands in such a folder


@pytest.mark.parametrize("make", [tables.inferred, paired])
def test_cells_are_taken_once(spark, make):
    df = spark.createDataFrame([(["Table 1.1 T", "size", "length", "1", "2", "3", "4"],)], "fragments array<string>").select(make(F.col("fragments")).alias("s"))
    assert df._jdf.queryExecution().analyzed().toString().count("slice(fragments") == 1


def test_only_merged_tables_are_gathered(spark):
    rows = [(1, 0, "Table1", ["T", "a"]), (1, 9, "Table1", ["T", "b"]), (2, 0, "Table2", ["U", "c"]), (1, 5, "Table2", ["U", "d"]), (3, 0, "Table3", ["V"])]
    t = spark.createDataFrame(rows, "stream long, start long, table_id string, fragments array<string>").withColumn("structure", F.lit(None).cast(tables.STRUCTURE))
    fixes = spark.createDataFrame([("Table1", "multi_page_merge"), ("Table2", "stolen_data")], "table_id string, fix_category string").withColumns({"override_action": F.lit("skip"), "override_data": F.lit(None).cast(tables.STRUCTURE), "extra_instructions": F.lit("x")})
    out = tables.corrected(t, fixes)
    assert {r.table_id: (r.action, r.fragments) for r in out.collect()} == {"Table1": ("rebuild", ["T", "a", "b"]), "Table2": ("rebuild", ["U", "d"]), "Table3": ("keep", ["V"])}
    gathers = [x for x in plan(out)[0].splitlines() if "collect_list" in x]
    assert gathers and not any("structure" in x for x in gathers)


def test_suggestions_are_difflibs_and_dealt_out(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    r = random.Random(0)
    valid = sorted({f"{r.randint(90, 999)}.{r.randint(1, 5)}" for _ in range(400)} | {"1.23.456.789.0123", "é.1"})
    asked = sorted({f"{r.randint(10, 999)}.{r.randint(0, 250)}" for _ in range(60)} - {*valid} | {"zz", "é1", "1.23.456.789.0124 and more"})
    dealt, real = [], DataFrame.mapInPandas
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda self, *a, **b: (dealt.append(plan(self)[1]), real(self, *a, **b))[1])
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    got = {x.id: x.similar for x in lookup.suggestions(frame(asked), frame(valid)).collect()}
    assert got == {x: get_close_matches(x, valid, n=5, cutoff=0.4) for x in asked}
    assert all(re.search("REPARTITION_BY_NUM", x) for x in dealt) and dealt


def test_cleaning_moves_contents_once_more(spark):
    df = registry.queries()["cleaning_pipeline"](spark, SF)
    assert exchanges(df) == 1 and "Join" not in plan(df)[0]


def test_page_mark_as_second_half(spark):
    """A page mark that goes as a second half no longer ends a page, so what it had led to is undone."""
    texts = ["it goes", "2023 Edition STANDARD CODE", "ARTICLE 90 - SCOPE", "STANDARD CODE 2023 Edition", "x", "ARTICLE 91 - SCOPE", "on like this"]
    df = spark.createDataFrame([(1, i, x, 30) for i, x in enumerate(texts)], "stream long, idx long, content string, page int")
    out = cleaning.sentence_runover(df).orderBy("idx").collect()
    assert [r.content for r in out] == ["it goes on like this", "2023 Edition STANDARD CODE", "ARTICLE 90 - SCOPE", "x", "ARTICLE 91 - SCOPE"]


def test_merge_adds_no_shuffle(spark):
    assert exchanges(registry.queries()["corrected_merge"](spark, SF)) == 1


def test_chunks_take_one_shuffle(spark):
    df = registry.queries()["chunk_subsections"](spark, SF)
    assert exchanges(df) == 1 and "Join" not in plan(df)[0]


@pytest.mark.parametrize("name", ["chunk_union", "chunk_id_check", "chunk_sizes", "chunk_stats", "chunk_tables", "structure_bounds"])
def test_contents_are_stored_twice(spark, monkeypatch, name):
    """The parsed stream and its subsections, and nothing on the way to them."""
    from lodestone.sources import shared

    made, real = [], shared.stored
    for module in (plans, tables):
        monkeypatch.setattr(module, "stored", lambda df: (made.append(df), real(df))[1])
    registry.queries()[name](spark, SF)
    assert len(made) == 2 and exchanges(made[0]) == 1
