"""Small streams with the corner cases of the sequential rules: each expectation is written out by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.functions.profile import DEFAULT as P
from lodestone.operators import cleaning, evaluate, lookup, retrieval, sessions, structure, tables
from lodestone.sources import overlay


@pytest.fixture
def stream(spark):
    def make(*contents, page=30):
        rows = [(1, i, c, page) if isinstance(c, str) else (1, i, *c) for i, c in enumerate(contents)]
        return spark.createDataFrame(rows, "stream long, idx long, content string, page int")

    return make


def contents(df):
    return [r.content for r in df.orderBy("stream", "idx").collect()]


@pytest.mark.parametrize("text, wanted", [
    (P.forward, True), (P.reverse, True), ("SAMPLE COPY", True), ("SAMPLE COPY here", False), ("Copyright @Press 2023", True), ("70-12", True), ("70-12a", False), ("ARTICLE 90 - RULES", True),
    ("ARTICLE 90 Rules", False), ("CHAPTER 3", True), ("CHAPTER 3 X", False), ("Chapter 3 Wiring", True), ("12.70", True), ("1.5", False), ("", False),
])
def test_furniture(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "c string").select(t.is_furniture(F.col("c"))).first()[0] is wanted


@pytest.mark.parametrize("one, two, wanted", [
    ("it goes", "on and on", True), ("it ends.", "New one", False), ("it goes", "12 things", False), ("it goes", "1_0 things", False), ("it goes", "nan things", False), ("it goes", "1d things", True),
    ("it goes", "(a) item", False), ("it goes", "Partial", False), ("UPPER", "on", False), ("it goes", "UP", False), ("", "on", False), ("a\nb", "on", False),
])
def test_runs_over(spark, one, two, wanted):
    assert spark.createDataFrame([(one, two)], "a string, b string").select(t.runs_over(F.col("a"), F.col("b"))).first()[0] is wanted


def test_sentence_over_a_page(stream):
    out = cleaning.sentence_runover(stream(("it goes", 30), (P.forward, 30), ("70-30", 30), ("ARTICLE 90 - SCOPE", 31), ("on like this.", 31), ("Next.", 31)))
    rows = out.orderBy("idx").collect()
    assert [r.content for r in rows] == ["it goes on like this.", P.forward, "70-30", "ARTICLE 90 - SCOPE", "Next."]
    assert rows[0].page == 30 and [r.idx for r in rows] == list(range(5))


def test_header_at_either_end(stream):
    df = stream("ARTICLE 90 - SCOPE", "text", "ARTICLE 91 - SCOPE")
    assert contents(cleaning.sentence_runover(df)) == contents(df)


def test_characters_and_hyphens(stream):
    assert contents(cleaning.dehyphenated(stream("co- operate 3- wire two- and"))) == ["cooperate 3- wire twoand"]
    assert cleaning.plain_text(stream("é° – ’", "b")).first().text == "é°  \nb"


def test_table_region(stream):
    df = stream("Before.", "Table 90.1 (A) Sizes", "10", "20", "(continues)", P.forward, "Table 90.1 (A) Sizes", "Continued", "30", "90.2 A section that is long enough", "After.")
    region = tables.table_regions(df).collect()
    assert [(r.start, r.finish, r.table_id) for r in region] == [(1, 8, "Table90.1(A)")]
    assert tables.table_fragments(df, tables.table_regions(df)).first().fragments == ["Table 90.1 (A) Sizes", "10", "20", "30"]


def test_title_without_short_rows_is_no_table(stream):
    assert tables.table_starts(stream("Table 90.1 is named here", "x" * 90, "y" * 90)).count() == 0


def test_interrupted_sentence(stream):
    df = stream("the length of", "Table 90.1 Sizes", "10", "20", "90.3 Another section that is long", "wire.")
    assert tables.interruptions(df, tables.table_regions(df)).count() == 0  # a section follows
    df = stream("the length of", "Table 90.1 Sizes", "10", "20", "(continues)", "Table 91.1 More", "1", "2", "3")
    assert contents(tables.table_pass(df))[1].startswith("**Table 90.1 Sizes**")


def test_repeated_table_is_given_once(stream):
    df = stream("Table 90.1 Sizes", "10", "20", "90.2 A section that is long enough", "Table 90.1 Sizes", "30", "40", "90.3 A section that is long enough")
    assert sum(x.startswith("**") for x in contents(tables.table_pass(df))) == 1


def test_render_and_parse(spark):
    df = spark.createDataFrame([(("Table 1.1 T", ["a", "b"], [["1", "2"], ["3", "4"]], ["n"]),)], f"s {tables.STRUCTURE}")
    text = df.select(tables.render(F.col("s")).alias("x"))
    assert text.first().x == "**Table 1.1 T**\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n\n> n"
    p = text.select(tables.parse(F.col("x")).alias("p")).first().p
    assert (p.id, p.title, p.column_headers, p.data_rows, p.footnotes) == ("Table1.1", "Table 1.1 T", ["a", "b"], [["1", "2"], ["3", "4"]], ["n"])
    assert df.select(tables.widths_ok(F.col("s"))).first()[0]


def test_inferred_columns(spark):
    df = spark.createDataFrame([(["Table 1.1 T", "size", "length", "1", "2", "3", "4"],), (["Table 1.1 T"],)], "f array<string>")
    a, b = (r.s for r in df.select(tables.inferred(F.col("f")).alias("s")).collect())
    assert a.data_rows == [["1", "2"], ["3", "4"]] and a.column_headers == ["size", "length"] and b is None


def test_hierarchy(stream):
    rows = structure.classified(stream("lost", "ARTICLE 90 Intro", "dropped", "90.1 Scope. x", "(A) one", "Part I. General", "more", "Part II. 90.5 Embedded title", "tail", "ARTICLE 100 Definitions", "(dropped)", "Term. Means this.", "Informational Note: more", "ARTICLE 90 Again", "still nothing"))
    subs = structure.subsections(rows).orderBy("ord").collect()
    assert [(s.section, s.part, s.paragraphs) for s in subs] == [("90.1", None, ["90.1 Scope. x", "(A) one"]), ("90.1", "I", ["more"]), ("90.5", "II", ["Part II. 90.5 Embedded title", "tail"])]
    d = structure.definitions(rows).collect()
    assert [(x.term, x.content) for x in d] == [("Term", "Term. Means this.\nInformational Note: more")]


def test_chunks_by_letter(stream):
    long = "x" * 1600
    rows = structure.classified(stream("ARTICLE 90 Intro", "90.1 Front", "(1) first " + long, "(A) Alpha. " + long, "(B) Beta."))
    subs = structure.subsections(rows)
    made = structure.chunks(subs, structure.sub_items(subs)).orderBy("g").collect()
    assert [c.chunk_id for c in made] == ["90_90.1_A", "90_90.1_B"]
    assert made[0].text.startswith("90.1 Front\n(1) first") and made[1].text == "90.1 Front\n(B) Beta."


def test_reference_swallows_a_note(spark):
    df = spark.createDataFrame([("see Table 220.55 (see note) and Table  90.1",)], "c string")
    assert df.select(t.table_refs(F.col("c"))).first()[0] == ["Table220.55(seenote)", "Table90.1"]


def test_union_of_orders(spark):
    hits = spark.createDataFrame([(1, r, 100 + r, float(s)) for r, s in enumerate([1, 5, 5, 0, 9, 2], 1)], "query_id long, rank long, vec_id long, score double")
    out = retrieval.reranked(hits, 2, 3).orderBy("position").collect()
    assert [r.rank for r in out] == [5, 2, 1, 3]
    assert retrieval.reranked(hits.limit(0)).count() == 0


def test_seen_sections(spark):
    hits = spark.createDataFrame([("s", 1, "A"), ("s", 1, "B"), ("s", 2, "B"), ("s", 2, "C"), ("s", 3, "A"), ("s", 3, "C"), ("s", 3, "D"), ("s", 3, "D")], "session_id string, call_no int, section_id string")
    assert sorted((r.call_no, r.section_id) for r in retrieval.unseen(hits).collect()) == [(1, "A"), (1, "B"), (2, "C"), (3, "D"), (3, "D")]


def test_vectors_with_ties_and_nulls(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.vec_id, r.distance) for r in retrieval.topk(v, q, 2).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]


@pytest.mark.parametrize("a, b, wanted", [(3, 1, "improved"), (1, 3, "worsened"), (2, 2, "unchanged"), (None, 4, "new"), (4, None, "lost"), (None, None, "unchanged")])
def test_rank_change(spark, a, b, wanted):
    assert spark.createDataFrame([(a, b)], "a int, b int").select(evaluate.rank_change(F.col("a"), F.col("b"))).first()[0] == wanted


def test_suggestions(spark):
    ids = spark.createDataFrame([(f"250.{i}",) for i in (50, 52, 6, 66)], "id string")
    out = lookup.suggestions(spark.createDataFrame([("250.5",), ("zzz",)], "id string"), ids).collect()
    assert {r.id: r.similar for r in out} == {"250.5": ["250.52", "250.50", "250.6", "250.66"], "zzz": []}


def test_sessions(spark):
    e = spark.createDataFrame([("s", 1, "text_delta", "a"), ("s", 2, "text_delta", "b"), ("f", 1, "text_delta", "a"), ("f", 2, "final", "whole")], "session_id string, seq int, type string, content string")
    assert {r.session_id: r.response for r in sessions.folded(e).collect()} == {"s": "ab", "f": "whole"}
    raw = spark.createDataFrame([('data: {"seq":1,"type":"a","payload":"x"}\n\ndata: {broken\n\nnoise',)], "stream string")
    assert [(r.seq, r.payload) for r in sessions.sse_decode(raw).collect()] == [(1, "x")]


def test_paragraph_files(spark, tmp_path):
    df = spark.createDataFrame([("d", 10, "ten", 2), ("d", 9, "nine", 1)], "doc_id string, idx long, content string, page int")
    overlay.save_paragraph_json(df, str(tmp_path / "out"))
    back = overlay.paragraph_json(spark, str(tmp_path / "out")).orderBy("idx").collect()
    assert [(r.idx, r.content, r.page) for r in back] == [(9, "nine", 1), (10, "ten", 2)]


def test_collections_are_written_once(spark, tmp_path):
    df = spark.range(3)
    at = str(tmp_path / "c")
    assert overlay.save_collection(df, at, "m") and not overlay.save_collection(df, at, "m") and overlay.save_collection(df.limit(1), at, "m", reset=True)
    assert spark.read.parquet(at).count() == 1
