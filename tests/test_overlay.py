"""The overlay hands whole lines on, in Spark and in the SQL that the oracles share."""

from lodestone.sources import overlay


def test_long_line(spark, tmp_path):
    line = "word " * 300 + "| see Table 220.55 at the end"
    spark.createDataFrame([(1, "first\nsecond\n" + line)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.idx: r.content for r in overlay.paragraphs(spark, str(tmp_path)).collect()}
    assert got[2] == line.replace("|", "/")


def test_sql_reads_whole_lines():
    assert "substr(line" not in overlay.DUCK_STREAM
