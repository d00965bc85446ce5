"""Repair of scanned pages: lines, words and whole paragraphs."""

from pyspark.sql import functions as F

from quire.llm.scanned import fold, page_lines, page_repairs, rebuild, repaired_texts, scan

CLEAN = "the silence of the harbour was broken by a careful visitor whenever the custom allowed it. self-control matters. "


def test_page_lines():
    lines = ["A Title", "", *["word " * 8 + "and"] * 12, "12", "The Quiet Harbour", *["word " * 8 + "and"] * 12, "13", "The Qu1et Harbour", "the end."]
    got = page_lines(lines)
    assert [k for _, k in sorted(got.items())] == ["page_no", "header", "page_no", "header"]
    assert 0 not in got


def test_years_are_no_page_numbers():
    lines = ["1824", "The war began in the north", "1856", "The anxiety of the town is older than its ferry, and the e", "1936", "Nobody asked"]
    assert page_lines(lines) == {}
    assert page_lines(["[203]", "", "| 62", "- 7 -", "Page 3l", "第 174 頁"]) == {0: "page_no", 2: "page_no", 3: "page_no", 4: "page_no", 5: "page_no"}


def test_fold_ignores_confusions():
    assert fold("THF M0dcrn") == fold("The Modern") and fold("cornrnon") == fold("common")


def test_whole(spark):
    rows = [(i, "epub", CLEAN * 20, None) for i in range(3)]
    rows += [(10, "pdf", "the sil-\nence of tbe harbour was\nbroken by a careful self-\ncontrol of the vis¬\nitor in l605.\n", "x"), (11, "pdf", None, None), (12, "pdf", "", None)]
    df = spark.createDataFrame(rows, "id long, kind string, content string, title string")
    fixes = page_repairs(df, "id", F.col("content"), F.col("kind") == "pdf", F.lit("a"))
    got = sorted((r.id, r.line, r.kind) for r in fixes.collect())
    assert got == [(10, 1, "broken_word"), (10, 2, "misread"), (10, 4, "broken_word"), (10, 5, "misread")]
    texts = {r.id: r.text for r in repaired_texts(df.where("kind = 'pdf'"), "id", F.col("content"), fixes).collect()}
    assert texts == {10: "the silence of the harbour was broken by a careful self-control of the visitor in 1605.", 11: None, 12: ""}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, content string")
    assert page_repairs(df, "id", F.col("content"), F.lit(True), F.lit("a")).count() == 0


def test_rebuild_keeps_paragraphs():
    assert rebuild("a b\nc\n\nd\n", []) == "a b c\n\nd"
    assert rebuild("你好\n世界。", []) == "你好世界。"


def test_scan_takes_long_lines():
    marks, breaks, words, shapes, titles = scan("x" * 200_000 + "\n" + "自已" * 1000)
    assert not marks and not breaks and shapes


def test_headers_by_title(spark):
    body = "\n".join(["it was a day like any other and the"] * 30)
    df = spark.createDataFrame([(1, "b", body + "\nTHE QU1ET HARBOUR\n" + body)], "id long, book string, content string")
    titles = spark.createDataFrame([("b", "The Quiet Harbour"), ("c", None)], "book string, title string")
    got = page_repairs(df, "id", F.col("content"), F.lit(True), F.col("book"), titles).collect()
    assert [(r.id, r.line, r.kind) for r in got] == [(1, 31, "header")]
