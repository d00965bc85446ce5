"""Pages made here: columns, paragraphs, furniture and bookmarks."""

from pyspark.sql import functions as F

from quire.operators import layout as L

LINE = "doc string, page int, block int, line int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, text string"


def test_two_columns_in_bands(spark):
    rows = [("d", 1, b, x0, y0, x0 + w, y0 + 10, 600.0, n) for b, x0, y0, w, n in [(1, 0.0, 100.0, 280.0, 50), (2, 310.0, 100.0, 280.0, 50), (3, 0.0, 200.0, 600.0, 80), (4, 310.0, 300.0, 280.0, 50), (5, 0.0, 310.0, 280.0, 50), (6, 0.0, 10.0, 600.0, 5)]]
    rows += [("d", 2, 1, 0.0, 50.0, 600.0, 60.0, 600.0, 50), ("d", 2, 2, 0.0, 10.0, 200.0, 20.0, 600.0, 50)]
    df = spark.createDataFrame(rows, "doc string, page int, block int, x0 double, y0 double, x1 double, y1 double, width double, chars int")
    got = L.reading_order(df).orderBy("page", "position").collect()
    assert [r.block for r in got if r.page == 1] == [6, 1, 2, 3, 5, 4] and [r.block for r in got if r.page == 2] == [1, 2]
    assert [r.side for r in got if r.page == 1] == [None, 0, 1, None, 0, 1]


def test_paragraphs(spark):
    t = [(0, 500, "這是第一行的文字"), (0, 500, "第二行到頁邊"), (0, 300, "結束了。"), (20, 500, "新的一段開始"), (0, 499, "• 一項"), (0, 300, "end")]
    rows = [("d", 1, 1, k, float(x0), 100.0 + 15 * k, float(x1), 110.0 + 15 * k, 10.0, False, s) for k, (x0, x1, s) in enumerate(t)]
    df = spark.createDataFrame(rows, LINE).withColumn("position", F.lit(1)).withColumn("side", F.lit(None).cast("int"))
    got = [r.text for r in L.paragraphs(df).orderBy("para").collect()]
    assert got == ["這是第一行的文字第二行到頁邊結束了。", "新的一段開始", "• 一項end"]


def test_furniture(spark):
    rows = []
    for page in range(1, 11):
        rows.append(("d", page, 1, 10.0, 20.0, 10.0, f"The Quiet Harbour {page}", 800.0, False))
        rows += [("d", page, 2 + k, 100.0 + 60 * k, 150.0 + 60 * k, 10.0, f"body text number {page} {k} " * 3, 800.0, False) for k in range(10)]
        rows.append(("d", page, 20, 780.0, 790.0, 10.0, f"- {page} -", 800.0, False))
    rows.append(("d", 3, 30, 781.0, 790.0, 10.0, "A caption of its own", 800.0, False))
    df = spark.createDataFrame(rows, "doc string, page int, para int, y0 double, y1 double, size double, text string, height double, edge boolean")
    got = {(r.page, r.para) for r in L.furniture(df).collect()}
    assert got == {(p, k) for p in range(1, 11) for k in (1, 20)}


def test_bookmarks(spark):
    b = spark.createDataFrame([("d", 1, "Book", 1, 1), ("d", 2, "One", 1, 2), ("d", 2, "One", 1, 3), ("d", 2, "Three", 2, 4)], "doc string, level int, title string, page int, seq int")
    assert L.top_level(b).first().top == 2
    p = spark.createDataFrame([("d", 1, 1, "Book"), ("d", 1, 2, "One"), ("d", 1, 3, "text"), ("d", 2, 1, "other")], "doc string, page int, para int, text string")
    got = {(r.seq): r.para for r in L.place_bookmarks(b, p).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None}
    assert L.chapter_bookmarks(b, spark.createDataFrame([("d", 100)], "doc string, n int")).count() == 4
    assert L.chapter_bookmarks(b, spark.createDataFrame([("d", 4)], "doc string, n int")).count() == 4


def test_vertical_columns(spark):
    rows = [("d", 1, k, 100.0 - 20 * (k // 3), 110.0 - 20 * (k // 3), 10.0 * (3 - k % 3), 10.0, "字") for k in range(6)]
    df = spark.createDataFrame(rows, "doc string, page int, item int, x0 double, x1 double, y0 double, size double, text string")
    got = [(r.item, r.col, r.row) for r in L.vertical_columns(df).orderBy("col", "row").collect()]
    assert got == [(2, 1, 1), (1, 1, 2), (0, 1, 3), (5, 2, 1), (4, 2, 2), (3, 2, 3)]


def test_join_pages(spark):
    p = spark.createDataFrame([("d", 1, 1, "a", False, False), ("d", 1, 2, "cut", True, False), ("d", 2, 1, "off.", False, False), ("d", 2, 2, "T", False, True), ("d", 4, 1, "z", False, False)], "doc string, page int, para int, text string, open_end boolean, heading boolean")
    j = L.join_pages(p)
    assert [r.text for r in j.orderBy("joined").collect()] == ["a", "cut off.", "T", "z"]
    assert L.to_markdown(j).first().text == "a\n\ncut off.\n\nT\n\nz"
