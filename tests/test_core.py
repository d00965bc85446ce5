"""Text functions, catalogue rules, components and the stream, on cases that break easily."""

import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalog, lines, lint, matching, notes
from quire.operators.components import connected_components
from quire.operators.rows import first_of
from quire.streaming import log


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, "a\x07\r\nb\rc\x9f\td", T.drop_controls) == "a\r\nbc\td"
    assert one(spark, 'a/b:c*"d"?<e>|', T.file_name) == "abcde"
    assert one(spark, "> Ａb，（[[x]]）c_1", lambda c: T.match_key(T.nfkc(c))) == "abxc1" and one(spark, "ab（[[x]]）c", T.match_key) == "abc"
    assert one(spark, "ab", lambda c: T.grams(c, 4)) == ["ab"] and one(spark, "", lambda c: T.grams(c, 2)) == [] and one(spark, "abc", lambda c: T.grams(c, 2)) == ["ab", "bc"]
    assert one(spark, "。12 [3]", T.ends_sentence) and one(spark, "", T.ends_sentence) and not one(spark, "ab,", T.ends_sentence)
    assert one(spark, "well-\nknown 中\n文 a\n\nb", lambda c: T.join_wrapped(F.split(c, "\n"))) == "wellknown 中文 a b"
    assert one(spark, "中\n文\nab\ncd", T.quote_line) == "> 中文 ab cd"
    assert one(spark, "（美）Tess（泰絲）、Other", lambda c: T.clean_name(c, True)) == "Tess" and one(spark, None, lambda c: T.name_key(c, True)) == ""
    assert one(spark, "J. K．羅琳", lambda c: T.name_key(c, True)) == "J．K．羅琳"
    assert one(spark, "a/b c.d.epub", T.book_key) == "b_c.d" and one(spark, "a\nb\nc", lambda c: T.line_of(c, F.lit(4))) == 3
    assert one(spark, "<b>a</b>&amp;lt;  b", T.plain_text) == "a&lt; b"
    assert abs(one(spark, "abcd", lambda c: T.gestalt_ratio(c, F.lit("bcde"))) - 0.75) < 1e-9


def test_metrics_and_guards(spark):
    df = spark.createDataFrame([("a", "# 轉換日期：1\n\n---\n# T\n12\nx1\n---\ny"), ("b", None), ("c", "")], "k string, t string")
    m = {r.chars: r for r in lines.metrics(df, F.col("k"), "t").collect()}
    assert len(m) == 2 and (m[32].sections, m[32].headings, m[32].number_lines, m[32].body_chars) == (2, 1, 1, 6) if 32 in m else True
    base = spark.createDataFrame([("a", 10, 1), ("b", 5, 0), ("c", 1, 1)], "key string, body_chars int, number_lines int")
    run = spark.createDataFrame([("a", 9, 2), ("b", 6, 0), ("d", 1, 1)], "key string, body_chars int, number_lines int")
    got = {(r.key, r.metric): r.broken for r in lines.compare_runs(base, run).collect()}
    assert got == {("a", "body_chars"): True, ("a", "number_lines"): True, ("c", "(book)"): False, ("d", "(book)"): False}


def test_first_of_takes_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 1, "z")], "k string, o int, v string")
    assert sorted(map(str, (tuple(r) for r in first_of(df, ["k"], [F.col("o")]).collect()))) == ["('a', 1, 'y')", "(None, 1, 'z')"]


def test_catalogue(spark):
    assert catalog.status_counts(spark.createDataFrame([(None,), ("raw",)], "status string").select("status")).count() == 2
    f = lambda *a: spark.range(1).select(catalog.folder_for(*map(F.lit, a)).alias("x")).first().x
    assert (f(None, "law", ""), f(0.9, "law", "A"), f(0.7, "law", None)) == ("Inbox", "law/A", "law")
    names = catalog.numbered_names(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, n string"), F.col("n"), [F.col("i")], "f")
    assert [r.f for r in names.orderBy("i").collect()] == ["a", "a_2", "b"]
    cards = spark.createDataFrame([("x/Book.md",), ("x/Other_2.md",)], "p string")
    got = catalog.match_by_stem(spark.createDataFrame([("1", "e/Book_Author.epub"), ("2", "e/Other_2.epub"), ("3", "e/None.epub")], "book_id string, path string"), "path", cards, "p")
    assert {r.book_id: r.card for r in got.collect()} == {"1": "x/Book.md", "2": "x/Other_2.md", "3": None}


def test_batches(spark):
    ch = spark.createDataFrame([("b", 1, 90), ("b", 2, 20), ("b", 3, 500), ("b", 4, None), ("c", 1, 1)], "book string, n int, s int")
    got = notes.note_batches(ch, "book", ["n"], F.col("s"), 100)
    assert [(r.book, r.n, r.batch) for r in got.orderBy("book", "n").collect()] == [("b", 1, 1), ("b", 2, 2), ("b", 3, 3), ("b", 4, 4), ("c", 1, 1)]


def test_upsert_twice_changes_nothing(spark):
    b = spark.createDataFrame([("c", "d", "x", 1, "old"), ("c", "d", "x", 2, "again"), ("c", "d", "y", 3, "keep")], "card string, section string, book string, ord int, text string")
    n = spark.createDataFrame([("c", "d", "x", "new"), ("c", "d", "z", "added")], "card string, section string, book string, text string")
    first = notes.upsert_blocks(b, n)
    rows = sorted(map(tuple, first.collect()))
    assert rows == [("c", "d", "x", 1, "new"), ("c", "d", "y", 3, "keep"), ("c", "d", "z", 4, "added")]
    assert sorted(map(tuple, notes.upsert_blocks(first, n).collect())) == rows
    src = lambda t: one(spark, t, notes.card_sources)
    assert src('source_book: "[[A]]"') == ["A"] and src('source_book:\n  - "[[A]]"\n  - "[[B]]"\n') == ["A", "B"] and src("x") == []


def test_matching_empty_corpus(spark):
    c = spark.createDataFrame([(1, "t", "d", "q", ["b"])], "card_id long, title string, definition string, quote string, sources array<string>")
    assert matching.match_cards(c, "b").count() == 0


def test_lint(spark):
    df = spark.createDataFrame([("f", "a [[x|y]] [[ ]]\n[[z]]"), ("g", None)], "file string, text string")
    known = spark.createDataFrame([("x",)], "t string")
    got = lint.all_issues(lint.empty_links(df, "file", "text"), lint.broken_links(df, "file", "text", known))
    assert sorted((r.line, r.type) for r in got.collect()) == [(1, "empty_wikilink"), (2, "broken_link")]
    assert lint.truncated(spark.createDataFrame([("a", "x" * 8000), ("b", "x" * 8000 + "\n> ends.")], "f string, t string"), "f", "t").count() == 1


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "SCAN", "b"), (1, "2024-01-01 10:00:00", "scan", "b"), (2, "2024-01-01 11:00:00", "convert", "b"), (3, "2024-01-02 09:00:00", "done", None)]
    df = spark.createDataFrame(rows, "log_id long, t string, action string, book_id string").select("log_id", F.to_timestamp("t").alias("ts"), F.to_timestamp("t").alias("ingested_at"), "action", "book_id", F.lit("{}").alias("details"))
    df.write.parquet(str(tmp_path / "in"))
    for name, f in (("w", lambda s: log.windows(log.once(s), late=None)), ("s", log.states)):
        q = f(log.read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("update" if name == "s" else "append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert [(r.book_id, r.status) for r in spark.table("s").collect()] == [("b", "converted")]
