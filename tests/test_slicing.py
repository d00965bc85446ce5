"""Chapters tile their book and join to it, whatever the book."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators.lines import lines_of, sections
from quire.operators.slicing import Doc, is_back_matter, markdown_doc, paragraph_cuts, slice_book, slice_markdown

LINE = st.one_of(st.just(""), st.builds(lambda n, e: "字" * n + e, st.integers(0, 400), st.sampled_from(["", "。", "!", "12"])), st.builds(lambda k, t: "#" * k + " " + t, st.integers(1, 4), st.sampled_from(["一", "Notes", "參考書目", "Part One", "第二章"])))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(LINE, min_size=1, max_size=30), min_size=1, max_size=6), st.sampled_from([500, 1500, 40_000]))
def test_nothing_is_lost(docs, limit):
    rows, whole = slice_book([markdown_doc("\n".join(d)) for d in docs], limit)
    assert whole
    kept = [d for d in docs if "\n".join(d).strip()]
    text = "\n".join(r["content"] for r in sorted(rows, key=lambda r: r["start_line"]))
    assert text == "\n".join("\n".join(d) for d in kept)
    numbers = [r["chapter_num"] for r in rows if r["kind"] == "chapter"]
    assert numbers == list(range(1, len(numbers) + 1))
    for r in rows:
        assert r["kind"] != "chapter" or r["char_count"] <= limit or "\n" not in r["content"] or r["split"] is None or r["char_count"] < limit + 400


def test_titles_and_back_matter():
    docs = [Doc(["Part One"], {}, "Part One", 1), Doc(["x" * 900], {}), Doc(["y" * 3000 + "。"], {}, "Two", 1), Doc(["z" * 2000], {}, "參考書目", 1)]
    rows, whole = slice_book(docs)
    assert whole and [(r["kind"], r["title"]) for r in rows] == [("chapter", "Part One"), ("chapter", "Two"), ("back", "參考書目")]
    assert not is_back_matter("參考文獻的寫法", 0.9) and is_back_matter("附錄2：網路資源與延伸閱讀", 0.9) and not is_back_matter("Notes", 0.2) and is_back_matter("Selected Bibliography", 0.8)


def test_notes_at_the_end_of_files():
    body = "b" * 500 + "。"
    docs = [Doc([body, "1 note " * 20], {}, "One", 1, 1), Doc([body, "2 note " * 20], {}, None, None, 1), Doc([body], {}, "Two", 1)]
    rows, whole = slice_book(docs)
    assert whole and [(r["kind"], r["title"]) for r in rows] == [("notes", "One：章末注釋"), ("notes", "One：章末注釋"), ("chapter", "One"), ("chapter", "Two")]
    assert rows[2]["content"] == body + "\n" + body


def test_oversize_at_headings_then_paragraphs():
    lines = ["# A", *["p" * 99 + "." for _ in range(60)], "## B", *["q" * 99 + "." for _ in range(60)]]
    rows, whole = slice_book([markdown_doc("\n".join(lines))], 7000)
    assert whole and [(r["title"], r["split"]) for r in rows] == [("A", "heading"), ("A／B", "heading")]
    rows, _ = slice_book([markdown_doc("\n".join(["# A", *lines[1:61]]))], 2500)
    assert [r["title"] for r in rows] == [f"A（{k}/3）" for k in (1, 2, 3)] and {r["split"] for r in rows} == {"paragraph"}


def test_frames(spark):
    md = spark.createDataFrame([("b", 1, "# 書名：X\n---\n# One\n" + "x" * 300 + "\n---\n[圖片]\n---\n# Two\n" + "y" * 300), ("c", 1, None), ("d", 1, "")], "book_id string, doc_no int, content string")
    s = sections(md, "book_id", "content").withColumnRenamed("section_no", "n")
    got = slice_markdown(s, "book_id", ["n"], "section").orderBy("chapter_num").collect()
    assert [(r.book, r.title, r.whole) for r in got] == [("b", "One", True), ("b", "Two", True)]


def test_paragraph_cuts_of_one_long_line(spark):
    df = spark.createDataFrame([(1, "x" * 50_000), (2, "a.\n" * 30 + "b"), (3, ""), (4, None)], "id long, t string")
    got = {}
    for r in paragraph_cuts(lines_of(df, ["id"], "t"), ["id"], 40).collect():
        got.setdefault(r.id, []).append((r.piece_no, r.first_line, r.last_line, r.chars))
    assert got[1] == [(1, 1, 1, 50_000)] and got[3] == [(1, 1, 1, 0)] and 4 not in got
    assert sum(c for *_, c in got[2]) + len(got[2]) - 1 == 91 and max(c for *_, c in got[2]) <= 40
