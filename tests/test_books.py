"""EPUB files made here, read, converted and sliced; a damaged one beside them."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions.html import decode, insert_headings, is_title, parse, text_lines, to_markdown
from quire.sources import books as B
from quire.sources import files as S


def epub(title="甲書", docs=None, ncx=True):
    docs = docs or {"text/a.xhtml": "<html><body><h1>One</h1><p>" + "alpha " * 120 + "</p></body></html>", "text/b.xhtml": '<html><body><p id="t2">Two</p><p>' + "beta " * 120 + '</p><p class="footnote">1 a note</p></body></html>'}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(docs))
        spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(docs)))
        z.writestr("OEBPS/c.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title><dc:creator>乙</dc:creator></metadata><manifest>{items}<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>{spine}</spine></package>')
        if ncx:
            z.writestr("OEBPS/toc.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml"/></navPoint><navPoint><navLabel><text>Two</text></navLabel><content src="text/b.xhtml#t2"/></navPoint></navMap></ncx>')
        for n, h in docs.items():
            z.writestr("OEBPS/" + n, h)
    return out.getvalue()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    (root / "x").mkdir()
    (root / "x" / "甲.epub").write_bytes(epub())
    (root / "bad.epub").write_bytes(b"no zip at all")
    (root / "p.pdf").write_bytes(b"%PDF-1.4")
    assert {r.kind for r in B.scan(spark, str(root)).collect()} == {"epub", "pdf"}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(str(root))
    return B.epub_documents(files)


def test_documents(docs):
    rows = docs.orderBy("doc_no").collect()
    good = [r for r in rows if r.error is None]
    assert [r.error is None for r in rows].count(False) == 1
    assert [(r.title, r.author, r.doc_no, r.lead) for r in good] == [("甲書", "乙", 1, "One"), ("甲書", "乙", 2, None)]
    assert [(t.fragment, t.title) for t in good[1].toc] == [("t2", "Two")]


def test_markdown_and_chapters(docs):
    md = B.book_markdown(B.documents_to_markdown(docs)).collect()
    assert len(md) == 1 and md[0].text.startswith("# One\n\nalpha") and "\n\n---\n\n# Two\n\nbeta" in md[0].text
    got = B.slice_epubs(docs).orderBy("start_line").collect()
    assert all(r.whole for r in got) and [(r.kind, r.title) for r in got] == [("chapter", "One"), ("chapter", "Two"), ("notes", "Two：章末注釋")]


def test_resolve():
    d = ["OEBPS/text/a.html", "OEBPS/other/b.html", "x/b.html"]
    assert B.resolve("OEBPS/text/a.html", d) == d[0] and B.resolve("text/a.html", d) == d[0] and B.resolve("b.html", d) == "b.html" and B.resolve("other/b.html", d) == d[1]


def test_decode():
    assert decode("<p>中</p>".encode("big5")) == "<p>中</p>" and decode(b'<?xml version="1.0"?><p>x</p>') == "<p>x</p>" and decode(b"\xef\xbb\xbfx") == "x"


def test_html_to_markdown():
    assert to_markdown("<p>a<b>b</b> <a href='x.html'>in</a> <a href='http://e.x/'>out</a></p><hr/><ul><li>1<li>2</ul>") == "a**b** in [out](http://e.x/)\n\n* * *\n\n* 1\n* 2"
    assert to_markdown("<script>x='</p>'</script><nav>n</nav><p>t &amp; u<!-- c --></p>") == "t & u"
    assert to_markdown("<img src=a><h1><img src=b>T</h1><img alt=cat>") == "[圖片]\n\n# T\n\n[圖片說明: cat]"
    assert to_markdown("<pre>a\n  b</pre>") == "```\na\n  b\n```" and to_markdown("") == ""


def test_headings_from_toc():
    t = parse('<p id="a">Chapter One</p><p>word <span id="b"></span>more</p><h2 id="c">Has</h2>')
    assert insert_headings(t, [("a", "Chapter One", 1), ("b", "X", 2), ("c", "Has", 1), ("zz", "None", 1)]) == ["None"]
    assert [n.tag for n in t.walk() if n.tag in ("h1", "h2")] == ["h1", "h2"]
    assert is_title("第一章 開始", "開始") and not is_title("開始的時候。", "開始的")


def test_text_lines():
    lines, points, notes = text_lines('<h1>T</h1><p>a<br>b</p><aside class="note">c</aside><p class="fn1">n</p>')
    assert lines == ["T", "a", "b", "c", "n"] and points == {0: (101, "T")} and notes == 4


def test_candidates(spark, docs):
    assert B.quotation_candidates(docs).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"books": {"a b": {"book_id": "a_b", "title": "T", "status": "raw"}, "c": {"title": null}}}', encoding="utf-8")
    assert sorted((r.book_id, r.title) for r in S.read_manifest(spark, str(tmp_path / "m.json")).collect()) == [("a_b", "T"), ("c", None)]
    (tmp_path / "l.jsonl").write_text('{"ts": "1", "action": "scan", "book_id": "x"}\n{"ts": "2", "act\n', encoding="utf-8")
    assert S.read_log(spark, str(tmp_path / "l.jsonl")).count() == 1
    (tmp_path / "ids").write_text("# head\na\n\n b # c\n")
    assert [r.book_id for r in S.read_ids(spark, str(tmp_path / "ids")).collect()] == ["a", "b"]
    moves = S.move_plan(spark.createDataFrame([("b", "x/a.epub", None, "m/a.md")], "book_id string, epub_path string, pdf_path string, md_path string"), F.lit("law"), F.lit(None), spark.createDataFrame([("x/a.epub",)], "p string"))
    assert [tuple(r) for r in moves.collect()] == [("b", "epub_path", "x/a.epub", "law/a.epub")]
