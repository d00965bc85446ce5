"""EPUB files, folders of books and converted texts as DataFrames.

Files are read as binary rows and opened one at a time inside an Arrow-batched function; a damaged
file gives a row with its error and never fails the others.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.html import decode, emphasised, text_lines, to_markdown
from quire.functions.text import stem
from quire.operators.slicing import CHAPTERS, CHAPTERS_COLUMNS, Doc, slice_book


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, bytes): EPUB and PDF files below a folder, not their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{epub,pdf,EPUB,PDF}").load(root)
    return files.select("path", F.lower(F.element_at(F.split("path", r"\."), -1)).alias("kind"), F.col("length").alias("bytes"))


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text): Markdown files below a folder, in UTF-8."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("wholetext", "true").text(root)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def index_by_stem(files: DataFrame) -> DataFrame:
    """(stem, path): of several files with one stem the last path."""
    return files.groupBy(stem(F.col("path")).alias("stem")).agg(F.max("path").alias("path"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class Epub:
    """An opened EPUB: metadata, documents in reading order and the table of contents."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.missing: list[str] = []
        box = self._xml("META-INF/container.xml")
        opf = next((e.get("full-path") for e in box.iter() if _local(e.tag) == "rootfile"), None) if box is not None else None
        self.opf = opf or next((n for n in sorted(self.names) if n.endswith(".opf")), "")
        root = self._xml(self.opf)
        self.meta: dict[str, str] = {}
        self.items: dict[str, dict[str, str]] = {}
        self.spine: list[str] = []
        for e in [] if root is None else root.iter():
            name = _local(e.tag)
            if name in ("title", "creator", "language", "publisher") and (e.text or "").strip():
                self.meta.setdefault(name, e.text.strip())
            elif name == "item":
                self.items[e.get("id", "")] = dict(e.attrib)
            elif name == "itemref":
                self.spine.append(e.get("idref", ""))

    def read(self, name: str) -> bytes:
        """A member; one that is absent is empty and noted."""
        try:
            return self.zip.read(name)
        except (KeyError, zipfile.BadZipFile, OSError):
            self.missing.append(name)
            return b""

    def _xml(self, name: str):
        if name not in self.names:
            return None
        try:
            return ElementTree.fromstring(self.read(name))
        except ElementTree.ParseError:
            return None

    def at(self, href: str, base: str | None = None) -> str:
        return posixpath.normpath(posixpath.join(posixpath.dirname(base or self.opf), unquote(href)))

    def documents(self) -> list[str]:
        """Members of the spine that are documents, in reading order; navigation isn't content."""
        out = []
        for i in self.spine:
            item = self.items.get(i)
            if item and "html" in item.get("media-type", "") and "nav" not in item.get("properties", "").split():
                out.append(self.at(item.get("href", "")))
        return out

    def toc(self) -> list[tuple[str, str, str, int]]:
        """(document, fragment, title, depth) from the navigation document, else from the NCX."""
        nav = next((self.at(x["href"]) for x in self.items.values() if "nav" in x.get("properties", "").split()), None)
        got = self._nav(nav) if nav else []
        ncx = next((self.at(x["href"]) for x in self.items.values() if "dtbncx" in x.get("media-type", "")), None)
        raw = got or (self._ncx(ncx) if ncx else [])
        docs = self.documents()
        return [(resolve(path, docs), fragment, title, depth) for path, fragment, title, depth in raw]

    def _ncx(self, name: str) -> list[tuple[str, str, str, int]]:
        root, out = self._xml(name), []

        def walk(e, depth: int) -> None:
            for p in e:
                if _local(p.tag) != "navPoint":
                    continue
                title = " ".join("".join(next((x for x in p if _local(x.tag) == "navLabel"), ElementTree.Element("x")).itertext()).split())
                src = next((x.get("src", "") for x in p if _local(x.tag) == "content"), "")
                if title:
                    path, _, fragment = src.partition("#")
                    out.append((self.at(path, name) if path else "", fragment, title, depth))
                walk(p, depth + 1)

        for e in [] if root is None else root.iter():
            if _local(e.tag) == "navMap":
                walk(e, 1)
        return out

    def _nav(self, name: str) -> list[tuple[str, str, str, int]]:
        from quire.functions.html import parse

        root, out = parse(decode(self.read(name))), []
        navs = root.all("nav")
        nav = next((n for n in navs if "toc" in n.attrs.get("epub:type", "").split()), navs[0] if navs else None)
        for a in [] if nav is None else nav.all("a"):
            title = " ".join(a.plain().split())
            depth = sum(1 for x in a.up() if x.tag == "ol")
            path, _, fragment = a.attrs.get("href", "").partition("#")
            if title:
                out.append((self.at(path, name) if path else name, fragment, title, max(depth, 1)))
        return out


def resolve(path: str, documents: list[str]) -> str:
    """The document a path means: itself, else the only one with the longest common ending, else itself."""
    if path in documents:
        return path
    parts = path.split("/")
    for k in range(len(parts)):
        end = "/".join(parts[k:])
        fits = [d for d in documents if d == end or d.endswith("/" + end)]
        if fits:
            return fits[0] if len(fits) == 1 else path
    return path


BOOK = "path string, title string, author string, language string, doc_no int, href string, lead string, depth int, html string, toc array<struct<fragment string, title string, depth int>>, error string"


def epub_documents(files: DataFrame) -> DataFrame:
    """One row for each document of each EPUB in ``files`` (path, content), with its part of the
    table of contents; a file that can't be opened gives one row with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = pa.struct([("fragment", pa.string()), ("title", pa.string()), ("depth", pa.int32())])
        schema = pa.schema([("path", pa.string()), ("title", pa.string()), ("author", pa.string()), ("language", pa.string()), ("doc_no", pa.int32()), ("href", pa.string()), ("lead", pa.string()), ("depth", pa.int32()), ("html", pa.string()), ("toc", pa.list_(entry)), ("error", pa.string())])
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                rows = []
                try:
                    book = Epub(data.as_py() or b"")
                    toc = book.toc()
                    for k, name in enumerate(book.documents(), 1):
                        own = [t for t in toc if t[0] == name]
                        lead = next((t for t in own if not t[1]), None)
                        rows.append({"path": path, "title": book.meta.get("title", "Unknown Title"), "author": book.meta.get("creator", "Unknown Author"), "language": book.meta.get("language"), "doc_no": k, "href": name, "lead": lead and lead[2], "depth": lead and lead[3], "html": decode(book.read(name)), "toc": [{"fragment": f, "title": t, "depth": d} for _, f, t, d in own if f], "error": None})
                except Exception as e:  # one damaged book must not stop the others
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, BOOK)


def documents_to_markdown(docs: DataFrame) -> DataFrame:
    """(path, doc_no, md): each document as Markdown; an empty page keeps its title as a heading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                md = to_markdown(r["html"] or "", [(t["fragment"], t["title"], t["depth"]) for t in r["toc"] or []])
                head = f"{'#' * min(max(r['depth'] or 1, 1), 6)} {r['lead']}" if r["lead"] else ""
                first = md.split("\n", 1)[0]
                out.append(md if not head or re.match(r"#{1,6} ", first) else f"{head}\n\n{md}".strip())
            yield pa.RecordBatch.from_pydict({"path": pa.array([r["path"] for r in rows], pa.string()), "doc_no": pa.array([r["doc_no"] for r in rows], pa.int32()), "md": pa.array(out, pa.string())})

    return docs.where("error is null").select("path", "doc_no", "lead", "depth", "html", "toc").mapInArrow(run, "path string, doc_no int, md string")


def book_markdown(md: DataFrame, head: Column | None = None) -> DataFrame:
    """(path, text): a book's documents in order, empty ones left out, parted by rules."""
    parts = md.where(F.trim("md") != "").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("doc_no", "md"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["md"]), "\n\n---\n\n")
    return parts.select("path", (text if head is None else F.concat(head, F.lit("\n"), text)).alias("text"))


def slice_epubs(docs: DataFrame, limit: int = 40_000) -> DataFrame:
    """The chapters of every book of ``epub_documents``, notes at the ends of files taken out."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = []
        for r in pdf.sort_values("doc_no").itertuples():
            lines, points, notes = text_lines(r.html or "", [(t["fragment"], t["title"], t["depth"]) for t in (r.toc if r.toc is not None else [])])
            ranks = [k for k, _ in points.values() if k < 100]
            lead = r.lead if isinstance(r.lead, str) else None
            made.append(Doc(lines, points, lead, int(r.depth) if lead else min(ranks, default=None), notes))
        rows, whole = slice_book(made, limit)
        out = pd.DataFrame(rows, columns=["kind", "chapter_num", "title", "char_count", "content", "split", "start_line"])
        out["chapter_num"] = out["chapter_num"].astype("Int32")
        return out.assign(book=pdf["path"].iloc[0], whole=whole)[CHAPTERS_COLUMNS]

    return docs.where("error is null").select("path", "doc_no", "lead", "depth", "html", "toc").groupBy("path").applyInPandas(run, CHAPTERS)


def quotation_candidates(docs: DataFrame) -> DataFrame:
    """(path, doc_no, source, text): bold passages and paragraphs of summaries, each once in a book."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["path"], r["doc_no"], s, t) for r in b.to_pylist() for s, t in emphasised(r["html"] or "")]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_pydict({"path": pa.array(cols[0], pa.string()), "doc_no": pa.array(cols[1], pa.int32()), "source": pa.array(cols[2], pa.string()), "text": pa.array(cols[3], pa.string())})

    from quire.operators.rows import first_of

    found = docs.where("error is null").select("path", "doc_no", "html").mapInArrow(run, "path string, doc_no int, source string, text string")
    return first_of(found, ["path", "text"], [F.col("doc_no"), F.col("source")]).select("path", "doc_no", "source", "text")
