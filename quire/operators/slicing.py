"""Books cut into chapters so that the pieces join again to the source.

A book is a run of lines with cut points; a point has a rank, and a lower rank is a bigger boundary.
Everything is decided on line lengths and points, so the work on a book is small beside its text.
Books are independent: each is one group, and no group holds more than one book.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters: of a chapter at least and at most, of packed pieces at least, of a part's title page at most.
LEAST, MOST, PACKED, TITLE_PAGE = 200, 40_000, 3_000, 500
#: Ranks: of the table of contents its depth, of headings this plus their level, of untitled files this.
HEADING, FILE = 100, 200
#: Words that make up the titles of back matter, and its English titles.
BACK_WORDS = "注釋 註釋 注解 註解 附註 附注 追記 注 註 參考文獻 參考書目 參考資料 參考材料 參考資源 參考書籍 徵引書目 引文出處 人名索引 中文索引 英文索引 名詞索引 參考 書目 索引 延伸閱讀 進階閱讀 推薦閱讀 推薦書單 資料來源 引用書目 引用文獻 引用資料 資料 網路資源 研究 縮寫說明".split()
BACK_ENGLISH = ("notes", "endnotes", "bibliography", "references", "index", "sources", "further reading")
#: Sentence ends, marks of notes behind them, and what a subtitle neither begins nor ends with.
SENTENCE_ENDS = "。！？!?.…」』）)\"'”’：:；;》〉】]"
NO_SUBTITLE = r"[-*+>|!#「『“\"\[［]|(?:圖|表|figure|table|fig\.)\s*[\d０-９]|(?:書名|作者|譯者|出版社?|isbn)\s*[:：]"
NO_SUBTITLE_END = "。！？!?.…；;，、,：:"

_word = "(?:" + "|".join(sorted(BACK_WORDS, key=len, reverse=True)) + ")"
_back = re.compile(rf"(?:附錄[\d０-９一二三四五六七八九十]*[：:]?)?(?:主要|章節)?{_word}(?:[與及和、之]?{_word})*(?:精選)?")
_notes_end = re.compile(r"[\d①-⑳\[\]\s]+$")


def is_back_matter(title: str | None, place: float) -> bool:
    """Whether a title in the second half of a book (``place`` from 0 to 1) is back matter's."""
    if not title or place < 0.5:
        return False
    plain = " ".join(re.sub("[^a-z ]", "", title.lower()).split()).removeprefix("selected ")
    return plain in BACK_ENGLISH or bool(_back.fullmatch(re.sub(r"[\s∣|｜【】\[\]（）()]", "", title)))


def back_matter(title: Column, place: Column) -> Column:
    """``is_back_matter`` as a native expression."""
    t = F.coalesce(title, F.lit(""))
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z ]", ""), " +", " ")), "^selected ", "")
    chinese = F.regexp_replace(t, r"[\s　∣|｜【】\[\]（）()]", "").rlike(f"^{_back.pattern}$")
    return (place >= 0.5) & (t != "") & (plain.isin(*BACK_ENGLISH) | chinese)


def ends_sentence(line: str) -> bool:
    t = _notes_end.sub("", line.strip())
    return not t or t[-1] in SENTENCE_ENDS


@dataclass
class Doc:
    """A source document: its lines, {line: (rank, title)}, its own title and rank, and the line where
    trailing notes begin."""

    lines: list[str]
    points: dict[int, tuple[int, str | None]]
    lead: str | None = None
    base: int | None = None
    notes: int | None = None


@dataclass
class Piece:
    title: str | None
    ranges: list[tuple[int, int]]
    how: str | None = None
    notes: bool = False


@dataclass
class Book:
    lines: list[str] = field(default_factory=list)
    points: dict[int, tuple[int, str | None]] = field(default_factory=dict)

    def measure(self) -> None:
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in self.lines], dtype=np.int64)]) if self.lines else np.zeros(1, np.int64)

    def size(self, a: int, b: int) -> int:
        """Characters of the lines [a, b), joined."""
        return int(self.ends[b] - self.ends[a]) + max(b - a - 1, 0)

    @property
    def total(self) -> int:
        return self.size(0, len(self.lines)) or 1

    def is_back(self, title: str | None, start: int) -> bool:
        return is_back_matter(title, self.size(0, start) / self.total)

    def text(self, ranges: list[tuple[int, int]]) -> str:
        return "\n".join("\n".join(self.lines[a:b]) for a, b in ranges)


def chapter_starts(doc: Doc, lead: str | None) -> list[tuple[int, str | None]]:
    """(line, title) of the chapters that begin in a document; line 0 only if it has a title."""
    one = Book(doc.lines)
    one.measure()
    inner = sorted(i for i, (rank, _) in doc.points.items() if i > 0 and rank < HEADING)
    base = doc.base
    if base is not None and inner and one.size(0, inner[0]) < TITLE_PAGE:
        base = max(base, min(doc.points[i][0] for i in inner))  # a part's title over its chapters
    cuts = [] if base is None else [i for i in inner if doc.points[i][0] <= base]
    if one.size(0, len(doc.lines)) < PACKED * (len(cuts) + 1):
        cuts = []  # many tiny entries stay one chapter
    title = lead
    if title is None:
        stop = cuts[0] if cuts else len(doc.lines)
        near = [i for i in sorted(doc.points) if i == 0 or (i < stop and one.size(0, i) < LEAST)]
        title = doc.points[near[0]][1] if near else None
    return [(0, title)] * (title is not None) + [(i, doc.points[i][1]) for i in cuts]


def gather(docs: list[Doc]) -> tuple[Book, list[tuple[int, str | None]], list[tuple[int, int]]]:
    """(book, chapter starts, ranges of trailing notes) of documents in reading order."""
    book, starts, notes = Book(), [], []
    waiting, title_page = None, False
    for doc in docs:
        text = "\n".join(doc.lines)
        if not text.strip():
            waiting = doc.lead or waiting
            continue
        cuts = chapter_starts(doc, doc.lead or waiting)
        if title_page and doc.lead is None and cuts and cuts[0][0] == 0:
            del cuts[0]  # the text behind a title page belongs to it
        if doc.lead:
            title_page = len(text) < TITLE_PAGE
        else:
            title_page = title_page and not cuts and len(text) < LEAST
        waiting = None
        at = len(book.lines)
        if doc.notes is not None and doc.notes < len(doc.lines):
            notes.append((at + doc.notes, at + len(doc.lines)))
        book.lines += doc.lines
        book.points |= {at + i: p for i, p in doc.points.items()}
        if at and at not in book.points and not (cuts and cuts[0][0] == 0):
            book.points[at] = (FILE, None)
        starts += [(at + i, t) for i, t in cuts]
    book.measure()
    if book.lines and (not starts or starts[0][0]):
        starts.insert(0, (0, None))
    return book, starts, notes


def merge_short(book: Book, starts: list[tuple[int, str | None]]) -> list[tuple[str | None, int, int]]:
    """(title, start, end): segments, those under ``LEAST`` joined to the next or, at the end, the one before.

    Back matter keeps its own segment however short, and a short piece before it goes backwards.
    """
    ends = [i for i, _ in starts[1:]] + [len(book.lines)]
    segments = [(t, a, b) for (a, t), b in zip(starts, ends)]
    if len(segments) < 2:
        return segments
    out: list[tuple[str | None, int, int]] = []

    def back_to_last(end: int, otherwise: tuple) -> None:
        out[-1:] = [(out[-1][0], out[-1][1], end)] if out else [otherwise]

    short = None
    for seg in segments:
        if short is not None:
            if book.is_back(seg[0], seg[1]) and not book.is_back(short[0], short[1]):
                back_to_last(short[2], short)
            else:
                part = bool(seg[0] and short[0] and seg[0].startswith(short[0] + "／"))
                seg = (short[0] if part else seg[0] or short[0], short[1], seg[2])
            short = None
        if book.size(seg[1], seg[2]) < LEAST and not book.is_back(seg[0], seg[1]):
            short = seg
        else:
            out.append(seg)
    if short is not None:
        back_to_last(short[2], short)
    return out


def part_notes(book: Book, segments: list[tuple[str | None, int, int]], notes: list[tuple[int, int]], limit: int) -> list[Piece]:
    """Segments with trailing notes taken out; a body between notes stays one piece if it fits."""
    out = []
    for title, a, b in segments:
        own = [] if book.is_back(title, a) else [(max(x, a), min(y, b)) for x, y in notes if max(x, a) < min(y, b)]
        if not own:
            out.append(Piece(title, [(a, b)]))
            continue
        edges = sorted({a, b, *(e for r in own for e in r)})
        runs: list[list] = []
        for x, y in pairwise(edges):
            noted = (x, y) in own or book.size(x, y) < LEAST
            if runs and runs[-1][2] == noted:
                runs[-1][1] = y
            else:
                runs.append([x, y, noted])
        bodies: list[list[tuple[int, int]]] = []
        room = 0
        for x, y, noted in runs:
            if noted:
                out.append(Piece(title, [(x, y)], notes=True))
                continue
            n = book.size(x, y)
            if not bodies or room + 1 + n > limit:
                bodies.append([])
                room = -1
            bodies[-1].append((x, y))
            room += 1 + n
        many = title and len(bodies) > 1
        out += [Piece(f"{title}（{k}/{len(bodies)}）" if many else title, r) for k, r in enumerate(bodies, 1)]
    return out


def paragraph_bounds(book: Book, a: int, b: int, limit: int) -> list[tuple[int, int]]:
    """[a, b) in pieces of at most ``limit``: once a piece has its even share it ends with the next
    sentence; a line above the limit is a piece of its own."""
    total = book.size(a, b)
    share = total / math.ceil(total / limit)
    bounds = [a]
    for i in range(a + 1, b):
        have = book.size(bounds[-1], i)
        if book.size(bounds[-1], i + 1) > limit or (have >= share and ends_sentence(book.lines[i - 1])):
            bounds.append(i)
    return list(pairwise([*bounds, b]))


def packed(book: Book, title: str | None, bounds: list[int], limit: int) -> list[tuple[str | None, int, int]]:
    """Neighbouring spans put together up to ``PACKED`` characters and never past ``limit``, but that a
    tiny one always takes the next; named by the first and last of what they hold."""
    groups: list[list[int]] = [[bounds[0]]]
    for x, y in pairwise(bounds):
        start = groups[-1][0]
        if x > start:
            have = book.size(start, x)
            if have >= PACKED or (have >= LEAST and book.size(start, y) > limit):
                groups.append([x])
            else:
                groups[-1].append(x)
    if len(groups) > 1:
        end = bounds[-1]
        if book.size(groups[-1][0], end) < LEAST and book.size(groups[-2][0], end) <= limit:
            groups[-2:] = [groups[-2] + groups[-1]]
    name = lambda i: None if i == bounds[0] else book.points[i][1]
    out = []
    for g, end in zip(groups, [g[0] for g in groups[1:]] + [bounds[-1]]):
        first, last = name(g[0]), name(g[-1])
        sub = first if first is None or last is None or len(g) == 1 else f"{first}～{last}"
        out.append(("／".join(x for x in (title, sub) if x) or None if sub is not None else title, g[0], end))
    return out


def refined(book: Book, title: str | None, a: int, b: int, limit: int, how: str | None = None) -> list[Piece]:
    """[a, b) cut while above ``limit``: at the biggest boundaries that give two pieces, else between paragraphs."""
    if book.size(a, b) <= limit:
        return [Piece(title, [(a, b)], how)]
    inner = {i: rank for i, (rank, _) in book.points.items() if a < i < b}
    for rank in sorted(set(inner.values())):
        parts = packed(book, title, [a, *sorted(i for i, r in inner.items() if r == rank), b], limit)
        if len(parts) > 1:
            by = "toc_sub" if rank < HEADING else "heading"
            return [p for t, x, y in parts for p in refined(book, t, x, y, limit, by)]
    cuts = paragraph_bounds(book, a, b, limit)
    if len(cuts) == 1:
        return [Piece(title, cuts, how)]
    return [Piece(title and f"{title}（{k}/{len(cuts)}）", [r], "paragraph") for k, r in enumerate(cuts, 1)]


def subtitle(book: Book, a: int, b: int) -> str | None:
    """The first line of [a, b) if it reads like a heading that wasn't marked."""
    filled = (i for i in range(a, b) if book.lines[i].strip())
    i = next(filled, None)
    if i is None or i + 1 >= b:
        return None
    before = next((x for x in reversed(book.lines[:i]) if x.strip()), None)
    s = book.lines[i].replace("**", "").replace("__", "").strip()
    fits = 2 <= len(s) <= 25 and not re.match(NO_SUBTITLE, s, re.I) and s[-1] not in NO_SUBTITLE_END and re.search(r"[^\W\d_]", s)
    return s if fits and (before is None or ends_sentence(before)) else None


def named(book: Book, pieces: list[Piece]) -> list[Piece]:
    """Pieces of one chapter with equal titles numbered, and numbered ones given their subtitle."""
    if len(pieces) < 2:
        return pieces
    count, seen = Counter(p.title for p in pieces), Counter()
    for p in pieces:
        old = p.title
        seen[old] += 1
        if old and count[old] > 1:
            p.title = f"{old}（{seen[old]}/{count[old]}）"
        if p.title and (p.how == "paragraph" or count[old] > 1):
            sub = subtitle(book, p.ranges[0][0], p.ranges[-1][1])
            if sub and sub not in p.title:
                p.title += f"／{sub}"
    return pieces


def slice_book(docs: list[Doc], limit: int = MOST) -> tuple[list[dict], bool]:
    """(rows, whole): chapters and back matter of a book in order, and whether they join to the source."""
    book, starts, notes = gather(docs)
    rows, ranges, num = [], [], 0
    for part in part_notes(book, merge_short(book, starts), notes, limit) if book.lines else []:
        back = part.notes or book.is_back(part.title, part.ranges[0][0])
        if part.notes:
            part.title = f"{part.title or '（無標題）'}：章末注釋"
        alone = back or len(part.ranges) > 1
        for p in [part] if alone else named(book, refined(book, part.title, *part.ranges[0], limit)):
            num += not back
            ranges += p.ranges
            text = book.text(p.ranges)
            rows.append({"kind": "notes" if part.notes else "back" if back else "chapter", "chapter_num": None if back else num, "title": p.title or f"第 {num} 節", "char_count": len(text), "content": text, "split": p.how, "start_line": p.ranges[0][0]})
    ranges.sort()
    tiles = [e for r in ranges for e in r]
    whole = tiles[1:-1:2] == tiles[2::2] and (not tiles or (tiles[0], tiles[-1]) == (0, len(book.lines))) and book.text(ranges) == "\n".join(book.lines)
    return rows, whole


def markdown_doc(section: str) -> Doc:
    """A section of converted text with its headings as points."""
    lines = section.split("\n")
    found = ((i, re.match(r"(#{1,6})\s+(.+)", s)) for i, s in enumerate(lines))
    return Doc(lines, {i: (HEADING + len(m[1]), m[2].strip()) for i, m in found if m})


CHAPTERS = "book string, kind string, chapter_num int, title string, char_count int, content string, split string, start_line int, whole boolean"


def slice_markdown(sections: DataFrame, book: str, order: list[str], section: str, limit: int = MOST) -> DataFrame:
    """(book, kind, chapter_num, title, char_count, content, split, start_line, whole) of every book.

    ``sections`` are parts of converted texts (``lines.sections``) with their order. Back matter has
    kind ``back`` and no number. ``whole`` tells that the pieces tile the book and join to it. Books
    without a section have no row.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        rows, whole = slice_book([markdown_doc(s) for s in pdf[section]], limit)
        out = pd.DataFrame(rows, columns=["kind", "chapter_num", "title", "char_count", "content", "split", "start_line"])
        out["chapter_num"] = out["chapter_num"].astype("Int32")
        return out.assign(book=pdf[book].iloc[0], whole=whole)[CHAPTERS_COLUMNS]

    return sections.select(book, *order, section).groupBy(book).applyInPandas(run, CHAPTERS)


CHAPTERS_COLUMNS = [c.split()[0] for c in CHAPTERS.split(", ")]


def paragraph_cuts(lines: DataFrame, keys: list[str], limit: Column | int = MOST) -> DataFrame:
    """(keys..., piece_no, first_line, last_line, chars): every text cut between lines by an even share.

    ``lines`` has (keys..., line_no, line). The fold runs over line lengths and sentence ends of one
    text, never over its characters.
    """
    from quire.functions.text import ends_sentence as ends

    lim = limit if isinstance(limit, Column) else F.lit(limit)
    row = F.struct("line_no", F.length("line").alias("n"), ends(F.col("line")).alias("e"))
    t = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("x"), (F.sum(F.length("line")) + F.count("*") - 1).alias("total"))
    t = t.withColumn("share", F.col("total") / F.greatest(F.ceil(F.col("total") / lim), F.lit(1)))

    def step(s: Column, x: Column) -> Column:
        fresh = s["lines"] == 0
        grown = s["size"] + x["n"] + F.when(fresh, 0).otherwise(1)
        cut = ~fresh & ((grown > lim) | ((s["size"] >= s["share"]) & s["e"]))
        return F.struct(
            F.when(cut, 1).otherwise(s["lines"] + 1).alias("lines"),
            F.when(cut, x["n"]).otherwise(grown).cast("long").alias("size"),
            x["e"].alias("e"),
            s["share"].alias("share"),
            F.when(cut | fresh, F.array_append(s["out"], x["line_no"])).otherwise(s["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("lines"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("e"), F.col("share").alias("share"), F.array().cast("array<int>").alias("out"))
    cuts = t.withColumn("first", F.aggregate("x", zero, step, lambda s: s["out"])).select(*keys, F.posexplode("first").alias("p", "first_line"), "first", F.element_at("x", -1)["line_no"].alias("end"))
    spans = cuts.select(*keys, (F.col("p") + 1).alias("piece_no"), "first_line", (F.coalesce(F.get("first", F.col("p") + 1), F.col("end") + 1) - 1).alias("last_line"))
    sizes = lines.select(*keys, "line_no", F.length("line").alias("n"))
    return spans.join(sizes, keys).where("line_no between first_line and last_line").groupBy(*keys, "piece_no", "first_line", "last_line").agg((F.sum("n") + F.count("*") - 1).alias("chars"))
