"""Pages of positioned text: reading order, paragraphs, running heads, headings from bookmarks.

A page's lines are rows (doc, page, block, line, x0, y0, x1, y1, size, bold, text) with the page's
width and height, y growing downwards. Everything but the grouping of vertical columns and the
placing of bookmarks, which keep a running state, is relational.
"""

from __future__ import annotations

import re
import unicodedata
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import grams, join_wrapped, letters_only, squeeze_lines

PAGE = ["doc", "page"]
#: The part of a page above and below which a line is no body text, unless the body itself reaches there.
MARGIN = 0.08
# Marks of list items, beginnings of steps, and ends of finished lines.
BULLET = r"^\s*[•●◆◇■□▪▫○★☆※➢►▶✓✔]"
STEP = r"^\s*(\d{1,2}[.)]?|[–-])\s"
FINISHED = r"[。！？!?」』…:：.]\s*$"


def column_side(x0: Column, x1: Column, width: Column) -> Column:
    """0 for the left half of a page, 1 for the right, null for what spans both."""
    return F.when(x1 <= width / 2 + 5, 0).when(x0 >= width / 2 - 5, 1)


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc, page, block, x0, y0, x1, y1, width, chars) with ``side`` and ``position``.

    A page has two columns if at least two blocks of 40 characters stand in each half; then the left
    column comes before the right one, band by band between the blocks that span both. Other pages
    keep the order of their blocks and have no sides.
    """
    page = Window.partitionBy(*PAGE)
    s = blocks.withColumn("s", column_side(F.col("x0"), F.col("x1"), F.col("width")))
    full = lambda k: F.count_if((F.col("s") == k) & (F.col("chars") >= 40)).over(page) >= 2
    s = s.withColumn("two", full(0) & full(1)).withColumn("wide", (F.col("two") & F.col("s").isNull()).cast("int"))
    above = F.coalesce(F.sum("wide").over(page.orderBy("y0", F.col("wide").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("band", F.when(F.col("two"), above).otherwise(0))
    order = [F.col("band"), F.when(F.col("two"), F.coalesce("s", F.lit(2))).otherwise(0), F.when(F.col("two"), F.col("y0")).otherwise(0.0), F.col("block")]
    return s.withColumn("position", F.row_number().over(page.orderBy(*order))).withColumn("side", F.when(F.col("two"), F.col("s"))).drop("s", "two", "wide", "band")


def right_edges(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., right): the farthest edge that two lines reach within 2 units, else the farthest."""
    w = Window.partitionBy(*keys).orderBy(F.col("x1").desc())
    long = lines.where(F.length(F.trim("text")) > 1).withColumn("next", F.lead("x1").over(w))
    both = long.groupBy(*keys).agg(F.max(F.when(F.col("x1") - F.col("next") <= 2, F.col("x1"))).alias("two"), F.max("x1").alias("one"))
    every = lines.groupBy(*keys).agg(F.max("x1").alias("all"))
    return every.join(both, keys, "left").select(*keys, F.coalesce("two", "one", "all").alias("right"))


def ragged_blocks(lines: DataFrame) -> DataFrame:
    """(doc, page, block, ragged): blocks of three lines or more of mostly Latin letters that don't
    reach a common right edge."""
    last = Window.partitionBy(*PAGE, "block").orderBy("line")
    l = lines.withColumn("more", F.lead("line").over(last).isNotNull())
    letters = F.sum(F.length(F.regexp_replace("text", "[^A-Za-z]", "")))
    chars = F.sum(F.length(F.replace("text", F.lit(" "), F.lit(""))))
    wide = F.avg(F.when(F.col("more"), F.col("x1") - F.col("x0"))) >= 0.7 * (F.max("x1") - F.min("x0"))
    return l.groupBy(*PAGE, "block").agg(F.coalesce((F.count("*") >= 3) & (letters >= 0.6 * chars) & wide, F.lit(False)).alias("ragged"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc, page, para, x0, y0, x1, y1, size, text, open_end) of horizontal pages.

    ``lines`` has ``position`` (of the block, from ``reading_order``) and ``side`` too. A line goes on
    with the paragraph if its size and distance fit, it is no list item and the line before reaches
    the right edge; in a ragged block also if it doesn't, unless something begins. ``open_end`` tells
    that the paragraph may go on on the next page.
    """
    order = Window.partitionBy(*PAGE).orderBy("position", "line")
    by_side = right_edges(lines.where("side is not null"), [*PAGE, "side"]).withColumnRenamed("right", "side_right")
    l = lines.join(right_edges(lines, PAGE), PAGE).join(by_side, [*PAGE, "side"], "left").join(ragged_blocks(lines), [*PAGE, "block"])
    l = l.withColumn("edge", F.coalesce("side_right", "right")).withColumn("reaches", F.col("x1") >= F.col("edge") - 1.5 * F.col("size"))
    before = lambda c: F.lag(c).over(order)
    dy = (F.col("y0") + F.col("y1")) / 2 - (before("y0") + before("y1")) / 2
    fits = (F.abs(F.col("size") - before("size")) <= 0.5) & (dy >= 0.6 * before("size")) & (dy < 2.4 * before("size")) & ~F.col("text").rlike(BULLET)
    flows = before("ragged") & (before("block") == F.col("block")) & (before("bold") == F.col("bold")) & (before("text").rlike(BULLET) | (F.col("x0") <= before("x0") + before("size"))) & ~(before("text").rlike(r"[.!?:;)]\s*$") & F.col("text").rlike(STEP))
    goes_on = F.coalesce(fits & (before("reaches") | flows), F.lit(False))
    l = l.withColumn("starts", (~goes_on).cast("int")).withColumn("para", F.sum("starts").over(order))
    open_end = F.max_by((F.col("reaches") | F.col("ragged")) & ~F.col("text").rlike(FINISHED), F.struct("position", "line"))
    rows = F.sort_array(F.collect_list(F.struct("position", "line", "text", "x0", "y0", "size")))
    g = l.groupBy(*PAGE, "para").agg(rows.alias("rows"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), open_end.alias("open_end"))
    first = F.col("rows")[0]
    return g.select(*PAGE, "para", first["x0"].alias("x0"), first["y0"].alias("y0"), "x1", "y1", first["size"].alias("size"), join_wrapped(F.transform("rows", lambda r: r["text"])).alias("text"), "open_end")


def body_sizes(paras: DataFrame) -> DataFrame:
    """(doc, body): the median size of paragraphs above 30 characters; 10 without any."""
    long = F.when(F.length("text") > 30, F.col("size"))
    return paras.groupBy("doc").agg(F.coalesce(F.percentile(long, 0.5), F.lit(10.0)).alias("body"))


def furniture(paras: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc, page, para) of running heads, footers and page numbers.

    ``paras`` has (doc, page, para, y0, y1, size, text, height, edge). A candidate stands outside the
    text block (where all but one paragraph in fifty of a document lie, if it has twenty long ones) or
    is marked as edge, is short and no larger than the body. It goes if it has no letters, or if most of its four-letter
    pieces stand on three pages or more among candidates; two pieces are enough for an edge.
    """
    long = F.length("text") > 30
    r = paras.where(long).groupBy("doc").agg(F.sort_array(F.collect_list(F.col("y0") / F.col("height"))).alias("t"), F.sort_array(F.collect_list(F.col("y1") / F.col("height"))).alias("b"))
    enough, k = F.size("t") >= 20, F.floor(F.size("t") / 50).cast("int")
    r = r.select("doc", F.when(enough, F.try_element_at("t", k + 1)).otherwise(MARGIN).alias("top"), F.when(enough, F.try_element_at("b", -1 - k)).otherwise(1 - MARGIN).alias("bottom"))
    p = paras.join(r, "doc", "left").fillna({"top": MARGIN, "bottom": 1 - MARGIN}).join(body_sizes(paras), "doc")
    h, s = F.col("height"), F.col("size")
    outside = (F.col("y1") <= h * F.col("top") + s * 0.5) | (F.col("y0") >= h * F.col("bottom") - s * 0.5) | (F.col("y0") < h * MARGIN) | (F.col("y0") > h * (1 - MARGIN))
    cand = p.where((F.col("edge") | outside) & (F.length(F.trim("text")) <= 60) & (s < F.col("body") * 1.15))
    cand = cand.select("doc", "page", "para", "edge", letters_only(F.col("text")).alias("k") if key is None else key.alias("k"))
    pieces = cand.select("doc", "page", "para", "edge", F.explode_outer(F.array_distinct(grams(F.col("k"), 4))).alias("g"))
    often = pieces.where("g is not null").groupBy("doc", "g").agg(F.count_distinct("page").alias("pages")).where("pages >= 3").select("doc", "g", F.lit(1).alias("hit"))
    n = pieces.join(often, ["doc", "g"], "left").groupBy("doc", "page", "para").agg(F.bool_or("edge").alias("edge"), F.count("g").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    gone = (F.col("n") == 0) | F.when(F.col("edge"), F.col("hits") >= F.least(F.lit(2), F.col("n"))).otherwise(F.col("hits") >= 0.6 * F.col("n"))
    return n.where(gone).select("doc", "page", "para")


def top_level(bookmarks: DataFrame) -> DataFrame:
    """(doc, top): the level of a document's chapters: the first, or the second if fewer than three
    bookmarks have the first and there is another."""
    n = bookmarks.groupBy("doc", "level").agg(F.count("*").alias("n"))
    g = n.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("level", "n"))).alias("x"))
    return g.select("doc", F.when((F.col("x")[0]["n"] < 3) & (F.size("x") > 1), F.try_element_at("x", F.lit(2))["level"]).otherwise(F.col("x")[0]["level"]).alias("top"))


def chapter_bookmarks(bookmarks: DataFrame, pages: DataFrame) -> DataFrame:
    """Bookmarks (doc, level, title, page, seq) without those of documents that have one for nearly
    every page under few names. ``pages``: (doc, n)."""
    b = bookmarks.where(F.trim("title") != "").withColumn("title", F.regexp_replace(F.trim("title"), r"\s+", " "))
    n = b.groupBy("doc").agg(F.count("*").alias("m"), F.count_distinct("title").alias("names")).join(pages, "doc")
    lists = n.where(~((F.col("m") >= 0.8 * F.col("n")) & (F.col("names") < 0.5 * F.col("m")))).select("doc")
    return b.join(lists, "doc", "left_semi")


def _key(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", s or "") if c.isalnum())


def place_bookmarks(bookmarks: DataFrame, paras: DataFrame) -> DataFrame:
    """(doc, page, seq, level, title, para): the paragraph each bookmark stands for, null for the top
    of its page. On a page, bookmarks take their turn, and a paragraph is taken once."""

    def run(key, marks: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        free = [(p, _key(t)) for p, t in zip(texts["para"], texts["text"])] if len(texts) else []
        free.sort()
        out = []
        for m in marks.sort_values("seq").itertuples():
            k = _key(m.title)
            fits = lambda t: bool(t) and (t == k or (len(t) >= 2 and (k.startswith(t) or t.startswith(k)) and len(t) <= 1.5 * len(k)))
            hit = next((i for i, (_, t) in enumerate(free) if fits(t)), None)
            out.append((m.doc, m.page, m.seq, m.level, m.title, None if hit is None else free.pop(hit)[0]))
        return pd.DataFrame(out, columns=["doc", "page", "seq", "level", "title", "para"]).astype({"para": "Int64"})

    schema = "doc string, page int, seq int, level int, title string, para bigint"
    return bookmarks.groupBy(*PAGE).cogroup(paras.select(*PAGE, "para", "text").groupBy(*PAGE)).applyInPandas(run, schema)


def vertical_columns(items: DataFrame) -> DataFrame:
    """``items`` (doc, page, item, x0, x1, y0, size, text) of vertical pages with ``col`` and ``row``.

    From right to left, an item joins a column if its centre is within 0.6 of a character's width of
    the running median of the column's centres. One page is one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mid = median(pdf["size"])
        cols: list[list[float]] = []
        at = {}
        for r in sorted(pdf.itertuples(), key=lambda r: (-(r.x0 + r.x1) / 2, r.y0)):
            centre = (r.x0 + r.x1) / 2
            wide = max(r.x1 - r.x0, 0 if re.match("[㐀-鿿]", r.text or "") else mid)
            best = min(range(len(cols)), key=lambda k: abs(median(cols[k]) - centre), default=None)
            if best is None or abs(median(cols[best]) - centre) > 0.6 * wide:
                cols.append([])
                best = len(cols) - 1
            cols[best].append(centre)
            at[r.item] = best
        order = {k: n for n, k in enumerate(sorted(range(len(cols)), key=lambda k: -median(cols[k])), 1)}
        out = pdf.assign(col=[order[at[i]] for i in pdf["item"]]).sort_values(["col", "y0", "item"])
        return out.assign(row=out.groupby("col").cumcount() + 1)

    names = items.columns
    types = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    return items.groupBy(*PAGE).applyInPandas(run, f"{types}, col int, row int").select(*names, "col", "row")


def is_vertical(lines: DataFrame) -> DataFrame:
    """(doc, page, vertical): whether more characters stand in vertical lines (``down``) than in others."""
    n = F.length(F.trim("text"))
    return lines.groupBy(*PAGE).agg((F.coalesce(F.sum(F.when(F.col("down"), n)), F.lit(0)) > F.coalesce(F.sum(F.when(~F.col("down"), n)), F.lit(0))).alias("vertical"))


def join_pages(paras: DataFrame) -> DataFrame:
    """(doc, joined, text): paragraphs in order, those cut by a page end put together.

    A paragraph with an open end takes the first one of the next page; heads in ``heading`` end it.
    The flags are found by windows over a document's short rows, not its texts.
    """
    w = Window.partitionBy("doc").orderBy("page", "para")
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy("para")) == 1
    p = paras.withColumn("f", first).withColumn("on", F.coalesce(F.col("f") & F.lag("open_end").over(w) & (F.lag("page").over(w) == F.col("page") - 1) & ~F.col("heading") & ~F.lag("heading").over(w), F.lit(False)))
    p = p.withColumn("joined", F.sum((~F.col("on")).cast("int")).over(w))
    g = p.groupBy("doc", "joined").agg(F.sort_array(F.collect_list(F.struct("page", "para", "text"))).alias("x"))
    return g.select("doc", "joined", join_wrapped(F.transform("x", lambda x: x["text"])).alias("text"))


def to_markdown(paras: DataFrame, head: Column | None = None) -> DataFrame:
    """(doc, text): joined paragraphs as one text, empty lines squeezed."""
    g = paras.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("joined", "text"))).alias("x"))
    body = squeeze_lines(F.array_join(F.transform("x", lambda x: x["text"]), "\n\n"))
    return g.select("doc", (body if head is None else F.concat(head, F.lit("\n"), body)).alias("text"))
