"""Splitting oversized items at natural boundaries (problem 6).

Method: pointer doubling. Every boundary is joined to its farthest legal successor (the overlap
counted in); the successor table is then squared again and again, so all greedy cuts of all items
come out in a logarithmic number of joins.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import materialize

HEADING, PARAGRAPH, SENTENCE, HARD = 1, 2, 3, 4
END = 0
NAMES = {HEADING: "heading", PARAGRAPH: "paragraph", SENTENCE: "sentence", HARD: "none"}

_heading = re.compile(r"^#{1,6}[ \t]+\S", re.M)
_newline = re.compile(r"\n")
_sentence = re.compile(r"[.!?。！？]")


def boundaries_of(text: str, limit: int, overlap: int, min_fill: float) -> tuple[list[int], list[int]]:
    """Positions where ``text`` may be cut and the best level of each.

    0 and the end are always there. Where two neighbours are further apart than a piece after the
    first may be long, a cut between them can't be avoided: hard cuts are set a full piece after
    the first of them and after each boundary that lies at most ``min_fill`` before it, and every
    full piece from there on, so that none of these need make a short piece.
    """
    at: dict[int, int] = {}
    for m in _sentence.finditer(text):
        at[m.end()] = SENTENCE
    for m in _newline.finditer(text):
        at[m.end()] = PARAGRAPH
    for m in _heading.finditer(text):
        at[m.start()] = HEADING
    at[0] = at[len(text)] = END
    step, least = limit - overlap, int(min_fill * limit)
    natural, pos = sorted(at), []
    for a, b in zip(natural, natural[1:]):
        pos.append(a)
        if b - a > step:
            hard: set[int] = set()
            for p in pos[bisect_left(pos, a - least) :]:
                hard.update(m for m in range(p + (step if p else limit), b, step) if m > a)
            at.update(dict.fromkeys(hard, HARD))
            pos += sorted(hard)
    pos = sorted(at)
    return pos, [at[p] for p in pos]


def _boundaries_udf(limit: int, overlap: int, min_fill: float):
    @F.pandas_udf(T.StructType().add("pos", T.ArrayType(T.IntegerType())).add("level", T.ArrayType(T.IntegerType())))
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            got = [boundaries_of(t, limit, overlap, min_fill) for t in s]
            yield pd.DataFrame({"pos": [a for a, _ in got], "level": [b for _, b in got]})

    return cut


def boundaries(df: DataFrame, id_col: str, text: str, limit: int, overlap: int, min_fill: float = 0.0) -> DataFrame:
    """(id, pos, level, size) of each item with more than ``limit`` code points.

    Items that fit, and null texts, never reach Python. An id given by several equal rows counts once.
    """
    big = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.length("text") > limit)
    cut = big.select("id", F.length("text").alias("size"), _boundaries_udf(limit, overlap, min_fill)("text").alias("b"))
    return cut.select("id", "size", F.inline(F.arrays_zip(F.col("b.pos").alias("pos"), F.col("b.level").alias("level")))).repartition("id").distinct()


def successors(b: DataFrame, keys: list[str], limit: int, overlap: int, min_fill: float) -> DataFrame:
    """(keys, pos, succ): the farthest boundary that makes a legal piece, of the best level there is.

    Boundaries and questions ("what is the last boundary at or before pos + limit?") are sorted
    together once; a running ``last`` of each level answers all of them, so no window frame grows.
    A piece after the first begins ``overlap`` before its boundary and is shorter by as much.
    """
    reach = F.when(F.col("pos") == 0, limit).otherwise(limit - overlap)
    marks = b.select(*keys, F.col("pos").alias("at"), F.lit(0).alias("ask"), "pos", "level")
    asks = b.where("pos < size").select(*keys, (F.col("pos") + reach).alias("at"), F.lit(1).alias("ask"), "pos", "level")
    w = Window.partitionBy(*keys).orderBy("at", "ask", "pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda cond: F.last(F.when((F.col("ask") == 0) & cond, F.col("pos")), ignorenulls=True).over(w)
    t = marks.unionByName(asks).select(
        *keys,
        "ask",
        "pos",
        last((F.col("level") == END) & (F.col("pos") > 0)).alias("e"),
        *(last(F.col("level") == k).alias(f"s{k}") for k in (HEADING, PARAGRAPH, SENTENCE, HARD)),
    )
    least = F.lit(int(min_fill * limit))
    good = [F.when(F.col(f"s{k}") > F.col("pos") + least, F.col(f"s{k}")) for k in (HEADING, PARAGRAPH, SENTENCE)]
    any_ = F.greatest(*(F.when(F.col(f"s{k}") > F.col("pos"), F.col(f"s{k}")) for k in (HEADING, PARAGRAPH, SENTENCE, HARD)))
    return t.where("ask = 1").select(*keys, "pos", F.coalesce(F.when(F.col("e") > F.col("pos"), F.col("e")), *good, any_).alias("succ")).where("succ is not null")


def reached(succ: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos) of all cuts reached from 0, by squaring the successor table.

    After round k the table leads 2^k pieces on and the reached cuts are those of the first 2^k
    pieces, so the rounds are the logarithm of the number of pieces of the longest item.
    """
    table = materialize(succ, "succ")
    got = table.where("pos = 0").select(*keys, "pos")
    rounds = 0
    while True:
        step = table.select(*keys, "pos", F.col("succ").alias("__to"))
        more = got.join(step, [*keys, "pos"]).select(*keys, F.col("__to").alias("pos"))
        got = materialize(got.unionByName(more).distinct(), "cuts")
        follow = table.select(*keys, F.col("pos").alias("__to"), "succ")
        table = materialize(step.join(follow, [*keys, "__to"]).select(*keys, "pos", "succ"), "succ")
        rounds += 1
        if table.isEmpty() or rounds > 40:
            return got


def split_items(df: DataFrame, id_col: str, title: str, text: str, limit: int = 40_000, overlap: int = 200, min_fill: float = 0.25) -> DataFrame:
    """(id, piece_no, pieces, title, start, end, n_chars, content) of each item above ``limit``.

    ``start`` and ``end`` are code points without the overlap, which precedes them in ``content``
    of every piece but the first; so no piece is longer than ``limit`` and the pieces without their
    overlap join to the text. A cut is made at the farthest heading, else line feed, else sentence
    end that leaves at least ``min_fill`` of the limit, else at the farthest of any level. Where a
    cut inside a sentence can't be avoided, it is made a full piece on, not at a boundary near the
    piece's begin. Titles become "title（k/n）"; a null or empty title counts as "（無標題）".
    Items that fit or have no text give no row.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    b = materialize(boundaries(df, id_col, text, limit, overlap, min_fill), "bounds")
    cuts = reached(successors(b, ["id"], limit, overlap, min_fill), ["id"])
    w = Window.partitionBy("id").orderBy("pos")
    spans = (
        cuts.select("id", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.row_number().over(w).alias("piece_no"), F.count("*").over(Window.partitionBy("id")).alias("cuts"))
        .where("end is not null")
        .select("id", "start", "end", "piece_no", (F.col("cuts") - 1).cast("int").alias("pieces"))
    )
    src = df.select(F.col(id_col).alias("id"), F.col(title).alias("__title"), F.col(text).alias("__text")).where(F.length("__text") > limit).dropDuplicates(["id"])
    begin = F.greatest(F.col("start") - overlap, F.lit(0))
    name = F.coalesce(F.when(F.trim("__title") != "", F.col("__title")), F.lit("（無標題）"))
    return spans.join(src, "id").select(
        F.col("id").alias(id_col),
        "piece_no",
        "pieces",
        F.concat(name, F.lit("（"), "piece_no", F.lit("/"), "pieces", F.lit("）")).alias("title"),
        "start",
        "end",
        (F.col("end") - begin).alias("n_chars"),
        F.substring(F.col("__text"), begin + 1, F.col("end") - begin).alias("content"),
    )


def boundary_levels(df: DataFrame, id_col: str, text: str, limit: int = 40_000) -> DataFrame:
    """(id, boundary): the first of heading, paragraph, sentence that alone (with those before it)
    leaves no piece above ``limit``, else none.

    The same successor tables, without overlap, once for each level with the boundaries up to it:
    a level is enough if the pointers lead from 0 to the end.
    """
    b = materialize(boundaries(df, id_col, text, limit, 0).where(F.col("level") < HARD), "bounds")
    modes = b.select("*", F.explode(F.array(*(F.lit(k) for k in (HEADING, PARAGRAPH, SENTENCE)))).alias("mode")).where("level <= mode")
    cuts = reached(successors(modes, ["id", "mode"], limit, 0, 0.0), ["id", "mode"])
    ends = b.where("pos = size").select("id", F.col("size").alias("pos"))
    best = cuts.join(ends, ["id", "pos"]).groupBy("id").agg(F.min("mode").alias("mode"))
    name = F.coalesce(*(F.when(F.col("mode") == k, F.lit(v)) for k, v in NAMES.items()), F.lit("none"))
    return ends.select("id").join(best, "id", "left").select(F.col("id").alias(id_col), name.alias("boundary"))
