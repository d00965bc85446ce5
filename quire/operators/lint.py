"""Checks of notes and cards: links, damaged text, truncation and quotations.

Every check gives (file, line, type, detail), ``line`` null where the whole file is meant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text of this length that ends inside a sentence may have been cut off.
LONG = 7500
#: What a finished text ends with.
FINISHED = "。」』”\".!?！？）)…、"


def _lines(df: DataFrame, file: str, text: str) -> DataFrame:
    return df.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\n")).alias("p", "s")).select("file", (F.col("p") + 1).alias("line"), "s")


def links(df: DataFrame, file: str, text: str) -> DataFrame:
    """(file, line, target): every wiki link's target, what stands behind a bar left out."""
    each = _lines(df, file, text).where(F.col("s").contains("[[")).select("file", "line", F.explode(F.regexp_extract_all("s", F.lit(r"\[\[([^\[\]]*)\]\]"), F.lit(1))).alias("t"))
    return each.select("file", "line", F.trim(F.element_at(F.split("t", r"\|"), 1)).alias("target"))


def empty_links(df: DataFrame, file: str, text: str) -> DataFrame:
    return links(df, file, text).where("target = ''").select("file", "line", F.lit("empty_wikilink").alias("type"), F.lit("[[]]").alias("detail"))


def broken_links(df: DataFrame, file: str, text: str, known: DataFrame) -> DataFrame:
    """Links to what ``known`` (one column) doesn't list."""
    targets = known.select(F.col(known.columns[0]).alias("target")).distinct()
    return links(df, file, text).where("target <> ''").join(targets, "target", "left_anti").select("file", "line", F.lit("broken_link").alias("type"), F.col("target").alias("detail"))


def damaged(df: DataFrame, file: str, text: str) -> DataFrame:
    """Texts with the replacement character; the line of the first one."""
    at = F.instr(text, "�")
    line = F.regexp_count(F.substring(F.col(text), F.lit(1), at), F.lit("\n")) + 1
    return df.where(at > 0).select(F.col(file).alias("file"), line.alias("line"), F.lit("encoding_corruption").alias("type"), F.lit("U+FFFD").alias("detail"))


def truncated(df: DataFrame, file: str, text: str, least: int = LONG) -> DataFrame:
    """Long texts whose last quotation (or, without one, whose end) is no finished sentence."""
    quotes = F.regexp_extract_all(F.col(text), F.lit("(?md)^> (.+)$"), F.lit(1))
    tail = F.regexp_replace(F.when(F.size(quotes) > 0, F.try_element_at(quotes, F.lit(-1))).otherwise(F.col(text)), r"\s+$", "")
    open_end = (tail != "") & ~F.lit(FINISHED).contains(F.right(tail, F.lit(1)))
    return df.where((F.length(text) >= least) & open_end).select(F.col(file).alias("file"), F.lit(None).cast("int").alias("line"), F.lit("possible_truncation").alias("type"), F.length(text).cast("string").alias("detail"))


def doubtful_quotes(df: DataFrame, file: str, title: Column, quote: Column) -> DataFrame:
    """Cards without a quotation, or whose quotation is just the title."""
    q = F.trim(F.coalesce(quote, F.lit("")))
    kind = F.when(q == "", "missing_quote").when(q == F.trim(title), "quote_equals_title")
    return df.select(F.col(file).alias("file"), F.lit(None).cast("int").alias("line"), kind.alias("type"), F.trim(title).alias("detail")).where("type is not null")


def all_issues(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def issues_by_type(issues: DataFrame) -> DataFrame:
    return issues.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
