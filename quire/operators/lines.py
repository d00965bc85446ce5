"""Texts as lines: offsets, headings, sections and the numbers that guard a conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import short_key

#: What is compared between two runs: numbers that must not fall and numbers that must not rise.
KEEP, LIMIT = ("body_chars",), ("number_lines",)


def lines_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., line_no, line): lines counted from 1; a null text has none."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(*keys, (F.col("p") + 1).alias("line_no"), "line")


def with_offsets(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with ``start``: the characters of the text before each line, line feeds included."""
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def headings(lines: DataFrame) -> DataFrame:
    """Lines that are Markdown headings, with ``level`` and ``title``."""
    h = lines.withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))).where("level > 0")
    return h.withColumn("title", F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)", 1)))


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, section): the parts between rules, trimmed, without empty ones, the head
    block and parts that hold nothing but pictures; numbered by their place among all parts."""
    s = df.select(key, F.posexplode(F.split(text, "\n---+\n")).alias("p", "s")).select(key, (F.col("p") + 1).alias("section_no"), F.regexp_replace("s", r"^\s+|\s+$", "").alias("section"))
    head = F.col("section").rlike("^#\\s*(書名|作者|轉換日期|轉換器)[：:]")
    pictures = F.trim(F.regexp_replace(F.regexp_replace("section", r"\[圖片[^\]]*\]", ""), r"\s+", "")) == ""
    return s.where((F.col("section") != "") & ~head & ~pictures)


def body(text: Column) -> Column:
    """The text after the first rule; the whole text if it has none."""
    return F.element_at(F.split(text, "\n---+\n", 2), -1)


def metrics(df: DataFrame, key: Column, text: str) -> DataFrame:
    """(key, sha, chars, body_chars, sections, headings, number_lines): a text's numbers, under an anonymous key.

    The checksum leaves out the lines that differ between runs (date and converter). Null texts have no row.
    """
    t = F.col(text)
    b = body(t)
    return df.where(t.isNotNull()).select(
        short_key(key).alias("key"),
        F.substring(F.sha2(F.regexp_replace(t, "(?md)^# (轉換日期|轉換器)：.*\n(\n)?", ""), 256), 1, 16).alias("sha"),
        F.length(t).alias("chars"),
        F.length(F.regexp_replace(b, r"[^\p{L}\p{N}]", "")).alias("body_chars"),
        (F.regexp_count(b, F.lit("(?md)^---+$")) + 1).alias("sections"),
        F.regexp_count(b, F.lit("(?md)^#{1,6} ")).alias("headings"),
        F.regexp_count(b, F.lit(r"(?md)^[ \t]*[0-9]{1,4}[ \t]*$")).alias("number_lines"),
    )


def compare_runs(base: DataFrame, run: DataFrame) -> DataFrame:
    """(key, metric, old, new, broken): what differs between two runs of ``metrics``; broken where a
    guarded number fell or rose. A text that is missing or new is a difference of ``(book)``.
    """
    names = [c for c in base.columns if c != "key"]
    both = base.select("key", F.struct(*names).alias("b")).join(run.select("key", F.struct(*names).alias("r")), "key", "full_outer")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"b.{n}").cast("string").alias("old"), F.col(f"r.{n}").cast("string").alias("new")) for n in names]))
    there = both.where("b is not null and r is not null").select("key", each.alias("x")).select("key", "x.*").where("not (old <=> new)")
    o, n = F.try_to_number("old", F.lit("999999999999")), F.try_to_number("new", F.lit("999999999999"))
    fell, rose = F.col("metric").isin(*KEEP) & (n < o), F.col("metric").isin(*LIMIT) & (n > o)
    guarded = F.col("metric").isin(*KEEP, *LIMIT)
    there = there.withColumn("broken", F.coalesce(fell | rose, F.lit(False))).where(~guarded | F.col("broken"))
    alone = both.where("b is null or r is null").select("key", F.lit("(book)").alias("metric"), F.when(F.col("b").isNull(), "missing").otherwise("present").alias("old"), F.when(F.col("r").isNull(), "missing").otherwise("new").alias("new"), F.lit(False).alias("broken"))
    return there.unionByName(alone)
