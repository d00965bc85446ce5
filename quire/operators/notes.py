"""Note batches of a book and what comes back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.rows import first_of, numbered

#: Characters of a batch.
BUDGET = 150_000


def note_batches(chapters: DataFrame, book: str, order: list[str], size: Column, budget: int = BUDGET) -> DataFrame:
    """(book, order..., size, batch): consecutive chapters of a book in batches of at most ``budget``.

    A batch ends where the next chapter would not fit; a chapter above the budget stands alone.
    Missing sizes count as 0, a missing book is a book of its own. The fold runs over (order, size)
    of one book only, not over its texts; texts never move.
    """
    row = F.struct(*order, F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    books = chapters.groupBy(book).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def step(state: Column, x: Column) -> Column:
        opens = (state["n"] > 0) & (state["sum"] + x["size"] > budget)
        batch = F.when((state["n"] == 0) | opens, state["batch"] + 1).otherwise(state["batch"])
        total = F.when(opens, x["size"]).otherwise(state["sum"] + x["size"])
        return F.struct((state["n"] + 1).alias("n"), total.alias("sum"), batch.alias("batch"), F.array_append(state["out"], batch).alias("out"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))
    done = books.select(book, "rows", F.aggregate("rows", zero, step, lambda s: s["out"]).alias("batches"))
    return done.select(book, F.explode(F.arrays_zip("rows", "batches")).alias("x")).select(book, *[F.col(f"x.rows.{o}").alias(o) for o in order], F.col("x.rows.size").alias("size"), F.col("x.batches").alias("batch"))


def merge_cards(cards: DataFrame, title: str, order: list[Column]) -> DataFrame:
    """Cards of all batches, the first of each title."""
    return first_of(cards, [title], order)


def merge_summaries(batches: DataFrame, book: str, batch: str, summary: str) -> DataFrame:
    """(book, summary): the summaries of a book's batches in order, empty ones left out."""
    s = batches.where(F.coalesce(F.col(summary), F.lit("")) != "").groupBy(book).agg(F.sort_array(F.collect_list(F.struct(batch, summary))).alias("x"))
    return s.select(book, F.array_join(F.transform("x", lambda x: x[summary]), " ").alias("summary"))


def missing_batches(results: DataFrame, planned: DataFrame, keys: list[str]) -> DataFrame:
    """Planned batches without a result."""
    return planned.select(*keys).distinct().join(results.select(*keys), keys, "left_anti")


def card_sources(front: Column) -> Column:
    """The book titles of a card's front matter, in its single or its list form; none gives an empty array."""
    single = F.regexp_extract(front, r'(?m)^source_book:\s*"\[\[(.*?)\]\]"\s*$', 1)
    block = F.regexp_extract(front, r'(?m)^source_book:[ \t]*\n((?:[ \t]+-[ \t]*"\[\[.*?\]\]"[ \t]*\n?)+)', 1)
    return F.when(single != "", F.array(single)).otherwise(F.regexp_extract_all(block, F.lit(r'"\[\[(.*?)\]\]"'), F.lit(1)))


def upsert_blocks(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """(card, section, book, ord, text): blocks of shared cards after new ones came in.

    A block of the same card, section and book is replaced in its place and its repetitions go; a new
    one is put at the end. Running it twice changes nothing.
    """
    keys = ["card", "section", "book"]
    kept = first_of(blocks.select(*keys, "ord", "text"), keys, [F.col("ord")])
    n = first_of(new.select(*keys, "text"), keys, [F.col("text")]).withColumnRenamed("text", "new_text")
    last = kept.groupBy("card", "section").agg(F.max("ord").alias("last"))
    got = kept.join(n, keys, "full_outer").join(last, ["card", "section"], "left")
    got = numbered(got.withColumn("added", F.col("ord").isNull()), ["card", "section", "added"], [F.col("book")], "k")
    return got.select(*keys, F.coalesce("ord", F.coalesce("last", F.lit(0)) + F.col("k")).cast("int").alias("ord"), F.coalesce("new_text", "text").alias("text"))


def card_text(title: Column, sources: Column, definition: Column, quote: Column, related: Column) -> Column:
    """A concept card as Markdown: front matter, definition, quotation and related links."""
    source = F.when(F.size(sources) == 1, F.concat(F.lit('source_book: "[['), sources[0], F.lit(']]"'))).otherwise(F.concat(F.lit("source_book:\n"), F.array_join(F.transform(sources, lambda s: F.concat(F.lit('  - "[['), s, F.lit(']]"'))), "\n")))
    links = F.when(F.size(related) > 0, F.array_join(F.transform(related, lambda r: F.concat(F.lit("- [["), r, F.lit("]]"))), "\n")).otherwise(F.lit("*（無）*"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit('---\ntitle: "'), empty(title), F.lit('"\n'), empty(source), F.lit("\n---\n\n## 定義\n"), empty(definition), F.lit("\n\n## 原文\n> "), empty(quote), F.lit("\n\n## 相關概念\n"), empty(links), F.lit("\n"))
