"""The catalogue: scanning, upserts, classification, folders, states and the activity log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import book_key, clean_name, name_key, stem
from quire.operators.rows import descending, first_of, numbered

#: The least books of one author or series that get a folder of their own.
FOLDER_BOOKS = 5
#: A classification below this confidence goes to the inbox.
SURE = 0.7
#: Characters of a text that a classifier is shown.
EXCERPT = 3000
#: The fallback category, and the states of a book in order.
NO_CATEGORY = "尚未歸檔"
STATES = ("raw", "converted", "classified", "card_only", "notes_generated", "reading", "done")
#: The state an action leaves a book in.
AFTER = {"scan": "raw", "convert": "converted", "classify": "classified", "create_card": "card_only", "apply_notes": "notes_generated", "done": "done"}


def status_counts(books: DataFrame) -> DataFrame:
    """(status, n): books by state; a missing state is ``unknown``."""
    return books.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def to_process(books: DataFrame) -> DataFrame:
    """Books that still await conversion or classification."""
    return books.where(F.col("status").isin("raw", "converted"))


def to_convert(books: DataFrame, force: bool = False) -> DataFrame:
    """Books to convert: raw ones, with ``force`` all that have a source."""
    source = (F.coalesce("epub_path", F.lit("")) != "") | (F.coalesce("pdf_path", F.lit("")) != "")
    return books.where((F.col("status") == "raw") | (source if force else F.lit(False)))


def to_classify(books: DataFrame, texts: DataFrame, order: list[str], limit: int | None = None, force: bool = False) -> DataFrame:
    """(book_id, title, excerpt) of converted books with a text and, without ``force``, no category.

    ``texts`` (book_id, text) gives the excerpt; a book without a row has an empty one.
    """
    want = books.where("status = 'converted' and coalesce(md_path, '') <> ''")
    if not force:
        want = want.where("coalesce(category, '') = ''")
    got = want.join(texts, "book_id", "left").select("book_id", "title", F.substring(F.coalesce("text", F.lit("")), 1, EXCERPT).alias("excerpt"), *[F.col(o).alias(f"__{o}") for o in order])
    if limit is not None:
        got = got.orderBy(*[f"__{o}" for o in order]).limit(limit)
    return got.drop(*[f"__{o}" for o in order])


def valid_category(c: Column, categories: DataFrame, name: str = "category") -> tuple[DataFrame, Column]:
    """(known, column): the table to left-join on ``known_category`` and the category with its fallback."""
    known = categories.select(F.col(name).alias("known_category")).distinct()
    return known, F.coalesce("known_category", F.lit(NO_CATEGORY))


def with_valid_category(df: DataFrame, column: str, categories: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: the category if it is known, else the fallback."""
    known, value = valid_category(F.col(column), categories)
    return df.join(known, F.col(column) == F.col("known_category"), "left").withColumn(out, value).drop("known_category")


def category_from_path(path: Column, names: Column) -> Column:
    """The first part of a path that is a known category (``names``, an array); else null."""
    return F.element_at(F.filter(F.split(path, "/"), lambda x: F.array_contains(names, x)), 1)


def folder_for(confidence: Column, category: Column, subfolder: Column) -> Column:
    """Where a book's card goes: the inbox if the classification is unsure, else category and subfolder.

    A missing confidence counts as none.
    """
    sub = F.coalesce(subfolder, F.lit(""))
    return F.when(F.coalesce(confidence, F.lit(0.0)) < SURE, "Inbox").when(sub != "", F.concat_ws("/", category, sub)).otherwise(category)


def name_counts(books: DataFrame, field: str) -> DataFrame:
    """(key, n): books by the comparison key of an author or series; nameless ones aren't counted."""
    key = name_key(F.col(field), field == "author")
    return books.select(key.alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n"))


def usual_folder(books: DataFrame, field: str) -> DataFrame:
    """(key, folder): the folder below a category that holds most of a name's books; of several the
    one whose first book comes first by id."""
    parts = F.split(F.coalesce(F.nullif(F.col("epub_path"), F.lit("")), F.nullif(F.col("pdf_path"), F.lit(""))), "/")
    got = books.select(name_key(F.col(field), field == "author").alias("key"), parts.alias("p"), "book_id").where("key <> '' and size(p) >= 3")
    n = got.groupBy("key", F.element_at("p", -2).alias("folder")).agg(F.count("*").alias("n"), F.min("book_id").alias("first"))
    return first_of(n, ["key"], [descending(F.col("n")), F.col("first")]).select("key", "folder")


def subfolders(books: DataFrame) -> DataFrame:
    """(book_id, needs_subfolder, subfolder): whether a book's series or author has books enough for a
    folder of its own, and which: the one already used, else the name itself; series before author."""
    b = books.select("book_id", *[e for f in ("series", "author") for e in (name_key(F.col(f), f == "author").alias(f"{f}_key"), clean_name(F.col(f), f == "author").alias(f"{f}_name"))])
    for f in ("series", "author"):
        b = b.join(name_counts(books, f).select(F.col("key").alias(f"{f}_key"), F.col("n").alias(f"{f}_n")), f"{f}_key", "left")
        b = b.join(usual_folder(books, f).select(F.col("key").alias(f"{f}_key"), F.col("folder").alias(f"{f}_folder")), f"{f}_key", "left")
    by = {f: F.coalesce(F.col(f"{f}_n"), F.lit(0)) >= FOLDER_BOOKS for f in ("series", "author")}
    found = F.coalesce(*[F.when(by[f], F.col(f"{f}_folder")) for f in by], *[F.when(by[f], F.col(f"{f}_name")) for f in by], F.lit(""))
    return b.select("book_id", (by["series"] | by["author"]).alias("needs_subfolder"), found.alias("subfolder"))


def scan_upsert(paths: DataFrame, manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """(book_id, epub_path, pdf_path, md_path, status): the manifest after a scan.

    ``paths`` (path) are files found, ``texts`` (path) converted texts. EPUB and PDF of one stem are
    one book. Found paths replace stored ones, books that the scan doesn't find stay; a raw book with
    a converted text becomes converted. Of several files with one stem the last path counts.
    """
    low = F.lower(F.col("path"))
    files = paths.where(low.endswith(".epub") | low.endswith(".pdf")).groupBy(book_key(F.col("path")).alias("book_id")).agg(
        F.max(F.when(low.endswith(".epub"), F.col("path"))).alias("new_epub"), F.max(F.when(low.endswith(".pdf"), F.col("path"))).alias("new_pdf")
    )
    md = texts.groupBy(book_key(F.col("path")).alias("book_id")).agg(F.max("path").alias("new_md"))
    got = manifest.select("book_id", "epub_path", "pdf_path", "md_path", "status").join(files, "book_id", "full_outer").join(md, "book_id", "left")
    md_path = F.coalesce("new_md", F.nullif(F.col("md_path"), F.lit("")))
    state = F.coalesce("status", F.lit("raw"))
    return got.select(
        "book_id",
        F.coalesce("new_epub", F.nullif(F.col("epub_path"), F.lit(""))).alias("epub_path"),
        F.coalesce("new_pdf", F.nullif(F.col("pdf_path"), F.lit(""))).alias("pdf_path"),
        md_path.alias("md_path"),
        F.when((state == "raw") & md_path.isNotNull(), "converted").otherwise(state).alias("status"),
    )


def match_by_stem(books: DataFrame, path: str, cards: DataFrame, card_path: str) -> DataFrame:
    """(book_id, card): the card with the book's stem, else with the stem less its last ``_`` part."""
    c = cards.groupBy(stem(F.col(card_path)).alias("stem")).agg(F.max(card_path).alias("card"))
    s = stem(F.col(path))
    b = books.select("book_id", s.alias("stem"), F.regexp_replace(s, r"_[^_]*$", "").alias("short"))
    return b.join(c, "stem", "left").join(c.select(F.col("stem").alias("short"), F.col("card").alias("second")), "short", "left").select("book_id", F.coalesce("card", "second").alias("card"))


def apply_updates(manifest: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The manifest with the given columns replaced where an update has a value."""
    u = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return manifest.join(u, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in manifest.columns])


def unknown_keys(results: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Results that no manifest row stands for."""
    return results.join(manifest.select(key), key, "left_anti")


def numbered_names(df: DataFrame, name: Column, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: the name, with ``_2``, ``_3`` … where it was used before."""
    n = numbered(df.withColumn("__name", name), ["__name"], order, "__k")
    return n.withColumn(out, F.when(F.col("__k") > 1, F.concat("__name", F.lit("_"), F.col("__k").cast("string"))).otherwise(F.col("__name"))).drop("__name", "__k")


def delivered_once(log: DataFrame, key: str = "log_id", arrived: str = "ingested_at") -> DataFrame:
    """Log entries without repeated deliveries: the first delivery of each counts."""
    return first_of(log, [key], [F.col(arrived)])


def log_tail(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` entries by time, oldest first."""
    return log.orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(n).orderBy("ts", "log_id")


def history(log: DataFrame) -> DataFrame:
    """(book_id, entries, actions): a book's log as one row; actions in order of time.

    Entries without a book are left out.
    """
    e = log.where("book_id is not null").groupBy("book_id").agg(F.count("*").alias("entries"), F.sort_array(F.collect_list(F.struct("ts", "log_id", F.lower("action").alias("action")))).alias("x"))
    return e.select("book_id", "entries", F.array_join(F.transform("x", lambda x: x["action"]), ",").alias("actions"))


def states(log: DataFrame) -> DataFrame:
    """(book_id, status, ts): the state that a book's last state-changing action left it in.

    A combinable aggregate: no task holds a book's whole log.
    """
    after = F.create_map(*[F.lit(x) for kv in AFTER.items() for x in kv])
    s = log.where("book_id is not null").select("book_id", "ts", "log_id", after[F.lower("action")].alias("status")).where("status is not null")
    return s.groupBy("book_id").agg(F.max(F.struct("ts", "log_id", "status")).alias("x")).select("book_id", "x.status", "x.ts")


def details(log: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``log`` with fields of its JSON ``details`` as columns; what is no JSON or lacks a field gives null."""
    return log.withColumns({c: F.try_to_number(F.get_json_object("details", f"$.{c}"), F.lit("999999999")).cast(t) if t in ("int", "bigint") else F.get_json_object("details", f"$.{c}").cast(t) for c, t in fields.items()})
