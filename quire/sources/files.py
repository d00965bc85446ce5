"""JSON, JSON-lines logs, note files, tables for other tools, and moves of files as a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOK = T.StructType([T.StructField(c, T.StringType()) for c in ("book_id", "title", "epub_path", "pdf_path", "md_path", "category", "series", "author", "status", "last_processed")])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(books...): a manifest {"books": {id: {...}}} as rows, without inferring a schema."""
    text = spark.read.option("wholetext", "true").text(path)
    books = F.from_json("value", T.StructType([T.StructField("books", T.MapType(T.StringType(), BOOK))]))["books"]
    rows = text.select(F.explode(books).alias("key", "b"))
    return rows.select(F.coalesce("b.book_id", "key").alias("book_id"), *[F.col(f"b.{c}").alias(c) for c in BOOK.names if c != "book_id"])


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Results that come as a list or as {"books": [...]}."""
    text = spark.read.option("wholetext", "true").text(path)
    many = T.ArrayType(schema)
    wrapped = F.from_json("value", T.StructType([T.StructField("books", many)]))["books"]
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", many)).otherwise(wrapped)
    return text.select(F.explode(rows).alias("r")).select("r.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, action, book_id, details, line): a JSON-lines log; lines that are no JSON are left out."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("ts", "action", "book_id")] + [T.StructField("details", T.StringType())])
    t = spark.read.text(path).select(F.from_json("value", schema).alias("r"), "value").where("r.action is not null")
    return t.select("r.*", F.col("value").alias("line"))


def append_log(entries: DataFrame, path: str) -> None:
    """Add entries to a log; nothing that is there is touched."""
    entries.select(F.to_json(F.struct(*entries.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(book_id): a list file; comments and empty lines left out."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"#.*$", "")).alias("book_id"))
    return t.where("book_id <> ''")


def write_chapters(chapters: DataFrame, path: str) -> None:
    """Chapters as one JSON object a book, in a folder of its own key."""
    one = F.struct("chapter_num", "title", "char_count", "content", "split", "kind", "start_line")
    books = chapters.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("start_line", one.alias("c")))).alias("x"), F.every("whole").alias("self_check"))
    books.select("book", "self_check", F.transform("x", lambda x: x["c"]).alias("chapters")).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """A CSV table with its header; spreadsheets read it as UTF-8."""
    df.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def write_texts(df: DataFrame, name: Column, text: Column, path: str) -> None:
    """One text for each name, in a folder partitioned by name."""
    df.select(name.alias("name"), text.alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def move_plan(books: DataFrame, category: Column, subfolder: Column, existing: DataFrame) -> DataFrame:
    """(book_id, field, source, target): the moves that a new category asks for; only of files that
    exist, and none where source and target are the same."""
    sub = F.coalesce(subfolder, F.lit(""))
    folder = F.when(sub != "", F.concat_ws("/", category, sub)).otherwise(category)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("source")) for c in ("epub_path", "pdf_path", "md_path")]))
    m = books.select("book_id", folder.alias("folder"), each.alias("m")).select("book_id", "m.field", "m.source", F.concat_ws("/", "folder", F.element_at(F.split("m.source", "/"), -1)).alias("target"))
    return m.where("source <> '' and source <> target").join(existing.select(F.col(existing.columns[0]).alias("source")), "source", "left_semi").select("book_id", "field", "source", "target")


def sync_front_matter(text: Column, fields: dict[str, Column]) -> Column:
    """A card's front matter with single-line fields replaced; fields it lacks are left out."""
    for k, v in fields.items():
        text = F.regexp_replace(text, F.lit(rf'(?m)^{k}:[ \t]*[^\n\[]*$'), F.concat(F.lit(f'{k}: "'), F.regexp_replace(v, r"([\\$])", r"\\$1"), F.lit('"')))
    return text
