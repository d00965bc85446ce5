"""The log as it comes in: deliveries once, windows by the time of the entry, and books' states.

Entries arrive late and twice; the watermark says how late still counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.catalog import AFTER

LOG = "log_id bigint, ts timestamp, ingested_at timestamp, action string, book_id string, details string"


def read_stream(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """Parquet files of entries as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def once(log: DataFrame, late: str = "7 days") -> DataFrame:
    """Every entry once, however often it is delivered within ``late`` of its time."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["log_id"])


def _marked(log: DataFrame, late: str | None) -> DataFrame:
    return log if late is None else log.withWatermark("ts", late)


def windows(log: DataFrame, width: str = "1 day", late: str | None = "7 days") -> DataFrame:
    """(start, action, n): entries by action in windows of the entry's time.

    ``late`` is None where the stream has its watermark already, as after ``once``.
    """
    w = _marked(log, late).groupBy(F.window("ts", width), F.lower("action").alias("action")).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "action", "n")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str | None = "7 days") -> DataFrame:
    """(book_id, start, end, n): runs of work on a book, parted by quiet of ``gap``."""
    s = _marked(log.where("book_id is not null"), late).groupBy(F.session_window("ts", gap), "book_id").agg(F.count("*").alias("n"))
    return s.select("book_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def states(log: DataFrame, late: str | None = "7 days") -> DataFrame:
    """(book_id, status, ts): the state of every book so far; one small row of state for each book."""
    after = F.create_map(*[F.lit(x) for kv in AFTER.items() for x in kv])
    s = _marked(log.where("book_id is not null"), late).select("book_id", "ts", "log_id", after[F.lower("action")].alias("status")).where("status is not null")
    return s.groupBy("book_id").agg(F.max(F.struct("ts", "log_id", "status")).alias("x")).select("book_id", "x.status", "x.ts")
