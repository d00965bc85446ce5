"""How characteristic each term of a record is (problem 5).

Method: log-odds ratio of the record against the rest of the collection with an informative
Dirichlet prior taken from the collection's counts, divided by its standard error (z-scores).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATIN_TERM = r"\p{IsLatin}{4,}"
# Words of any script but Han; every two neighbouring Han characters; Han characters standing alone.
WORD, HAN_PAIR, HAN_ALONE = r"[\p{L}\p{M}&&[^\p{IsHan}]]+", r"(?=(\p{IsHan}{2}))", r"(?<!\p{IsHan})\p{IsHan}(?!\p{IsHan})"


def any_terms(text: Column) -> Column:
    """All terms of a text: words, and overlapping pairs of Han characters at every offset."""
    low = F.lower(text)
    return F.concat(*(F.regexp_extract_all(low, F.lit(p), F.lit(g)) for p, g in ((WORD, 0), (HAN_PAIR, 1), (HAN_ALONE, 0))))


def term_counts(df: DataFrame, id_col: str, text: Column, pattern: str | None = LATIN_TERM) -> DataFrame:
    """(id, term, tf, n): lower-case terms of each row's text, their count and the row's total.

    Terms are what matches ``pattern``; with None, all of ``any_terms``.
    Rows whose text is null, empty or without a term give no row. Ids must be unique; repeated
    ids count as one record.
    """
    terms = any_terms(text) if pattern is None else F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    words = df.select(F.col(id_col).alias("id"), terms.alias("w")).where(F.size("w") > 0)
    return (
        words.select("id", F.size("w").alias("n"), F.explode("w").alias("term"))
        .groupBy("id", "term")
        .agg(F.count("*").alias("tf"), F.max("n").cast("bigint").alias("n"))
    )


def distinctive_terms(
    df: DataFrame,
    id_col: str,
    text: Column,
    pattern: str | None = LATIN_TERM,
    min_tf: int = 1,
    min_df: int = 1,
    max_df: int | None = None,
    prior_weight: float = 1.0,
) -> DataFrame:
    """(id, term, tf, df, z) for each term of each record.

    y and n are the term's and all terms' counts in the record, Y and N in the collection; the
    prior of a term is ``prior_weight * Y`` (total ``prior_weight * N``). With the record against
    the rest: delta = ln((y+a)/(n+A-y-a)) - ln((Y-y+a)/(N-n+A-Y+y-a)),
    z = delta / sqrt(1/(y+a) + 1/(Y-y+a)). Where a side holds nothing but the term, its denominator
    counts as half an occurrence, so z is always finite. An empty table gives an empty result.

    The collection's statistics are over all records; ``min_tf``, ``min_df`` and ``max_df`` only
    choose what is returned, and reach the term table before the join. Statistics are summed before
    they are shuffled; what is joined to them is one row per record and term, and AQE splits a
    common term's rows.
    """
    tc = term_counts(df, id_col, text, pattern)
    stats = tc.groupBy("term").agg(F.sum("tf").alias("Y"), F.count("*").alias("df"))
    total = stats.agg(F.sum("Y").alias("total"))
    keep = F.col("df") >= min_df
    if max_df is not None:
        keep &= F.col("df") <= max_df
    j = tc.where(F.col("tf") >= min_tf).join(stats.where(keep), "term").join(F.broadcast(total))
    a = F.col("Y") * F.lit(float(prior_weight))
    big = F.col("total") * F.lit(float(prior_weight))
    half = F.lit(0.5)
    own = F.log((F.col("tf") + a) / F.greatest(F.col("n") + big - F.col("tf") - a, half))
    rest_y = F.col("Y") - F.col("tf") + a
    rest = F.log(rest_y / F.greatest(F.col("total") - F.col("n") + big - rest_y, half))
    z = (own - rest) / F.sqrt(1 / (F.col("tf") + a) + 1 / rest_y)
    return j.select("id", "term", "tf", "df", z.alias("z"))
