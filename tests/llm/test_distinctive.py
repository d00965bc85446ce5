"""Every term of a card gets a score, whatever its offset."""

from pyspark.sql import functions as F

from quire.llm.distinctive import distinctive_terms, term_counts


def test_han_pairs_at_every_offset(spark):
    df = spark.createDataFrame([(1, "道德經書"), (2, "論道德經"), (3, "Wu 與 tao, δόξα")], "id bigint, t string")
    got = {(r["id"], r["term"]): r["tf"] for r in term_counts(df, "id", F.col("t"), None).collect()}
    assert got == {(1, "道德"): 1, (1, "德經"): 1, (1, "經書"): 1, (2, "論道"): 1, (2, "道德"): 1, (2, "德經"): 1, (3, "wu"): 1, (3, "與"): 1, (3, "tao"): 1, (3, "δόξα"): 1}


def test_same_word_has_one_df(spark):
    df = spark.createDataFrame([(1, "道德經書"), (2, "論道德經")], "id bigint, t string")
    got = {(r["id"], r["term"]): r["df"] for r in distinctive_terms(df, "id", F.col("t"), None).collect()}
    assert got[1, "道德"] == got[2, "道德"] == 2
