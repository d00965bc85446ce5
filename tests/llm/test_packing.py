"""Every row placed, no batch above the capacity, and few batches."""

import math

from pyspark.sql import functions as F

from quire.llm.packing import pack_items


def test_many_tiny_items_end(spark):
    got = pack_items(spark.range(50_000).withColumn("n", F.lit(1)), "id", F.col("n"), 150_000)
    assert got.count() == 50_000 and got.select("batch_id").distinct().count() == 1


def test_tight_and_whole(spark):
    sizes = [(i, [90_000, 61_000, 7_000, 300, 140_000, 49_000][i % 6] + i % 977) for i in range(3000)] + [(9000, 400_000), (9001, None), (9002, -5), (9003, 0)]
    df = spark.createDataFrame(sizes, "id long, n long")
    got = pack_items(df, "id", F.col("n"), 150_000).toPandas()
    assert set(got.id) == {i for i, _ in sizes}
    fill = got.groupby("batch_id")["size"].sum()
    total = sum(max(n or 0, 0) for _, n in sizes)
    assert fill.max() <= 150_000 and got["size"].sum() == total
    assert len(fill) <= 1.1 * math.ceil(total / 150_000)
    assert got[got.id == 9000].piece_no.tolist() == [1, 2, 3] or sorted(got[got.id == 9000].piece_no) == [1, 2, 3]
    assert (got[got.id != 9000].groupby("id").size() == 1).all()


def test_empty(spark):
    assert pack_items(spark.createDataFrame([], "id long, n long"), "id", F.col("n")).count() == 0
