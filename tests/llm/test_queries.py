"""The registered queries answer over whole tables."""

import pytest

from quire.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["card_id_a", "card_id_b"],
    "p5_found": ["card_id", "term"],
    "p6_found": ["chapter_id", "boundary"],
    "p7_found": ["field", "row_id", "kind"],
    "p8_found": ["doc_id", "item_id"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_found_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count()


def test_batches_hold_every_chapter(spark):
    got = QUERIES["p4_batches"](spark, SF).toPandas()
    assert set(got["chapter_id"]) == {r[0] for r in spark.read.parquet(f"{SF}/chapters.parquet").select("chapter_id").collect()}
    assert got.groupby("batch_id")["size"].sum().max() <= 150_000
