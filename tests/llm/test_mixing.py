"""Shares, caps and the exactness of the index permutations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.mixing import Source, mix, permute, running_total, slots_for


def test_permutations():
    for n in (1, 2, 3, 64, 1000, 4097):
        got = permute(np.arange(n), n, 7)
        assert sorted(got.tolist()) == list(range(n))
    assert permute(np.arange(1000), 1000, 1).tolist() != permute(np.arange(1000), 1000, 2).tolist()


def test_slots_leave_room():
    s = [Source("a", 0.9, 1, 1000), Source("b", 0.1, 3, 10)]
    k = slots_for(s)
    assert 0 < k * 0.1 + 3.9 * (k * 0.09) ** 0.5 <= 30.5
    assert slots_for([]) == 0


def test_running_total(spark):
    df = spark.createDataFrame([("a", i, i % 5 + 1) for i in range(200)] + [("b", i, 2) for i in range(10)], "k string, o long, v long")
    got = {(r.k, r.o): r.before for r in running_total(df, "k", F.floor(F.col("o") / 30), ["o"], "v", "before").collect()}
    assert all(got["a", i] == sum(j % 5 + 1 for j in range(i)) for i in range(200)) and got["b", 9] == 18 and len(got) == 210


def test_mix(spark):
    rows = [(i, ["big", "BIG", "Mid-Size", "small"][min(3, i % 4)], "one two three four five six seven " * (1 + i % 30)) for i in range(2000)]
    rows += [(5000, None, "x y z"), (5001, "big", None), (5002, "big", ""), (5003, "none", "a b"), (5004, "big", "<|endoftext|> " * 40)]
    t = spark.createDataFrame([("big", 0.6, 1), ("mid_size", 0.3, 2), ("small", 0.05, 4), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    m = mix(spark.createDataFrame(rows, "id long, source string, text string"), "id", "source", "text", t, block=64, shard=128)
    shares = {r.source: r for r in m.shares().collect()}
    assert shares["absent"].tokens == 0
    for s in ("big", "mid_size", "small"):
        assert shares[s].actual_share == pytest.approx(shares[s].target_share / 0.95, abs=0.02)
    docs = m.documents().toPandas()
    cap = docs.source.map({"big": 1, "mid_size": 2, "small": 4})
    assert (docs.repeats <= cap).all() and (docs.tokens_used <= docs.n_tokens * cap).all()
    assert not set(docs.id) & {5000, 5001, 5002, 5003}
    assert docs.tokens_used.sum() == sum(r.tokens for r in shares.values())
    slots = m.slots.toPandas()
    assert not slots.duplicated(["shard", "slot"]).any() and not slots.duplicated(["source", "block", "round"]).any()
    assert (slots.groupby("shard").size().iloc[:-1] == 128).all()


def test_nothing_to_mix(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    m = mix(spark.createDataFrame([], "id long, source string, text string"), "id", "source", "text", t)
    assert m.documents().count() == 0 and m.shares().first().tokens == 0
