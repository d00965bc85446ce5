"""Groups of near-duplicates against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm.neardup import group_pairs, list_links, near_duplicates, similar_pairs


def _words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def _texts(n=300, seed=5):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = _words(rng, rng.randrange(20, 60))
        for _ in range(rng.randrange(1, 6)):
            v = list(base)
            for _ in range(rng.randrange(0, 9)):
                i = rng.randrange(len(v))
                v[i : i + 1] = rng.choice([[], [f"w{rng.randrange(400)}"], [v[i], "w0"]])
            out.append(" ".join(v))
    return out


def test_pairs_equal_brute_force(spark):
    texts = list(dict.fromkeys(_texts()))
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", F.col("text"), 0.5)
    links = {r.id: r.n_links for r in got.collect()}
    count = dict.fromkeys(range(len(texts)), 0)
    for p in want:
        for i in p:
            count[i] += 1
    assert links == count
    assert sum(count.values()) > 100


def test_long_lists_lose_nothing():
    """Blocks, parts and answers derived from a leader give what comparing all pairs gives."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, (6, 40))
    sets = []
    for i in range(400):
        s = base[rng.integers(0, 6)].copy()
        s[rng.integers(0, 40, rng.integers(0, 12))] = rng.integers(0, 1 << 62)
        sets.append(np.unique(np.append(s, 7)))
    import pandas as pd

    from quire.llm.neardup import sketch

    n, bits = np.array([len(s) for s in sets], float), sketch(pd.Series(sets))
    pos = rng.integers(0, 10, 400)
    for side in (np.zeros(400, int), rng.integers(0, 2, 400)):
        i, j = list_links(n, pos, bits, side, 0.5)
        got = set(zip(i.tolist(), j.tolist()))
        for a in range(400):
            for b in range(a + 1, 400):
                if side.any() and side[a] == side[b]:
                    continue
                need = np.ceil((n[a] + n[b]) / 3 - 1e-9)
                fits = min(n[a] - pos[a], n[b] - pos[b]) >= need
                if fits and len(np.intersect1d(sets[a], sets[b])) >= need:
                    assert (a, b) in got


def test_copies_nulls_and_empties(spark):
    rows = [(1, "a b c d"), (2, "A  b, c d."), (3, None), (4, ""), (5, "a b c d"), (6, "...")]
    got = near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"), 0.5)
    assert {r.id: r.group_id for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6}
    assert sorted(map(tuple, group_pairs(got).collect())) == [(1, 2), (1, 5), (2, 5)]
    assert near_duplicates(spark.createDataFrame([], "id long, text string"), "id", F.col("text"), 0.5).count() == 0


def test_empty_sets(spark):
    assert similar_pairs(spark.createDataFrame([(1, [])], "id long, tokens array<bigint>"), 0.5).count() == 0


def _packed(sets, t):
    """The index entries of sets as ``similar_pairs`` makes them: keys, records, places, sizes, sketches."""
    import pandas as pd
    import pyarrow as pa

    from quire.llm.neardup import GROUPS, _entries, learn, sketch

    tokens = pa.array([np.asarray(s, np.int64) for s in sets], pa.list_(pa.int64()))
    count, group = learn(tokens)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(np.arange(len(sets))), "tokens": tokens})
    out = []
    for first, last in ((0, 5), (5, GROUPS)):  # two rounds
        for b in _entries(t, count, group, first, last, 1)([batch]):
            assert b.num_rows == 1
            x = {c: np.frombuffer(b.column(c)[0].as_buffer(), k) for c, k in (("key", np.uint64), ("rec", np.int32), ("pos", np.int32), ("ids", np.int64), ("n", np.int32), ("bits", np.uint64))}
            out.append((x["key"], x["ids"][x["rec"]], x["pos"]))
    key, rec, pos = (np.concatenate(c) for c in zip(*out))
    return key, rec, pos, np.array([len(s) for s in sets]), sketch(pd.Series([np.asarray(s, np.int64) for s in sets]))


def _made_sets(n, seed):
    """Sets of all sizes of few, frequent elements, some near to others, some parts of others."""
    rng = np.random.default_rng(seed)
    words, p = rng.integers(-(1 << 62), 1 << 62, 400), 1 / np.arange(1, 401) ** 0.7
    out = []
    while len(out) < n:
        base = rng.choice(words, rng.integers(1, 90), replace=False, p=p / p.sum())
        out.append(base)
        for _ in range(rng.integers(0, 4)):
            part = base[rng.random(len(base)) < rng.uniform(0.5, 1)]
            new = rng.choice(words, rng.integers(0, 1 + len(base) // 3), replace=False)
            out.append(np.append(part, new))
    return [np.unique(s) for s in out if len(s)][:n]


def test_lists_over_two_elements_lose_nothing(monkeypatch):
    from quire.llm import neardup

    sets = _made_sets(700, 11)
    for t in (0.5, 0.8):
        want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(np.intersect1d(sets[a], sets[b])) >= t * len(np.union1d(sets[a], sets[b]))}
        assert len(want) > 50
        entries = _packed(sets, t)
        for long, chunk in ((2048, 1 << 20), (20, 100)):
            monkeypatch.setattr(neardup, "LONG", long)
            monkeypatch.setattr(neardup, "CHUNK", chunk)
            got = neardup.lists_links(*entries, t)
            assert want <= set(map(tuple, got.T.tolist()))


def test_frequent_elements_dont_meet_in_long_lists():
    """The lists over two elements are a small part of those over one; on tables a tenfold as large, lists over one took a tenfold time a record."""
    rng = np.random.default_rng(2)
    words, p = rng.integers(-(1 << 62), 1 << 62, 3000), 1 / np.arange(1, 3001) ** 0.5
    sets = [np.unique(rng.choice(words, 75, replace=False, p=p / p.sum())) for _ in range(1500)]
    key = _packed(sets, 0.5)[0]
    two = np.unique(key, return_counts=True)[1].astype(float)
    df = dict(zip(*np.unique(np.concatenate(sets), return_counts=True)))
    one = np.unique(np.concatenate([sorted(s, key=lambda x: (df[x], x))[: len(s) - -(-len(s) // 2) + 1] for s in sets]), return_counts=True)[1].astype(float)
    assert (two * (two - 1)).sum() < 0.1 * (one * (one - 1)).sum()


def test_rounds(spark, monkeypatch):
    """Lists made in several rounds give the same pairs."""
    from quire.llm import neardup

    sets = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(_made_sets(150, 4))], "id long, tokens array<bigint>")
    once = sorted(map(tuple, similar_pairs(sets, 0.5).collect()))
    monkeypatch.setattr(neardup, "ROUND", 60)
    assert len(once) > 20 and sorted(map(tuple, similar_pairs(sets, 0.5).collect())) == once
