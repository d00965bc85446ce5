"""Matching of cards: every card of the book is asked about, and no way to the best leaves one out."""

import difflib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from quire.operators import cardindex, gestalt, matching
from quire.queries import ORACLES, QUERIES

CARD = "card_id long, title string, definition string, quote string, sources array<string>"


def same_as_sql(spark, folder, rows):
    """The rows of the query on ``rows``, after they were found equal to those of its SQL."""
    spark.createDataFrame(rows, CARD).coalesce(1).write.parquet(f"{folder}/concept_cards.parquet")
    got = sorted(map(tuple, QUERIES["concept_match_topn"](spark, str(folder)).select("query", "candidate", "score", "title_part", "cosine", "place").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW concept_cards AS SELECT * FROM read_parquet('{folder}/concept_cards.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT query, candidate, score, title_part, cosine, place FROM ({ORACLES['concept_match_topn']})").fetchall())
    assert [r[:2] + r[5:] for r in got] == [r[:2] + r[5:] for r in want]
    assert all(abs(x - y) < 2e-6 for r, s in zip(got, want) for x, y in zip(r[2:5], s[2:5]))
    return got


def test_every_card_of_the_book_is_asked(spark, tmp_path):
    texts = ["The quiet harbour", "A study of tides", "潮汐與港口"]
    rows = [(i + 1, t, f"{t} is one of the words", None, ["b"]) for i, t in enumerate(texts)] + [(i + 11, t, f"{t} stands here as well", "and here", ["c"]) for i, t in enumerate(texts)]
    assert {r[0] for r in same_as_sql(spark, tmp_path, rows)} == {1, 2, 3}


def _by_hand(rows, top=5, least=0.3, scale=4.0):
    """The best of ``rows`` (query?, title, text) by plain dictionaries."""
    grams = lambda k: [k[i : i + 2] for i in range(len(k) - 1)] if len(k) > 1 else [k] if k else []
    corpus = [(t, k) for own, t, k in rows if not own]
    df = Counter(g for _, k in corpus for g in set(grams(k)))
    idf = {g: math.log((len(corpus) + 1) / (c + 1)) + 1 for g, c in df.items()}

    def vector(k):
        v = {g: c * idf.get(g, math.log(len(df) + 1) + 1) for g, c in Counter(grams(k)).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    vectors, out = [vector(k) for _, k in corpus], []
    mass = lambda x: sum(idf.get(g, 1.0) for g in x)
    for q, (own, a, k) in enumerate(rows):
        if not own:
            continue
        v, n, got = *vector(k), []
        for c, ((b, _), (w, m)) in enumerate(zip(corpus, vectors)):
            cos = sum(x * w.get(g, 0.0) for g, x in v.items()) / (n * m) if n and m else 0.0
            short, long = sorted((a, b), key=len)
            x, y = set(grams(a)), set(grams(b))
            t = 0.0 if not short else 1.0 if a == b else 0.5 + 0.5 * len(short) / len(long) if len(short) > 1 and short in long else 2 * mass(x & y) / (mass(x) + mass(y))
            s = 0.5 * t + 0.5 * min(1.0, scale * cos)
            if s >= least:
                got.append((-math.floor(s * 1000 + 0.5), c, round(s, 9)))
        out.append((q, [x[1:] for x in sorted(got)[:top]]))
    return [x for x in out if x[1]]


@pytest.mark.parametrize("letters, sizes, scale", [("ab", (4, 9), 4.0), ("abcdefgh", (5, 30), 4.0), ("abcdefghijklmnopqrstuvwxyz潮汐港", (6, 40), 4.0), ("abcdefgh", (5, 30), 0.3)])
def test_index_finds_the_best_of_all(monkeypatch, letters, sizes, scale):
    """Titles and texts of few letters, empty ones too; the first cards compared are few, so all ways are taken."""
    monkeypatch.setattr(cardindex, "STEP", 3)
    monkeypatch.setattr(cardindex, "FIRST", 4)
    monkeypatch.setattr(cardindex, "CHUNK", 32)
    rng = random.Random(len(letters))
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    rows = [(i % 4 == 0, word(sizes[0]), word(sizes[1])) for i in range(240)]
    corpus = [(t, k) for own, t, k in rows if not own]
    own = [i for i, r in enumerate(rows) if r[0]]
    _, grams, _ = cardindex.gram_counts([k for _, k in corpus])
    weights = cardindex.Weights(*np.unique(grams, return_counts=True), len(corpus))
    distinct, at, of = cardindex.by_title([rows[i][1] for i in own])
    index = cardindex.CardIndex([t for t, _ in corpus], [k for _, k in corpus], weights, scale, 5, 0.3)
    got = index.search(cardindex.Vectors([rows[i][2] for i in own], weights), cardindex.Titles(distinct, weights), at, of)
    got = sorted((own[q], [(int(c), round(float(s), 9)) for c, s in zip(x[0], x[1])]) for q, x in got)
    assert got == _by_hand(rows, scale=scale)


def test_no_table_of_pairs_is_made(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matching, "SMALL", 8)
    monkeypatch.setattr(matching, "BLOCK", 5)
    rng = random.Random(3)
    words = ["harbour", "tide", "quiet", "潮汐", "港口", "of", "the", "an", "x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n))) or None
    rows = [(i, text(4), text(9), text(5), rng.choice([["b"], ["c"], ["d", "e"], ["b", "c"], None])) for i in range(1, 90)]
    assert len({r[0] for r in same_as_sql(spark, tmp_path, rows)}) > 5
    plan = QUERIES["concept_match_topn"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def _ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@pytest.mark.parametrize("few", [0, 2, 24])
def test_most_alike_are_those_of_difflib(monkeypatch, few):
    """Texts on both sides of the length from which difflib leaves characters out, with copies, shared
    beginnings, empty ones and two scripts."""
    monkeypatch.setattr(gestalt, "FEW", few)
    rng = random.Random(few)
    words = [["harbour", "quiet", "7", "tide,", "Zeal", "in", "of", "a"], ["潮汐", "港口", "。", "安靜", "7", "的"]]

    def text():
        w = rng.choice(words)
        return " ".join(rng.choice(w) for _ in range(rng.choice([0, 3, 20, 60, 90])))

    new = [(text(), text()) for _ in range(60)]
    new += [(x[:150] + text(), y) for x, y in new[:20]] + new[:4]
    fields = tuple(gestalt.Texts([x[k] for x in new]) for k in range(2))
    for a in [(text(), text()) for _ in range(20)] + [new[3], (new[5][0], ""), ("", "")]:
        score = [max(_ratio(a[0], x[0]), _ratio(a[1], x[1])) for x in new]
        assert gestalt.most_alike(a, fields, 3) == sorted(((s, i) for i, s in enumerate(score)), key=lambda x: (-x[0], x[1]))[:3]
        for k, field in enumerate(fields):
            low = field.bounds(a[k])
            assert all(x <= y for x, y in zip((_ratio(a[k], x[k]) for x in new), field.closer(a[k], low)))
            assert [field.ratio(a[k], i) for i in range(len(new))] == [_ratio(a[k], x[k]) for x in new]


def test_stale_cards_meet_all_new_cards_of_their_book_and_few_ratios_are_computed(spark, monkeypatch):
    """Parted on both sides, with a null and equal titles; the plan compares no pair of the whole book."""
    for name, x in (("NEW", 16), ("STALE", 2), ("TASKS", 6)):
        monkeypatch.setattr(matching, name, x)
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["harbour", "quiet", "tide", "Zeal", "of", "7"]) for _ in range(rng.choice([0, 4, 30, 50]))) or None
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(["b", "b", "c", None]), text(), text()) for i in range(130)]
    rows[20:24] = [(20 + i, *r[1:]) for i, r in enumerate(rows[:4])]  # copies on either side
    rows[100:120] = [(100 + i, rng.choice(["x", "y"]), *r[2:]) for i, r in enumerate(rows[30:50])]
    make = lambda x: spark.createDataFrame(x, "card_id long, title string, book_id string, definition string, quote string")
    df = matching.stale_review(make(rows[:25]), make(rows[25:]), "card_id", "title")
    got = sorted(map(tuple, df.select("stale", "place", "candidate", "score").collect()))
    want = []
    for s in rows[:25]:
        near = [(-max(_ratio(s[3] or "", n[3] or ""), _ratio(s[4] or "", n[4] or "")), n[1] or "", n[0]) for n in rows[25:] if s[2] and n[2] == s[2]]
        want += [(s[0], p + 1, n[2], -n[0]) for p, n in enumerate(sorted(near)[:3])]
    assert got == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_ratio" not in plan
