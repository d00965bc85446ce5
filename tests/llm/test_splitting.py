"""Pieces of oversized items: no slivers, no lost text."""

import pytest

from quire.llm.splitting import split_items

TEXTS = {
    "near_heading": "# T\n" + "x" * 600 + "\n" + "字" * 70_000,
    "short_title": "Title\n" + "y" * 79_000,
    "two_gaps": "a" * 45_000 + ". Middle\n" + "b" * 45_000,
    "all_natural": "t" * 603 + "\n" + "c" * 39_497 + "\n" + "d" * 20_000,
}
# as few pieces as 40,000 and then 39,800 characters allow; where all can be natural, three natural ones
PIECES = {"near_heading": 2, "short_title": 2, "two_gaps": 3, "all_natural": 3}


@pytest.fixture(scope="module")
def pieces(spark):
    df = spark.createDataFrame([(k, "N", v) for k, v in TEXTS.items()], "id string, title string, content string")
    rows = split_items(df, "id", "title", "content").orderBy("id", "piece_no").collect()
    return {k: [r for r in rows if r["id"] == k] for k in TEXTS}


def test_no_slivers(pieces):
    assert {k: len(v) for k, v in pieces.items()} == PIECES
    assert [r["end"] for r in pieces["all_natural"]] == [604, 40_102, 60_102]


@pytest.mark.parametrize("k", TEXTS)
def test_pieces_join_to_the_text(pieces, k):
    assert "".join(r["content"][r["start"] - max(r["start"] - 200, 0) :] for r in pieces[k]) == TEXTS[k]
    for a, b in zip(pieces[k], pieces[k][1:]):
        assert b["content"].startswith(a["content"][-200:])
    assert all(r["n_chars"] == len(r["content"]) <= 40_000 for r in pieces[k])


def test_overlap_never_before_the_text(spark):
    text = "Title\n" + "y" * 39_700 + "z" * 30_000
    df = spark.createDataFrame([(1, "N", text)], "id int, title string, content string")
    got = split_items(df, "id", "title", "content", min_fill=0.0).orderBy("piece_no").collect()
    assert [(r["start"], r["n_chars"]) for r in got[:2]] == [(0, 6), (6, 39_806)]
    assert got[1]["content"] == text[:39_806]
