"""Forms, accents, invisible characters, spaces and look-alikes; and what must stay."""

import unicodedata

from quire.llm.consistent import KINDS, consistent, found, with_consistent


def kinds(t):
    return {k for i, k in enumerate(KINDS) if consistent(t)[1] >> i & 1}


def test_kinds():
    assert consistent("Ｓｈａｄｏｗ １２ ﬁne") == ("Shadow 12 fine", 1)
    assert consistent("café") == ("café", 2)
    assert consistent("in​vi­sible﻿") == ("invisible", 4)
    assert consistent("a b　c") == ("a b c", 8)
    assert consistent("ѕеrνer ⼈") == ("server 人", 16)
    assert consistent("Тһе Modern") == ("The Modern", 16)
    assert consistent("ɑrmenian օne 𝐀") == ("armenian one A", 17)


def test_marks_and_look_alikes_together():
    got, bits = consistent("nаїve")  # Cyrillic a and i, the i with its dots apart
    assert got == "naïve" and bits == 16 | 2
    assert unicodedata.is_normalized("NFC", got)


def test_real_words_stay():
    for t in ("хор и ухо, а также сухо о с у", "the word хор и ухо here", "Promise (книга)", "«Ψυχή» is α + β", "naïve señor", "（全形，標點！）", "Δ x"):
        assert kinds(t) == set(), t
        assert consistent(t)[0] == t


def test_stable():
    for t in ("Ｃｅnѕuѕ", "ⅾ", "nаїve", "Тһе Modern"):
        once = consistent(t)[0]
        assert consistent(once)[0] == once


def test_nulls_empties_and_repeats(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "ａ ａ", 0), (3, "ａ ａ", 0), (4, "x" * 100_000 + "ａ", 0)], "id long, t string, kinds int")
    got = {r.id: r["__k"] for r in with_consistent(df, "t", "__t", "__k").collect()}
    assert got[1] is None and got[2] == [] and got[3] == ["form", "space"]
    assert sorted(map(tuple, found(df, "t", "id", "t").collect())) == [("t", 3, "form"), ("t", 3, "space"), ("t", 4, "form")]
