"""Subjects by propagation, against held-out labels and on small cases."""

import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import subjects
from quire.llm.subjects import HAN, sentences, subjects_of

WORDS = {"law": "court judge statute appeal verdict plaintiff", "sport": "match goal coach league stadium player", "food": "bread oven butter dough recipe spice"}


def _docs():
    out, k = [], 0
    for s, w in WORDS.items():
        w = w.split()
        for i in range(40):
            text = " ".join(f"The {w[i % 6]} met the {w[(i + j) % 6]} near the {w[(i + 2) % 6]}. Nobody came back here." for j in range(1, 5))
            out.append((k, text))
            k += 1
    return out


def test_propagation_and_cases(spark):
    rows = _docs()
    a, b, c = (rows[i][1] for i in (0, 40, 80))
    rows += [(1000, a + " " + b), (1001, a + ' The goal met the goal. "' + c + '"'), (1002, a + "\n> " + c), (1003, None), (1004, ""), (1005, "Nobody came back here.")]
    labels = [(i, s) for n, s in enumerate(WORDS) for i in range(n * 40, n * 40 + 12)] + [(0, "law"), (15, "unknown"), (16, None)]
    got = subjects_of(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"), spark.createDataFrame(labels, "id long, subject string"), "id", "subject", spark.createDataFrame([(s,) for s in WORDS], "category string"), "category")
    by: dict[int, set] = {}
    for r in got.collect():
        by.setdefault(r.id, set()).add(r.subject)
    held = [(n * 40 + i, s) for n, s in enumerate(WORDS) for i in range(12, 40)]
    assert sum(by.get(i) == {s} for i, s in held) >= 0.95 * len(held)
    assert by[1000] == {"law", "sport"} and by[1001] == {"law"} and by[1002] == {"law"}
    assert not {1003, 1004, 1005} & set(by)


def test_sentences():
    got = [s.strip() for s in sentences('One. Two "three four." Five\n> six.\n\n七。「八。」九\n十。') if s.strip()]
    assert got == ["One.", "Two   Five", "七。", "九十。"]


def test_empty(spark):
    e = spark.createDataFrame([], "id long, text string")
    labels = spark.createDataFrame([], "id long, subject string")
    cats = spark.createDataFrame([("law",)], "category string")
    assert subjects_of(e, "id", F.col("text"), labels, "id", "subject", cats, "category").count() == 0


def _plain(text):
    """The distinct terms of each sentence that has any, one sentence after the other."""
    out = []
    for s in sentences(text or ""):
        low = s.lower()
        w = {*re.findall(rf"[^\W\d_{HAN}]{{4,}}", low)} | {a + b for run in re.findall(rf"[{HAN}]{{2,}}", low) for a, b in zip(run, run[1:])}
        if w:
            out.append(w)
    return out


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


def _read(texts):
    return pa.Table.from_batches(subjects._terms_of(iter([_batch(texts)]))).to_pylist()


ODD = [
    "Words here. More words here! No end", None, "", "   ", "> only quoted", "abc de f", "time item emit mite", "Straße ΣΟΦΟΣ. ΟΔΟΣ.Next İstanbul ｶﾀｶﾅｶ naïve",
    "五個漢字連著。又一句！一 二三\n四五\r\n六七，八九", "hyphen-\nated hy-\r\nphen 3-\nfour", "lines one\n \t\nlines two\n\n\nlines\nthree", 'said "not this. nor this" but this「不要這個」只要這個', "½half ①once snake_case four4five 𝔸𝔹ℂ𝔻 𠀀𠀁",
    "Long text here. " * 50 + "the end", "word" * 60, ".\n\n。\n", "end.\x1cnext\x85line. \u3000wide",
]


@pytest.mark.parametrize("most", [1 << 19, 40, 5])
def test_terms_are_those_read_plainly(monkeypatch, most):
    monkeypatch.setattr(subjects, "CHARS", most)
    plain = [_plain(t) for t in ODD]
    words = sorted({w for d in plain for s in d for w in s})
    one = [r["terms"] for r in _read(words)]
    assert all(len(x) == 1 for x in one)
    code = {w: x[0] for w, x in zip(words, one)}
    assert len(set(code.values())) == len(words)
    got = _read(ODD)
    assert [r["id"] for r in got] == list(range(len(ODD)))
    assert [[sorted(s) for s in r["sentences"]] for r in got] == [[sorted(code[w] for w in s) for s in d] for d in plain]
    assert [sorted(r["terms"]) for r in got] == [sorted({code[w] for s in d for w in s}) for d in plain]


def test_reading_takes_half_of_reading_plainly():
    texts = [t for _, t in _docs()] * 5 + ["後來，第三次授粉之後，演化才穩定下來。這就是耐心的世界。" * 8] * 400
    b = _batch(texts)

    def took(f):
        best = 1e9
        for _ in range(3):
            t = time.process_time()
            f()
            best = min(best, time.process_time() - t)
        return best

    assert took(lambda: list(subjects._terms_of(iter([b])))) < 0.5 * took(lambda: [_plain(t) for t in texts])
