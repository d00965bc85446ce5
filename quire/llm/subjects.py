"""The subject areas of each document (problem 10).

Method: labels are propagated over the document-similarity graph by iterative joins, with trusted
seeds clamped and several subjects kept. The graph is held in its factors: two documents are as
similar as the terms they share tell, so a step goes from documents to terms and from terms back to
documents, which carries every link of the graph without writing one row for each pair. A link
counts only where its term is verified: seen often enough, and telling one subject from the others.
What a document is about is then decided by its own sentences, outside quoted passages.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize, release

#: The most subjects: each is a column of the score tables.
MOST_SUBJECTS = 200
#: Pseudo-observations of the collection's mix that a term starts with, and what it must tell (nats).
PRIOR, VERIFIED = 2.0, 0.7
#: How much more a seed counts than a document labelled by propagation, and the evidence at which a
#: document counts half.
SEED, EVIDENCE = 5.0, 20.0
#: Steps of propagation.
STEPS = 2
#: A further subject needs this many sentences and this share of those of the main one.
SENTENCES, SHARE = 2, 0.25
#: Texts and characters that are read at once.
ROWS, CHARS = 512, 1 << 19

# The blocks of ideographs (ranges are far faster to match than the script property).
HAN = "㐀-鿿豈-﫿"
# Quotation marks, opening and closing.
QUOTED = r"“[^”]*”|「[^」]*」|『[^』]*』|«[^»]*»|\"[^\"]{1,1000}\""
OPENING = "“「『«\""


_quoted_line = re.compile(r"^[ \t]*>.*$", re.M)
# A set of characters comes first, and what must be before them after it: so few places are tried.
_wrapped = re.compile(rf"[ \t\r\n](?<=[{HAN}，、；：。！？][ \t\r\n])(?:(?<=\n)|(?<=\r)\n|(?<=[ \t])[ \t]*\r?\n)(?=[{HAN}，])")
_hyphened = re.compile(r"[-‐¬](?<=[^\W\d_][-‐¬])\r?\n(?=[^\W\d_])")
_quoted = re.compile(QUOTED)
_end = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n\s*\n")
_ended = re.compile(r"[.!?]\s|[。！？]|\n\s*\n")

# What a character is to ``_read``.
LETTER, IDEOGRAPH, SPACE, STOP, FULL_STOP = range(1, 6)


def _own(text: str) -> str:
    """A text without quoted lines and passages; wrapped lines are joined."""
    t = text
    if ">" in t:
        t = _quoted_line.sub(" ", t)
    if "\n" in t:
        t = _hyphened.sub("", _wrapped.sub("", t))
    return _quoted.sub(" ", t) if any(c in t for c in OPENING) else t


def sentences(text: str) -> list[str]:
    """The sentences of a text, without quoted lines and passages; wrapped lines are joined."""
    return _end.split(_own(text))


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point, as the expressions have it."""
    every = np.arange(sys.maxunicode + 1, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.zeros(len(every), np.uint8)
    for kind, e in ((LETTER, rf"[^\W\d_{HAN}]+"), (IDEOGRAPH, rf"[{HAN}]+"), (SPACE, r"\s+"), (STOP, "[.!?]"), (FULL_STOP, "[。！？]")):
        for m in re.finditer(e, every):
            out[m.start() : m.end()] = kind
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """64 bits to as many that look random, one to one (the end of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each term's sentence and hash, and the number that each text's sentences begin at.

    Terms are words of four letters or more, and pairs of ideographs. All texts are read at once,
    as an array of characters; sentences end where ``_end`` splits, and at each text's end.
    """
    joined = "\n\n".join(texts) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kind = _kinds()[c]
    ends = kind == FULL_STOP
    ends[:-1] |= (kind[:-1] == STOP) & (kind[1:] == SPACE)
    lines, solid = np.flatnonzero(c == 10), np.cumsum(kind != SPACE)
    ends[lines[1:][solid[lines[1:]] == solid[lines[:-1]]]] = True  # nothing but space since the line before
    number = np.cumsum(ends)
    edges = np.flatnonzero(np.diff(kind == LETTER, prepend=False, append=False))
    lo, n = edges[::2], edges[1::2] - edges[::2]
    lo, n = lo[n >= 4], n[n >= 4]
    # a word's hash is the sum of its letters', each mixed with its place in the word
    at = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(at, n)
    words = _mix(c[np.repeat(lo, n) + place] | (place.astype(np.uint64) << np.uint64(21)))
    words = np.add.reduceat(words, at) if len(at) else words
    two = np.flatnonzero((kind[:-1] == IDEOGRAPH) & (kind[1:] == IDEOGRAPH))
    pairs = _mix(c[two] | (c[two + 1].astype(np.uint64) << np.uint64(32)))
    begin = np.cumsum([0, *(len(t) + 2 for t in texts[:-1])])
    return number[np.concatenate([lo, two])], np.concatenate([words, pairs]).view(np.int64), np.concatenate([[0], number[begin[1:] - 1]])


def _pieces(text: str) -> Iterator[str]:
    """A text, cut after a sentence where it is longer than ``CHARS``."""
    lo = 0
    while len(text) - lo > CHARS and (m := _ended.search(text, lo + CHARS)):
        yield text[lo : m.end()]
        lo = m.end()
    yield text[lo:]


def _distinct(group: np.ndarray, rank: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of (group, rank), sorted."""
    key = np.sort(group * ranks + rank)
    return np.divmod(key[np.diff(key, prepend=-1) > 0], max(ranks, 1))


def _lists(of: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """A list of values for each of 0 to n - 1, from the place of each value, which are sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of ``ROWS`` rows and ``CHARS`` bytes of text at most, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(), dtype=np.int64)
    lo = 0
    while lo < b.num_rows:
        most = np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHARS, "right")
        hi = max(lo + 1, min(lo + ROWS, int(most)))
        yield b.slice(lo, hi - lo)
        lo = hi


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sentences, terms): the distinct terms of each sentence that has any, and of the text, as hashes."""
    for b in batches:
        for part in _slices(b):
            pieces = [(k, p) for k, t in enumerate(part.column("text").to_pylist()) if t for p in _pieces(_own(t).lower())]
            # all pieces at once, but for those of a text that is longer than a slice
            runs = [pieces] if len({k for k, _ in pieces}) > 1 else [[p] for p in pieces]
            number, term, begin, past = [], [], [], 0
            for run in runs:
                s, h, first = _read([p for _, p in run])
                number.append(s + past)
                term.append(h)
                begin.append(first + past)
                past = max(number[-1].max(initial=past), begin[-1].max(initial=past)) + 1
            owner = np.array([k for k, _ in pieces], np.int64)
            distinct, rank = np.unique(np.concatenate(term or [owner]), return_inverse=True)
            number, rank_in = _distinct(np.concatenate(number or [owner]), rank, len(distinct))
            of = owner[np.searchsorted(np.concatenate(begin or [owner]), number, "right") - 1]
            new = np.flatnonzero(np.diff(number, prepend=-1))
            each = pa.ListArray.from_arrays(pa.array(np.append(new, len(number)), pa.int32()), pa.array(distinct[rank_in]))
            own, rank_own = _distinct(of, rank_in, len(distinct))
            yield pa.RecordBatch.from_arrays([part.column("id"), _lists(of[new], each, part.num_rows), _lists(own, pa.array(distinct[rank_own]), part.num_rows)], names=["id", "sentences", "terms"])


def _total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _term_scores(docs: DataFrame, scores: DataFrame, f: list[str]) -> DataFrame:
    """(term, f...): each verified term's weight for each subject; the weights of a document's terms add up.

    Scores are balanced first: every subject has the same mass in the collection, so a common
    subject doesn't swallow a rare one.
    """
    mass = scores.agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in f)).first()  # one number a subject
    held = sum(m or 0.0 for m in mass)
    q = 1.0 / len(f)
    even = scores.select("id", *((F.col(c) * F.col("w") * (held * q / m if m else 0.0)).alias(c) for c, m in zip(f, mass)))
    # documents meet their scores before their terms are spread out, so only term sums are shuffled
    s = docs.select("id", "terms").join(even, "id").select(F.explode("terms").alias("term"), *f).groupBy("term").agg(*(F.sum(c).alias(c) for c in f), F.count("*").alias("df")).where("df > 1")
    n = _total([F.col(c) for c in f])
    p = s.select("term", *(((F.col(c) + PRIOR * q) / (n + PRIOR)).alias(c) for c in f))
    told = p.withColumn("tells", _total([F.col(c) * F.log(F.col(c) / q) for c in f])).where(F.col("tells") >= VERIFIED)
    return told.select("term", *((F.col("tells") * F.greatest(F.col(c) - q, F.lit(0.0))).alias(c) for c in f))


def subjects_of(df: DataFrame, id_col: str, text: Column, labels: DataFrame, label_id: str, label: str, subjects: DataFrame, subject: str, steps: int = STEPS) -> DataFrame:
    """(id, subject, sentences, share): the one or more subjects of each document.

    ``labels`` are the seeds, documents with two subjects have two rows; a subject that
    ``subjects`` doesn't list, a null and a repeated row are left out. Documents without a sentence
    that tells a subject (null and empty texts among them) have no row. ``sentences`` counts those
    that tell the subject, ``share`` their part in all that tell one. Seeds hold their labels while
    labels are propagated, but as a few are wrong, every document is decided by its own sentences.
    """
    names = sorted(r[0] for r in subjects.select(subject).where(F.col(subject).isNotNull()).distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    f = [f"f{i}" for i in range(len(names))]
    if not names:
        return df.sparkSession.createDataFrame([], "id bigint, subject string, sentences bigint, share double")
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).mapInArrow(_terms_of, "id bigint, sentences array<array<bigint>>, terms array<bigint>")
    docs = materialize(docs.where(F.size("terms") > 0), "sentences")
    given = labels.select(F.col(label_id).cast("bigint").alias("id"), F.col(label).alias("subject")).where(F.col("subject").isin(names)).distinct()
    n = F.sum(F.lit(1.0))
    seeds = materialize(given.groupBy("id").agg(*((F.sum(F.when(F.col("subject") == s, 1.0).otherwise(0.0)) / n).alias(c) for s, c in zip(names, f))), "seeds")
    seeds = seeds.withColumn("w", F.lit(1.0))
    scores, old = seeds, None
    for _ in range(steps):
        weights = materialize(_term_scores(docs, scores, f), "terms")
        got = docs.select("id", F.explode("terms").alias("term")).join(weights, "term").groupBy("id").agg(*(F.sum(c).alias(c) for c in f))
        n, n2 = _total([F.col(c) for c in f]), _total([F.col(c) * F.col(c) for c in f])
        # weak traces of other subjects fade, strong ones stay; thin evidence counts less
        spread = got.where(n > 0).select("id", *((F.col(c) * F.col(c) / n2 * n / (n + EVIDENCE)).alias(c) for c in f), F.lit(1.0).alias("w"))
        new = materialize(spread.join(seeds, "id", "left_anti").unionByName(seeds.withColumn("w", F.lit(SEED))), "scores")
        release(weights)
        if old is not None:
            release(old)
        scores = old = new
    weights = materialize(_term_scores(docs, scores, f), "terms")
    each = docs.select("id", F.posexplode("sentences").alias("k", "terms"))
    votes = each.select("id", "k", F.explode("terms").alias("term")).join(weights, "term").groupBy("id", "k").agg(*(F.sum(c).alias(c) for c in f))
    top = F.greatest(*(F.col(c) for c in f)) if len(f) > 1 else F.col(f[0])
    told = votes.where(top > 0).select("id", F.coalesce(*(F.when(F.col(c) == top, F.lit(s)) for s, c in zip(names, f))).alias("subject"), (top / _total([F.col(c) for c in f])).alias("part"), top.alias("strength"))
    told = told.where("part >= 0.5")
    count = told.groupBy("id", "subject").agg(F.count("*").alias("sentences"), F.sum("strength").alias("strength"))
    best = count.groupBy("id").agg(F.max("sentences").alias("most"), F.sum("sentences").alias("all"), F.max_by("subject", F.struct("sentences", "strength", "subject")).alias("main"))
    keep = (F.col("subject") == F.col("main")) | ((F.col("sentences") >= SENTENCES) & (F.col("sentences") >= SHARE * F.col("most")))
    return count.join(best, "id").where(keep).select("id", "subject", "sentences", (F.col("sentences") / F.col("all")).alias("share"))
