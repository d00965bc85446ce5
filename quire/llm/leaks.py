"""Evaluation texts inside a corpus (problem 8).

Method: one Aho-Corasick automaton over the normalised passages (every window of ``WINDOW`` tokens
of every item), which reads each document once; hits keep their token positions, which map to
offsets of the original text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .consistent import _invisible, consistent

#: Tokens of a window; a CJK character is a token.
WINDOW = {"word": 5, "han": 8}
#: Gap of changed tokens inside a run, and how far a run may drift by insertions.
GAP, DRIFT = 8, 4
#: An opening sentence that so many items share is an instruction to the reader.
INSTRUCTION_ITEMS = 3
#: Items are read in blocks of at most so many tokens, each with an automaton of its own.
BLOCK_TOKENS = 2_000_000

_NEAR = sorted(range(-DRIFT, DRIFT + 1), key=abs)
_tok = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿豈-﫿]+")
_sentence = re.compile(r"[^.!?。！？:：]*[.!?。！？:：]+\s*")
_apostrophe = re.compile("(?<=\\w)['\u2019\u02bc](?=\\w)")


def _joins(ch: str) -> bool:
    """Whether normalisation may join the character to the one before it, or drop it."""
    return unicodedata.category(ch)[0] == "M" or bool(_invisible.match(ch)) or "\u1160" <= ch <= "\u11ff" or unicodedata.combining(unicodedata.normalize("NFKD", ch)[0]) > 0


def tokens(text: str) -> list[tuple[str, int, int]]:
    """The tokens of ``words`` with their offsets in ``text``.

    Case, punctuation, line breaks, quotation marks and look-alike characters make no difference.
    The normalised text is followed back through clusters (a character and what joins it), which
    normalise on their own: to the consistent text first, then to its compatibility form.
    """
    if text.isascii():
        return [(m.group(), m.start(), m.end()) for m in _tok.finditer(text.lower())]
    same, kinds = consistent(text)
    # an accent anywhere composes the whole text; resolving look-alikes keeps the number of characters
    composed = (lambda x: unicodedata.normalize("NFC", consistent(x)[0])) if kinds & 2 else (lambda x: consistent(x)[0])
    first = _spans(text, composed)
    at = [(first[a][0], first[b - 1][1]) for a, b in _spans(same, lambda x: unicodedata.normalize("NFKC", x).lower())]
    return [(m.group(), at[m.start()][0], at[m.end() - 1][1]) for m in _tok.finditer(normalised(text))]


def _spans(text: str, form) -> list[tuple[int, int]]:
    """For each character of the text in the form ``form`` gives, the span of the cluster it is from."""
    starts = [k for k, ch in enumerate(text) if not k or ch.isascii() or not _joins(ch)] + [len(text)]
    return [(a, b) for a, b in zip(starts, starts[1:]) for _ in form(text[a:b])]


def normalised(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", consistent(text)[0])
    return text.lower()


def words(text: str) -> list[str]:
    return _tok.findall(normalised(text))


def passages(items: list[tuple[int, str]]) -> dict[int, list[str]]:
    """The passage of each item as tokens, without an instruction that several items share."""
    first = {}
    for i, t in items:
        m = _sentence.match(t)
        first[i] = (tuple(words(m.group())), m.end()) if m else ((), 0)
    shared = Counter(k for k, _ in first.values() if k)
    out = {}
    for i, t in items:
        k, end = first[i]
        rest = t[end:] if k and shared[k] >= INSTRUCTION_ITEMS and t[end:].strip() else t
        out[i] = words(rest)
    return {i: w for i, w in out.items() if w}


def blocks(items: dict[int, list[str]]) -> list[dict[int, list[str]]]:
    out, size = [{}], 0
    for i, w in items.items():
        if size and size + len(w) > BLOCK_TOKENS:
            out.append({})
            size = 0
        out[-1][i] = w
        size += len(w)
    return out


def nearest(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> tuple[int, int]:
    """The shortest span that holds a place of ``a`` and one of ``b`` that don't overlap."""
    spans = []
    for x, y in ((a, b), (b, a)):
        for start, end in x:
            if (k := bisect_left(y, (end, 0))) < len(y):
                spans.append((y[k][1] - start, start, y[k][1]))
    return min(spans)[1:]


class Scanner:
    """The automaton over a block of items; ``scan`` gives the items a text holds."""

    def __init__(self, items: dict[int, list[str]], min_share: float):
        import ahocorasick

        self.items, self.min_share = items, min_share
        where = defaultdict(list)
        for i, w in items.items():
            n = min(self.window(w), len(w))
            for p in range(len(w) - n + 1):
                where[" " + " ".join(w[p : p + n]) + " "].append((i, p, n))
        self.auto = ahocorasick.Automaton()
        for k, v in where.items():
            self.auto.add_word(k, v)
        if where:
            self.auto.make_automaton()

    @staticmethod
    def window(w: list[str]) -> int:
        han = sum("㐀" <= x[0] <= "鿿" for x in w)
        return WINDOW["han"] if han * 2 > len(w) else WINDOW["word"]

    def scan(self, w: list[str]) -> list[tuple[int, float, int, int]]:
        """(item, share held, first token, last token) of each item of which enough is held."""
        if not len(self.auto) or not w:
            return []
        hits = defaultdict(list)
        ends = None
        for end, found in self.auto.iter(" " + " ".join(w) + " "):
            if ends is None:
                ends, at = {}, 0
                for k, x in enumerate(w):
                    at += len(x) + 1
                    ends[at] = k
            last = ends[end]
            for i, p, n in found:
                hits[i].append((last - n + 1, p, n))
        out = []
        for i, hs in hits.items():
            if (best := self.held(hs, len(self.items[i])))[0] >= self.min_share:
                out.append((i, *best))
        return out

    def held(self, hs: list[tuple[int, int, int]], length: int) -> tuple[float, int, int]:
        """Share of the item covered by the best one or two runs, 0 if it is under ``min_share``.

        Runs are open by the diagonal (text minus item) they have reached; on one diagonal only the
        last can go on. Equal parts of the item count once, with all their places in the text; two
        parts can stand apart if the first place of one ends before the last of the other begins.
        """
        hs.sort()
        runs: list[list[int]] = []  # text start, text end, item start, item end
        on: dict[int, list[int]] = {}
        for d, p, n in hs:
            for g in _NEAR:
                # goes on with the run: forward in text and item, close, on nearly the same diagonal
                if (r := on.get(d - p + g)) and 0 < d + n - r[1] <= n + GAP and 0 < p + n - r[3] <= n + GAP:
                    del on[d - p + g]
                    r[1], r[3] = d + n, p + n
                    break
            else:
                runs.append(r := [d, d + n, p, p + n])
            on[d - p] = r
        places = defaultdict(list)
        for a in runs:
            places[a[2], a[3]].append((a[0], a[1]))
        parts = sorted(((e - s, s, e, min(x[1] for x in at), max(x[0] for x in at)) for (s, e), at in places.items()), reverse=True)
        best, pair = math.ceil(self.min_share * length - 1e-9) - 1, None
        for k, (n, s, e, first, last) in enumerate(parts):
            if n > best:
                best, pair = n, ((s, e), None)
            if 2 * n <= best:
                break
            for m, s2, e2, first2, last2 in parts[k + 1 :]:
                if n + m <= best:
                    break
                both = n + m - max(0, min(e, e2) - max(s, s2))
                if both > best and (first <= last2 or first2 <= last):
                    best, pair = both, ((s, e), (s2, e2))
        if pair is None:
            return 0.0, 0, 0
        start, end = min(places[pair[0]]) if pair[1] is None else nearest(sorted(places[pair[0]]), sorted(places[pair[1]]))
        return best / length, start, end - 1


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, share, start, end) of every document that holds at least ``min_share`` of
    an item's passage in one or two runs; start and end are offsets in the original text.

    The held-out items are the query set and are read to the driver; each block of at most
    ``BLOCK_TOKENS`` tokens gets one automaton, sent to the executors as a broadcast, so the size
    of what is broadcast is bounded. The corpus is read once and isn't shuffled. Null or empty
    texts hold nothing; repeated rows of a document give one row.
    """
    spark = docs.sparkSession
    got = [(r[0], r[1]) for r in items.select(item_id, item_text).where(F.col(item_text).isNotNull()).distinct().toLocalIterator()]
    parts = [b for b in blocks(passages(got)) if b]
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("__text")).where(F.length("__text") > 0)
    schema = "doc_id bigint, item_id bigint, share double, start int, end int"
    out = None
    for block in parts:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            scanner = Scanner(sent.value, min_share)
            for pdf in batches:
                rows = []
                for d, t in zip(pdf["doc_id"], pdf["__text"]):
                    if found := scanner.scan(words(t)):
                        at = tokens(t)
                        rows += [(d, i, s, at[a][1], at[b][2]) for i, s, a, b in found]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "start", "end"])

        part = src.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.min_by("start", F.col("share") * -1).alias("start"), F.min_by("end", F.col("share") * -1).alias("end"))
