"""An index over one part of the cards: their bigrams as numbers, titles by bigram, and the search for
the cards most like a given one."""

from __future__ import annotations

from itertools import pairwise

import numpy as np

#: Bits of a character in a gram's number, and what stands in place of the second of a single character.
BITS = 21
NONE = (1 << BITS) - 1
#: Texts whose grams are counted at once, and cards compared at once.
CHUNK, STEP, FIRST = 4096, 64, 64


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, grams, tf): the distinct bigrams of text i are those from places[i] to places[i + 1],
    in order. A single character is its own only gram."""
    sizes, codes, counts = [], [], []
    for at in range(0, len(texts), CHUNK):
        some = texts[at : at + CHUNK]
        n = np.fromiter(map(len, some), np.int64, len(some))
        c = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(some)), n)
        two = np.flatnonzero(of[1:] == of[:-1]) if len(of) else of
        one = np.flatnonzero(n[of] == 1)
        g = np.concatenate(((of[two] << 2 * BITS) | (c[two] << BITS) | c[two + 1], (of[one] << 2 * BITS) | (c[one] << BITS) | NONE))
        g, tf = np.unique(g, return_counts=True)
        sizes.append(np.bincount(g >> 2 * BITS, minlength=len(some)))
        codes.append(g & ((1 << 2 * BITS) - 1))
        counts.append(tf)
    flat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return np.concatenate(([0], np.cumsum(flat(sizes, np.int64)))), flat(codes, np.int64), flat(counts, np.int32)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def rounded(x):
    """To three places, halves up."""
    return np.floor(x * 1000 + 0.5) / 1000


class Weights:
    """Weights of the grams of a corpus; ``grams`` is in order."""

    def __init__(self, grams: np.ndarray, df: np.ndarray, cards: int):
        self.grams, self.idf = grams, np.log((cards + 1) / (df + 1)) + 1
        self.unseen = float(np.log(len(grams) + 1) + 1)

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each gram, and whether the corpus has it."""
        if not len(self.grams):
            return np.zeros(len(g), np.int32), np.zeros(len(g), bool)
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        return at.astype(np.int32), self.grams[at] == g


class Titles:
    """Distinct titles: their grams, weighed as a set."""

    def __init__(self, texts: list[str], weights: Weights):
        self.texts = texts
        self.at, self.grams, _ = gram_counts(texts)
        place, known = weights.find(self.grams)
        self.w = np.where(known, weights.idf[place], 1.0) if len(weights.grams) else np.ones(len(self.grams))
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.at))
        self.mass = np.bincount(self.of, self.w, len(texts))


class Vectors:
    """Weighed grams of texts and the length of each vector (1 where it has none)."""

    def __init__(self, texts: list[str], weights: Weights):
        at, grams, tf = gram_counts(texts)
        place, known = weights.find(grams)
        w = tf * (np.where(known, weights.idf[place], weights.unseen) if len(weights.grams) else weights.unseen)
        of = np.repeat(np.arange(len(texts)), np.diff(at))
        norm = np.sqrt(np.bincount(of, w * w, len(texts)))
        self.norm = np.where(norm > 0, norm, 1.0)
        # a gram that the corpus lacks counts in the length only
        self.place, self.w = place[known], w[known]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(of[known], minlength=len(texts)))))


def by_title(titles: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct titles, places, cards): the cards of title i in their order."""
    ids: dict[str, int] = {}
    of = np.fromiter((ids.setdefault(t, len(ids)) for t in titles), np.int64, len(titles))
    return list(ids), np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(ids))))), np.argsort(of, kind="stable")


class CardIndex:
    """Cards of a part of the corpus, in the order of their keys."""

    def __init__(self, titles: list[str], texts: list[str], weights: Weights, scale: float, top: int, least: float):
        self.weights, self.scale, self.top, self.least, self.n = weights, scale, top, least, len(titles)
        distinct, self.title_at, self.title_cards = by_title(titles)
        self.titles, self.vectors = Titles(distinct, weights), Vectors(texts, weights)
        self.title_of = np.empty(self.n, np.int64)
        self.title_of[self.title_cards] = np.repeat(np.arange(len(distinct)), np.diff(self.title_at))
        order = np.argsort(self.titles.grams, kind="stable")
        self.post_grams, first = np.unique(self.titles.grams[order], return_index=True)
        self.post_at, self.post_titles = np.append(first, len(order)), self.titles.of[order]
        self.text_post = None
        self.query = np.zeros(max(1, len(weights.grams)))

    def title_scores(self, a: str, grams: np.ndarray, w: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
        """(titles, scores): those that share a gram with ``a``."""
        if not len(grams) or not len(self.post_grams):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.post_grams, grams), len(self.post_grams) - 1)
        hit = self.post_grams[at] == grams
        at, w = at[hit], w[hit]
        sizes = self.post_at[at + 1] - self.post_at[at]
        shared = np.bincount(self.post_titles[spread(self.post_at[at], sizes)], np.repeat(w, sizes), len(self.titles.texts))
        some = np.flatnonzero(shared)
        shared, other = shared[some], self.titles.mass[some]
        score = 2 * shared / (mass + other)
        # a title held in another shares all of its grams
        for i in np.flatnonzero(shared >= np.minimum(mass, other) * (1 - 1e-9)):
            b = self.titles.texts[some[i]]
            la, lb = len(a), len(b)
            if a == b:
                score[i] = 1.0
            elif min(la, lb) >= 2 and (a in b if la <= lb else b in a):
                score[i] = 0.5 + 0.5 * min(la, lb) / max(la, lb)
        return some, score

    def cosines(self, cards: np.ndarray) -> np.ndarray:
        """Of the query that is set with some cards."""
        v = self.vectors
        sizes = v.at[cards + 1] - v.at[cards]
        p = spread(v.at[cards], sizes)
        return np.bincount(np.repeat(np.arange(len(cards)), sizes), self.query[v.place[p]] * v.w[p], len(cards))

    def all_cosines(self, place: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of a query with every card, by the cards of each gram."""
        v = self.vectors
        if self.text_post is None:
            order = np.argsort(v.place, kind="stable")
            grams, first = np.unique(v.place[order], return_index=True)
            of = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(v.at))
            self.text_post = grams, np.append(first, len(order)), of[order], v.w[order]
        grams, at, cards, weight = self.text_post
        k = np.minimum(np.searchsorted(grams, place), len(grams) - 1)
        hit = grams[k] == place
        k, w = k[hit], w[hit]
        sizes = at[k + 1] - at[k]
        p = spread(at[k], sizes)
        return np.bincount(cards[p], weight[p] * np.repeat(w, sizes), self.n)

    def score(self, title: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        return 0.5 * title + 0.5 * np.minimum(1.0, self.scale * cosine)

    def best(self, cards: np.ndarray, title: np.ndarray, cosine: np.ndarray) -> list[np.ndarray]:
        """The best of some cards, in their order: (cards, scores, title scores, cosines, rounded scores)."""
        s = self.score(title, cosine)
        got = [x[s >= self.least] for x in (cards, s, title, cosine)]
        got.append(rounded(got[1]))
        first = np.lexsort((got[0], -got[4]))[: self.top]
        return [x[first] for x in got]

    def of_titles(self, titles: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cards, title scores, the most their rounded score can be), that falling, then by key."""
        sizes = self.title_at[titles + 1] - self.title_at[titles]
        cards, t = self.title_cards[spread(self.title_at[titles], sizes)], np.repeat(scores, sizes)
        most = rounded(0.5 * t + 0.5)
        order = np.lexsort((cards, -most))
        return cards[order], t[order], most[order]

    def search(self, queries: Vectors, titles: Titles, at: np.ndarray, asked: np.ndarray):
        """(query, best cards) for the queries ``asked``, those of title i from ``at[i]`` to ``at[i + 1]``.

        The title's score bounds the whole, as a text counts for half at most: cards are compared in
        the order of that bound until it falls behind the last of the best. Where it doesn't, every
        card is.
        """
        for i, a in enumerate(titles.texts):
            g = slice(titles.at[i], titles.at[i + 1])
            some, ts = self.title_scores(a, titles.grams[g], titles.w[g], titles.mass[i])
            rest = 0.5  # the most that cards beyond the first can score
            if len(some) > FIRST:
                near = np.argpartition(-ts, FIRST)
                rest = float(rounded(0.5 * ts[near[FIRST]] + 0.5))
                near = near[:FIRST]
            else:
                near = np.arange(len(some))
            first = self.of_titles(some[near], ts[near])
            if not len(some):  # no title is like it: all cards have the same bound
                k = min(self.n, 16 * STEP)
                first = np.arange(k), np.zeros(k), np.full(k, 0.5)
            for q in asked[at[i] : at[i + 1]]:
                v = slice(queries.at[q], queries.at[q + 1])
                place, w = queries.place[v], queries.w[v] / queries.norm[q]
                self.query[place] = w
                got = self.walk(first, None)
                if not (self.full(got) and (got[4][-1] > rest or not len(some) and got[4][-1] == 0.5)):
                    # all cards whose title alone leaves them a chance
                    limit = got[4][-1] if self.full(got) else 0.0
                    if limit > 0.5:
                        more = rounded(0.5 * ts + 0.5) >= limit
                        more[near] = False
                        got = self.walk(self.of_titles(some[more], ts[more]), got)
                    else:
                        t = np.zeros(len(self.titles.texts))
                        t[some] = ts
                        cos = self.all_cosines(place, w) / self.vectors.norm if len(place) else np.zeros(self.n)
                        got = self.best(np.arange(self.n), t[self.title_of], cos)
                self.query[place] = 0.0
                if len(got[0]):
                    yield q, got

    def full(self, got: list[np.ndarray]) -> bool:
        return len(got[0]) >= self.top

    def walk(self, cards: tuple[np.ndarray, np.ndarray, np.ndarray], got: list[np.ndarray] | None) -> list[np.ndarray]:
        """The best of ``got`` and some cards in the order of their bounds."""
        c, t, most = cards
        got = got or [np.zeros(0, np.int64), *(np.zeros(0) for _ in range(4))]
        edges = [*range(0, len(c), STEP), len(c)]
        for a, b in pairwise(edges):
            # the last of the best comes before all that is left
            if self.full(got) and (got[4][-1], -got[0][-1]) > (most[a], -c[a]):
                break
            cos = self.cosines(c[a:b]) / self.vectors.norm[c[a:b]]
            got = self.best(np.concatenate((got[0], c[a:b])), np.concatenate((got[2], t[a:b])), np.concatenate((got[3], cos)))
        return got
