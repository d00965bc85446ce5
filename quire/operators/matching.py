"""Related cards across books: character-bigram weights, cosine, title scores and stale reviews."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import grams, match_key
from quire.session import materialize
from quire.operators import cardindex, gestalt
from quire.operators.rows import descending, numbered

#: How a cosine is scaled before it counts as much as a title, results of a query, and the least score.
TEXT_SCALE, TOP, LEAST = 4.0, 5, 0.3
#: Cards of the corpus indexed at once, at most, and where it isn't worth to part them further; cards asked about at once.
PART, SMALL, BLOCK = 32768, 4096, 65536
#: New cards compared at once, at most; stale cards that are worth a task of their own, and tasks of a book.
NEW, STALE, TASKS = 8192, 8, 32


def card_grams(cards: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, gram, tf): bigrams of each card's text and how often they stand in it.

    A text without letters and digits, null or empty, has none.
    """
    k = cards.select(key, match_key(F.coalesce(text, F.lit(""))).alias("k"))
    return k.select(key, F.explode(grams(F.col("k"), 2)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))


def match_cards(cards: DataFrame, book: str, key: str = "card_id", titles: Column | None = None, queries: Column | None = None, top_n: int = TOP, least: float = LEAST) -> DataFrame:
    """(query, candidate, score, title_part, cosine, place): for each card of a book the best cards of
    other books.

    ``queries`` chooses which of the book's cards are asked about; without it all are. ``cards`` has key, title, definition, quote, sources. The corpus is every card that doesn't name
    the book as a source; frequencies are taken from it alone, and a bigram it lacks gets the weight
    of one that its whole vocabulary would. The score is half the title's and half the cosine's,
    which is scaled and capped. Candidates below ``least`` are dropped; the rest are ranked by the
    score to three places, then by key. No table of pairs is made: the book's cards are sent in
    blocks to each part of the corpus, which is indexed there (``cardindex``), and only the best of
    each part come out.
    """
    t = titles if titles is not None else F.col("title")
    own = F.coalesce(F.array_contains("sources", book), F.lit(False))
    text = F.concat_ws(" ", t, "definition", "quote")
    base = materialize(cards.select(key, own.alias("own"), match_key(F.coalesce(t, F.lit(""))).alias("t"), match_key(F.coalesce(text, F.lit(""))).alias("k")), "cards")
    corpus, asked = base.where("not own"), base.where("own")
    if queries is not None:
        asked = asked.where(queries)
    counted = corpus.select("k").mapInArrow(_frequencies, "gram bigint, df bigint").groupBy("gram").agg(F.sum("df").alias("df")).toArrow()
    codes, df = (counted[c].to_numpy() for c in ("gram", "df"))
    n = int(df[codes < 0].sum())
    order = np.argsort(codes)[int((codes < 0).sum()) :]
    weights = cardindex.Weights(codes[order], df[order], n)
    spark = cards.sparkSession
    parts = max(1, -(-n // PART), min(spark.sparkContext.defaultParallelism, -(-n // SMALL)))
    split = corpus.select(key, "t", "k").repartition(parts, key)
    blocks = max(1, -(-asked.count() // BLOCK))
    kind = base.schema[key].dataType.simpleString()
    found = [split.mapInArrow(_matcher(_asked(asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i), key, weights), top_n, least), f"query {kind}, candidate {kind}, score double, title_part double, cosine double, shown double") for i in range(blocks)]
    ranked = numbered(reduce(DataFrame.unionAll, found), ["query"], [F.col("shown").desc(), F.col("candidate")], "place")
    return ranked.where(F.col("place") <= top_n).select("query", "candidate", "score", "title_part", "cosine", "place")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, df) of a part of the texts; their number stands under -1."""
    n, grams, df = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        n += b.num_rows
        g, c = np.unique(cardindex.gram_counts(b.column(0).to_pylist())[1], return_counts=True)
        both = np.concatenate((grams, g))
        grams, at = np.unique(both, return_inverse=True)
        df = np.bincount(at, np.concatenate((df, c)), len(grams)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(grams, -1)), pa.array(np.append(df, n))], ["gram", "df"])


def _asked(asked: DataFrame, key: str, weights: cardindex.Weights):
    """The cards asked about, sent to all tasks: their keys, vectors and titles."""
    got = asked.select(key, "t", "k").toArrow()
    distinct, at, of = cardindex.by_title(got["t"].to_pylist())
    block = got[key].combine_chunks(), cardindex.Vectors(got["k"].to_pylist(), weights), cardindex.Titles(distinct, weights), at, of, weights
    return asked.sparkSession.sparkContext.broadcast(block)


def _matcher(sent, top_n: int, least: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        keys, vectors, titles, at, of, weights = sent.value
        if not rows or not len(keys):
            return
        part = pa.Table.from_batches(rows)
        part = part.take(pc.sort_indices(part.column(0)))
        names = part.column(0).combine_chunks()
        index = cardindex.CardIndex(part.column(1).to_pylist(), part.column(2).to_pylist(), weights, TEXT_SCALE, top_n, least)
        del rows, part

        def out(some: list) -> pa.RecordBatch:
            q = pa.array(np.repeat([x for x, _ in some], [len(x[0]) for _, x in some]))
            c, *values = (np.concatenate([x[j] for _, x in some]) for j in range(5))
            score, title, cosine, shown = values
            return pa.RecordBatch.from_arrays([keys.take(q), names.take(pa.array(c)), *map(pa.array, (score, title, cosine, shown))], ["query", "candidate", "score", "title_part", "cosine", "shown"])

        for some in batched(index.search(vectors, titles, at, of), 4096):
            yield out(some)

    return match


def stale_review(stale: DataFrame, new: DataFrame, key: str, title: str, n: int = 3) -> DataFrame:
    """(stale, candidate, score, place): for each card no longer produced, the new cards of the same
    book most like it, by the better of the definitions' and the quotations' ratio.

    Both sides have (key, title, book_id, definition, quote). Nulls count as empty; two empty texts
    aren't alike. They meet on the book; a large book is parted on both sides. In a part the ratio is
    computed only where its bound reaches the best so far (``gestalt``), so the result is that of all
    pairs.
    """
    side = lambda x, name: x.select("book_id", F.col(name).alias("__k"), F.col(title).alias("__t"), F.coalesce("definition", F.lit("")).alias("d"), F.coalesce("quote", F.lit("")).alias("q"))
    a, b = side(stale, key), side(new, key)
    sizes = a.groupBy("book_id").agg(F.count("*").alias("a")).join(b.groupBy("book_id").agg(F.count("*").alias("b")), "book_id")
    sizes = sizes.withColumn("parts", F.ceil(F.col("b") / NEW))
    sizes = sizes.select("book_id", "parts", F.least(F.ceil(F.col("a") / STALE), F.ceil(TASKS / F.col("parts"))).alias("blocks"))
    part = lambda n: F.pmod(F.xxhash64("d", "q"), F.col(n))  # noqa: E731 equal texts meet, and count once
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    both = a.join(sizes, "book_id").select("book_id", each("parts").alias("part"), part("blocks").alias("block"), F.lit(0).alias("new"), "__t", "__k", "d", "q")
    both = both.unionAll(b.join(sizes, "book_id").select("book_id", part("parts").alias("part"), each("blocks").alias("block"), F.lit(1).alias("new"), "__t", "__k", "d", "q"))
    met = ["book_id", "part", "block"]
    kind = stale.schema[key].dataType.simpleString()
    tasks = 8 * stale.sparkSession.sparkContext.defaultParallelism
    got = both.repartition(tasks, *met).sortWithinPartitions(*met, "new", "__t", "__k").mapInArrow(_most_alike(n), f"stale {kind}, candidate {kind}, __t string, score double")
    return numbered(got, ["stale"], [descending(F.col("score")), F.col("__t"), F.col("candidate")], "place").where(F.col("place") <= n).select("stale", "candidate", "score", "place")


def _most_alike(n: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.null()

        def rows():
            nonlocal kind
            for b in batches:
                kind = b.schema.field("__k").type
                yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))

        def found():
            for _, some in groupby(rows(), lambda r: r[:3]):
                asked = []
                for is_new, group in groupby(some, lambda r: r[3]):
                    if not is_new:
                        asked = list(group)
                    elif asked:
                        new = list(group)
                        texts: dict[tuple[str, str], list[int]] = {}
                        for i, r in enumerate(new):
                            texts.setdefault(r[6:], []).append(i)
                        of, done = list(texts.values()), {}
                        fields = gestalt.Texts([d for d, _ in texts]), gestalt.Texts([q for _, q in texts])
                        for s in asked:
                            if s[6:] not in done:
                                best = [(-score, i) for score, u in gestalt.most_alike(s[6:], fields, n) for i in of[u][:n]]
                                done[s[6:]] = sorted(best)[:n]
                            for score, i in done[s[6:]]:
                                yield s[5], new[i][5], new[i][4], -score

        for some in batched(found(), 4096):
            stale, candidate, t, score = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(stale, kind), pa.array(candidate, kind), pa.array(t, pa.string()), pa.array(score, pa.float64())], ["stale", "candidate", "__t", "score"])

    return match
