"""Sources mixed to target shares of all tokens (problem 9).

Method: the tokens of each source are packed into blocks of fixed length, documents one after the
other in pseudorandom order. Each output shard draws how many of its slots go to each source from
a multinomial; a source's slots are numbered through all shards and mapped to its blocks by a keyed
pseudorandom permutation of the block numbers, another one for each round through the source. Slots
and blocks meet in a join by block number.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

#: Vocabulary file of a public tokenizer (byte-level BPE as ranks), and its pattern of words.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that cuts text into words before the byte pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Tokens of a block, slots of a shard, and standard deviations kept free for the draw.
BLOCK, SHARD, MARGIN = 256, 1024, 4.0
#: Rows of a bucket of a running total; the most sources.
BUCKET, MOST_SOURCES = 100_000, 1000


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, keep: list[str], text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, keep..., n_tokens); a null or empty text has none. Text that looks like a special token is text."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            n = [0 if not t else len(enc.encode_ordinary(t)) for t in b.column("__text").to_pylist()]
            cols = {c: b.column(c) for c in ["id", *keep]}
            yield pa.RecordBatch.from_pydict(cols | {"n_tokens": pa.array(n, pa.int64())})

    src = df.select(F.col(id_col).cast("bigint").alias("id"), *keep, text.alias("__text"))
    return src.mapInArrow(run, ", ".join(["id bigint", *(f"`{c}` {fields[c]}" for c in keep), "n_tokens bigint"]))


def running_total(df: DataFrame, key: str, bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the total of ``value`` over all rows of ``key`` that come before.

    Rows are ordered by bucket, then ``order``. Totals run within a bucket, and buckets are moved by
    what came before them, so no task holds all rows of a key.
    """
    b = df.withColumn("__bucket", bucket)
    before = Window.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(key, "__bucket").agg(F.sum(value).alias("__sum"))
    moved = totals.withColumn("__base", F.coalesce(F.sum("__sum").over(Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    return b.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0))).join(moved, [key, "__bucket"]).withColumn(out, F.col(out) + F.col("__base")).drop("__base", "__bucket")


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 at the places ``x``: a Feistel network on the next
    even power of two, walked until the result is below ``n``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def rounds(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for r in range(6):
            h = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = rounds(x.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = rounds(out[far])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Source:
    name: str
    share: float
    repeats: int
    blocks: int


def slots_for(sources: list[Source]) -> int:
    """The most slots that can be drawn so that no source runs out but for ``MARGIN`` deviations."""
    most = math.inf
    for s in sources:
        room = s.repeats * s.blocks
        if s.share > 0:
            # k p + z sqrt(k p (1 - p)) = room, solved for sqrt(k)
            z = MARGIN * math.sqrt(s.share * (1 - s.share))
            root = (-z + math.sqrt(z * z + 4 * s.share * room)) / (2 * s.share)
            most = min(most, root * root)
    return int(most) if most < math.inf else 0


@dataclass(frozen=True)
class Mix:
    """pieces: (source, block, id, n) tokens of a document in a block; slots: (shard, slot, source,
    block, round); targets: (source, target_share, max_repeats)."""

    pieces: DataFrame
    slots: DataFrame
    targets: DataFrame
    docs: DataFrame

    def documents(self) -> DataFrame:
        """(id, source, n_tokens, repeats, tokens_used): the chosen documents.

        repeats is how often the most used block of the document is used; none is above the source's
        ``max_repeats``.
        """
        uses = self.slots.groupBy("source", "block").agg(F.count("*").alias("uses"))
        used = self.pieces.join(uses, ["source", "block"]).groupBy("source", "id").agg(F.max("uses").cast("int").alias("repeats"), F.sum(F.col("uses") * F.col("n")).alias("tokens_used"))
        return self.docs.select("id", "source", "n_tokens").join(used, ["id", "source"]).select("id", "source", "n_tokens", "repeats", "tokens_used")

    def shares(self) -> DataFrame:
        """(source, target_share, tokens, actual_share, max_uses): what each source really gives."""
        sizes = self.pieces.groupBy("source", "block").agg(F.sum("n").alias("n"))
        uses = self.slots.groupBy("source", "block").agg(F.count("*").alias("uses"))
        got = sizes.join(uses, ["source", "block"]).groupBy("source").agg(F.sum(F.col("n") * F.col("uses")).alias("tokens"), F.max("uses").alias("max_uses"))
        r = self.targets.join(got, "source", "left").select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("max_uses", F.lit(0)).alias("max_uses"))
        total = r.agg(F.sum("tokens").alias("all"))
        return r.join(total).select("source", "target_share", "tokens", F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(0.0).alias("actual_share"), "max_uses")


def source_key(c: Column | str) -> Column:
    """One spelling for a source's name."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def mix(df: DataFrame, id_col: str, source: str, text: str, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK, shard: int = SHARD, seed: int = 1) -> Mix:
    """The mix of ``df`` by ``targets`` (source, target_share, max_repeats).

    Sources are compared in one spelling. Documents without a source, of a source without a target,
    or without tokens can't be chosen; a source with a target and no tokens gives nothing, and the
    others share what it leaves in proportion. Shares are met up to the draw's spread and the one
    short block at the end of a source; the total is as large as the scarcest source allows. Ids
    must be unique. Equal input, parameters and seed give an equal mix on any cluster.
    """
    spark = df.sparkSession
    t = targets.select(source_key("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("target_share > 0 and max_repeats > 0")
    rows = t.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    clean = df.select(id_col, source_key(source).alias("source"), text).where(F.col("source").isin([r.source for r in rows]))
    counted = token_counts(clean, id_col, ["source"], F.col(text), tokenizer).where("n_tokens > 0")
    docs = materialize(counted.withColumn("h", F.xxhash64(F.col("id"), F.lit(seed))), "mix")
    size = {r.source: (r.n, r.c) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("c")).collect()}
    buckets = max(1, math.ceil(max((c for _, c in size.values()), default=0) / BUCKET))
    at = running_total(docs, "source", F.pmod("h", F.lit(buckets)), ["h", "id"], "n_tokens", "at")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n_tokens") - 1) / block)
    pieces = at.select("source", "id", "at", "n_tokens", F.explode(F.sequence(first, last)).alias("block"))
    pieces = pieces.select("source", "block", "id", (F.least(F.col("at") + F.col("n_tokens"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)).alias("n"))

    have = [r for r in rows if r.source in size]
    whole = sum(r.target_share for r in have) or 1.0
    sources = [Source(r.source, r.target_share / whole, r.max_repeats, math.ceil(size[r.source][0] / block)) for r in sorted(have)]
    total = slots_for(sources)
    n_shards = math.ceil(total / shard)
    p = [s.share for s in sources]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"shard": [], "source": [], "before": [], "count": []}
            for k in b.column("id").to_pylist():
                got = np.random.default_rng([seed, k]).multinomial(min(shard, total - k * shard), p)
                out["shard"] += [k] * len(p)
                out["source"] += list(range(len(p)))
                out["before"] += np.concatenate([[0], np.cumsum(got)[:-1]]).tolist()
                out["count"] += got.tolist()
            types = {"shard": pa.int64(), "source": pa.int32(), "before": pa.int64(), "count": pa.int64()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, types[c]) for c, v in out.items()})

    counts = spark.range(n_shards).mapInArrow(draw, "shard bigint, source int, before bigint, count bigint") if sources and n_shards else spark.createDataFrame([], "shard bigint, source int, before bigint, count bigint")
    placed = running_total(counts, "source", F.floor(F.col("shard") / BUCKET), ["shard"], "count", "start")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                f = {c: part.column(c).to_numpy() for c in ("shard", "source", "before", "count", "start")}
                rep = np.repeat(np.arange(part.num_rows), f["count"])
                inner = np.arange(len(rep)) - np.repeat(np.cumsum(f["count"]) - f["count"], f["count"])
                src, j = f["source"][rep], f["start"][rep] + inner
                block_no, turn = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
                for s, x in enumerate(sources):
                    of = src == s
                    turn[of] = j[of] // x.blocks
                    for e in np.unique(turn[of]):
                        now = of & (turn == e)
                        block_no[now] = permute(j[now] % x.blocks, x.blocks, seed * 1_000_003 + s * 1009 + int(e))
                keep = turn < np.array([x.repeats for x in sources])[src]
                cols = {"shard": f["shard"][rep], "slot": f["before"][rep] + inner, "source": src, "block": block_no, "round": turn}
                names = pa.array([x.name for x in sources])
                cols = {c: pa.array(v[keep]) for c, v in cols.items()}
                cols["source"] = names.take(cols["source"])
                yield pa.RecordBatch.from_pydict(cols)

    slots = placed.select("shard", "source", "before", "count", "start").mapInArrow(fill, "shard bigint, slot bigint, source string, block bigint, round bigint")
    return Mix(pieces, slots, t, docs)
