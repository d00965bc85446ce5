"""Near-duplicate records with small edits (problem 1).

Method: an exact set-similarity self-join with set-relation skipping. A record is the set of its
neighbouring word pairs. Two similar sets share so many elements that two of the rarest shared ones
fall into the same of ``GROUPS`` groups of elements; an index list therefore holds the sets that
have the same two elements of a group in reach, and is a small part of the list of either. Lists
are sorted by size, and what position and size can't let reach the threshold is skipped whole.
Within a long list, the answers of a set that is highly similar to the one before are derived from
that one's computed answers: sets farther from the leader than the difference of the two allows
aren't looked at again. Sketches stand for the sets there and can only overstate an overlap, so no
link is lost; every link is then checked on the sets themselves.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.components import connected_components
from quire.session import materialize, release

#: Words: an ideograph each, else runs of letters and digits.
WORD = r"\p{IsHan}|[\p{L}\p{M}\p{N}&&[^\p{IsHan}]]+"
#: Groups of elements; two sets that share more elements than that share two of one group.
GROUPS = 16
#: Records from which the order and the groups of elements are learned, and elements told apart there (a power of 2).
SAMPLE, SEEN = 20_000, 18
#: Elements, and records, from which it is learned which elements come together.
TOGETHER = (1500, 8000)
#: Entries of a task's index lists, and pairs of entries compared at once.
TASK, CHUNK = 2_000_000, 1 << 20
#: Records of which a round makes all lists, and the most rounds.
ROUND, ROUNDS = 300_000, 8
#: Entries from which a list is compared by blocks and leaders.
LONG = 2048
#: Bits of a key's sort value that hold the size.
SIZE_BITS = 20
#: Entries of a block; lists up to DIRECT entries are compared without blocks.
BLOCK, DIRECT = 64, 48
#: 64-bit words of a sketch.
SKETCH = 4
#: A set this near to the leader (differing sketch bits) takes over the leader's answers.
NEAR = 48


def words(text: Column) -> Column:
    """Lower-case words of a text in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) to (id, n, c1, c2, tokens): the set of neighbouring pairs of words as hashes, its size and
    two hashes of it; a single word stands for itself. Of an empty set ``c1`` is the id, as it is no one's copy."""
    for b in batches:
        ids, lens = b.column("id").to_numpy(), pc.list_value_length(b.column("words")).to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        coded = b.column("words").flatten().dictionary_encode()
        h = pd.util.hash_array(np.array([*coded.dictionary.to_pylist(), ""], object), categorize=False)[coded.indices.to_numpy()]
        rows = np.repeat(np.arange(len(ids)), lens)
        near = np.flatnonzero(rows[1:] == rows[:-1])
        alone = np.flatnonzero((lens == 1)[rows])
        tokens = np.concatenate([_mix(_mix(h[near]) + h[near + 1]), _mix(h[alone])])
        rows = np.concatenate([rows[near], rows[alone]])
        order = np.lexsort((tokens, rows))
        tokens, rows = tokens[order], rows[order]
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])][: len(rows)]
        tokens, rows = tokens[new], rows[new]
        n = np.bincount(rows, minlength=len(ids))
        ends = np.r_[0, np.cumsum(n)]
        sums = [np.r_[np.uint64(0), np.cumsum(_mix(tokens ^ np.uint64(k)))] for k in (1, 2)]
        c1, c2 = ((x[ends[1:]] - x[ends[:-1]]).view(np.int64) for x in sums)
        out = {"id": pa.array(ids), "n": pa.array(n.astype(np.int32)), "c1": pa.array(np.where(n > 0, c1, ids)), "c2": pa.array(c2)}
        yield pa.RecordBatch.from_pydict(out | {"tokens": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens.view(np.int64)))})


def _needed(a, b, t: float):
    """Shared elements that sets of these sizes need for a Jaccard similarity of ``t``."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)


def _reach(n1, p1, n2, p2):
    """The most elements that two sets can share if the first shared one stands at p1 and p2."""
    return np.minimum(n1 - p1, n2 - p2)


def list_links(n: np.ndarray, pos: np.ndarray, bits: np.ndarray, side: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate links (i, j), i < j, among the entries of one index list.

    ``n`` sizes, ``pos`` places of the list's element counted from 0, ``bits`` sketches (entries,
    SKETCH), ``side`` 0 or 1: with both sides present only links between the sides are wanted.
    Every pair with similarity ``t`` or more whose first shared element is the list's comes out.
    """
    m = len(n)
    both = bool(side.any()) and not bool(side.all())
    out_i, out_j = [], []
    if m <= DIRECT:
        i, j = np.triu_indices(m, 1)
        if both:
            keep = side[i] != side[j]
            i, j = i[keep], j[keep]
        need = _needed(n[i], n[j], t)
        keep = _reach(n[i], pos[i], n[j], pos[j]) >= need
        i, j, need = i[keep], j[keep], need[keep]
        keep = (n[i] + n[j] - _differ(bits[i], bits[j])) / 2 >= need
        return i[keep], j[keep]
    order = np.lexsort((n, pos))
    n, pos, bits, side = n[order], pos[order], bits[order], side[order]
    starts = np.arange(0, m, BLOCK)
    block_pos = pos[starts]
    low, high = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
    leader, leader_dist, leader_seen = -1, None, None
    for k in range(m - 1):
        # blocks by position: what no entry of a block can reach is skipped whole
        reach = np.minimum(n[k] - pos[k], high - np.maximum(block_pos, 0))
        ok = (reach >= _needed(n[k], low, t)) & (starts + BLOCK > k + 1)
        if not ok.any():
            continue
        cand = np.flatnonzero(np.repeat(ok, BLOCK)[:m])
        cand = cand[cand > k]
        if leader >= 0:
            gap = int(_differ(bits[leader], bits[k]))
            if gap <= NEAR:
                # derived from the leader's answers: an entry differs from this set by no less than
                # it differs from the leader less the gap
                known = leader_seen[cand]
                far = known & (leader_dist[cand] - gap > n[k] + n[cand] - 2 * _needed(n[k], n[cand], t))
                cand = cand[~far]
            else:
                leader = -1
        if both:
            cand = cand[side[cand] != side[k]]
        dist = _differ(bits[cand], bits[k])
        if leader < 0 and k + 1 < m and int(_differ(bits[k], bits[k + 1])) <= NEAR:
            leader, leader_dist, leader_seen = k, np.zeros(m, np.int32), np.zeros(m, bool)
            leader_dist[cand], leader_seen[cand] = dist, True
        need = _needed(n[k], n[cand], t)
        hit = cand[(n[k] + n[cand] - dist >= 2 * need) & (_reach(n[k], pos[k], n[cand], pos[cand]) >= need)]
        if len(hit):
            out_i.append(np.full(len(hit), k))
            out_j.append(hit)
    if not out_i:
        return np.zeros(0, int), np.zeros(0, int)
    a, b = order[np.concatenate(out_i)], order[np.concatenate(out_j)]
    return np.minimum(a, b), np.maximum(a, b)


def _sketch(flat: np.ndarray, rows: np.ndarray, m: int) -> np.ndarray:
    h = (flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 8)
    out = np.zeros((m, SKETCH), np.uint64)
    np.bitwise_or.at(out, (rows, (h >> np.uint64(6)).astype(int)), np.uint64(1) << (h & np.uint64(63)))
    return out


def sketch(sets: pd.Series) -> np.ndarray:
    """A bit for each element's hash: sets that differ in d elements differ in at most d bits."""
    flat = np.concatenate([*sets.to_numpy(), np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
    return _sketch(flat, np.repeat(np.arange(len(sets)), sets.map(len).to_numpy()), len(sets))


def _seen(tokens: np.ndarray) -> np.ndarray:
    """A number for each element; the few that share one share order and group."""
    return ((tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SEEN)).astype(np.int64)


def _flat(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements, their rows and the rows' sizes."""
    n = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(n)), n), n


def learn(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """How often elements are seen in a sample, and their groups.

    Any order and any groups lose nothing. Frequent elements that often come together are put into
    different groups, so that two of one group seldom come together.
    """
    flat, rows, _ = _flat(tokens)
    seen = _seen(flat)
    count = np.bincount(seen, minlength=1 << SEEN).astype(np.int32)
    group = (np.arange(1 << SEEN) % GROUPS).astype(np.uint8)
    m, few = TOGETHER
    top = np.argsort(-count, kind="stable")[:m]
    at = np.full(1 << SEEN, -1)
    at[top] = np.arange(m)
    keep = (at[seen] >= 0) & (rows < few)
    x = np.zeros((few, m), np.float32)
    x[rows[keep], at[seen[keep]]] = 1
    together = (x.T @ x).astype(np.float64) ** 2
    cost = np.zeros((m, GROUPS))
    for k in range(m):
        g = int(cost[k].argmin())
        group[top[k]] = g
        cost[:, g] += together[k]
    return count, group


def _entries(t: float, count: np.ndarray, group: np.ndarray, first: int, last: int, buckets: int):
    """(id, tokens) to the index entries of the groups from ``first`` to before ``last``, packed by bucket.

    A set has an entry for each two elements of a group that are in reach: if sets share ``GROUPS``
    + 1 elements or more, the rarest so many of those are among the first n - needed + ``GROUPS``
    + 1 of each, and two are of one group. Sets small enough to link with fewer shared elements
    have entries for single elements too, in the round of group 0. ``pos`` is the place of the later
    element, less what the others may take, as ``list_links`` wants it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, (tokens, rows, n) = b.column("id").to_numpy(), _flat(b.column("tokens"))
            if not len(tokens):
                continue
            bits, seen = _sketch(tokens, rows, len(ids)), _seen(tokens)
            order = np.lexsort((tokens, count[seen], rows))
            tokens, of = tokens[order], group[seen[order]]
            pos = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            least = np.ceil(t * n - 1e-9).astype(np.int64)
            reach = np.where(n > GROUPS, n - least + 1 + GROUPS, 0)
            keep = np.flatnonzero((pos < reach[rows]) & (of >= first) & (of < last))
            keep = keep[np.argsort(rows[keep] * GROUPS + of[keep], kind="stable")]
            same = rows[keep] * GROUPS + of[keep]
            keys, recs, places = [], [], []
            for d in range(1, len(keep)):
                i = np.flatnonzero(same[d:] == same[:-d])
                if not len(i):
                    break
                x, y = keep[i], keep[i + d]
                keys.append(_mix(_mix(tokens[x]) + tokens[y]))
                recs.append(rows[x])
                places.append(np.maximum(pos[y] - GROUPS, 0))
            if first == 0:
                alone = np.flatnonzero((pos < (n - least + 1)[rows]) & (_needed(n, least, t) <= GROUPS)[rows])
                keys.append(_mix(tokens[alone] ^ np.uint64(3)))
                recs.append(rows[alone])
                places.append(pos[alone])
            if not keys:
                continue
            key, rec, place = np.concatenate(keys), np.concatenate(recs), np.concatenate(places).astype(np.int32)
            bucket = ((key & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket.astype(np.int16) if buckets < 1 << 15 else bucket, kind="stable")
            key, rec, place = key[order], rec[order], place[order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = {k: [] for k in ("bucket", "key", "rec", "pos", "ids", "n", "bits")}
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
                lo, hi = cuts[k], cuts[k + 1]
                mark = np.zeros(len(ids), bool)
                mark[rec[lo:hi]] = True
                place_of = np.cumsum(mark, dtype=np.int32) - 1
                out["bucket"].append(int(k))
                for c, x in (("key", key[lo:hi]), ("rec", place_of[rec[lo:hi]]), ("pos", place[lo:hi]), ("ids", ids[mark]), ("n", n[mark].astype(np.int32)), ("bits", bits[mark])):
                    out[c].append(x.tobytes())
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "bucket" else pa.binary()) for c, v in out.items()})

    return run


def lists_links(key: np.ndarray, rec: np.ndarray, pos: np.ndarray, n: np.ndarray, bits: np.ndarray, t: float) -> np.ndarray:
    """Candidate links (2, links), as numbers of records, among the entries (``key``, ``rec``, ``pos``) of many index lists.

    ``n`` and ``bits`` are the records'. The lists are those of equal keys.
    """
    top = (1 << SIZE_BITS) - 1
    value = (key & ~np.uint64(top)) | np.minimum(n[rec], top).astype(np.uint64)
    order = np.argsort(value)
    value = value[order]
    lists = value >> np.uint64(SIZE_BITS)
    cuts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1], True])
    length = np.diff(cuts)
    found = []
    for k in np.flatnonzero(length >= LONG):
        at = order[cuts[k] : cuts[k + 1]]
        r = rec[at]
        i, j = list_links(n[r].astype(float), pos[at], bits[r], np.zeros(len(r), int), t)
        found.append(np.stack([r[i], r[j]]))
    keep = np.repeat((length > 1) & (length < LONG), length)
    order, value = order[keep], value[keep]
    rec, pos = rec[order], pos[order]
    size = n[rec].astype(np.int64)
    # the largest set with which the place leaves enough to share; a set that can't be linked with its own size can only be the larger
    most = np.floor((size - pos) * (1 + t) / t - size + 1e-6).astype(np.int64)
    early = most >= size
    e = np.flatnonzero(early)
    ve = value[e]
    lists = value & ~np.uint64(top)
    end = np.searchsorted(ve, lists | np.clip(most, 0, top).astype(np.uint64), "right")
    start = np.searchsorted(ve, lists | np.clip(np.ceil(t * size - 1e-9), 0, top).astype(np.uint64), "left")
    start[e] = np.arange(1, len(e) + 1)
    wide = np.maximum(end - start, 0)
    upto = np.r_[0, np.cumsum(wide)]
    lo = 0
    while lo < len(wide):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CHUNK, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), wide[lo:hi])
        j = e[np.arange(upto[hi] - upto[lo]) - (upto[lo:hi] - upto[lo])[i - lo] + start[i]]
        keep = size[i] <= most[j]
        i, j = i[keep], j[keep]
        a, b = rec[i], rec[j]
        spare = size[i] + size[j] - 2 * _needed(size[i], size[j], t).astype(np.int64)
        differ = np.zeros(len(a), np.int64)
        for w in range(SKETCH):
            differ += np.bitwise_count(bits[a, w] ^ bits[b, w])
            keep = differ <= spare
            a, b, spare, differ = a[keep], b[keep], spare[keep], differ[keep]
        found.append(np.stack([a, b]))
        lo = hi
    if not found:
        return np.zeros((2, 0), np.int64)
    a, b = np.concatenate(found, axis=1).astype(np.int64)
    pairs = np.unique(np.minimum(a, b) * len(n) + np.maximum(a, b))
    pairs = np.stack([pairs // max(len(n), 1), pairs % max(len(n), 1)])
    return pairs[:, pairs[0] < pairs[1]]


def _links(t: float):
    def run(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]
        ids = read("ids", np.int64)
        before = np.cumsum([0, *map(len, ids)])
        rec = np.concatenate([r + k for r, k in zip(read("rec", np.int32), before)])
        n, bits = np.concatenate(read("n", np.int32)), np.concatenate(read("bits", np.uint64)).reshape(-1, SKETCH)
        got = np.concatenate(ids)[lists_links(np.concatenate(read("key", np.uint64)), rec, np.concatenate(read("pos", np.int32)), n, bits, t)]
        return pa.table({"a": got.min(axis=0), "b": got.max(axis=0)})

    return run


def _only(sets: DataFrame, ids: DataFrame, total: int) -> DataFrame:
    """The rows of ``sets`` whose id is among ``ids``, and some more: a bit a hash stands for the ids, in 8 MB at most."""
    size = 1 << min(26, max(16, (8 * total).bit_length()))
    bit = F.pmod(F.xxhash64("id"), F.lit(size))
    words = ids.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {size}) & 63 AS int))").alias("m"))
    got = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    marks = np.zeros(size >> 6, np.uint64)
    marks[got.column("w").to_numpy()] = got.column("m").to_numpy().view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("bit").to_numpy()
            keep = (marks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield b.filter(pa.array(keep.astype(bool))).select(["id", "tokens"])

    return sets.select("id", "tokens", bit.alias("bit")).mapInArrow(run, "id bigint, tokens array<bigint>")


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, shared, n_a, n_b), a < b: all pairs of different sets with Jaccard similarity of at
    least ``threshold``. ``sets`` has (id, tokens): unique ids and arrays of distinct longs; empty
    sets are similar to none. Exact copies should be one row, as ``near_duplicates`` does it.

    The lists of many sets are made and compared in rounds, some groups of elements each, so that no
    round holds all entries at once.
    """
    spark = sets.sparkSession
    total = sets.count()
    some = sets.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // SAMPLE))) == 0).select("id", "tokens").toArrow().sort_by("id")
    count, group = learn(some.column("tokens").combine_chunks())
    rounds = min(ROUNDS, max(1, -(-total // ROUND)))
    edges = [GROUPS * k // rounds for k in range(rounds + 1)]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * 100 // rounds // TASK))
    schema = "bucket int, " + ", ".join(f"{c} binary" for c in ("key", "rec", "pos", "ids", "n", "bits"))
    cand = None
    for first, last in zip(edges[:-1], edges[1:]):
        entries = sets.select("id", "tokens").mapInArrow(_entries(threshold, count, group, first, last, buckets), schema)
        got = entries.groupBy("bucket").applyInArrow(_links(threshold), "a bigint, b bigint").distinct()
        if rounds > 1:
            got = materialize(got, "candidates")
            gc.collect()
            spark.sparkContext._jvm.System.gc()  # else a round's shuffle files stay while the next writes its own
        cand = got if cand is None else cand.unionByName(got)
    if rounds > 1:
        cand = cand.distinct()
        sets = materialize(_only(sets, cand.select(F.explode(F.array("a", "b")).alias("id")), total), "linked")
    x = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    return (
        cand.join(x, "a")
        .join(y, "b")
        .select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("shared"), F.size("ta").alias("n_a"), F.size("tb").alias("n_b"))
        .where(F.col("shared") >= F.lit(threshold) * (F.col("n_a") + F.col("n_b") - F.col("shared")))
    )


def near_duplicates(df: DataFrame, id_col: str, text: Column, threshold: float) -> DataFrame:
    """(id, group_id, n_links): every record's group and its number of links to other texts.

    Groups are the connected components of the links, named by their smallest id; a record without
    a link is its own group. Records whose word pairs are the same set are copies: they count as one
    text, share a group, and their links are those of the text. A null or empty text is no one's
    copy. Ids must be unique. An empty table gives an empty result.
    """
    said = df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).select("id", words(F.coalesce("text", F.lit(""))).alias("words"))
    rows = materialize(said.mapInArrow(_shingles, "id bigint, n int, c1 bigint, c2 bigint, tokens array<bigint>"), "sets")
    same = ["n", "c1", "c2"]
    more = rows.groupBy(*same).agg(F.min("id").alias("head"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = materialize(rows.select("id", *same).join(more, same).where("id <> head").select("id", "head"), "copies")
    texts = rows.where("n > 0").select("id", "tokens").join(copies.select("id"), "id", "left_anti")
    links = materialize(similar_pairs(texts, threshold).select("a", "b"), "links")
    comp = connected_components(links)
    counts = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    of_text = comp.select(F.col("node").alias("head"), "component").join(counts.withColumnRenamed("id", "head"), "head")
    return (
        rows.select("id")
        .join(copies, "id", "left")
        .withColumn("head", F.coalesce("head", "id"))
        .join(of_text, "head", "left")
        .select("id", F.coalesce("component", "head").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    )


def group_pairs(groups: DataFrame, part: int = 2000) -> DataFrame:
    """(a, b), a < b: all pairs of ids in one group of (id, group_id).

    A large group's members are spread over parts, so that no task makes more than ``part`` times
    the group's pairs for its rows.
    """
    size = groups.groupBy("group_id").agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / part).cast("int"))
    g = groups.select("id", "group_id").join(size, "group_id")
    left = g.select("group_id", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    right = g.select("group_id", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["group_id", "part"]).where("a < b").select("a", "b")
