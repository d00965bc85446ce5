"""Filling containers of fixed capacity (problem 4).

Method: the linear grouping scheme. Large lengths are grouped by rank into groups of equal
cardinality and rounded up to the longest of each group; few sizes remain, for which the best
configurations are found by column generation; the actual documents take the places by their
rank, and small ones then fill what is left by best fit.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

#: Groups of the linear grouping; an item above this share of the capacity is large.
GROUPS, LARGE = 24, 1 / 15
#: Small items of a shard, which one task packs; a row number's bucket holds about as many rows.
SHARD, BUCKET = 20_000, 100_000
#: Batches' worth of small items that a shard has at least, and rooms of large batches that it has at most.
FILLED, ROOMS = 20, 500_000
#: Ids of batches opened by a shard begin here, far above those of the configurations.
OPENED = 1 << 40


def linear_groups(sizes: np.ndarray, counts: np.ndarray, k: int = GROUPS) -> tuple[np.ndarray, np.ndarray, int]:
    """(rounded size, members) of each group, largest first, and the members of a full group."""
    order = np.argsort(-sizes)
    ends = np.cumsum(counts[order])
    n = int(ends[-1])
    h = max(1, math.ceil(n / k))
    starts = np.arange(0, n, h)
    rounded = sizes[order][np.searchsorted(ends, starts, side="right")]
    return rounded, np.diff(np.append(starts, n)), h


def best_pattern(value: np.ndarray, sizes: np.ndarray, demand: np.ndarray, capacity: int, cells: int = 3000) -> np.ndarray:
    """The configuration of most value (an unbounded knapsack; sizes rounded up to 1/``cells``)."""
    w = np.maximum(1, np.ceil(sizes * cells / capacity).astype(int))
    best, take = np.zeros(cells + 1), np.full(cells + 1, -1)
    for c in range(int(w.min()), cells + 1):
        fits = np.flatnonzero(w <= c)
        v = best[c - w[fits]] + value[fits]
        i = int(v.argmax())
        if v[i] > best[c - 1] + 1e-12:
            best[c], take[c] = v[i], fits[i]
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(sizes), int), cells
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            out[take[c]] += 1
            c -= w[take[c]]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(members of each group, how often) so that each group gets exactly its demand of places.

    The linear programme over all configurations is solved by column generation, rounded down, and
    what remains is placed first-fit by decreasing size.
    """
    k = len(sizes)
    basis = [np.eye(k, dtype=int)[g] * max(1, int(capacity // sizes[g])) for g in range(k)]
    for _ in range(40 * k):
        m = np.array(basis, float).T
        x = np.linalg.solve(m, demand.astype(float))
        duals = np.linalg.solve(m.T, np.ones(k))
        col = best_pattern(np.maximum(duals, 0), sizes, demand, capacity)
        if col @ duals <= 1 + 1e-6:
            break
        move = np.linalg.solve(m, col.astype(float))
        ok = move > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, move, 1), np.inf)
        basis[int(ratio.argmin())] = col
    x = np.linalg.solve(np.array(basis, float).T, demand.astype(float))
    out, left = [], demand.astype(int).copy()
    for col, times in zip(basis, np.floor(x + 1e-9).astype(int)):
        times = min([int(times)] + [left[g] // col[g] for g in range(k) if col[g]])
        if times > 0:
            out.append((col, times))
            left -= col * times
    rest: list[tuple[int, np.ndarray]] = []  # room, members
    for g in range(k):
        for _ in range(left[g]):
            for j, (room, mem) in enumerate(rest):
                if room >= sizes[g]:
                    mem[g] += 1
                    rest[j] = (room - sizes[g], mem)
                    break
            else:
                mem = np.zeros(k, int)
                mem[g] = 1
                rest.append((capacity - sizes[g], mem))
    return out + [(mem, 1) for _, mem in rest]


def places(configs: list[tuple[np.ndarray, int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(group, first rank, end rank, members in a batch, first batch) rows, and the number of batches."""
    rows, at, batch = [], {}, 0
    for mem, times in configs:
        for g in np.flatnonzero(mem):
            a, off = int(mem[g]), at.get(int(g), 0)
            rows.append((int(g), off, off + a * times, a, batch))
            at[int(g)] = off + a * times
        batch += times
    return rows, batch


def best_fit(sizes: np.ndarray, room: list[tuple[int, int]], capacity: int, first_new: int) -> tuple[np.ndarray, dict[int, int]]:
    """Batch of each item, taken by decreasing size into the batch with least room; and the room left of new ones."""
    room = sorted(room)
    out, opened = np.zeros(len(sizes), np.int64), {}
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        j = bisect_left(room, (s, -1))
        if j < len(room):
            r, b = room.pop(j)
        else:
            r, b = capacity, first_new + len(opened)
            opened[b] = capacity
        out[i] = b
        insort(room, (r - s, b))
        if b in opened:
            opened[b] = r - s
    return out, opened


def _fill(items: DataFrame, room: DataFrame | None, capacity: int, shards: int, base: int) -> DataFrame:
    """Small items into batches, shard by shard; ``under`` marks batches opened and left under nine tenths full."""
    schema = "id bigint, piece_no int, size int, batch_id bigint, under boolean"
    side = items.select("id", "piece_no", "size", F.pmod(F.xxhash64("id", "piece_no"), F.lit(shards)).alias("shard"))

    def pack(key, pdf: pd.DataFrame, have: pd.DataFrame | None = None) -> pd.DataFrame:
        got = [] if have is None else list(zip(have["room"].astype(int), have["batch_id"].astype(int)))
        if pdf.empty:
            return pd.DataFrame({"id": [], "piece_no": [], "size": [], "batch_id": [], "under": []})
        pdf = pdf.sort_values(["size", "id", "piece_no"], ascending=[False, True, True])
        batch, opened = best_fit(pdf["size"].to_numpy(), got, capacity, base + int(key[0]) * (1 << 20))
        low = {b for b, r in opened.items() if r > capacity // 10}
        return pdf[["id", "piece_no", "size"]].assign(batch_id=batch, under=[b in low for b in batch])

    if room is None:
        return side.groupBy("shard").applyInPandas(lambda key, pdf: pack(key, pdf), schema)
    rooms = room.withColumn("shard", F.pmod(F.xxhash64("batch_id"), F.lit(shards)))
    return side.groupBy("shard").cogroup(rooms.groupBy("shard")).applyInPandas(pack, schema)


def pack_items(df: DataFrame, id_col: str, size, capacity: int = 150_000) -> DataFrame:
    """(id, piece_no, size, batch_id): the batch of every row, no batch above ``capacity``.

    Only a row longer than the capacity has several pieces (all but the last fill a batch). Rows
    of null or negative size count as 0 and are placed too. Ids should be unique: repeated rows
    are items of their own, which get batches but aren't told apart.

    What is collected is the histogram of large sizes, at most ``capacity`` rows whatever the
    input; small items are packed in shards, and the batches that shards leave open are packed
    again in an eighth of the shards until one is left.
    """
    spark = df.sparkSession
    sized = df.select(F.col(id_col).cast("bigint").alias("id"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("int").alias("all"))
    full = F.when(F.col("all") > capacity, F.floor((F.col("all") - 1) / capacity)).otherwise(0).cast("int")
    pieces = sized.select("id", "all", full.alias("full")).select("id", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("k"), "all", "full")
    items = materialize(pieces.select("id", (F.col("k") + 1).cast("int").alias("piece_no"), F.when(F.col("k") < F.col("full"), capacity).otherwise(F.col("all") - F.col("full") * capacity).cast("int").alias("size")), "items")

    bar = int(capacity * LARGE)
    large = items.where(F.col("size") > bar)
    hist = large.groupBy("size").count().orderBy(F.desc("size")).toPandas()  # at most capacity - bar rows
    n_small, all_small = items.where(F.col("size") <= bar).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # a shard has rows for one task, but at least FILLED batches' worth of them
    shards = max(1, min(math.ceil(n_small / SHARD), int(all_small // (FILLED * capacity))))
    placed = room = None
    if len(hist):
        rounded, members, h = linear_groups(hist["size"].to_numpy(), hist["count"].to_numpy())
        rows, _ = places(configurations(rounded, members, capacity))
        table = spark.createDataFrame(rows, "grp int, lo bigint, hi bigint, a int, first bigint")
        # rank among the large ones: those of greater size, then the number within the size, which
        # is counted in buckets so that no task numbers all rows of a common size
        before = hist["count"].cumsum() - hist["count"]
        offs = spark.createDataFrame(pd.DataFrame({"size": hist["size"], "before": before}))
        buckets = max(1, math.ceil(int(hist["count"].max()) / BUCKET))
        b = large.withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.lit(buckets)))
        sub = b.groupBy("size", "bucket").count()
        sub = sub.select("size", "bucket", (F.sum("count").over(Window.partitionBy("size").orderBy("bucket")) - F.col("count")).alias("sub"))
        w = Window.partitionBy("size", "bucket").orderBy("id", "piece_no")
        ranked = b.withColumn("rn", F.row_number().over(w) - 1).join(sub, ["size", "bucket"]).join(F.broadcast(offs), "size")
        ranked = ranked.withColumn("rank", F.col("before") + F.col("sub") + F.col("rn")).withColumn("grp", F.floor(F.col("rank") / h).cast("int")).withColumn("r", F.col("rank") % h)
        placed = ranked.join(F.broadcast(table), (ranked["grp"] == table["grp"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
        placed = materialize(placed.select("id", "piece_no", "size", (F.col("first") + F.floor((F.col("r") - F.col("lo")) / F.col("a"))).cast("bigint").alias("batch_id")), "placed")
        room = placed.groupBy("batch_id").agg((F.lit(capacity) - F.sum("size")).cast("int").alias("room"))
    if room is not None:
        room = materialize(room.where("room > 0"), "room")
        shards = max(shards, math.ceil(room.count() / ROOMS))
    small = materialize(_fill(items.where(F.col("size") <= bar), room, capacity, shards, OPENED), "small")
    base = OPENED
    while shards > 1:
        shards = max(1, shards // 8)  # fewer each time, so it ends
        base += OPENED
        again = _fill(small.where("under"), None, capacity, shards, base)
        small = materialize(small.where("not under").unionByName(again), "small")
    out = small.select("id", "piece_no", "size", "batch_id")
    if placed is not None:
        out = placed.unionByName(out)
    return out.select(F.col("id").alias(id_col), "piece_no", "size", "batch_id")
