"""Best-fit packing into sequences of several permitted lengths.

A document is cut into pieces of at most the largest length, and pieces are packed by decreasing length: a piece goes to
the open bin with the least room that holds it (the oldest of equals). If none does, a bin is opened: for each permitted
size, what it would be filled with is looked up among the pieces still to come (the longest that fits, again and again),
and the size whose filling costs least a unit is taken, downsized as it would be. In the end each bin is downsized to
the smallest permitted length that holds its contents. The sizes are optimised jointly in a second way, too: the same
packing is tried with each single size as the least one to open, and the cheapest of all packings is kept.

Pieces are dealt to shards of PER_SHARD by a hash of their place in the table, so that repeated rows spread, too, and
each shard is packed by itself. It is a bound on a task's memory and no switch: a shard fills its bins but for a few out
of thousands, and packings cost the same a unit whatever the number of shards.

Defined results: null or empty texts have no piece and appear in no bin; a text of any length is cut and kept whole;
rows that repeat are packed as often as they occur; ties go by doc_id (null first) and start; an empty table gives no
bins; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm._shared import materialise, table

#: Permitted lengths in code points, i.e. about 512 to 4096 tokens of four characters.
CAPACITIES = (2048, 4096, 8192, 16384)
PER_SHARD = 20_000


def sequence_cost(capacity: int) -> float:
    """Relative cost of a sequence: linear work, a quadratic share for attention, and a fixed share for each sequence. A unit costs least in sequences of 4,096 to 8,192, if they are full."""
    return capacity + capacity * capacity / 65536 + 512


def _filled(negated: list[int], after: int, room: int) -> int:
    """How much of `room` the pieces after a place fill, the longest that fits taken again and again; lengths are negated, so ascending."""
    had, at = room, after
    while room and (at := bisect_left(negated, -room, at)) < len(negated):
        room += negated[at]
        at += 1
    return had - room


def _packed(lengths: Sequence[int], sizes: list[int], cost: Callable[[int], float], least: int) -> tuple[list[int], list[int], float]:
    """Bins, capacities and total cost, if bins open with one of `sizes` from `least` on."""
    negated = [-n for n in lengths]
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    bins_at: dict[int, deque[int]] = {}
    used: list[int] = []
    room: list[int] = []
    placed: list[int] = []
    for k, n in enumerate(lengths):
        r = bisect_left(rooms, n)
        if r < len(rooms):
            at = rooms[r]
            b = bins_at[at].popleft()
            if not bins_at[at]:
                del bins_at[at], rooms[r]
        else:
            best = None
            for c in sizes[bisect_left(sizes, max(n, least)) :]:
                full = n + _filled(negated, k + 1, c - n)
                price = cost(sizes[bisect_left(sizes, full)]) / full
                if best is None or price < best[0]:
                    best = price, c
            b = len(used)
            used.append(0)
            room.append(best[1])
        used[b] += n
        room[b] -= n
        placed.append(b)
        if room[b]:
            if room[b] not in bins_at:
                insort(rooms, room[b])
                bins_at[room[b]] = deque()
            bins_at[room[b]].append(b)
    final = [sizes[bisect_left(sizes, u)] for u in used]
    return placed, final, sum(map(cost, final))


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int]]:
    """Packs lengths, given in decreasing order. Returns the bin of each and the final capacity of each bin."""
    sizes = sorted(set(capacities))
    if lengths and lengths[0] > sizes[-1]:
        raise ValueError(f"a piece of {lengths[0]} exceeds the largest capacity")
    # Look-ahead sees each bin by itself; a least size for all of them costs a pass each.
    tried = [_packed(lengths, sizes, cost, least) for least in sizes] + [smallest_fit(lengths, sizes, cost)]
    return min(tried, key=lambda x: x[2])[:2]


def smallest_fit(lengths: Sequence[int], sizes: list[int], cost: Callable[[int], float]) -> tuple[list[int], list[int], float]:
    """The packing whose bins open with the smallest size that holds their first piece."""
    rooms: list[tuple[int, int]] = []
    room: list[int] = []
    used: list[int] = []
    placed: list[int] = []
    for n in lengths:
        r = bisect_left(rooms, (n, -1))
        if r < len(rooms):
            _, b = rooms.pop(r)
        else:
            b = len(room)
            room.append(sizes[bisect_left(sizes, n)])
            used.append(0)
        room[b] -= n
        used[b] += n
        placed.append(b)
        if room[b]:
            insort(rooms, (room[b], b))
    final = [sizes[bisect_left(sizes, u)] for u in used]
    return placed, final, sum(map(cost, final))


def pieces(docs: DataFrame, largest: int, length: str = "length(text)") -> DataFrame:
    """(doc_id, start, length): each text's consecutive pieces of at most `largest` units."""
    n = docs.select("doc_id", F.expr(length).cast("long").alias("n")).where("n > 0")
    cut = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(largest).cast("long"))).alias("start"))
    return cut.select("doc_id", "start", F.least(F.lit(largest), F.col("n") - F.col("start")).cast("int").alias("length"))


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost, length: str = "length(text)", per_shard: int = PER_SHARD) -> DataFrame:
    """(bin_id, capacity, used, position, doc_id, start, length): one row for each piece, in its place within its bin. `length` is an SQL expression for a row's length, in code points unless another is given, e.g. a column of token counts."""
    largest = max(capacities)
    cut = materialise(pieces(docs, largest, length).withColumn("piece", F.monotonically_increasing_id()))
    shards = max(1, -(-cut.count() // per_shard))
    named = cut.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards))).drop("piece")
    schema = "bin_id string, capacity int, used int, position int, doc_id long, start long, length int"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], na_position="first", kind="stable").reset_index(drop=True)
        bins, sizes = best_fit(pdf["length"].tolist(), capacities, cost)
        pdf["bin"] = bins
        pdf["capacity"] = pdf["bin"].map(lambda b: sizes[b])
        pdf["used"] = pdf.groupby("bin")["length"].transform("sum")
        pdf["position"] = pdf.groupby("bin").cumcount()
        pdf["bin_id"] = f"{key[0]}-" + pdf["bin"].astype(str)
        return pdf[["bin_id", "capacity", "used", "position", "doc_id", "start", "length"]]

    return named.groupBy("shard").applyInPandas(run, schema)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
