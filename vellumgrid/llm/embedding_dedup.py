"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected onto LINES random lines. Around each vector's projection stands a window, and each row whose
projection falls into it collides once; pairs with at least COUNT collisions are verified by their cosine in double
precision. COUNT is the largest number that a pair just at the threshold reaches with probability RECALL: its
projections differ by a normal variable of known spread, so its collisions are binomial.

So that counting isn't quadratic, vectors meet in cells: a table cuts a few of the lines, each at a random offset, into
intervals of CELL, and a cell is a choice of intervals. The number of lines a table cuts follows the logarithm of the
number of vectors, so that a cell of unrelated vectors holds some FILL of them, and there are as many tables as a pair at
the threshold needs to share a cell of one of them with probability RECALL. A pair counts in the first table whose cell
it shares. A cell of more than BLOCK vectors is dealt to tiles of two blocks each: every pair of them meets in one tile.

What leaves a tile is one count for each vector that links there and a spanning forest of its links, never its pairs.
Equal vectors are one node first, however many there are.

Defined results: a vector that is null, zero, or holds null or non-finite components links with nothing and is its
own component; vectors of different dimensions don't link; rows that repeat (the same vec_id and vector) count as
separate vectors in n_links; a null vec_id never names a component and is never kept; an empty table gives an empty
result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm._shared import components, drop, materialise, table

COSINE, RECALL, LINES, WINDOW, BLOCK = 0.95, 0.997, 64, 0.1, 2048
#: Width of a table's intervals, and vectors that a cell of unrelated ones holds on average.
CELL, FILL = 1.5, 32


def least_count(cosine: float = COSINE, recall: float = RECALL, lines: int = LINES, window: float = WINDOW) -> int:
    """The largest number of collisions that a pair at `cosine` reaches with probability `recall`."""
    p = erf(window / sqrt(2 - 2 * cosine) / sqrt(2))
    below = 0.0
    for c in range(lines + 1):
        below += comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if below > 1 - recall:
            return max(c, 1)
    return lines


def share(sigma: float, cell: float = CELL) -> float:
    """How likely projections that differ by a normal variable of this spread lie in one interval."""
    x = cell / sigma
    return erf(x / sqrt(2)) - sqrt(2 / pi) * (1 - exp(-x * x / 2)) / x


@dataclass(frozen=True)
class Tables:
    """`count` tables of `lines` lines each for vectors of one dimension."""

    dim: int
    count: int
    lines: int

    @classmethod
    def of(cls, dim: int, vectors: int, cosine: float, recall: float = RECALL, fill: int = FILL) -> Tables:
        lines = min(LINES, max(1, ceil(log(max(vectors, 2) / fill) / -log(share(sqrt(2))))))
        missed = 1 - share(sqrt(max(2 - 2 * cosine, 1e-9))) ** lines
        return cls(dim, max(1, ceil(log(1 - recall) / log(missed))) if missed > 1 - recall else 1, lines)

    def cells(self, projections: np.ndarray) -> np.ndarray:
        """The cell of each row (by projections onto all lines) in each table, as a hash."""
        rng = np.random.default_rng(30_000 + self.dim)
        out = np.empty((len(projections), self.count), np.uint64)
        for t in range(self.count):
            chosen, offset = rng.permutation(LINES)[: self.lines], rng.uniform(0, CELL, self.lines)
            h = np.full(len(projections), (t + 1) * 1_000_003 + self.dim, np.uint64)
            for k in np.floor((projections[:, chosen] + offset) / CELL).astype(np.int64).view(np.uint64).T:
                h = (h ^ k) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, t] = h
        return out


def _directions(dim: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng(20_000 + dim).standard_normal((dim, lines))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one dimension, none of them null, at unit length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def colliding(q: np.ndarray, r: np.ndarray, same: bool, count: int, window: float = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of q and a row of r (a later one, if both are the same block) whose projections collide in `count` lines or more."""
    lines = q.shape[1]
    if max(len(q), len(r)) <= 256:  # few rows: windows are compared as they stand
        if max(len(q), len(r)) <= 64:
            often = (np.abs(q[:, None, :] - r[None, :, :]) <= window).sum(axis=2) >= count
        else:
            hits = np.zeros((len(q), len(r)), np.int16)
            for k in range(lines):
                hits += np.abs(q[:, k, None] - r[None, :, k]) <= window
            often = hits >= count
        return np.nonzero(np.triu(often, 1) if same else often)
    order = np.argsort(r, axis=0, kind="stable")
    columns = [np.ascontiguousarray(order[:, k]) for k in range(lines)]
    lo = np.stack([np.searchsorted(r[columns[k], k], q[:, k] - window, "left") for k in range(lines)], axis=1)
    hi = np.stack([np.searchsorted(r[columns[k], k], q[:, k] + window, "right") for k in range(lines)], axis=1)
    i, j = [], []
    for row, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        hits = np.concatenate([columns[k][x:y] for k, (x, y) in enumerate(zip(a, b, strict=True))])
        often = np.flatnonzero(np.bincount(hits, minlength=len(r)) >= count)
        often = often[often > row] if same else often
        i.append(np.full(len(often), row))
        j.append(often)
    return np.concatenate(i), np.concatenate(j)


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component over the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def _linked(x: np.ndarray, key: np.ndarray, ends: list[int], node: np.ndarray, copies: np.ndarray, block: np.ndarray, tables: Tables, cosine: float) -> pa.RecordBatch:
    """Counts (node, null, links) and links (node, node, 0) that span the components of tiles; tiles end at `ends`, key holds (cell, first, second, t) of each row."""
    p = x @ _directions(x.shape[1])
    count, found, at = least_count(cosine), [], 0
    for end in ends:
        if end - at > 1:
            _, first, second, t = key[at].tolist()
            q, r = np.flatnonzero(block[at:end] == first) + at, np.flatnonzero(block[at:end] == second) + at
            if len(q) and len(r):
                i, j = colliding(p[q], p[r], first == second, count)
                found.append((q[i], r[j], np.full(len(i), t)))
        at = end
    i, j, t = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    ok = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        a, b = i[part], j[part]
        ok[part] = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        left = np.flatnonzero(ok[part] & (t[part] > 0))
        if len(left):  # a pair counts in the first table whose cell it shares
            rows, places = np.unique(np.concatenate((a[left], b[left])), return_inverse=True)
            cells = tables.cells(p[rows])
            same = cells[places[: len(left)]] == cells[places[len(left) :]]
            ok[k + left[(same & (np.arange(tables.count) < t[part][left][:, None])).any(axis=1)]] = False
    i, j = i[ok], j[ok]
    links = np.bincount(np.concatenate((i, j)), weights=np.concatenate((copies[j], copies[i])), minlength=len(node)).astype(np.int64)
    linked, label = np.flatnonzero(links), _labels(len(node), i, j)
    spans = np.flatnonzero(label != np.arange(len(node)))
    none = pa.nulls(len(linked), pa.int64())
    out = [np.concatenate((node[linked], node[spans])), pa.concat_arrays([none, pa.array(node[label[spans]], pa.int64())]), np.concatenate((links[linked], np.zeros(len(spans), np.int64)))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c for c in out], ["a", "b", "links"])


def _tiles(plans: dict[int, Tables], cosine: float):
    """_linked() of rows sorted by (dim, cell, first, second, t), a tile being a run of equal ones. Runs go on from batch to batch."""
    names = ["cell", "first", "second", "t"]

    def run(batches):
        held: pa.Table | None = None
        for batch in chain(batches, [None]):
            if batch is not None:
                now = pa.Table.from_batches([batch])
                held = now if held is None else pa.concat_tables([held, now])
                if held.num_rows < 4 * BLOCK:
                    continue
            if held is None or not held.num_rows:
                continue
            key = np.stack([held[k].to_numpy() for k in ["dim", *names]], axis=1)
            ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), held.num_rows]
            if batch is not None:
                ends.pop()  # the last run may go on
            dims, starts = np.unique(key[: ends[-1] if ends else 0, 0], return_index=True)
            for dim, a, b in zip(dims.tolist(), starts.tolist(), [*starts[1:].tolist(), ends[-1] if ends else 0], strict=True):
                part = held.slice(a, b - a)
                own = [e - a for e in ends if a < e <= b]
                node, copies, block = (part[k].to_numpy() for k in ("node", "copies", "block"))
                yield _linked(_unit(part["embedding"]), key[a:b, 1:], own, node, copies, block, plans[dim], cosine)
            held = held.slice(ends[-1] if ends else 0)

    return run


def _cells(plans: dict[int, Tables]):
    """(node, dim, t, cell) of rows (node, embedding, dim), for each table."""

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                cells = plans[dim].cells(_unit(batch.column(1).take(pa.array(rows))) @ _directions(int(dim)))
                n = cells.shape[1]
                node = batch.column(0).to_numpy()[rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, n)), pa.array(np.full(len(node) * n, dim, np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(node))), pa.array(cells.ravel().view(np.int64))], ["node", "dim", "t", "cell"])

    return run


def classes(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, fill: int = FILL) -> DataFrame:
    """(vec_id, n_links, component_id) of vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    sound = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <= 1.7976931348623157E308) AND exists(embedding, x -> x <> 0)")
    # Adding 0.0 makes -0.0 and 0.0 one value. Equal vectors are told by 128 bits of hash.
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("embedding", F.when(F.col("sound"), F.transform("embedding", lambda x: x + F.lit(0.0))))
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(2), "embedding"))
    nodes = rows.where("sound").groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    # One plan for each dimension that occurs.
    plans = {r["dim"]: Tables.of(r["dim"], r["count"], cosine, fill=fill) for r in nodes.groupBy("dim").count().collect()}
    keys = materialise(nodes.select("node", "embedding", "dim").mapInArrow(_cells(plans), "node long, dim int, t int, cell long"))
    # Cells that one vector has to itself go; those of more than a block are dealt to tiles.
    sizes = keys.groupBy("dim", "t", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    met = keys.join(sizes, ["dim", "t", "cell"])
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("node", "dim", "t", "cell", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    dealt = met.join(nodes.select("node", "embedding", "copies"), "node").select("cell", "first", "second", "t", "dim", "node", "copies", "block", "embedding")
    order = ["dim", "cell", "first", "second", "t"]
    found = materialise(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_tiles(plans, cosine), "a long, b long, links long"))
    comp = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    placed = nodes.join(comp, "node", "left").join(links, "node", "left").select("h1", "h2", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = materialise(placed)
    drop(nodes, keys, found, comp)
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(named, "component").select("h1", "h2", "n_links", "component_id")
    linked = rows.where("sound").select("vec_id", "h1", "h2").join(placed, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "embeddings")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT r, vec_id, e, e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 AS sound FROM v),
u AS (SELECT r, vec_id, len(e) AS dim, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM s WHERE sound),
p AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.dim = b.dim AND a.r <> b.r WHERE list_inner_product(a.e, b.e) >= 0.95),
c(r, id) AS (SELECT r, vec_id FROM v UNION SELECT p.b, c.id FROM c JOIN p ON p.a = c.r),
m AS (SELECT r, min(id) AS component_id FROM c GROUP BY r),
n AS (SELECT a AS r, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN m USING (r) LEFT JOIN n USING (r)"""
