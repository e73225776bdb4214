"""SimHash near-dedup by pigeonhole blocks.

Two 64-bit fingerprints that differ in at most three bits agree on at least three of six blocks. Each distinct
fingerprint is therefore dealt out under the twenty choices of three blocks (about 32 bits each); those that meet under
a choice are compared by Hamming distance, and connected components are taken over distinct fingerprints, so that
copies, however many, are one node. A large group sends on a spanning forest of its links, not its pairs: a row for
each fingerprint at most, however many are near each other.

Defined results: null or blank texts have fingerprint zero and link like any other; a null doc_id keeps its row but
never names a component; rows that repeat stay repeated in classes(). dedup() keeps one row of each component: the
smallest doc_id, rows without one last, and of rows that share it the least hash of the text; of rows equal in both
one stays. An empty table gives an empty result; columns other than doc_id and text pass through dedup() whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm._shared import LEAST_LONG, LOWER, UPPER, components, drop, identified, materialise, restored, table

SEED, BLOCKS, DISTANCE, WORDS = 42, 6, 3, 3
_CHUNK = 1 << 16
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint: a bit is set if over half of the shingles' hashes have it."""
    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return 0
    joined, k = b" ".join(w), min(words, len(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b, n = starts[: len(w) - k + 1], ends[k - 1 :], len(w) - k + 1
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, _CHUNK):  # memory stays bounded however long the text
        hashes = np.array([h(joined[x:y], SEED) for x, y in zip(a[i : i + _CHUNK].tolist(), b[i : i + _CHUNK].tolist(), strict=True)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


_FINGERPRINTS = "doc long, mark long, fp long"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, fp: the fingerprint's bits as a signed number) of rows (doc, mark, text)."""
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc", "mark", "fp"])


#: Groups up to this size send on their links as they are.
FOREST = 64


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in fps) that span the components of one group: a row's links to one member of each component that it joins."""
    label = np.arange(len(fps))
    i, j = [], []
    for k in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:k] ^ fps[k]) <= distance)
        if len(near):
            labels, first = np.unique(label[near], return_index=True)
            i += [k] * len(first)
            j += near[first].tolist()
            label[k] = labels[0]
            if len(labels) > 1:
                label[:k][np.isin(label[:k], labels[1:])] = labels[0]
    return np.array(i, np.int64), np.array(j, np.int64)


def _group_links(distance: int):
    """(a, b) out of rows (t, key, fp) sorted by (t, key). Groups run on from batch to batch."""

    def links(fp: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(fp))
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(fp)))
        head, own = np.repeat(starts, size), np.repeat(size, size)
        found, left, ahead = [], at[~new & (own <= FOREST)], 0
        while len(left := left[head[left] + ahead < left]):
            j = head[left] + ahead
            ok = np.bitwise_count(fp[left] ^ fp[j]) <= distance
            found.append((left[ok], j[ok]))
            ahead += 1
        for x, n in zip(starts[size > FOREST].tolist(), size[size > FOREST].tolist(), strict=True):
            i, j = _forest(fp[x : x + n], distance)
            found.append((i + x, j + x))
        i, j = (np.concatenate([f[k] for f in found]) if found else at[:0] for k in (0, 1))
        a, b = fp[i].view(np.int64), fp[j].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            t, key, fp = held
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1])
            cut = int(np.flatnonzero(new)[-1])  # sorted: all but the last group is whole
            if cut:
                yield from links(fp[:cut].view(np.uint64), new[:cut])
                held = [x[cut:] for x in held]
        if held is not None:
            new = np.zeros(len(held[0]), bool)
            new[0] = True
            yield from links(held[2].view(np.uint64), new)

    return run


def linked(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) at no more than `distance` bits, a < b, whose components are those of all such pairs; a pair may occur more than once."""
    if not 0 <= distance < blocks:
        raise ValueError("more blocks than differing bits are needed")
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[i] for i in c)))).alias("key")) for k, c in enumerate(combinations(range(blocks), blocks - distance))])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    return dealt.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_group_links(distance), "a long, b long")


def _placed(nodes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(fp, component, first) of nodes (fp, first), written; a component is named by one of its fingerprints."""
    comp = components(linked(nodes, distance, blocks))
    placed = materialise(nodes.join(comp, nodes.fp == comp.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "first"))
    drop(comp)
    return placed


def classes(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of fingerprints."""
    found = materialise(docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("mark"), F.col("text").cast("string")).mapInArrow(_fingerprints, _FINGERPRINTS))
    nodes = materialise(found.groupBy("fp").agg(F.min("doc").alias("first")))
    placed = _placed(nodes, distance, blocks)
    drop(nodes)
    named = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    return found.join(placed.join(named, "component").select("fp", "component_id"), "fp").select(F.col("doc").alias("doc_id"), "fp", "component_id")


def dedup(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """docs with one row of each component, all columns kept."""
    rows = identified(docs)
    found = materialise(rows.select("doc", "mark", "text").mapInArrow(_fingerprints, _FINGERPRINTS))
    place = F.struct((F.col("doc") == LEAST_LONG).alias("none"), "doc", "mark")
    nodes = materialise(found.groupBy("fp").agg(F.min(place).alias("first")))
    placed = _placed(nodes, distance, blocks)
    named = placed.groupBy("component").agg(F.min("first").alias("head")).join(placed, "component").select("fp", "head")
    each = found.groupBy("doc", "mark").agg(F.first("fp").alias("fp"), (F.count("*") > 1).alias("again"))
    # Only what goes and what repeats: most rows are neither.
    odd = each.join(named, "fp").select("doc", "mark", "again", ((F.col("head.doc") != F.col("doc")) | (F.col("head.mark") != F.col("mark"))).alias("gone")).where("gone OR again")
    odd = materialise(odd)
    drop(found, nodes, placed)
    kept = rows.join(odd.where("gone").select("doc", "mark"), ["doc", "mark"], "left_anti")
    again = odd.where("NOT gone").select("doc", "mark")
    if again.head(1):
        kept = kept.join(again, ["doc", "mark"], "left_anti").unionByName(kept.join(again, ["doc", "mark"], "left_semi").dropDuplicates(["doc", "mark"]))
    return kept.select(*restored(docs, F.col("text")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
