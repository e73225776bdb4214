"""Substring dedup by hashed word windows.

The unit is a window of MIN_WORDS words, from every word, whatever sentences or lines it stands in. Words are lower-cased
and white space doesn't matter. A window is removed if an earlier document holds it too, or an earlier place of its own
text does; a passage of MIN_WORDS words or more that texts share is thus removed word by word to its
ends, wherever it stands in them.

Windows are not shuffled one by one. A window's anchor is the least hash among its runs of (MIN_WORDS + 1) / 2 words, so
that equal windows have equal anchors; windows in a row that share one are a run, some seven words long on random text.
Runs are grouped by anchor: a run whose words an earlier document has goes whole, and only where an anchor has
runs of different words (at the ends of passages and around edits) are their windows compared by 128-bit digests.

Offsets are code points of the original text, end exclusive. An occurrence that overlaps the earliest one in the same
text loses only what lies beyond it.

Each task settles what it has seen of other documents, so that a passage in a third of all documents is a group of as
many rows as there are chunks of CHUNK characters, not documents.

Defined results: null or blank texts have no units; a text shorter than MIN_WORDS is left alone; documents rank by
doc_id, none first, and rows that share it (or have none) by a hash of the text: rows with different texts are different
documents, each with spans of its own; rows equal in both are one document, with one result for each of them, since
nothing tells which is the earlier; an empty table gives an empty result; other columns pass through whatever their
names, and the added column's name takes an underscore where the input has it already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from vellumgrid.llm._shared import chunks, drop, identified, materialise, restored, result_name, table

MIN_WORDS = 25
#: Characters of text a task looks at together, and words whose hashes it remembers.
CHUNK, WORDS = 4_000_000, 500_000
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(k)
    return h ^ (h >> np.uint64(29))


class _Words(dict):
    """Words to places in a table of their hashes."""

    def __init__(self) -> None:
        self.digests: list[bytes] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.digests)
        self.digests.append(xxhash.xxh3_128_digest(word.encode("utf-8", "replace")))
        return n

    def hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        both = np.frombuffer(b"".join(self.digests), "<u8").reshape(-1, 2)
        out = both[at, 0], both[at, 1]
        if len(self.digests) > WORDS:
            self.clear()
            self.digests = []
        return out


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """The polynomial hash of every n values in a row, by doubling."""
    out, have, power, step, width = h, 0, h, _STEP, 1
    while True:
        if n & width:
            out = out[: len(h) - have - width + 1] * step + power[have:] if have else power
            have += width
        if 2 * width > n:
            return out
        power = power[:-width] * step + power[width:]
        step, width = np.uint64(int(step) ** 2 % (1 << 64)), 2 * width


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """The least of every n values in a row."""
    width = 1
    while 2 * width <= n:
        g, width = np.minimum(g[:-width], g[width:]), 2 * width
    return np.minimum(g[: len(g) - (n - width)], g[n - width :]) if n > width else g


def _windows(texts: list[str | None], min_words: int, known: _Words) -> dict[str, np.ndarray]:
    """The windows of all texts in order: row (the text's place), start, stop, digest (h1, h2) and anchor."""
    texts = [t or "" for t in texts]
    whole = "\n".join(texts)
    words = whole.lower().split()
    names = ("row", "start", "stop", "h1", "h2", "anchor")
    if len(words) < min_words:
        return {k: np.zeros(0, np.uint64 if k in ("h1", "h2", "anchor") else np.int64) for k in names}
    space = _SPACE[np.minimum(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), 0x3001)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    row = np.searchsorted(begins, starts, "right") - 1
    w1, w2 = known.hashes(words)
    gram = (min_words + 1) // 2
    anchor = _least(_mix(_rolled(w1, gram), 0xBF58476D1CE4E5B9), min_words - gram + 1)
    at = np.flatnonzero(row[: len(row) - min_words + 1] == row[min_words - 1 :])
    h1, h2 = (_mix(_rolled(w, min_words), 0x94D049BB133111EB)[at] for w in (w1, w2))
    base = begins[row[at]]
    return dict(zip(names, (row[at], starts[at] - base, ends[at + min_words - 1] - base, h1, h2, anchor[at]), strict=True))


def units(text: str | None, min_words: int = MIN_WORDS) -> tuple[list[int], list[int], list[bytes]]:
    """Starts, ends and digests of a text's units."""
    w = _windows([text], min_words, _Words())
    return w["start"].tolist(), w["stop"].tolist(), [x.tobytes() for x in np.stack((w["h1"], w["h2"]), axis=1)]


def _runs(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of windows with one anchor starts, and the run of each window."""
    new = np.ones(len(w["row"]), bool)
    new[1:] = (w["row"][1:] != w["row"][:-1]) | (w["anchor"][1:] != w["anchor"][:-1]) | (np.diff(w["start"]) <= 0)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _settled(k1: np.ndarray, k2: np.ndarray, rank: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in order of place: which are the first of their key in their row, and which of them another row of a lower rank has."""
    order = np.lexsort((np.arange(len(k1)), row, rank, k2, k1))
    a, b, r, o = k1[order], k2[order], rank[order], row[order]
    new, again = np.ones(len(a), bool), np.zeros(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    again[1:] = ~new[1:] & (o[1:] == o[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) if len(a) else order
    first, gone = np.empty(len(a), bool), np.empty(len(a), bool)
    first[order], gone[order] = ~again, r > r[head]
    return first, gone & first


def _own(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of what a text repeats of itself, beyond the first occurrence."""
    key = w["h1"] ^ _mix(w["row"].astype(np.uint64) + _STEP, 0xD6E8FEB86659FD93)
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    i = np.unique(np.concatenate((order[same], order[same + 1])))
    order = i[np.lexsort((i, w["h2"][i], w["h1"][i], w["row"][i]))]
    new = np.ones(len(order), bool)
    new[1:] = np.any([w[k][order][1:] != w[k][order][:-1] for k in ("row", "h1", "h2")], axis=0)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    start = np.maximum(w["start"][order], w["stop"][head])
    ok = ~new & (start < w["stop"][order])
    return w["row"][order][ok], start[ok], w["stop"][order][ok]


_ROWS = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("kind", pa.int8())])
_ROWS_SQL = "doc long, mark long, start int, stop int, h1 long, h2 long, kind byte"
#: Kinds of rows: to be removed; to be grouped by (h1, h2); so, and known to have windows to compare; an anchor h1 known to have runs of different words.
GONE, OPEN, MIXED, MARK = range(4)


def _batch(ids: tuple[np.ndarray, np.ndarray], parts: list[tuple]) -> pa.RecordBatch:
    row, start, stop, h1, h2, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(x[row]) for x in ids), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(kind.astype(np.int8))], schema=_ROWS)


def _gone(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple:
    """Rows to be removed, what touches or overlaps in a text being one."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    if len(row):
        far = row * (1 << 32) + stop
        reach = np.maximum.accumulate(far)
        new = np.ones(len(row), bool)
        new[1:] = row[1:] * (1 << 32) + start[1:] > reach[:-1]
        head = np.flatnonzero(new)
        row, start, stop = row[head], start[head], np.maximum.reduceat(stop, head)
    none = np.zeros(len(row), np.uint64)
    return row, start, stop, none, none, np.full(len(row), GONE)


def _ranks(doc: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The rank of each text; equal identities share one."""
    order = np.lexsort((mark, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (mark[order][1:] != mark[order][:-1])
    out = np.empty(len(doc), np.int64)
    out[order] = np.cumsum(new)
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], list[str | None], list | None]]:
    """Identities, texts and, if there is such a column, the runs asked for, of some CHUNK characters at once."""
    for part in chunks(batches, 2, CHUNK):
        ids = tuple(part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        yield ids, part.column(2).to_pylist(), part.column(3).to_pylist() if part.num_columns > 3 else None


def _run_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for ids, texts, _ in _parts(batches):
            w = _windows(texts, min_words, known)
            if not len(w["row"]):
                continue
            head, of = _runs(w)
            tail = np.append(head[1:], len(of)) - 1
            row, start, stop, v = w["row"][head], w["start"][head], w["stop"][tail], w["anchor"][head]
            inside = (np.arange(len(of)) - head[of]).astype(np.uint64)
            words = np.add.reduceat(_mix(w["h2"] + inside * _STEP, 0xC4CEB9FE1A85EC53), head)
            first, gone = _settled(v, words, _ranks(*ids)[row], row)
            own = _own(w)
            spans = [np.concatenate((x, y[gone])) for x, y in zip(own, (row, start, stop), strict=True)]
            i = np.flatnonzero(first & ~gone)
            # An anchor with runs of different words here says so once, and those runs meet by their words alone.
            order = i[np.lexsort((words[i], v[i]))]
            differ = (v[order][1:] == v[order][:-1]) & (words[order][1:] != words[order][:-1])
            marks = np.unique(v[order][1:][differ])
            mixed = np.isin(v[i], marks)
            none = np.zeros(len(marks), np.int64)
            key = np.where(mixed, _mix(v[i] + words[i] * _STEP, 0xFF51AFD7ED558CCD), v[i])
            yield _batch(ids, [_gone(*spans), (row[i], start[i], stop[i], key, words[i], np.where(mixed, MIXED, OPEN)), (none, none, none, marks, np.zeros(len(marks), np.uint64), np.full(len(marks), MARK))])

    return run


def _window_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for ids, texts, runs in _parts(batches):
            w = _windows(texts, min_words, known)
            if not len(w["row"]):
                continue
            head, of = _runs(w)
            asked = np.concatenate([np.array(r, np.int64) + (k << 32) for k, r in enumerate(runs)])
            at = np.flatnonzero(np.isin((w["row"][head] << 32) + w["start"][head], asked)[of])
            w = {k: x[at] for k, x in w.items()}
            first, gone = _settled(w["h1"], w["h2"], _ranks(*ids)[w["row"]], w["row"])
            i = np.flatnonzero(first & ~gone)
            yield _batch(ids, [_gone(w["row"][gone], w["start"][gone], w["stop"][gone]), (*(w[k][i] for k in ("row", "start", "stop", "h1", "h2")), np.full(len(i), OPEN))])

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, mark, start, stop): by the identity of identified(), spans that cover what isn't the earliest occurrence of a unit, cut to what lies beyond the earliest one where they overlap in one text. A written table, the only one left."""
    texts = identified(docs).select("doc", "mark", "text")
    # What is settled needs no group: its key spreads it over all partitions.
    spread = F.when(F.col("kind") == GONE, F.xxhash64("doc", "mark", "start")).otherwise(F.col("h1"))
    rows = texts.mapInArrow(_run_rows(min_words), _ROWS_SQL).withColumn("h1", spread)
    anchor = Window.partitionBy("h1")
    run = F.col("kind").isin(OPEN, MIXED)
    rows = rows.withColumn("first", F.first(F.when(run, F.struct("doc", "mark"))).over(Window.partitionBy("h1", "h2", "kind").orderBy("doc", "mark")))
    own = F.struct("doc", "mark").eqNullSafe(F.col("first"))
    rows = rows.withColumn("differ", (F.max(F.col("kind")).over(anchor) > OPEN) | (F.min(F.when(run, F.col("h2"))).over(anchor) != F.max(F.when(run, F.col("h2"))).over(anchor)) | (F.sum(F.when(run & own, 1)).over(Window.partitionBy("h1", "h2")) > 1))
    gone = (F.col("kind") == GONE) | (run & ~own)
    rows = rows.where(gone | (run & F.coalesce("differ", F.lit(False)))).select("doc", "mark", "start", "stop", gone.alias("gone"))
    rows = materialise(rows)
    asked = rows.where(~F.col("gone")).groupBy("doc", "mark").agg(F.collect_set("start").alias("runs"))
    again = texts.join(asked, ["doc", "mark"]).select("doc", "mark", "text", "runs")
    found = again.mapInArrow(_window_rows(min_words), _ROWS_SQL).withColumn("h1", spread).withColumn("h2", F.when(F.col("kind") == GONE, F.col("start").cast("long")).otherwise(F.col("h2")))
    w = Window.partitionBy("h1", "h2", "kind").orderBy("doc", "mark", "start")
    found = found.withColumn("first", F.first(F.struct("doc", "mark", "start", "stop")).over(w))
    own = (F.col("doc") == F.col("first.doc")) & (F.col("mark") == F.col("first.mark"))
    settled = F.col("kind") == GONE
    cut = F.when(~settled & own, F.greatest("start", "first.stop")).otherwise(F.col("start"))
    found = found.where(settled | ~own | (F.col("start") > F.col("first.start"))).select("doc", "mark", cut.alias("start"), "stop").where("start < stop")
    out = materialise(rows.where("gone").select("doc", "mark", "start", "stop").unionByName(found))
    drop(rows)
    return out


def _merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; white space on both sides of a cut becomes the left side's."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
        while at < len(text) and text[at] in " \t\n" and (not (left := kept[-1] or (kept[-2] if len(kept) > 1 else "")) or left[-1] in " \t\n"):
            at += 1
    kept.append(text[at:])
    return "".join(kept)


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` cut (and n_chars, if there is such a column, counted anew) and a column `removed` of original spans; empty where nothing was removed."""
    spans = repeats(docs, min_words).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    kind = "struct<text: string, removed: array<struct<start: int, stop: int>>>"

    @arrow_udf(kind)
    def edited(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            m = _merged([x["start"] for x in s], [x["stop"] for x in s]) if s else []
            rows.append({"text": cut(t, m) if m else None, "removed": [{"start": a, "stop": b} for a, b in m]})
        return pa.array(rows, pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))

    df = identified(docs).join(spans, ["doc", "mark"], "left")
    # Only texts that lose something travel to Python.
    df = df.withColumn("left", edited(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans")))
    return df.select(*restored(docs, F.coalesce("left.text", F.col("text"))), F.col("left.removed").alias(result_name("removed", docs.columns)))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove(docs)
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.expr("aggregate(removed, 0L, (n, x) -> n + x.stop - x.start)").alias("removed_chars"), "removed", "text")
