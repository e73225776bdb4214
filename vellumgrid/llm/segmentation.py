"""N-best segmentation into the pieces of a SentencePiece model, and its inverse.

A text is normalised as the model's identity normaliser does (spaces become U+2581, one is put in front), and its
pieces span a lattice: an edge for every piece of the vocabulary, and for a character without a piece of its own an
edge of its UTF-8 byte pieces. A segmentation's score is the sum of its edges' scores. The N best are found by a
forward Viterbi pass, whose scores serve as exact heuristics for an A-star search backwards from the end: hypotheses
leave the queue in the order of their full scores, so the first N that reach the start are the N best.

No piece crosses from another character into a U+2581, nor holds a newline beside others (checked when a model is
read), so a text's lattice is a chain of unit lattices. Forward and backward Viterbi passes over all new units of a
batch at once give each unit's best path and what its second best loses; only the N - 1 units of a text that lose
least can differ in its N best segmentations, so A-star searches those, and the N best of the chain are found by the
same best-first search over their alternatives.

Scores are log-probabilities of pieces. The model at hand is a BPE model, whose own scores are merge ranks and no measure
of a segmentation; as merges come in the order of frequency, a piece of rank r gets the probability of Zipf's law,
proportional to 1 / (r + SHIFT), over the whole vocabulary (a unigram model's scores are taken as they are). The best
segmentation is thus the likeliest, not the one that merging greedily gives; on the test corpus the two agree on most
words. A character of byte pieces scores PENALTY less than the rarest piece.

Ties go to the segmentation whose last differing piece is longer; a model whose best path ties is thus decoded alike
everywhere. Defined results: null and empty texts have no pieces, one segmentation and score 0; a text of any length
is segmented whole; repeated rows alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from vellumgrid.llm._shared import chunks, table

SPACE = "▁"
N_BEST = 4
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units in a generation of those that a worker remembers (it keeps two), and the longest one that Viterbi takes in bulk.
CACHE_UNITS, CACHE_LENGTH = 200_000, 24
_CHUNK, _SLOTS = 4096, 1 << 18
#: Of Zipf's law over merge ranks.
SHIFT = 2.7
#: Characters of text segmented together.
CHUNK = 2_000_000
#: Units in a worker's memory of searches.
SEARCHED = 20_000
#: How much less than the lowest piece a character of byte pieces scores.
PENALTY = 10.0
#: What this worker has learnt, by model.
_WORKER: dict = {}
_UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


@dataclass
class Pieces:
    """A vocabulary: piece -> (id, score), ids of the 256 byte pieces, and pieces by id."""

    scores: dict[str, tuple[int, float]]
    bytes_at: list[int]
    by_id: list[str]
    longest: int = 0
    lowest: float = 0.0
    cache: dict = field(default_factory=dict, repr=False)
    old: dict = field(default_factory=dict, repr=False)
    searched: dict = field(default_factory=dict, repr=False)
    lookup: object = field(default=None, repr=False)
    values: np.ndarray = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.scores), default=1)
        self.lowest = min((s for _, s in self.scores.values()), default=0.0) - PENALTY
        # The score of each id: that of a character of byte pieces is with its first byte.
        self.values = np.zeros(1 + max((i for i, _ in self.scores.values()), default=0))
        self.values = np.append(self.values, np.zeros(max(0, max(self.bytes_at) + 1 - len(self.values))))
        self.values[self.bytes_at] = [0.0 if 0x80 <= b < 0xC0 else self.lowest for b in range(256)]
        for i, score in self.scores.values():
            self.values[i] = score
        for p in self.scores:
            inner = p.lstrip(SPACE)
            if SPACE in inner or "\n" in p and len(p) > 1:
                raise ValueError(f"piece {p!r} crosses a unit's bound")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "old": {}, "searched": {}, "lookup": None}


def read_model(path: str = MODEL) -> Pieces:
    """The vocabulary of a SentencePiece model file, read by the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, at = {}, [0] * 256
    by_id = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        by_id.append(p)
        if sp.is_byte(i):
            at[int(p[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            scores[p] = (i, sp.get_score(i))
    return Pieces(log_probabilities(scores), at, by_id)


def log_probabilities(scores: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float]]:
    """The scores of a unigram model as they are; those of a BPE model, which are whole negative ranks, by Zipf's law."""
    ranks = np.array([-s for _, s in scores.values()])
    if not len(ranks) or (ranks != np.floor(ranks)).any():
        return scores
    likely = 1 / (ranks - ranks.min() + SHIFT)
    return {p: (i, float(x)) for (p, (i, _)), x in zip(scores.items(), np.log(likely / likely.sum()), strict=True)}


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def search(unit: str, v: Pieces, n_best: int = N_BEST) -> list[tuple[float, tuple[int, ...]]]:
    """The n_best segmentations of a unit as (score, ids), best first."""
    n, get, longest = len(unit), v.scores.get, v.longest
    best = [0.0] + [float("-inf")] * n
    into: list[list] = [[] for _ in range(n + 1)]
    for i in range(n):
        b = best[i]
        for j in range(i + 1, min(n, i + longest) + 1):
            hit = get(unit[i:j])
            if hit is not None:
                s = hit[1]
                into[j].append((i, s, hit[0]))
                if b + s > best[j]:
                    best[j] = b + s
            elif j == i + 1:
                s = v.lowest
                into[j].append((i, s, tuple(v.bytes_at[c] for c in unit[i].encode("utf-8", "replace"))))
                if b + s > best[j]:
                    best[j] = b + s
    out: list[tuple[float, tuple[int, ...]]] = []
    # Of equal scores, what was pushed later goes on first: a tie is followed to its end, not broadened.
    queue: list = [(-best[n], 0, n, 0.0, None)]
    k = 0
    while queue and len(out) < n_best:
        _, _, at, tail, path = heapq.heappop(queue)
        if at == 0:
            ids: list[int] = []
            while path is not None:
                piece, path = path
                ids.extend(piece) if piece.__class__ is tuple else ids.append(piece)
            out.append((tail, tuple(ids)))
            continue
        for i, s, piece in reversed(into[at]):
            k -= 1
            t = tail + s
            heapq.heappush(queue, (-(best[i] + t), k, i, t, (piece, path)))
    return out


@dataclass
class _Lookup:
    """The pieces and what they begin with (id -1) by a rolling hash of their code points, in an open-addressed table."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    @classmethod
    def of(cls, v: Pieces) -> _Lookup:
        known: dict[int, tuple[str, int, float]] = {}
        for piece, (i, score) in v.scores.items():
            h = 0
            for k, c in enumerate(piece, 1):
                h = (h * 0x100000001B3 + ord(c) + 1) & (1 << 64) - 1
                if known.setdefault(h, (piece[:k], -1, -np.inf))[0] != piece[:k]:
                    raise ValueError("two pieces share a hash")
            known[h] = (piece, i, score)
        size = max(_SLOTS, 1 << (4 * len(known)).bit_length())
        keys, ids, scores = np.zeros(size, np.uint64), np.full(size, -1, np.int64), np.full(size, -np.inf)
        places = cls(keys, ids, scores).slot(np.fromiter(known, np.uint64, len(known))).tolist()
        for (h, (_, i, score)), at in zip(known.items(), places, strict=True):
            while keys[at]:
                at = (at + 1) % size
            keys[at], ids[at], scores[at] = h, i, score
        return cls(keys, ids, scores)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of the hashes, or of an empty slot."""
        at = self.slot(h)
        open_ = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            found = self.keys[at[open_]]
            open_ = open_[(found != h[open_]) & (found != 0)]
        return at


def _viterbi(units: list[str], v: Pieces, lookup: _Lookup) -> list[tuple[float, bytes] | None]:
    """(loss of the second best, best ids as 32-bit numbers) of units of one length; None where a character needs byte pieces."""
    m, n = len(units), len(units[0])
    chars = np.frombuffer("".join(units).encode("utf-32-le", "replace"), np.uint32).reshape(m, n).astype(np.uint64) + np.uint64(1)
    # An edge's rows, their scores and slots: only units that a piece fits, and no longer ends of what no piece begins with.
    edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    sound = np.ones(m, bool)
    for i in range(n):
        h, rows = np.zeros(m, np.uint64), np.arange(m)
        for j in range(i + 1, min(n, i + v.longest) + 1):
            h = h * np.uint64(0x100000001B3) + chars[rows, j - 1]
            at = lookup.find(h)
            fits = lookup.keys[at] == h
            h, rows, at = h[fits], rows[fits], at[fits]
            score = lookup.scores[at]
            own = score > -np.inf
            if j == i + 1:
                single = np.zeros(m, bool)
                single[rows[own]] = True
                sound &= single
            if own.any():
                edges[i, j] = rows[own], score[own], at[own]
            if not len(rows):
                break
    ahead, prev = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int64)
    ahead[0] = 0
    for (i, j), (rows, score, _) in sorted(edges.items(), key=lambda e: e[0][::-1]):
        s = ahead[i][rows] + score
        better = s > ahead[j][rows]
        ahead[j][rows[better]], prev[j][rows[better]] = s[better], i
    back = np.full((n + 1, m), -np.inf)
    back[n] = 0
    for (i, j), (rows, score, _) in sorted(edges.items(), reverse=True, key=lambda e: e[0]):
        back[i][rows] = np.maximum(back[i][rows], score + back[j][rows])
    used = np.zeros((n + 1, m), bool)  # positions on the best path
    at, rows = np.full(m, n), np.arange(m)
    while at.any():
        used[at, rows] = True
        at = np.where(at > 0, prev[at, rows], 0)
    used[0] = False
    second, piece = np.full(m, -np.inf), np.zeros((n + 1, m), np.int64)
    for (i, j), (rows, score, at) in edges.items():
        on = used[j][rows] & (prev[j][rows] == i)
        second[rows] = np.maximum(second[rows], np.where(on, -np.inf, ahead[i][rows] + score + back[j][rows]))
        piece[j][rows[on]] = lookup.ids[at[on]]
    # Row by row, the pieces that end at the positions used.
    flat, stops = piece.T[used.T].astype(np.int32).tobytes(), np.cumsum(4 * used.sum(axis=0)).tolist()
    ids = [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)]
    with np.errstate(invalid="ignore"):
        loss = (ahead[n] - second).tolist()
    return [(d, x) if ok else None for d, x, ok in zip(loss, ids, sound.tolist(), strict=True)]


def _slow(unit: str, v: Pieces) -> tuple[float, bytes]:
    s = search(unit, v, 2)
    return (s[0][0] - s[1][0] if len(s) > 1 else float("inf"), np.array(s[0][1], np.int32).tobytes())


def learn(units: set[str], v: Pieces) -> None:
    """Puts what n_best() needs of the units into the cache."""
    if len(v.cache) > CACHE_UNITS:  # two generations: what is still in use moves on to the new one
        v.old, v.cache = v.cache, {}
    new = {u for u in units if u not in v.cache}
    known = {u for u in new if u in v.old}
    v.cache.update((u, v.old[u]) for u in known)
    new -= known
    if v.lookup is None:
        v.lookup = _Lookup.of(v)
    by_length: dict[int, list[str]] = {}
    for u in sorted(new):
        by_length.setdefault(len(u), []).append(u)
    for length, own in by_length.items():
        for at in range(0, len(own), _CHUNK):
            part = own[at : at + _CHUNK]
            found = _viterbi(part, v, v.lookup) if length <= CACHE_LENGTH else [None] * len(part)
            for u, f in zip(part, found, strict=True):
                v.cache[u] = f or _slow(u, v)


def _searched(unit: str, v: Pieces, n: int) -> list[tuple[float, tuple[int, ...]]]:
    found = v.searched.get((unit, n))
    if found is None:
        if len(v.searched) >= SEARCHED:
            v.searched.clear()
        found = search(unit, v, n)
        if len(unit) <= CACHE_LENGTH:
            v.searched[unit, n] = found
    return found


def _total(values: np.ndarray) -> float:
    """The sum of a segmentation's scores from its last piece on, one by one: the same wherever the units' bounds lie."""
    return float(np.cumsum(values[::-1])[-1]) if len(values) else 0.0


def n_best(units: list[str], v: Pieces, n: int = N_BEST) -> list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]:
    """The n best segmentations of a chain of learnt units as (score, edits): the best comes first and whole, (score, [(0, 0, ids)]); an edit (at, length, ids) of another replaces pieces of the best one."""
    cells = list(map(v.cache.__getitem__, units))
    # Only the n - 1 units whose second best costs least can take part in the n best.
    loss = np.fromiter(map(itemgetter(0), cells), float, len(cells))
    few = np.flatnonzero(loss <= np.partition(loss, n - 2)[n - 2]) if 1 < n <= len(loss) else np.arange(len(loss))
    least = [(float(loss[k]), k) for k in few[np.argsort(loss[few], kind="stable")][: n - 1].tolist() if loss[k] < np.inf]
    full = {k: _searched(units[k], v, n) for _, k in least}
    for k, s in full.items():
        cells[k] = (cells[k][0], np.array(s[0][1], np.int32).tobytes())  # of equal paths, the search's
    paths = list(map(itemgetter(1), cells))
    ids = np.frombuffer(b"".join(paths), np.int32)
    value = v.values[ids]
    out = [(_total(value), [(0, 0, tuple(ids.tolist()))])]
    if not least:
        return out
    ends = np.cumsum(np.fromiter(map(len, paths), np.int64, len(paths))) // 4
    starts = {k: int(ends[k]) - len(s[0][1]) for k, s in full.items()}
    losses = [[s[0][0] - x for x, _ in s] for s in (full[k] for _, k in least)]
    # Best-first over choices (unit's rank in `least`, alternative): each choice is reached once, by raising, extending or moving its last part.
    queue = [(losses[0][1], ((0, 1),))]
    while queue and len(out) < n:
        loss, choice = heapq.heappop(queue)
        edits = [(starts[k], len(full[k][0][1]), full[k][a][1]) for k, a in ((least[u][1], a) for u, a in choice)]
        own, done = [], 0
        for at, length, new in sorted(edits):
            own += [value[done:at], v.values[list(new)]]
            done = at + length
        out.append((_total(np.concatenate((*own, value[done:]))), edits))
        u, a = choice[-1]
        if a + 1 < len(losses[u]):
            heapq.heappush(queue, (loss - losses[u][a] + losses[u][a + 1], (*choice[:-1], (u, a + 1))))
        if u + 1 < len(least):
            heapq.heappush(queue, (loss + losses[u + 1][1], (*choice, (u + 1, 1))))
            if a == 1:
                heapq.heappush(queue, (loss - losses[u][1] + losses[u + 1][1], (*choice[:-1], (u + 1, 1))))
    # Scores that differ by rounding alone come in their own order.
    return [out[0], *sorted(out[1:], key=itemgetter(0), reverse=True)]


def segment(texts: list[str | None], v: Pieces, n: int = N_BEST) -> Iterator[list]:
    """n_best() of each text; the units of all of them are learnt together."""
    units = [_UNIT.findall(normalise(t or "")) for t in texts]
    learn(set(chain.from_iterable(units)), v)
    return (n_best(u, v, n) for u in units)


def decode(ids: list[int], v: Pieces) -> str:
    """The text of a segmentation: byte pieces joined and decoded, U+2581 a space, the one in front gone."""
    byte_of = {i: b for b, i in enumerate(v.bytes_at)}
    raw = b"".join(bytes([byte_of[i]]) if i in byte_of else v.by_id[i].encode() for i in ids)
    text = raw.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


_EDITS = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
SCHEMA = "doc_id long, ids array<int>, score double, others array<struct<score: double, edits: array<struct<at: int, length: int, ids: array<int>>>>>, round_trip boolean"


def encode(docs: DataFrame, model: Pieces, n: int = N_BEST) -> DataFrame:
    """(doc_id, ids, score, others, round_trip): the best segmentation whole, the others as edits of it in falling order of score, and whether decoding gives the text again (a U+2581 in it would not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_bytes = [p.encode("utf-8", "replace") for p in model.by_id]
        for b, i in enumerate(model.bytes_at):
            piece_bytes[i] = bytes([b])
        space, get = SPACE.encode(), piece_bytes.__getitem__
        # A worker runs many tasks: what it remembers goes on while the model is the same.
        key = (len(model.by_id), model.lowest, hash(tuple(model.by_id)))
        learnt = _WORKER.setdefault(key, model)
        for batch in chunks(batches, 1, CHUNK):
            flat, sizes, scores, others, same = [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for text, (first, *rest) in zip(texts, segment(texts, learnt, n), strict=True):
                ids = first[1][0][2]
                flat.append(np.fromiter(ids, np.int32, len(ids)))
                sizes.append(len(ids))
                scores.append(first[0])
                others.append([{"score": s, "edits": [{"at": a, "length": k, "ids": list(x)} for a, k, x in edits]} for s, edits in rest])
                back = b"".join(map(get, ids)).replace(space, b" ")
                same.append(back[1:] == (text or "").encode("utf-8", "replace") if ids else not text)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(scores, pa.float64()), pa.array(others, _EDITS), pa.array(same, pa.bool_())], ["doc_id", "ids", "score", "others", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def alternatives(encoded: DataFrame) -> DataFrame:
    """(doc_id, rank, score, ids) of encode()'s rows: the best segmentation, rank 0, and each of the others written out."""
    edited = "aggregate(array_sort(x.edits, (a, b) -> b.at - a.at), ids, (acc, e) -> concat(slice(acc, 1, e.at), e.ids, slice(acc, e.at + e.length + 1, size(acc))))"
    every = F.expr(f"concat(array(named_struct('score', score, 'ids', ids)), transform(others, x -> named_struct('score', x.score, 'ids', {edited})))")
    return encoded.select("doc_id", F.posexplode(every).alias("rank", "x")).select("doc_id", "rank", "x.score", "x.ids")


def decode_ids(encoded: DataFrame, model: Pieces, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with a column `text` that its ids spell; null ids give null, ids beyond the vocabulary an error."""
    raw = [p.encode("utf-8", "replace") for p in model.by_id]
    for b, i in enumerate(model.bytes_at):
        raw[i] = bytes([b])
    space = SPACE.encode()

    @arrow_udf("string")
    def spelt(ids: pa.Array) -> pa.Array:
        out = []
        for x in ids.to_pylist():
            found = None if x is None else b"".join(map(raw.__getitem__, x)).replace(space, b" ").decode("utf-8", "replace")
            out.append(found and found.removeprefix(" "))
        return pa.array(out, pa.string())

    return encoded.withColumn(text, spelt(F.col(ids)))


def op10_segmentation(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), read_model(model))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", "ids", "others", "round_trip")
