"""Line dedup by an exact set-similarity join.

A line's set is its distinct words, ASCII letters lower-cased. A line is removed if an earlier one (by document, then
line number) has a Jaccard similarity of THRESHOLD or more with it, removed or not. In the query every line that isn't
blank takes part; by default only those of MIN_TOKENS distinct words or more.

Lines are joined by prefix filtering: tokens are ordered by rarity, two similar sets share one of their first
n - ceil(t n) + 1 tokens (the prefix), and what meets on such a token is filtered by length, by the position of the
shared token and by parity bitmaps of the sets (their differing bits bound the symmetric difference from below). A
bitmap has about a bit and a third a word, in powers of two from 64 bits on; of two lengths the longer is folded. What
passes is verified on the whole sets, hashed anew from the texts. The order is that of a count sketch over all lines,
a table of fixed size whatever the vocabulary: any total order is exact, and a bucket shared by chance costs candidates
only. A token whose bucket counts more than FREQUENT occurrences is no key of its own: with prefixes one token longer
two similar sets share two tokens, so that it is paired with each token after it, which splits its group. Every pair
is found either way; FREQUENT decides by which of its tokens.

Equal lines share all their keys: in each group only the first of them goes on, and a task sends on none that it
has seen before. Sets of three words or fewer are similar at 0.8 only when equal; their key is the whole set.

A line needs one witness. In each token group it names the WITNESSES earliest lines that pass the filters. The one
that most of its groups name is verified first, then the rest of them. Where none of them holds and a group has more to
name, the line is compared there with all earlier lines, word by word, within the group's task. So a group of near
copies gives a number of candidates linear in its size, and no pair is left out.

Words are told apart by 64 bits of hash (one function for candidates, XXH64 for the verdict), sets of a token group by 64.

Defined results: lines that take no part, blank ones included, stay; a null text stays null; a null doc_id ranks
first; rows that share a doc_id but not the text are documents of their own, ranked by a hash of the text; rows equal in
both are one document, with one result for each of them, as none is earlier; a document whose lines all go keeps an
empty text; an empty table gives an empty result; other columns pass through whatever their names, and the added
column's name takes an underscore where the input has it already.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from vellumgrid.llm._shared import BREAK, LOWER, UPPER, chunks, drop, identified, materialise, restored, result_name, table

THRESHOLD_PER_CENT, MIN_TOKENS, SKETCH_BITS, WITNESSES = 80, 5, 20, 4
#: A token whose bucket counts more occurrences than this is paired.
FREQUENT = 20_000
#: Characters of text looked at together, bytes hashed together, and rows of token groups scanned together.
CHUNK, BLOCK, ROWS = 4_000_000, 1 << 18, 200_000
_SLICE, _LEVELS, _SEEN = 1 << 14, 120, 100_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_TO_LOWER = np.frombuffer(_LOWER, np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(k)
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, x, np.uint64)))) for x in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1]


def token_hashes(texts: list[str | None], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(line, hash) of every word of the texts, lines counted through all of them, and each text's number of lines."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    whole = np.frombuffer(b"\n".join(raw), np.uint8)
    lines, hashes, at, line = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0, 0
    while at < len(whole):
        end = min(at + block, len(whole))
        while end < len(whole) and not _SPACE[whole[end]]:  # words stay whole
            end += 1
        a = _TO_LOWER[whole[at:end]]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[a], [True])).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        power, inverse = _powers(len(a))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(a * power)))
        hashes.append(_mix((total[ends] - total[starts]) * inverse[starts], 0xBF58476D1CE4E5B9))
        breaks = np.flatnonzero(a == 10)
        lines.append(np.searchsorted(breaks, starts) + line)
        at, line = end, line + len(breaks)
    return np.concatenate(lines), np.concatenate(hashes), [r.count(b"\n") + 1 for r in raw]


def _sketch(texts: DataFrame) -> np.ndarray:
    """A level from 0 to 119 for each bucket of token hashes, growing with the logarithm of its count over all rows. Tasks count for themselves; 2^20 bytes reach the driver."""
    size = 1 << SKETCH_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for part in chunks(batches, 0, CHUNK):
            _, h, _ = token_hashes(part.column(0).to_pylist())
            n += np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(size // _SLICE), pa.int32()), pa.array([zlib.compress(n[k : k + _SLICE].tobytes(), 1) for k in range(0, size, _SLICE)], pa.binary())], ["k", "v"])

    def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_SLICE, np.int64)
        for batch in batches:
            for x in batch.column("v"):
                n += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(_LEVELS - 1, np.log(n + 1.0) * 4).astype(np.uint8).tobytes()], pa.binary())], ["k", "v"])

    out = np.zeros(size, np.uint8)
    for r in texts.mapInArrow(counted, "k int, v binary").groupBy("k").applyInArrow(summed, "k int, v binary").collect():
        out[r.k * _SLICE : (r.k + 1) * _SLICE] = np.frombuffer(r.v, np.uint8)
    return out


def _need(na, nb, t: int):
    """The least overlap of sets of these sizes at the similarity."""
    return -(-t * (na + nb) // (100 + t))


def _bitmap_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmap of a set of n."""
    return 1 << np.ceil(np.log2(np.maximum(n, 48) / 48)).astype(np.int64)


@dataclass
class Sets:
    """The sets of many lines, tokens by line and from rare to frequent."""

    line: np.ndarray  # line of each set, counted through all texts
    start: np.ndarray  # its first token
    n: np.ndarray
    tokens: np.ndarray
    levels: np.ndarray
    digest: np.ndarray
    of_text: np.ndarray
    line_no: np.ndarray


def line_sets(texts: list[str | None], level: np.ndarray, min_tokens: int) -> Sets:
    line, h, counts = token_hashes(texts)
    lvl = level[(h & np.uint64(len(level) - 1)).astype(np.int64)].astype(np.uint64)
    key = (lvl << np.uint64(57)) | (h >> np.uint64(7))
    packed = (line.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20))
    order = np.argsort(packed)
    s = packed[order]
    # Line numbers of more than 20 bits don't fit, or a tie of different tokens: the full order.
    if sum(counts) > 1 << 20 or np.any((s[1:] == s[:-1]) & (h[order][1:] != h[order][:-1])):
        order = np.lexsort((h, key, line))
    line, h, lvl = line[order], h[order], lvl[order]
    first = np.ones(len(h), bool)
    first[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
    line, h, lvl = line[first], h[first], lvl[first]
    n = np.bincount(line, minlength=sum(counts))
    take = n[line] >= max(min_tokens, 1)
    line, h, lvl = line[take], h[take], lvl[take]
    own, start = np.unique(line, return_index=True)
    digest = np.add.reduceat(_mix(h, 0x94D049BB133111EB), start) if len(own) else h
    line_starts = np.concatenate(([0], np.cumsum(counts)))
    text = np.searchsorted(line_starts, own, "right") - 1
    return Sets(own, start, n[own], h, lvl, digest, text, own - line_starts[text])


def _chosen(s: Sets, rows: np.ndarray) -> Sets:
    """Some of the sets."""
    n = s.n[rows]
    start = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else s.start[:0]
    at = np.repeat(s.start[rows] - start, n) + np.arange(n.sum())
    return Sets(s.line[rows], start, n, s.tokens[at], s.levels[at], s.digest[rows], s.of_text[rows], s.line_no[rows])


def bitmaps(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    """The parity bitmaps of all sets one after another, and where each starts (and the last ends)."""
    words = _bitmap_words(s.n)
    at = np.concatenate(([0], np.cumsum(words)))
    out = np.zeros(at[-1], np.uint64)
    row = np.repeat(np.arange(len(s.n)), s.n)
    # The low bits choose the word, so that a longer bitmap folds to a shorter one.
    place = s.tokens >> np.uint64(32)
    np.bitwise_xor.at(out, at[row] + (place & (words[row] - 1).astype(np.uint64)).astype(np.int64), np.uint64(1) << (s.tokens >> np.uint64(26) & np.uint64(63)))
    return out, at


def prefix_keys(s: Sets, per_cent: int, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, place of the key's first token) of all prefixes, sets in order; a set's first key is that of its rarest token."""
    n = s.n
    prefix = n - -(-n * per_cent // 100) + 1
    # A set too small to be similar to one of a word more or less is similar to its equals only: one key for the whole.
    whole = (100 * n < per_cent * (n + 1)) & (100 * (n - 1) < per_cent * n)
    prefix = np.where(whole, 0, prefix)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(s.tokens)) - s.start[row]
    often = s.levels >= np.uint64(min(_LEVELS - 1, int(np.log(frequent + 1.0) * 4)))
    single = np.flatnonzero((place < prefix[row]) & ~often)
    heads = np.flatnonzero((place < prefix[row]) & often)
    after = np.minimum(prefix[row[heads]] + 1, n[row[heads]]) - 1 - place[heads]
    head = np.repeat(heads, after)
    tail = head + 1 + np.arange(len(head)) - np.repeat(np.cumsum(after) - after, after)
    # A set that may share but one token with a similar one has its frequent tokens as keys of their own, too.
    single = np.concatenate((single, heads[-(-n * per_cent // 100)[row[heads]] < 2]))
    keys = np.concatenate((_mix(s.digest[whole], 0xA0761D6478BD642F), _mix(s.tokens[single], 0xFF51AFD7ED558CCD), _mix(s.tokens[head] * np.uint64(31) + _mix(s.tokens[tail], 0xC4CEB9FE1A85EC53), 0x2545F4914F6CDD1D)))
    owner = np.concatenate((np.flatnonzero(whole), row[single], row[head]))
    at = np.concatenate((np.zeros(whole.sum(), np.int64), place[single], place[head]))
    by = np.lexsort((at, owner))
    return owner[by], keys[by], at[by]


_KEYED_SQL = "key long, row binary"
#: A row is a header of 64-bit words and the words of the bitmap.
DOC, MARK, LINE_N, PLACE, DIGEST, HEADER = range(6)
#: Places of rows that aren't keys: a line that an equal one before it settles.
_GONE = -1


def _rows(key: np.ndarray, header: tuple[np.ndarray, ...], words: np.ndarray, bits: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of _KEYED_SQL; `words` words of each row's bitmap start at `at` in bits."""
    ends = np.concatenate(([0], np.cumsum(words + HEADER)))
    out = np.empty(ends[-1], np.uint64)
    for k, column in enumerate(header):
        out[ends[:-1] + k] = column.astype(np.int64).view(np.uint64)
    inside = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
    out[np.repeat(ends[:-1] + HEADER, words) + inside] = bits[np.repeat(at, words) + inside]
    data = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), data], ["key", "row"])


def _keyed(level: np.ndarray, per_cent: int, min_tokens: int, frequent: int):
    """Rows of _KEYED_SQL of texts (doc, mark, text): a line's keys, its first one by a place of 0 or more, the others by -2 - place; or a row that says that the line goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: dict[int, tuple[int, int, int]] = {}  # sets that came up more than once in this task
        for part in chunks(batches, 2, CHUNK):
            doc, mark = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            s = line_sets(part.column(2).to_pylist(), level, min_tokens)
            if not len(s.n):
                continue
            by = np.lexsort((mark, doc))
            text_rank = np.empty(len(doc), np.int64)
            text_rank[by] = np.cumsum(np.append(True, (doc[by][1:] != doc[by][:-1]) | (mark[by][1:] != mark[by][:-1])))
            order = np.lexsort((s.line_no, text_rank[s.of_text], s.digest))
            d = s.digest[order]
            new = np.ones(len(d), bool)
            new[1:] = d[1:] != d[:-1]
            again = np.flatnonzero(new & np.append(~new[1:], False))
            gone, drop_ = np.zeros(len(d), bool), np.zeros(len(d), bool)
            head = np.flatnonzero(new)
            # The same line of the same document read twice is neither earlier nor later.
            rank, lead = text_rank[s.of_text[order]], order[head[np.cumsum(new) - 1]]
            itself = (rank == text_rank[s.of_text[lead]]) & (s.line_no[order] == s.line_no[lead])
            gone[order[~itself]], drop_[order[~new]] = True, True
            for i in head[np.isin(d[head], np.fromiter(hot, np.uint64, len(hot)))].tolist() if hot else ():
                r = order[i]
                here = (int(doc[s.of_text[r]]), int(mark[s.of_text[r]]), int(s.line_no[r]))
                if here > hot[int(d[i])]:
                    gone[r] = drop_[r] = True
                else:
                    hot[int(d[i])] = here
            if len(hot) < _SEEN:
                for r in order[again].tolist():
                    hot.setdefault(int(s.digest[r]), (int(doc[s.of_text[r]]), int(mark[s.of_text[r]]), int(s.line_no[r])))
            g = np.flatnonzero(gone)
            if len(g):
                t, none = s.of_text[g], np.zeros(len(g), np.int64)
                spread = _mix(mark[t].view(np.uint64) + s.line_no[g].astype(np.uint64) * _BASE, 0xD6E8FEB86659FD93)
                yield _rows(spread, (doc[t], mark[t], s.line_no[g] << 32, none + _GONE, none), none, np.zeros(0, np.uint64), none)
            s = _chosen(s, np.flatnonzero(~drop_))
            row, key, place = prefix_keys(s, per_cent, frequent)
            bits, at = bitmaps(s)
            first = np.ones(len(row), bool)
            first[1:] = row[1:] != row[:-1]
            place = np.where(first, place, -2 - place)
            for k in range(0, len(row), ROWS):
                r = row[k : k + ROWS]
                t = s.of_text[r]
                yield _rows(key[k : k + ROWS], (doc[t], mark[t], s.line_no[r] << 32 | s.n[r], place[k : k + ROWS], s.digest[r].view(np.int64)), np.diff(at)[r], bits, at[r])

    return run


def _close(a: dict, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    """Places in i of those rows that pass the length, position and bitmap filters with the row of j, with which they share a key."""
    nj = a["n"][j]
    k = np.flatnonzero((nj >= a["low"][i]) & (nj <= a["high"][i]))
    i, j = i[k], j[k]
    both = a["n"][i] + a["n"][j]
    need = a["need"][both]
    ok = np.minimum(a["rest"][i], a["rest"][j]) >= need
    k, i, j, differ = k[ok], i[ok], j[ok], (both - 2 * need)[ok]
    ok = np.bitwise_count(a["fold"][i] ^ a["fold"][j]) <= differ
    low = np.where(ok, np.minimum(a["words"][i], a["words"][j]), 0)
    for w in np.unique(low[low > 1]).tolist():
        x = np.flatnonzero(low == w)
        ok[x] = np.bitwise_count(_folded(a, i[x], w) ^ _folded(a, j[x], w)).sum(axis=1) <= differ[x]
    return k[ok]


def _folded(a: dict, rows: np.ndarray, words: int) -> np.ndarray:
    """The bitmaps of the rows, of `words` words or more, folded to that many."""
    out = np.zeros((len(rows), words), np.uint64)
    for k in range(int((a["words"][rows] // words).max())):
        more = a["words"][rows] > k * words
        out[more] ^= a["bits"][a["at"][rows[more]][:, None] + k * words + np.arange(words)]
    return out


_FOUND = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("line", pa.int32()), ("kind", pa.int8()), ("b_doc", pa.int64()), ("b_mark", pa.int64()), ("b_line", pa.int32()), ("key", pa.int64())])
_FOUND_SQL = "doc long, mark long, line int, kind byte, b_doc long, b_mark long, b_line int, key long"
#: Kinds of found rows: the line goes; the line b is a candidate for it; the group `key` holds more candidates for it; it is in such a group.
GONE, CANDIDATE, MORE, MEMBER = range(4)


def _group_scan(t: int, witnesses: int):
    """Rows of _FOUND out of rows of _KEYED_SQL sorted by key. Groups run on from batch to batch; of equal sets in a group only the first is held."""
    plain = ["key", "doc", "mark", "line", "n", "place", "digest", "words"]

    def read(batches: list[pa.RecordBatch]) -> dict:
        batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        column = batch.column(1)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
        data = np.frombuffer(column.buffers()[2], np.uint8)
        data = data[: len(data) // 8 * 8].view(np.uint64)
        at = offsets[:-1]
        a = {"key": batch.column(0).to_numpy(zero_copy_only=False)} | {k: data[at + w].view(np.int64) for k, w in (("doc", DOC), ("mark", MARK), ("n", LINE_N), ("place", PLACE), ("digest", DIGEST))}
        a["line"], a["n"] = a["n"] >> 32, a["n"] & 0xFFFFFFFF
        return a | {"words": np.diff(offsets) - HEADER, "at": at + HEADER, "bits": data}

    def part(a: dict, rows: np.ndarray) -> dict:
        words = a["words"][rows]
        at = np.cumsum(words) - words
        out = {k: a[k][rows] for k in plain} | {"at": at}
        out["bits"] = a["bits"][np.repeat(a["at"][rows] - at, words) + np.arange(words.sum())]
        return out

    def joined(a: dict, b: dict) -> dict:
        out = {k: np.concatenate((a[k], b[k])) for k in (*plain, "bits")}
        return out | {"at": np.concatenate((a["at"], b["at"] + len(a["bits"])))}

    def found(a: dict, i: np.ndarray, kind: int, j: np.ndarray | None = None) -> pa.RecordBatch:
        kinds = (("doc", pa.int64()), ("mark", pa.int64()), ("line", pa.int32()))
        own, other = ([pa.nulls(len(i), x) if r is None else pa.array(a[k][r], x) for k, x in kinds] for r in (i, j))
        return pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(i), kind, np.int8)), *other, pa.array(a["key"][i])], schema=_FOUND)

    def heads(a: dict) -> tuple[dict, pa.RecordBatch]:
        """The first row of each set of a group, and what is settled: the others, where it is their first key, and rows that say so."""
        settled = a["place"] == _GONE
        # One sort brings equal sets together (a twin that another hash parts from its own stays, and is found as a candidate); the ranks of few rows matter.
        order = np.argsort(_mix(a["key"].view(np.uint64) + a["digest"].view(np.uint64) * _BASE, 0x9FB21C651E98DF25))
        x, y = order[1:], order[:-1]
        twin = (a["key"][x] == a["key"][y]) & (a["digest"][x] == a["digest"][y])
        twins = np.zeros(len(order), bool)
        twins[x[twin]] = twins[y[twin]] = True
        k = np.flatnonzero(twins & ~settled)
        k = k[np.lexsort((a["line"][k], a["mark"][k], a["doc"][k], a["digest"][k], a["key"][k]))]
        first = np.ones(len(k), bool)
        first[1:] = (a["key"][k[1:]] != a["key"][k[:-1]]) | (a["digest"][k[1:]] != a["digest"][k[:-1]])
        lead = k[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(k) else k
        same, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
        same[k] = ~first
        later[k] = (a["doc"][k] != a["doc"][lead]) | (a["mark"][k] != a["mark"][lead]) | (a["line"][k] != a["line"][lead])
        gone = np.flatnonzero(settled | later & (a["place"] >= 0))
        return part(a, np.flatnonzero(~settled & ~same)), found(a, gone, GONE)

    def groups(a: dict) -> Iterator[pa.RecordBatch]:
        if not len(a["key"]):
            return
        starts = np.flatnonzero(np.append(True, a["key"][1:] != a["key"][:-1]))  # sorted by key
        size = np.diff(np.append(starts, len(a["key"])))
        rows = np.flatnonzero(np.repeat(size > 1, size))
        if not len(rows):
            return
        order = rows[np.lexsort((a["doc"][rows], np.repeat(np.arange(len(size)), size)[rows]))]
        if np.any((a["key"][order][1:] == a["key"][order][:-1]) & (a["doc"][order][1:] == a["doc"][order][:-1])):
            order = rows[np.lexsort((a["line"][rows], a["mark"][rows], a["doc"][rows], a["key"][rows]))]
        a = part(a, order)
        n = a["n"]
        place = np.where(a["place"] < 0, -2 - a["place"], a["place"])
        a |= {"rest": n - place, "fold": np.bitwise_xor.reduceat(a["bits"], a["at"]), "low": -(-t * n // 100), "high": 100 * n // t, "need": _need(np.arange(2 * int(n.max()) + 1), 0, t)}
        new = np.ones(len(n), bool)
        new[1:] = a["key"][1:] != a["key"][:-1]
        at = np.arange(len(new))
        head = np.maximum.accumulate(np.where(new, at, 0))
        left, ahead, hits, open_ = at[~new], 0, np.zeros(len(new), np.int64), np.zeros(len(new), bool)
        while len(left := left[head[left] + ahead < left]):
            ok = _close(a, left, head[left] + ahead, t)
            if len(ok):
                i = left[ok]
                yield found(a, i, CANDIDATE, head[i] + ahead)
                hits[i] += 1
                i = i[hits[i] >= witnesses]
                open_[i[head[i] + ahead + 1 < i]] = True
                left = left[hits[left] < witnesses]
            ahead += 1
        yield found(a, np.flatnonzero(open_), MORE)
        yield found(a, np.flatnonzero(np.bincount(head[open_], minlength=len(head))[head] > 0), MEMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows = None, [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                waiting.append(batch)
                rows += batch.num_rows
                if rows < ROWS:
                    continue
            if not rows:
                continue
            now = read(waiting)
            held, waiting, rows = now if held is None else joined(held, now), [], 0
            held, gone = heads(held)
            yield gone
            cut = int(np.searchsorted(held["key"], held["key"][-1])) if len(held["key"]) else 0  # sorted by key: all but the last group is whole
            if cut:
                yield from groups(part(held, np.arange(cut)))
                held = part(held, np.arange(cut, len(held["key"])))
        if held is not None and len(held["key"]):
            yield from groups(held)

    return run


def _settled_in_groups(t: int):
    """(doc, mark, line) of the open rows that have an earlier similar one in their group, out of rows (key, member, doc, mark, line, tokens) sorted by (key, member): a group's open rows come first and are held, its members pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rank = None, [], []
        for batch in batches:
            names = batch.schema.names
            keys, member = batch.column(names.index("key")).to_numpy(zero_copy_only=False), batch.column(names.index("member")).to_numpy(zero_copy_only=False)
            places = list(zip(*(batch.column(names.index(k)).to_pylist() for k in _PLACE), strict=True))
            column = batch.column(names.index("tokens"))
            ends, tokens = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (member[1:] != member[:-1])) + 1
            settled = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if keys[a] != key:
                    key, held = keys[a], []
                if not member[a]:
                    held += [(places[k], np.sort(tokens[ends[k] : ends[k + 1]])) for k in range(a, b)]
                    continue
                if not held:
                    continue
                here, starts = tokens[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                n, rank, left = np.diff(starts), places[a:b], []
                for place, own in held:
                    hit = own[np.minimum(np.searchsorted(own, here), len(own) - 1)] == here
                    total = np.concatenate(([0], np.cumsum(hit)))
                    close = np.flatnonzero((100 + t) * (total[starts[1:]] - total[starts[:-1]]) >= t * (n + len(own)))
                    if any(rank[k] < place for k in close.tolist()):
                        settled.append(place)
                    else:
                        left.append((place, own))
                held = left
            if settled:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in settled], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], _PLACE)

    return run


_PLACE = ["doc", "mark", "line"]


def _tokens(line: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.translate(line, UPPER, LOWER), BREAK), ""))


def _token_table(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(place, tokens: the words' hashes) of these places, written. Only texts that hold one of them are cut to lines."""
    asked = places.groupBy("doc", "mark").agg(F.collect_set("line").alias("lines"))
    # Texts are cut before they are dealt out: later an expression over them would cut them once for each line.
    cut = texts.select("doc", "mark", F.split("text", "\n", -1).alias("all"))
    lines = cut.join(asked, ["doc", "mark"]).select("doc", "mark", F.explode(F.transform("lines", lambda k: F.struct(k.alias("line"), F.get("all", k).alias("t")))).alias("x"))
    # Words are cut and hashed once for each line, not for each pair, and pairs carry eight bytes a word.
    hashed = lines.select("doc", "mark", F.col("x.line").alias("line"), F.transform(_tokens(F.col("x.t")), lambda w: F.xxhash64(w)).alias("tokens"))
    # Rows that are equal give equal lines; the join's partitions hold them together.
    return materialise(hashed.groupBy(*_PLACE).agg(F.first("tokens").alias("tokens")).select(F.struct(*_PLACE).alias("place"), "tokens"))


def _verified(pairs: DataFrame, tokens: DataFrame, t: int) -> DataFrame:
    """The places `a` of the pairs (a, b) whose sets have the similarity, written."""
    x, y = (tokens.select(F.col("place").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
    full = pairs.select("a", "b").join(x, "a").join(y, "b")
    return materialise(full.where((100 + t) * F.size(F.array_intersect("ta", "tb")) >= t * (F.size("ta") + F.size("tb"))).select("a").distinct())


def gone_lines(docs: DataFrame, per_cent: int = THRESHOLD_PER_CENT, min_tokens: int = MIN_TOKENS, frequent: int = FREQUENT, witnesses: int = WITNESSES) -> DataFrame:
    """(doc, mark, line) of the lines that go, by the identity of identified(); a written table, the only one left of the join."""
    texts = identified(docs).select("doc", "mark", "text")
    level = _sketch(texts.select("text"))
    keyed = texts.mapInArrow(_keyed(level, per_cent, min_tokens, frequent), _KEYED_SQL)
    found = materialise(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_group_scan(per_cent, witnesses), _FOUND_SQL))
    a, b = F.struct(*_PLACE).alias("a"), F.struct(*[F.col(f"b_{k}").alias(k) for k in _PLACE]).alias("b")
    pairs = materialise(found.where(F.col("kind") == CANDIDATE).groupBy(a, b).agg(F.count("*").alias("shared")))
    members = found.where(F.col("kind") == MEMBER)
    tokens = _token_table(texts, pairs.select("a.*").unionByName(pairs.select("b.*")).unionByName(members.select(*_PLACE)).distinct())
    # A witness is enough: the line that most groups name first, then, for those it doesn't settle, the others.
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    sure = _verified(best, tokens, per_cent)
    late = _verified(pairs.join(sure, "a", "left_anti"), tokens, per_cent)
    open_ = materialise(found.where(F.col("kind") == MORE).select(a, "key").join(sure.unionByName(late), "a", "left_anti"))
    groups = members.join(open_.select("key").distinct(), "key", "left_semi").select("key", F.lit(True).alias("member"), a.alias("place"))
    groups = groups.unionByName(open_.select("key", F.lit(False).alias("member"), F.col("a").alias("place"))).join(tokens, "place").select("key", "member", "place.*", "tokens")
    rest = groups.repartition("key").sortWithinPartitions("key", "member").mapInArrow(_settled_in_groups(per_cent), "doc long, mark long, line int")
    gone = found.where(F.col("kind") == GONE).select(*_PLACE).unionByName(sure.select("a.*")).unionByName(late.select("a.*")).unionByName(rest)
    out = materialise(gone.distinct())
    drop(found, pairs, tokens, sure, late, open_)
    return out


def dedup(docs: DataFrame, per_cent: int = THRESHOLD_PER_CENT, min_tokens: int = MIN_TOKENS, frequent: int = FREQUENT, witnesses: int = WITNESSES) -> DataFrame:
    """docs with removed lines cut from `text` (n_chars, if there is such a column, counted anew) and a column `removed_lines` of their numbers, null for a null text."""
    gone = gone_lines(docs, per_cent, min_tokens, frequent, witnesses).groupBy("doc", "mark").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    kind = pa.string()

    @arrow_udf("string")
    def edited(text: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for t, drops in zip(text.to_pylist(), gone.to_pylist(), strict=True):
            drops = set(drops or ())
            out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in drops) if drops else None)
        return pa.array(out, kind)

    df = identified(docs).join(gone, ["doc", "mark"], "left")
    # Only texts that lose something travel to Python.
    df = df.withColumn("left", edited(F.when(F.col("gone").isNotNull(), F.col("text")), F.col("gone")))
    text = F.when(F.col("gone").isNotNull(), F.col("left")).otherwise(F.col("text"))
    removed = F.when(F.col("text").isNotNull(), F.coalesce("gone", F.array().cast("array<int>")))
    return df.select(*restored(docs, text), removed.alias(result_name("removed_lines", docs.columns)))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_tokens=1)
    return out.select("doc_id", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"), "text")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, text FROM documents),
l AS (SELECT r, unnest(p) AS line, unnest(range(len(p))) AS line_no FROM (SELECT r, string_split(text, chr(10)) AS p FROM d WHERE text IS NOT NULL)),
s AS (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(line, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM l),
k AS (SELECT row_number() OVER (ORDER BY r, line_no) AS k, r, line_no, w FROM s WHERE len(w) > 0),
c AS (SELECT w, min(k) AS k, len(w) AS n FROM k GROUP BY w),
t AS (SELECT k, n, unnest(w) AS tok FROM c),
j AS (SELECT DISTINCT b AS k FROM (SELECT x.k AS a, y.k AS b, any_value(x.n + y.n) AS n, count(*) AS o FROM t x JOIN t y ON x.tok = y.tok AND x.k < y.k AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n GROUP BY x.k, y.k) WHERE 100 * o >= 80 * (n - o)),
g AS (SELECT k.r, k.line_no FROM k JOIN c USING (w) WHERE k.k <> c.k OR k.k IN (SELECT k FROM j)),
o AS (SELECT l.r, count(g.r) AS n, string_agg(l.line_no::VARCHAR, ',' ORDER BY l.line_no) FILTER (g.r IS NOT NULL) AS gone, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (g.r IS NULL) AS text FROM l LEFT JOIN g ON l.r = g.r AND l.line_no = g.line_no GROUP BY l.r)
SELECT doc_id, coalesce(o.n, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(o.gone, '') END AS removed_lines, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text
FROM d LEFT JOIN o USING (r)"""
