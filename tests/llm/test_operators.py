"""Every operator against a brute-force version, its DuckDB SQL, an exact round trip, or on edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import os
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from vellumgrid.llm import chat_format, embedding_dedup, license_scan, line_dedup, packing, quality_classifier, quality_rules, segmentation, simhash, substring_dedup
from vellumgrid.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component string, removed string"
#: Names that operators use inside.
CLASHING = ["doc", "mark", "row", "left", "spans", "gone", "removed", "removed_lines", "_e", "_kept", "_spans", "_doc", "_score", "_head", "score", "fp", "first", "component", "line", "key", "h1", "piece", "_t", "_text", "level", "alone", "turns", "node", "dim"]
WORDS = [f"w{k:03d}" for k in range(400)]


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def edge(spark):
    """Odd rows: a null text, an empty one, blanks, a null id, a repeated row, a long text, and names that clash with internal ones."""
    rng = random.Random(5)
    long_text = "\n".join(sentence(rng, 12) for _ in range(3000))
    base = [(1, None), (2, ""), (3, " \n\t"), (None, sentence(rng, 30)), (4, "Same words in this very line here"), (4, "Same words in this very line here"), (5, long_text), (6, "SAME words in this very line here")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", "y") for i, t in base], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for n in os.listdir(SF):
        c.sql(f"CREATE VIEW {n[:-8]} AS SELECT * FROM '{SF}/{n}'")
    df = QUERIES[name](spark, SF)
    rel = c.sql(ORACLES[name])
    at = [rel.columns.index(k) for k in df.columns]
    assert sorted(repr(norm(tuple(r))) for r in df.collect()) == sorted(repr(norm(tuple(r[i] for i in at))) for r in rel.fetchall())


def clashing(spark, rows, key="doc_id", kind="string"):
    """rows (key, value) with a column of every internal name."""
    return spark.createDataFrame([(*r, *[f"{c}{k}" for c in CLASHING]) for k, r in enumerate(rows)], f"{key} long, {'text' if kind == 'string' else 'embedding'} {kind}, {', '.join(f'`{c}` string' for c in CLASHING)}")


def unclashed(before, after):
    """All other columns of a row are as they were."""
    return {tuple(r[c] for c in CLASHING) for r in after} <= {tuple(r[c] for c in CLASHING) for r in before}


def test_ten_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


# --- 1 substring dedup --------------------------------------------------------------------------------------------


def brute_repeats(rows):
    first, out = {}, {}
    for doc, text in sorted(rows):
        spans = []
        for s, e, k in zip(*substring_dedup.units(text), strict=True):
            if k not in first:
                first[k] = (doc, s, e)
            elif first[k][0] != doc or s > first[k][1]:
                a = max(s, first[k][2]) if first[k][0] == doc else s
                if a < e:
                    spans.append((a, e))
        out[doc] = substring_dedup._merged([a for a, _ in spans], [b for _, b in spans])
    return out


def test_substring_dedup(spark):
    rng = random.Random(1)
    passage = " ".join(sentence(rng, 9) for _ in range(7))
    rows = [(k, " ".join(sentence(rng, 8) for _ in range(6)) + ("  " + passage + "\n" if k % 3 == 0 else " ") + sentence(rng, 40)) for k in range(12)]
    rows.append((50, " ".join([sentence(rng, 6)] * 12)))
    out = {r.doc_id: r for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_repeats(rows)
    assert {k: [(x.start, x.stop) for x in r.removed] for k, r in out.items()} == want
    assert not out[0].removed and passage in out[0].text and passage[:40] not in out[3].text
    assert all(not out[k].removed for k in range(12) if k % 3)
    assert out[50].removed and len(out[50].text.split()) >= 25


def shared_words(rows, least=25):
    """Per document the words it loses: those in runs of least words or more that stood in an earlier document or earlier in its text (there, only beyond the first occurrence)."""
    first, out = {}, {}
    for doc, text in rows:
        w = text.lower().split()
        gone = set()
        for i in range(len(w) - least + 1):
            k = tuple(w[i : i + least])
            d, at = first.setdefault(k, (doc, i))
            gone.update(range(i if d != doc else max(i, at + least), i + least) if (d, at) != (doc, i) else ())
        out[doc] = [x for i, x in enumerate(text.split()) if i not in gone]
    return out


def test_substring_passages_within_sentences(spark):
    rng = random.Random(11)
    some = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passages = [some(n) for n in (25, 26, 35, 60, 24)]
    passages[3][30] += "."
    rows = []
    for k in range(40):
        words = some(rng.randrange(30))
        for p in rng.sample(passages, rng.randrange(4)):
            p = list(p)
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edited"
            words += [*p, *some(rng.randrange(1, 40))]
        rows.append((k, " ".join(words)))
    rows += [(50, rows[3][1].upper().replace(" ", " \n")), (51, "İ　" + " ".join(passages[3])), (52, " ".join(some(3) * 30))]
    out = {r.doc_id: r.text for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {k: t.split() for k, t in out.items()} == shared_words(rows)


def test_substring_edges(spark, edge, empty):
    out = substring_dedup.remove(edge)
    assert out.columns == [*edge.columns, "removed_"] and out.count() == edge.count()
    assert {r.removed for r in out.collect()} == {"y"}
    assert substring_dedup.remove(empty).count() == 0


def test_substring_identity(spark):
    """Rows that share an id, or have none, keep their own text; every row by brute force over (doc_id, hash of the text)."""
    rng = random.Random(21)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    dup, unique = some(40), some(60)
    rows = [(0, dup), (5, unique), (5, dup + " " + some(9)), (None, some(30) + " " + unique), (None, some(33)), (7, dup), (7, dup), (None, None)]
    df = clashing(spark, rows)
    ranks = {(r.doc_id, r.text): (r.none, r.doc_id or 0, r.mark) for r in df.selectExpr("doc_id", "text", "doc_id IS NOT NULL AS none", "xxhash64(doc_id IS NULL, text) AS mark").collect()}
    want = shared_words([(ranks[r], r[1] or "") for r in sorted(set(rows), key=lambda r: ranks[r])])
    out = substring_dedup.remove(df)
    assert out.columns == [*df.columns, "removed_"]
    got = out.collect()
    assert len(got) == len(rows) and unclashed(df.collect(), got)
    texts = dict(zip((r["key"] for r in df.collect()), rows, strict=True))
    for r in got:
        assert (r.text or "").split() == want[ranks[texts[r["key"]]]], texts[r["key"]]


@pytest.mark.parametrize("seed", [31, 32])
def test_substring_many_chunks(spark, seed, monkeypatch):
    """Passages that stand in most documents, settled over many tasks."""
    rng = random.Random(seed)
    some = lambda n: [rng.choice(WORDS) for _ in range(n)]
    hot = some(70)
    rows = [(k, " ".join([*some(rng.randrange(20)), *hot[rng.randrange(20) : 70 - rng.randrange(20)], *some(5)])) for k in rng.sample(range(1000), 90)]
    out = {r.doc_id: r.text.split() for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert out == shared_words(sorted(rows))


# --- 2 licence scan -----------------------------------------------------------------------------------------------


def test_licences(spark, edge, empty):
    header = "\n".join(["Licensed under the Apache License, Version 2.0 (the \"License\");", *[license_scan.SENTENCES[k] for k in ("apache-use", "apache-copy", "apache-as-is", "apache-see")]])
    d = spark.createDataFrame([(1, "x\n" + header), (2, license_scan.SENTENCES["mit-grant"] + "\n" + license_scan.SENTENCES["mit-notice"]), (3, "Released under the MIT License."), (4, "All rights reserved."), (5, license_scan.SENTENCES["mit-notice"] + "\n" + license_scan.SENTENCES["mit-grant"])], "doc_id long, text string")
    r = {x.doc_id: x for x in license_scan.scan(d).collect()}
    assert "apache-header" in r[1].rules and r[1].licenses == ["Apache-2.0"]
    assert r[2].rules == ["mit-text"] and r[3].licenses == ["MIT"] and r[4].unmatched == ["proprietary"]
    assert r[5].rules == [], "the order of sentences counts"


WRAPPED = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_licences_as_they_stand_in_files(spark):
    bsd = [license_scan.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    gpl = "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program " + license_scan.SENTENCES["gnu-warranty"] + "  " + license_scan.SENTENCES["gpl-see"]
    texts = [
        ("some words\n" + WRAPPED + "\nmore", ["apache-header"], ["Apache-2.0"]),
        *[("\n".join(f"{mark} {x}" for x in WRAPPED.split("\n")), ["apache-header"], ["Apache-2.0"]) for mark in ("#", " *", "//", "--", ";;")],
        ("\n".join([*bsd, third]), ["bsd-3-text"], ["BSD-3-Clause"]),
        (f"{bsd[0]}\n1. {bsd[1]}\n2. {bsd[2]}\nTHIS SOFTWARE", ["bsd-2-text"], ["BSD-2-Clause"]),
        ("/* " + gpl + " */", ["gpl-3-or-later-header"], ["GPL-3.0-or-later"]),
        (gpl.replace("General", "Lesser General"), ["lgpl-3-or-later-header"], ["LGPL-3.0-or-later"]),
        ("This project is licensed under the MIT License - see the LICENSE file.", ["notice:MIT"], ["MIT"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", ["notice:GPL-2.0-or-later"], ["GPL-2.0-or-later"]),
        ("licensed under GPLv3 or\nlater", ["notice:GPL-3.0-or-later"], ["GPL-3.0-or-later"]),
        ("Unlicensed words; a licensed plumber under the sink", [], []),
        ("Released under the MIT License. Licensed under the Apache License 2.0.", ["notice:MIT", "notice:Apache-2.0"], ["Apache-2.0", "MIT"]),
    ]
    rows = {r.doc_id: r for r in license_scan.scan(clashing(spark, [(k, t) for k, (t, _, _) in enumerate(texts)])).collect()}
    for k, (text, rules, licenses) in enumerate(texts):
        assert (rows[k].rules, rows[k].licenses) == (rules, licenses), text


def test_licence_edges(spark, edge, empty):
    notice = "Licensed under the MIT License. "
    r = [x.licenses for x in license_scan.scan(spark.createDataFrame([(1, notice), (1, notice), (None, notice), (2, "word " * 300_000 + notice)], "doc_id long, text string")).collect()]
    assert r == [["MIT"]] * 4
    assert license_scan.scan(edge).count() == edge.count() and license_scan.scan(empty).count() == 0


# --- 3 line dedup -------------------------------------------------------------------------------------------------


def words_of(line):
    return frozenset(line.encode().translate(line_dedup._LOWER).split())


def brute_lines(rows, least=5):
    seen, kept = [], set()
    for doc, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            s = words_of(line)
            if len(s) >= least:
                if not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    kept.add((doc, k))
                seen.append(s)
    return kept


def kept_lines(df, **options):
    """(doc_id, line number) of the lines with words that dedup() leaves, for distinct ids."""
    least = options.get("min_tokens", 5)
    gone = {(r.doc_id, k) for r in line_dedup.dedup(df, **options).collect() for k in r.removed_lines or ()}
    return {(r.doc_id, k) for r in df.collect() for k, line in enumerate((r.text or "").split("\n")) if len(words_of(line)) >= least} - gone


@pytest.mark.parametrize(("frequent", "witnesses"), [(20_000, 4), (20, 4), (20_000, 1), (5, 1)])
def test_line_dedup(spark, frequent, witnesses):
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(30)]
    rows = []
    for k in range(60):
        near = list(base)
        for _ in range(rng.randrange(6)):
            near[rng.randrange(30)] = rng.choice(WORDS)
        rows.append((k, "\n".join([" ".join(near), " ".join(rng.choice(WORDS[:9]) for _ in range(rng.randrange(12))), "", " ".join(near[:5]).upper()])))
    assert kept_lines(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent, witnesses=witnesses) == brute_lines(rows)


@pytest.mark.parametrize("witnesses", [1, 4])
def test_long_lines_just_under_the_threshold(spark, witnesses, monkeypatch):
    """Large groups of lines near the threshold: many candidates, few of them similar; bitmaps of several lengths."""
    rng = random.Random(14)
    rows = []
    for n in (20, 47, 49, 90, 100, 250):
        base = rng.sample([f"v{k}" for k in range(2000)], n)
        for _ in range(40):
            near = list(base)
            for i in rng.sample(range(n), rng.randrange(round(n * 0.07), round(n * 0.14) + 1)):
                near[i] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(near[: n - rng.randrange(n // 10)])))
    want = brute_lines(rows)
    assert 40 < len(want) < len(rows)
    assert kept_lines(spark.createDataFrame(rows, "doc_id long, text string"), witnesses=witnesses) == want


@pytest.mark.parametrize("frequent", [20_000, 5])
def test_short_lines(spark, frequent):
    rng = random.Random(12)
    rows = [(k, "\n".join(" ".join(rng.choice(WORDS[:12]) for _ in range(rng.randrange(7))) for _ in range(12))) for k in range(30)]
    rows += [(40, "All rights reserved."), (41, "x\nALL rights  reserved.\n\n \nno no no no"), (42, "no\nx x\na b c d"), (43, "a b c d e\na b c e")]
    got = kept_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=1, frequent=frequent)
    assert got == brute_lines(rows, 1)
    assert {(40, 0), (41, 0), (41, 4), (42, 2)} == {x for x in got if 40 <= x[0] < 43}


@pytest.mark.parametrize("per_cent", [30, 55, 95])
def test_other_thresholds(spark, per_cent):
    rng = random.Random(15)
    rows = [(k, "\n".join(" ".join(rng.sample(WORDS[:14], rng.randrange(1, 9))) for _ in range(4))) for k in range(12)]
    seen, want = [], set()
    for doc, text in rows:
        for k, line in enumerate(text.split("\n")):
            s = words_of(line)
            if not any(100 * len(s & o) >= per_cent * len(s | o) for o in seen):
                want.add((doc, k))
            seen.append(s)
    assert kept_lines(spark.createDataFrame(rows, "doc_id long, text string"), per_cent=per_cent, min_tokens=1, frequent=9) == want


def test_line_query_takes_all_lines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    kept = brute_lines([(r.doc_id, r.text) for r in docs], 1)
    want = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if not words_of(x) or (r.doc_id, k) in kept) for r in docs if r.text is not None}
    got = {r.doc_id: r.text for r in QUERIES["op3_line_dedup"](spark, SF).collect() if r.text is not None}
    assert got == want and want != {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if len(words_of(x)) < 5 or (r.doc_id, k) in kept) for r in docs if r.text is not None}


def test_more_lines_than_twenty_bits(spark):
    far = "a b c d e" + "\n" * (1 << 20) + "v w x y z"
    level = np.zeros(1 << line_dedup.SKETCH_BITS, np.uint8)
    got, want = (line_dedup.line_sets([t], level, 5) for t in (far, "a b c d e\nv w x y z"))
    assert got.line_no.tolist() == [0, 1 << 20]
    assert all((getattr(got, k) == getattr(want, k)).all() for k in ("digest", "n", "tokens", "levels", "start"))
    out = {r.doc_id: r.removed_lines for r in line_dedup.dedup(spark.createDataFrame([(1, far), (2, "v w x y z"), (3, "b a c d e")], "doc_id long, text string")).collect()}
    assert out == {1: [], 2: [0], 3: [0]}


def test_words_over_blocks():
    texts = ["Aa bb  cc\n\ndd", None, "", "long" * 30 + " x\ny", " \n\t"]
    whole, cut = line_dedup.token_hashes(texts), line_dedup.token_hashes(texts, block=7)
    assert all((x == y).all() for x, y in zip(whole[:2], cut[:2], strict=True)) and whole[2] == cut[2] == [3, 1, 1, 2, 2]
    assert whole[0].tolist() == [0, 0, 0, 2, 5, 5, 6]


def test_line_identity(spark):
    """Near copies of lines of rows without an id, or that share one."""
    line = " ".join(WORDS[:20])
    near, other = line.replace("w003", "edited"), " ".join(WORDS[50:70])
    for rows, gone in (
        ([(None, line), (7, near)], [[], [0]]),
        ([(1, line), (7, near), (7, other)], [[], [0], []]),
        ([(7, line), (7, other), (9, other + " x"), (9, near)], [[], [], [0], [0]]),
        ([(None, None), (3, line), (3, line)], [None, [], []]),
    ):
        df = clashing(spark, rows)
        out = line_dedup.dedup(df)
        assert out.columns == [*df.columns, "removed_lines_"]
        got = {r["key"]: r for r in out.collect()}
        assert [got[f"key{k}"].removed_lines_ for k in range(len(rows))] == gone and unclashed(df.collect(), got.values())


def test_line_edges(edge, empty):
    out = line_dedup.dedup(edge)
    assert out.columns == [*edge.columns, "removed_lines"]
    r = {(x.doc_id, x.text): x for x in out.collect()}
    assert r[1, None].removed_lines is None and r[2, ""].removed_lines == []
    assert (6, "") in r, "a line whose words are an earlier line's goes"
    assert sum(1 for d, t in r if d == 4 and t.startswith("Same")) == 1
    assert line_dedup.dedup(empty).count() == 0


# --- 4 chat formatting --------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["### ", "</turn>", "\\", "\\s", "#\\h## ", "<\\t/turn>", "\n", "%0A", "x", "#", " ", "<", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "a%\n#<\\", None]), "".join(rng.choice(bits) for _ in range(rng.randrange(12))) or None) for c in range(60) for t in range(rng.randrange(1, 5))]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    levels = set()
    for r in out.collect():
        levels.add(r.level)
        assert [(p.role, p.text) for p in r.parts] == [(t.role, t.text) for t in r.turns]
    assert {0, 1} <= levels
    spans = chat_format.loss_spans(out).collect()
    texts = {r.conv_id: r.formatted for r in out.collect()}
    assert spans and all(texts[s.conv_id][s.start : s.end] == s.text for s in spans)


def test_chat_edges(spark):
    """Null ids, repeated rows, null turns, a long text, and columns of clashing names."""
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (1, 2, "assistant", "same"), (1, 2, "assistant", "same"), (1, None, None, None), (2, 1, "assistant", "### x </turn> " * 60_000)]
    names = [c for c in CLASHING if c != "turn"]
    df = spark.createDataFrame([(*r, *names) for r in rows], f"conv_id long, turn long, role string, text string, {', '.join(f'`{c}` string' for c in names)}")
    out = sorted(([(p.role, p.text) for p in r.parts] for r in chat_format.format_chats(df).collect()), key=len)
    assert out == [[("user", "a")], [("user", "a")], [("assistant", rows[5][3])], [("", ""), ("assistant", "same"), ("assistant", "same")]] or out[:3] == sorted(out[:3], key=len)
    assert sorted(map(len, out)) == [1, 1, 1, 3] and [("", ""), ("assistant", "same"), ("assistant", "same")] in out and [("assistant", rows[5][3])] in out


def test_chat_empty(spark):
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 5 packing ----------------------------------------------------------------------------------------------------


def naive_pack(lengths, sizes, cost, least):
    """The packing of one least size, by looking at every open bin and every piece to come."""
    bins, out = [], []
    for k, n in enumerate(lengths):
        open_ = [(room, age, b) for b, (room, age, _) in enumerate(bins) if room >= n]
        if open_:
            _, _, b = min(open_)
        else:
            prices = []
            for c in sizes:
                if c >= max(n, least):
                    full = n
                    for m in lengths[k + 1 :]:
                        full += m if full + m <= c else 0
                    prices.append((cost(min(x for x in sizes if x >= full)) / full, c))
            b = len(bins)
            bins.append([min(prices)[1], 0, 0])
        bins[b][0] -= n
        bins[b][1] = len(out)
        bins[b][2] += n
        out.append(b)
    return out, [min(c for c in sizes if c >= used) for _, _, used in bins]


def optimum(lengths, sizes, cost):
    """The least cost of any packing."""
    best = {0: 0.0}
    for chosen in range(1, 1 << len(lengths)):
        first, found = chosen & -chosen, []
        sub = chosen
        while sub:
            total = sum(n for k, n in enumerate(lengths) if sub >> k & 1)
            if sub & first and total <= sizes[-1]:
                found.append(best[chosen ^ sub] + cost(min(c for c in sizes if c >= total)))
            sub = (sub - 1) & chosen
        best[chosen] = min(found)
    return best[(1 << len(lengths)) - 1]


def test_best_fit():
    rng = random.Random(4)
    cost = lambda c: c + c * c / 500 + 30
    for _ in range(20):
        sizes = sorted(rng.sample(range(20, 200), 3))
        lengths = sorted((rng.randrange(1, sizes[-1] + 1) for _ in range(120)), reverse=True)
        for least in sizes:
            assert packing._packed(lengths, sizes, cost, least)[:2] == naive_pack(lengths, sizes, cost, least)
        _, final = packing.best_fit(lengths, sizes, cost)
        assert sum(map(cost, final)) <= packing.smallest_fit(lengths, sizes, cost)[2]
    with pytest.raises(ValueError):
        packing.best_fit([11], [10])


def test_best_fit_against_the_optimum():
    rng = random.Random(16)
    near = []
    for _ in range(60):
        lengths = sorted((rng.randrange(100, 9000) for _ in range(8)), reverse=True)
        placed, final = packing.best_fit(lengths)
        used = [sum(n for n, b in zip(lengths, placed, strict=True) if b == k) for k in range(len(final))]
        assert all(u <= c for u, c in zip(used, final, strict=True)) and final == [min(c for c in packing.CAPACITIES if c >= u) for u in used]
        near.append(sum(map(packing.sequence_cost, final)) / optimum(lengths, packing.CAPACITIES, packing.sequence_cost))
    assert min(near) > 0.999999 and np.mean(near) < 1.03, np.mean(near)


def test_production_sizes_beat_the_smallest_that_holds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    lengths = sorted((min(16384, len(r.text) - k) for r in docs for k in range(0, len(r.text or ""), 16384)), reverse=True)
    _, final = packing.best_fit(lengths)
    assert sum(map(packing.sequence_cost, final)) < 0.995 * packing.smallest_fit(lengths, sorted(packing.CAPACITIES), packing.sequence_cost)[2]


def test_packing_spreads_equal_rows(spark):
    out = packing.pack(spark.createDataFrame([(1, "x" * 30)] * 500 + [(2, None), (None, "y" * 9)], "doc_id long, text string"), (64, 128), per_shard=50).toPandas()
    assert len(out) == 501 and out.bin_id.str.split("-").str[0].nunique() == 11
    assert out.groupby(out.bin_id.str.split("-").str[0]).size().max() < 100


def test_pack_keeps_every_character(spark, edge, empty):
    out = packing.pack(edge, (64, 128, 512)).toPandas()
    assert (out.groupby("bin_id").length.sum() <= out.groupby("bin_id").capacity.first()).all()
    assert out.length.sum() == sum(len(r.text or "") for r in edge.collect())
    long_ = out[out.doc_id == 5].sort_values("start")
    assert (long_.start.values[1:] == (long_.start + long_.length).values[:-1]).all()
    assert packing.pack(empty).count() == 0


# --- 6 classifier -------------------------------------------------------------------------------------------------


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality_classifier.op6_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    p, n = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])
    assert auc > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.88


def brute_risk(w, c, p, u, prior):
    z = lambda row: sum(w[k] for k in row) + c
    plus = [np.log1p(np.exp(-z(r))) for r in p]
    minus = [np.log1p(np.exp(z(r))) for r in p]
    every = [np.log1p(np.exp(z(r))) for r in u]
    return prior * np.mean(plus), np.mean(every) - prior * np.mean(minus)


@pytest.mark.parametrize("bias", [0.3, -3.0])
def test_risk_and_gradient(bias):
    """The risk by its formula and the gradient by differences, with the second part positive and negative."""
    rng = np.random.default_rng(5)
    p, u, w = rng.integers(0, 12, (9, 4)), rng.integers(0, 12, (14, 4)), rng.normal(0, 0.5, 12)
    p = p if bias > 0 else np.repeat(p[:1], 9, axis=0)
    w = w if bias > 0 else np.where(np.isin(np.arange(12), p), 3.0, -3.0)
    positive, negative, g = quality_classifier.risk(w, bias, p, u, 0.4)
    assert np.allclose((positive, negative), brute_risk(w, bias, p, u, 0.4))
    assert (negative >= 0) == (bias > 0)
    target = (lambda w, c: sum(brute_risk(w, c, p, u, 0.4))) if negative >= 0 else (lambda w, c: -brute_risk(w, c, p, u, 0.4)[1])
    for k in range(13):
        step = np.eye(13)[k] * 1e-6
        assert np.isclose(g[k], (target(w + step[:12], bias + step[12]) - target(w - step[:12], bias - step[12])) / 2e-6, atol=1e-6)


def test_prior_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(6)
    for share in (0.3, 0.7):
        rows = lambda n, at: rng.normal(at, 1, (n, 3)).astype(np.float32)
        k = int(4000 * share)
        unlabelled = np.concatenate([rows(k, 2), rows(4000 - k, -2)])[rng.permutation(4000)]
        assert abs(quality_classifier.estimated_prior(rows(3000, 2), unlabelled) - share) < 0.08


def test_classifier_rows(spark):
    """A sample is bounded in rows though one id has many; equal rows and clashing names do no harm."""
    rng = random.Random(17)
    rows = [(4 * k, sentence(rng, 30) if k % 2 else "### " * 30) for k in range(200)] + [(8, sentence(rng, 20)) for _ in range(300)] + [(12, "same"), (12, "same"), (None, "x"), (16, None)]
    df = clashing(spark, rows)
    labels = spark.createDataFrame([(4 * k, k % 2) for k in range(200)] + [(8, None), (None, 1)], "doc_id long, quality int")
    seen = []
    fit = quality_classifier.fit
    quality_classifier.fit = lambda p, u, prior: seen.append((len(p), len(u))) or fit(p, u, prior)
    try:
        quality_classifier.train(df, labels, 40, 50, prior=0.5)
    finally:
        quality_classifier.fit = fit
    assert seen and seen[-1][0] <= 40 and seen[-1][1] <= 50
    out = quality_classifier.reject(df, labels)
    assert out.columns == df.columns and unclashed(df.collect(), out.collect())


def test_classifier_edges(spark, edge, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.train(edge, labels) is None
    assert quality_classifier.reject(edge, labels).count() == edge.count()
    model = quality_classifier.fit(np.random.default_rng(1).normal(1, 1, (200, 3)).astype(np.float32), np.random.default_rng(2).normal(0, 1, (200, 3)).astype(np.float32), 0.5)
    assert model.score(np.array([[3, 3, 3]], np.float32))[0] > model.score(np.array([[-3, -3, -3]], np.float32))[0]
    assert np.isfinite(quality_classifier.features(None)).all()


# --- 7 rules ------------------------------------------------------------------------------------------------------


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_rules(spark):
    rng = random.Random(6)
    texts = [None, "", " \n ", "a b c d e f g h " * 4, "\n".join(rng.choice(["x #y", "zz", "", "\x0b"]) for _ in range(30))]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(40)]
    rows = quality_rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in rows.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(texts[r.doc_id]), texts[r.doc_id]
    kept = quality_rules.apply_policy(rows).where("kept").count()
    for a in quality_rules.ablations(rows).collect():
        left = sum(quality_rules.BITS[n] for n in quality_rules.POLICIES[quality_rules.CURRENT] if n != a.rule)
        assert a.n_kept_without == rows.where(f"fail_bits & {left} = 0").count() and a.n_kept_without - a.n_failed_only == kept


def test_rules_edges(spark, edge, empty):
    rows = quality_rules.ledger(edge)
    assert rows.count() == edge.count() and quality_rules.ledger(empty).count() == 0
    by = {}
    for r in rows.collect():
        by.setdefault(r.doc_id, set()).add(r[1:])
    assert len(by[4]) == 1, "repeated rows measure alike"
    assert all(a.n_failed == 0 for a in quality_rules.ablations(quality_rules.ledger(empty)).collect())
    got = quality_rules.ledger(clashing(spark, [(1, "a b " * 50_000), (1, "a b " * 50_000), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_repeat_words) for r in got) == [(0, 0, 0), (1, 100_000, 100_000), (1, 100_000, 100_000)]


# --- 8 embeddings -------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 24))
    for k in range(0, 300, 3):
        x[k + 1] = x[k] + rng.normal(0, 0.05 + 0.25 * (k % 2), 24)
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    rows += [(900, rows[0][1]), (901, None), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None, 1.0]), (905, [1.0, 2.0])]
    out = {r.vec_id: r for r in embedding_dedup.classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=50).collect()}
    assert len(out) == len(rows)
    ok = {i: np.array(v, float) for i, v in rows if i <= 900}
    ids = sorted(ok)
    u = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    found = np.array([out[i].n_links for i in ids])
    assert (found <= true).all() and found.sum() >= 0.95 * true.sum() > 0
    assert out[900].component_id == out[0].component_id == 0
    assert all(out[i].n_links == 0 and out[i].component_id == i for i in range(901, 906))
    assert embedding_dedup.classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_tables():
    """A pair at the threshold shares a cell of some table, and collides often enough, as often as planned."""
    rng = np.random.default_rng(18)
    tables = embedding_dedup.Tables.of(24, 50_000, 0.95)
    x = rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((3000, 24))
    y -= (x * y).sum(axis=1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1)[:, None]
    px, py = (v @ embedding_dedup._directions(24) for v in (x, y))
    meet = (tables.cells(px) == tables.cells(py)).any(axis=1)
    often = (np.abs(px - py) <= embedding_dedup.WINDOW).sum(axis=1) >= embedding_dedup.least_count()
    assert (meet & often).mean() > 0.985
    assert tables.lines > 3 and (tables.cells(px)[:1500] == tables.cells(py)[1500:]).any(axis=1).mean() < 0.2


def test_embedding_cluster_over_blocks(spark):
    """Hundreds of near copies of one vector, in tiles; repeated ids and rows; null ids; clashing names."""
    rng = np.random.default_rng(19)
    base = rng.standard_normal(16)
    x = [(base + rng.normal(0, 0.12, 16)).tolist() for _ in range(300)]
    rows = [*enumerate(x), (0, x[0]), (7, x[9]), (None, x[3]), (None, [1.0, 2.0])]
    out = embedding_dedup.classes(clashing(spark, rows, "vec_id", "array<double>"), block=40).withColumnRenamed("n_links", "n").collect()
    u = np.array([v for _, v in rows[:-1]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert len(out) == len(rows) and sum(r.n for r in out) >= 0.99 * true.sum() and max(r.n for r in out) <= true.max()
    want = {}
    for (i, _), n in zip(rows, [*true.tolist(), 0], strict=True):
        want.setdefault(i, []).append(n)
    assert all(r.n <= max(want[r.vec_id]) for r in out) and {r.component_id for r in out if r.vec_id is not None and r.n} == {0}
    assert [r.component_id for r in out if r.vec_id is None and not r.n] == [None]


# --- 9 simhash ----------------------------------------------------------------------------------------------------


def test_fingerprints_link_within_three_bits(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base[:30]:
        for d in (1, 2, 3, 4):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), d)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_large_groups_send_a_forest(spark):
    rng = random.Random(20)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << k for k in rng.sample(range(24), rng.randrange(7))) for _ in range(400)})
    rows = np.array(fps, np.uint64)
    i, j = simhash._forest(rows, 3)
    assert len(i) < len(fps) and all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in zip(i, j, strict=True))

    def first(pairs):
        label = {f: f for f in fps}
        while True:
            before = dict(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                return label

    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert first([(fps[a], fps[b]) for a, b in zip(i, j, strict=True)]) == first(near)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    got = simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert first([(signed[r.a], signed[r.b]) for r in got]) == first(near)


def brute_fingerprint(text):
    w = [x.encode() for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)})) if x]
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(texts):
    """Each text's fingerprint, and the place of the first text of its component."""
    fps = [brute_fingerprint(t) for t in texts]
    near = [[j for j, g in enumerate(fps) if (f ^ g).bit_count() <= 3] for f in fps]
    first, before = list(range(len(fps))), None
    while first != before:
        first, before = [min(first[j] for j in x) for x in near], first
    return fps, first


def test_classes_by_brute_force(spark):
    rng = random.Random(13)
    texts = [None, "", "One", "one TWO", " ".join(rng.choice(WORDS) for _ in range(300))]
    for k in range(60):
        w = texts[4 + k // 3 * 3 if k % 3 else 4].split()
        w[rng.randrange(len(w))] = "Edited" if k % 3 else rng.choice(WORDS)
        texts.append(" ".join(w) if k % 5 else "\n".join(rng.choice(WORDS) for _ in range(40)))
    rows = [(k, t) for k, t in enumerate(texts)]

    fps, first = brute_components(texts)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (f, c) for k, (f, c) in enumerate(zip(fps, first, strict=True))}
    assert len(set(first)) < len(set(fps)), "some near copies link"


def test_simhash_edges(edge, empty):
    rows = simhash.classes(edge).collect()
    assert len(rows) == edge.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    out = simhash.dedup(edge)
    assert out.columns == edge.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 4), (False, 5), (True, 0)]
    assert simhash.classes(empty).count() == simhash.dedup(empty).count() == 0


def test_simhash_dedup_rows(spark):
    """One row of each component whatever rows share: ids, texts or neither."""
    rng = random.Random(22)
    a, b, c = (" ".join(rng.choice(WORDS) for _ in range(200)) for _ in range(3))
    rows = [(7, a), (7, b), (7, b), (3, a + " "), (None, c), (None, c), (9, c.upper()), (5, None), (6, "")]
    df = clashing(spark, rows)
    got = simhash.dedup(df)
    assert got.columns == df.columns and unclashed(df.collect(), got.collect())
    assert sorted((r.doc_id, r.text) for r in got.select("doc_id", "text").collect() if r.text) == sorted([(3, a + " "), (7, b), (9, c.upper())])
    assert [r.doc_id for r in got.collect() if not r.text] == [5]


# --- 10 segmentation ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return segmentation.read_model()


def every(text, v):
    if not text:
        yield 0.0, ()
        return
    for k in range(1, min(len(text), v.longest) + 1):
        if text[:k] in v.scores:
            head, score = (v.scores[text[:k]][0],), v.scores[text[:k]][1]
        elif k == 1:
            head, score = tuple(v.bytes_at[c] for c in text[0].encode()), v.lowest
        else:
            continue
        for s, rest in every(text[k:], v):
            yield score + s, head + rest


def test_n_best_are_the_n_best(pieces):
    rng = random.Random(10)
    for _ in range(60):
        text = "".join(rng.choice("aeh t né\n漢") for _ in range(rng.randrange(1, 9)))
        (found,) = segmentation.segment([text], pieces)
        best = found[0][1][0][2]

        def path(edits, best=best):
            out = list(best)
            for at, n, ids in sorted(edits, reverse=True):
                out[at : at + n] = ids
            return tuple(out)

        got = [(found[0][0], best), *[(s, path(e)) for s, e in found[1:]]]
        all_ = sorted(every(segmentation.normalise(text), pieces), key=lambda x: -x[0])
        scores = {}
        for s, ids in all_:
            scores.setdefault(ids, set()).add(s)
        assert [s for s, _ in got] == [s for s, _ in all_[: len(got)]] and len(got) == min(4, len(all_))
        assert all(s in scores[ids] for s, ids in got) and len({ids for _, ids in got}) == len(got)
        assert segmentation.decode(list(best), pieces) == text


def test_scores_are_log_probabilities(pieces):
    p = np.exp([s for _, s in pieces.scores.values()])
    assert abs(p.sum() - 1) < 1e-9 and pieces.lowest < np.log(p.min())
    assert segmentation.log_probabilities({"a": (0, -1.5), "b": (1, -2.0)}) == {"a": (0, -1.5), "b": (1, -2.0)}, "a unigram model's stay"


def test_hashing_words_takes_little_memory_beside_them():
    import tracemalloc

    tracemalloc.start()
    try:
        line_dedup.token_hashes(["abcdefghi " * 400_000])
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()


def test_scores_are_sums_from_the_end(pieces):
    for text in ("the lines of many words \x07 and 漢字 🦄\n\nmore of them, and more " * 5, "hello", ""):
        (found,) = segmentation.segment([text], pieces)
        total = 0.0
        for x in pieces.values[list(found[0][1][0][2])][::-1].tolist():
            total += x
        assert found[0][0] == total and [s for s, _ in found[1:]] == sorted([s for s, _ in found[1:]], reverse=True)


def test_words_mostly_as_the_model_encodes_them(spark, pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=segmentation.MODEL)
    words = "the quick brown fox jumps over a lazy dog while several people watch from their houses and write letters".split()
    ours = [segmentation.search("▁" + w, pieces, 1)[0][1] for w in words]
    assert np.mean([list(x) == sp.encode(w) for x, w in zip(ours, words, strict=True)]) > 0.7


def test_every_alternative_decodes(spark, edge, pieces):
    rows = [(1, "a tab\tand 漢字 é\n\nlines"), (2, None), (3, ""), (None, " two  spaces "), (4, "hello world " * 3)]
    df = segmentation.decode_ids(segmentation.alternatives(segmentation.encode(clashing(spark, rows), pieces)), pieces)
    got = df.collect()
    texts = {k: t or "" for k, t in rows}
    assert all(r.text == texts[r.doc_id] for r in got) and max(r["rank"] for r in got) == 3
    scores = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        scores.setdefault(r.doc_id, []).append(r.score)
    assert all(x == sorted(x, reverse=True) for x in scores.values())
    assert len({(r.doc_id, tuple(r.ids)) for r in got}) == len(got)


def test_segmentation_edges(edge, empty, pieces):
    rows = segmentation.encode(edge, pieces).collect()
    assert len(rows) == edge.count() and all(r.round_trip for r in rows)
    assert [r.ids for r in rows if r.doc_id in (1, 2)] == [[], []]
    assert segmentation.encode(empty, pieces).count() == 0


# --- the pipeline -------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.toPandas()
        docs = corpus_pipeline.materialise(stage(spark, docs, sf))
        after = docs.toPandas()
        assert list(after.columns) == columns, name
        assert set(after.doc_id) <= set(before.doc_id) and (after.n_chars == after.text.str.len()).all()
        if name == "line dedup":
            kept = brute_lines(list(zip(before.doc_id, before.text, strict=True)))
            for r in before.itertuples():
                lines = [x for k, x in enumerate(r.text.split("\n")) if len(words_of(x)) < 5 or (r.doc_id, k) in kept]
                assert after[after.doc_id == r.doc_id].text.item() == "\n".join(lines)
        if name == "substring dedup":
            want = brute_repeats(list(zip(before.doc_id, before.text, strict=True)))
            for r in before.itertuples():
                assert after[after.doc_id == r.doc_id].text.item() == substring_dedup.cut(r.text, want[r.doc_id])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert packed.length.sum() == docs.toPandas().n_chars.sum()


def test_pipeline_run(spark):
    """run()'s pieces against brute force on what the classifier keeps: its lines, near copies and passages, and the kept ids of each stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in corpus_pipeline.classify(spark, docs, SF).collect())
    assert 0 < len(rows) <= docs.count()
    kept = brute_lines(rows)
    rows = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if len(words_of(x)) < 5 or (d, k) in kept)) for d, t in rows]
    _, first = brute_components([t for _, t in rows])
    heads = [r for k, r in enumerate(rows) if first[k] == k]
    assert len(heads) < len(rows)
    spans = brute_repeats(heads)
    want = {d: len(substring_dedup.cut(t, spans[d])) for d, t in heads}
    out = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        out.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, pieces in out.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == want[d]
    assert set(out) >= {d for d, n in want.items() if n} and set(out) <= set(want)
