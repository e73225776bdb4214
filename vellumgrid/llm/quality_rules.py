"""Quality rules as a bitmask ledger, in built-in expressions only.

ledger() measures every text once and evaluates every rule once: a rule that fails sets its bit in `fail_bits`. A
policy is a named, versioned set of rules, i.e. a mask over these bits; apply_policy() and ablations() work on the
ledger alone, so a policy can change without reading a text again.

Defined results: a null or blank text has no words and fails `few_words`; a text of any length is measured whole;
repeated rows are measured alike; an empty table gives an empty ledger (its ablations hold zero counts); columns
other than the key and the text are not read, so extra or clashing columns do no harm. Windows are compared by a hash of
64 bits: two different ones in a text count as one with a probability of 2^-64 a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm._shared import table, words

WINDOW = 8

#: name -> condition under which a text fails; the bit of a rule is its place in this list, which only grows.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("many_words", "n_words > 1000000"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("short_or_long_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines and n_lines >= 4"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
    ("letterless_words", "100 * n_letterless > 40 * n_words"),
    ("bullet_lines", "100 * n_bullet_lines > 90 * n_lines and n_lines >= 4"),
    ("ellipsis_lines", "100 * n_ellipsis_lines > 30 * n_lines and n_lines >= 4"),
]
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: (policy, version) -> rules; a text is kept if it fails none of them.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeated_words"),
    ("web", 1): ("few_words", "many_words", "repeated_words", "short_or_long_words", "symbols", "duplicate_lines"),
    ("web", 2): tuple(BITS),
}
CURRENT = ("web", 2)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letterless", "n_bullet_lines", "n_ellipsis_lines"]


def mask(policy: tuple[str, int] = CURRENT) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def measures(text: Column, df: DataFrame) -> DataFrame:
    """df with the columns MEASURES of text."""
    df = df.withColumn("_text", F.coalesce(text.cast("string"), F.lit("")))
    df = df.withColumn("_words", words(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.trim(F.translate(x, "\t\n\x0b\x0c\r", "     ")) != ""))
    # A window's hash chains over its words, so that word bounds count.
    df = df.withColumn("_win", F.expr(f"CASE WHEN size(_words) < {WINDOW} THEN cast(array() AS array<bigint>) ELSE transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))) END"))
    df = df.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_win)) < size(_win) THEN array_sort(transform(_win, (h, i) -> struct(h AS h, i AS i))) END"))
    # Places of windows equal to their neighbour in the sorted order, in the text's order.
    df = df.withColumn("_hits", F.expr("array_sort(transform(filter(transform(_sorted, (x, k) -> struct(x.i AS i, (k > 0 AND _sorted[k - 1].h = x.h) OR (k + 1 < size(_sorted) AND _sorted[k + 1].h = x.h) AS dup)), x -> x.dup), x -> x.i))"))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn("n_repeat_words", F.expr(f"coalesce(aggregate(_hits, struct(0L AS n, -{WINDOW} AS last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last), a -> a.n), 0L)"))
    df = df.withColumn("n_lines", F.size("_lines").cast("long"))
    df = df.withColumn("n_capitals", F.regexp_count("_text", F.lit("[A-Z]")).cast("long"))
    df = df.withColumn("n_letterless", F.expr("cast(size(filter(_words, w -> NOT w RLIKE '\\\\p{L}')) AS bigint)"))
    df = df.withColumn("n_bullet_lines", F.expr("cast(size(filter(_lines, l -> l RLIKE '^[ \\\\t]*[-*+•]')) AS bigint)"))
    df = df.withColumn("n_ellipsis_lines", F.expr("cast(size(filter(_lines, l -> l RLIKE '(\\\\.\\\\.\\\\.|…)[ \\\\t\\\\r]*$')) AS bigint)"))
    return df.drop("_text", "_words", "_lines", "_win", "_sorted", "_hits")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measures, fail_bits): every rule of RULES evaluated once for every row."""
    found = measures(F.col("_t"), docs.select(F.col(key), F.col(text).alias("_t"))).drop("_t")
    bits = [f"CASE WHEN {condition} THEN {BITS[name]}L ELSE 0L END" for name, condition in RULES]
    return found.withColumn("fail_bits", F.expr(" | ".join(f"({x})" for x in bits)))


def apply_policy(rows: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """rows of a ledger with `kept`: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """For each rule of the policy: rows failing it, rows failing it alone (kept if it were dropped), and rows kept without it. One pass over the ledger's bits."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    names = POLICIES[policy]
    counts = [F.count_if(hit == 0).alias("kept")]
    for name in names:
        counts += [F.count_if(hit.bitwiseAND(F.lit(BITS[name])) != 0).alias(f"f_{name}"), F.count_if(hit == BITS[name]).alias(f"o_{name}")]
    one = rows.agg(*counts)
    stack = ", ".join(f"'{n}', f_{n}, o_{n}, kept + o_{n}" for n in names)
    return one.selectExpr(f"stack({len(names)}, {stack}) AS (rule, n_failed, n_failed_only, n_kept_without)")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(("base", 1)))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "fail_bits")


def _oracle() -> str:
    ws = r"[^\x20\x09-\x0D]+"
    cond = " + ".join(f"(CASE WHEN {c} THEN {BITS[n]} ELSE 0 END)" for n, c in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{ws}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{ws}')) AS ls FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}),
g AS (SELECT p.r, p.i, ws[p.i:p.i + {WINDOW - 1}] AS win FROM p JOIN w USING (r)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g),
c AS (SELECT r, sum(least({WINDOW}, i - last))::BIGINT AS n_repeat_words FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -100) AS last FROM h WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
  len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals, len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letterless,
  len(list_filter(ls, lambda l: regexp_matches(l, '^[ \t]*[-*+•]')))::BIGINT AS n_bullet_lines,
  len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[ \t\r]*$')))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, ({cond})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {mask(("base", 1))}) <> 0 AS base_failed,
  (fail_bits & {mask(("base", 1)) | mask()}) = 0 AS kept, fail_bits FROM b"""


ORACLE = _oracle()
