"""Queries registered with the driver, each with DuckDB SQL that computes the same rows from the tables alone: where a query renders tables to markup, parses it and works on the nodes, its SQL never sees markup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.functions import scalar
from vellumgrid.operators import corpus, resolve
from vellumgrid.sources import markup
from vellumgrid.sources.tables import load, part_tables, region_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def nodes_of(texts: DataFrame) -> DataFrame:
    return markup.parse(texts)


# --- scan, parse, count -------------------------------------------------------------------------------------------


@query("""SELECT n_regionkey::VARCHAR AS doc_id, kind, sum(n)::BIGINT AS n FROM (
  SELECT n_regionkey, 'heading' AS kind, count(*) AS n FROM nation GROUP BY 1
  UNION ALL SELECT n_regionkey, 'heading', count(DISTINCT (n_nationkey, c_mktsegment)) FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1
  UNION ALL SELECT n_regionkey, 'list', count(DISTINCT (n_nationkey, c_mktsegment)) FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1
  UNION ALL SELECT n_regionkey, 'list_item', count(*) FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1
  UNION ALL SELECT n_regionkey, 'paragraph', count(*) FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1
  UNION ALL SELECT n_regionkey, k, count(*) FROM nation, (VALUES ('paragraph'), ('math_block'), ('reference'), ('reference')) v(k) GROUP BY 1, 2) GROUP BY 1, 2""")
def block_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by kind in region texts (texts apart)."""
    return nodes_of(region_texts(spark, sf_dir)).where("kind <> 'text'").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_kind_counts(spark, sf_dir)


@query(f"""SELECT doc_id, CASE WHEN kind IN ('reference', 'text') THEN 'inline' ELSE 'block' END AS cls, kind, n FROM ({ORACLES["block_kind_counts"]}) WHERE kind NOT IN ('list_item')
UNION ALL SELECT n_regionkey::VARCHAR, 'inline', 'text', sum(n)::BIGINT FROM (SELECT n_regionkey, 4 AS n FROM nation UNION ALL SELECT n_regionkey, 1 FROM nation JOIN customer ON n_nationkey = c_nationkey
  UNION ALL SELECT DISTINCT n_regionkey, 1 FROM (SELECT n_regionkey, n_nationkey, c_mktsegment FROM nation JOIN customer ON n_nationkey = c_nationkey) WHERE false) GROUP BY 1
UNION ALL SELECT n_regionkey::VARCHAR, 'segments', 'text', count(DISTINCT (n_nationkey, c_mktsegment))::BIGINT FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1""")
def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and inlines of region texts by kind; texts of second-level headings counted apart."""
    nodes = nodes_of(region_texts(spark, sf_dir))
    second = nodes.where("kind = 'heading' AND level = 2").select("doc_id", F.col("pre").alias("parent"))
    of_second = nodes.where("kind = 'text'").join(second, ["doc_id", "parent"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("m"))
    counts = corpus.kind_counts(nodes).join(of_second, "doc_id", "left")
    text = F.col("kind") == "text"
    rest = counts.select("doc_id", "cls", "kind", F.when(text, F.col("n") - F.coalesce("m", F.lit(0))).otherwise(F.col("n")).alias("n"))
    return rest.unionByName(of_second.select("doc_id", F.lit("segments").alias("cls"), F.lit("text").alias("kind"), F.col("m").alias("n")))


@query("""WITH c AS (SELECT n_regionkey, n_nationkey, c_mktsegment, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS a FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey),
d AS (SELECT DISTINCT n_regionkey, n_nationkey, a, c_mktsegment FROM c WHERE c_mktsegment IS NOT NULL)
SELECT n_regionkey::VARCHAR AS doc_id, a || '.' AS number_text, 1 AS level FROM (SELECT DISTINCT n_regionkey, a FROM c)
UNION ALL SELECT n_regionkey::VARCHAR, a || '.' || row_number() OVER (PARTITION BY n_regionkey, n_nationkey ORDER BY c_mktsegment) || '.', 2 FROM d""")
def heading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical counters of numbered headings."""
    return resolve.heading_numbers(nodes_of(region_texts(spark, sf_dir))).select("doc_id", "number_text", "level")


@query("""SELECT p_brand AS doc_id, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey)::BIGINT AS number FROM part WHERE p_size < 10""")
def figure_numbers_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = resolve.figure_numbers(nodes_of(part_tables(spark, sf_dir)))
    return f.select("doc_id", F.substring("label", F.lit(3), F.lit(20)).cast("long").alias("p_partkey"), "number")


@query("""SELECT n_regionkey::VARCHAR AS doc_id, 'eq-' || n_nationkey AS label, '(' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || ')' AS number_text FROM nation""")
def equation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.equation_numbers(nodes_of(region_texts(spark, sf_dir))).select("doc_id", "label", "number_text")


@query("""SELECT n_regionkey::VARCHAR AS doc_id, 'nation-' || n_nationkey AS target, 'Section ' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS resolved, true AS found FROM nation
UNION ALL SELECT n_regionkey::VARCHAR, 'missing-' || n_nationkey, '@missing-' || n_nationkey, false FROM nation""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_references(nodes_of(region_texts(spark, sf_dir))).select("doc_id", "target", "resolved", "found")


@query("""SELECT n_regionkey::VARCHAR AS doc_id, 'missing-' || n_nationkey AS target FROM nation""")
def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unresolved_references(nodes_of(region_texts(spark, sf_dir))).select("doc_id", "target")


@query("""WITH p AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_brand AS doc_id, (k // 3)::BIGINT AS row_idx, (k % 3)::BIGINT AS col_idx, p_name AS text FROM p""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their place in the grid and their plain text."""
    n = nodes_of(part_tables(spark, sf_dir))
    cells = n.where("kind = 'cell'").select("doc_id", F.col("pre").alias("a"), F.col("post").alias("b"), F.col("attrs")["row"].cast("long").alias("row_idx"), F.col("attrs")["col"].cast("long").alias("col_idx"))
    t = n.where("kind = 'text'").select(F.col("doc_id").alias("d"), "pre", "post", "text", "parent")
    paragraphs = n.where("kind = 'paragraph' AND slot = 'cell'").select(F.col("doc_id").alias("d"), F.col("pre").alias("parent"), F.col("parent").alias("a"))
    # A text's paragraph and its cell are parent links: equi joins, no interval join.
    joined = t.join(paragraphs, ["d", "parent"]).select(F.col("d").alias("doc_id"), "a", "text")
    return cells.join(joined, ["doc_id", "a"]).select("doc_id", "row_idx", "col_idx", "text")


@query("""SELECT p_brand AS doc_id, least(3, count(*))::BIGINT AS columns FROM part GROUP BY 1""")
def table_max_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes_of(part_tables(spark, sf_dir)).where("kind = 'cell'")
    cells = n.select("doc_id", F.lit(0).alias("table_id"), F.col("attrs")["row"].cast("int").alias("row_idx"), F.col("attrs")["colspan"].cast("int").alias("colspan"))
    return resolve.max_columns(cells).select("doc_id", F.col("columns").cast("long").alias("columns"))


@query("""SELECT n_regionkey::VARCHAR AS doc_id, c_name AS text FROM nation JOIN customer ON n_nationkey = c_nationkey""")
def list_item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of list items: escape, parse, coalesce."""
    n = nodes_of(region_texts(spark, sf_dir))
    para = n.where("kind = 'paragraph' AND slot = 'item'").select("doc_id", F.col("pre").alias("block"))
    rows = n.where("cls = 'inline'").withColumnRenamed("parent", "block").join(para, ["doc_id", "block"], "left_semi")
    return resolve.plain_text(rows.select("doc_id", "block", "pre", "kind", "text", "attrs")).select("doc_id", "text")


@query(r"""SELECT doc_id::VARCHAR AS doc_id, regexp_replace(regexp_replace(trim(regexp_replace(text, '[\n]+', ' ', 'g'), ' '), ' +', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents WHERE trim(replace(text, chr(10), ' '), ' ') <> ''""")
def escape_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsing an escaped text gives the text again, line feeds folded to spaces."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), scalar.escape_markup(F.col("text")).alias("text"))
    n = nodes_of(d)
    rows = n.where("cls = 'inline'").select("doc_id", F.lit(0).alias("block"), "pre", "kind", "text", "attrs")
    folded = F.trim(F.regexp_replace("text", r" +", " "))
    return resolve.plain_text(rows).select("doc_id", folded.alias("text")).where("text <> ''")


# --- scalar functions ---------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, round_even(p_retailprice * 20, 0)::BIGINT AS twips, round_even(p_retailprice * 2, 0)::BIGINT AS half_points, round_even(p_retailprice * 12700, 0)::BIGINT AS emu, least(96, greatest(2, round_even(p_size / 4.0 * 8, 0)))::BIGINT AS eighths FROM part""")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_retailprice")
    return load(spark, sf_dir, "part").select("p_partkey", scalar.points_to_twips(x).alias("twips"), scalar.points_to_half_points(x).alias("half_points"), scalar.points_to_emu(x).alias("emu"), scalar.border_eighths(F.col("p_size") / 4.0).alias("eighths"))


_LENGTH_UNITS = ["pt", "in", "cm", "mm", "em", "%", "fr", ""]


@query("""SELECT l_orderkey, l_linenumber, CASE l_orderkey % 8 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity * 72.0 WHEN 2 THEN l_quantity * 72.0 / 2.54 WHEN 3 THEN l_quantity * 72.0 / 25.4 WHEN 4 THEN l_quantity * 11.0 WHEN 7 THEN l_quantity END::DOUBLE AS points FROM lineitem""")
def length_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("string"), F.get(F.array(*map(F.lit, _LENGTH_UNITS)), (F.col("l_orderkey") % 8).cast("int"))).alias("t"))
    return d.select("l_orderkey", "l_linenumber", scalar.parse_length(F.col("t")).alias("points"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.2f', p_retailprice), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END || 'pt' AS length FROM part""".replace("\\\\", "\\"))
def length_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", scalar.format_length(F.bround("p_retailprice", 2)).alias("length"))


@query(r"""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(p_name, '[^A-Za-z0-9_.:-]+', '-', 'g'), '-'), ''), 'label') AS label,
  left(CASE WHEN regexp_matches(p_name, '^[A-Za-z]') THEN regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') ELSE 'b_' || regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') END, 40) AS bookmark,
  left(regexp_replace(p_name, '[^A-Za-z0-9_]', '', 'g'), 253) AS style_id FROM part""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_name")
    return load(spark, sf_dir, "part").select("p_partkey", scalar.safe_label(x).alias("label"), scalar.safe_bookmark(x).alias("bookmark"), scalar.safe_style_id(x).alias("style_id"))


@query("""SELECT o_orderkey, ('0x' || substr(sha256(o_orderpriority || o_orderkey), 1, 7))::BIGINT AS id FROM orders""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", scalar.stable_numeric_id(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("id"))


@query("""SELECT p_partkey, CASE WHEN k <= 26 THEN chr(96 + k::INT) ELSE chr((96 + (k - 1) // 26)::INT) || chr((97 + (k - 1) % 26)::INT) END AS letters,
  CASE WHEN k <= 26 THEN chr(64 + k::INT) ELSE chr((64 + (k - 1) // 26)::INT) || chr((65 + (k - 1) % 26)::INT) END AS upper_letters FROM (SELECT p_partkey, p_partkey % 702 + 1 AS k FROM part)""")
def counter_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 702 + 1
    return load(spark, sf_dir, "part").select("p_partkey", scalar.counter(k, F.lit("a")).alias("letters"), scalar.counter(k, F.lit("A")).alias("upper_letters"))


@query("""SELECT p_partkey, (['', 'M', 'MM', 'MMM'])[k // 1000 + 1] || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[k // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[k // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[k % 10 + 1] AS roman FROM (SELECT p_partkey, p_partkey % 3999 + 1 AS k FROM part)""")
def counter_roman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", scalar.counter(F.col("p_partkey") % 3999 + 1, F.lit("I")).alias("roman"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN l_linenumber || '.' || l_suppkey WHEN 1 THEN '(' || l_linenumber || ')(' || l_suppkey || ')' WHEN 2 THEN l_linenumber || '.' || l_suppkey || '.' ELSE l_suppkey::VARCHAR END AS number_text FROM lineitem""")
def numbering_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counters through `1.1`, `(1)(1)`, `1.` and a pattern without symbols."""
    p = F.get(F.array(*map(F.lit, ["1.1", "(1)(1)", "1.", "-"])), (F.col("l_orderkey") % 4).cast("int"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.numbering(p, F.array(F.col("l_linenumber").cast("long"), "l_suppkey")).alias("number_text"))


@query("""SELECT p_partkey, upper(lpad(to_hex(p_partkey % 16777216), 6, '0')) AS colour, upper(lpad(to_hex(p_partkey % 256), 2, '0')) || '00' || upper(lpad(to_hex(p_size), 2, '0')) AS rgb FROM part""")
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex(F.col("p_partkey") % 16777216), 6, "0"))
    rgb = F.concat(F.lit("rgb("), (F.col("p_partkey") % 256).cast("string"), F.lit(", 0, "), F.col("p_size").cast("string"), F.lit(")"))
    return load(spark, sf_dir, "part").select("p_partkey", scalar.normalize_colour(F.concat(F.lit("#"), hexed)).alias("colour"), scalar.colour_value(rgb).alias("rgb"))


_FIELD_CODES = ["PAGE", "NUMPAGES \\* MERGEFORMAT", "TOC \\o", "PAGEREF a-{} \\h", "REF b_{}", 'HYPERLINK "http://x/{}"', "DATE", "UNKNOWN {}"]


@query(r"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN '#context counter(page).display()' WHEN 1 THEN '#context counter(page).final().first()' WHEN 2 THEN '#outline()'
  WHEN 3 THEN '#ref(<a-' || user_id || '>, form: "page")' WHEN 4 THEN '#link(<b_' || user_id || '>)[cached]' WHEN 5 THEN '#link("http://x/' || user_id || '")[cached]' WHEN 6 THEN 'cached' END AS markup FROM events""")
def field_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.replace(F.get(F.array(*map(F.lit, _FIELD_CODES)), (F.col("event_id") % 8).cast("int")), F.lit("{}"), F.col("user_id").cast("string"))
    return load(spark, sf_dir, "events").select("event_id", scalar.field_markup(code, F.lit("cached")).alias("markup"))


@query("""SELECT doc_id, length(text)::BIGINT AS n_chars, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT AS n_lines, sha256(text) AS sha256 FROM documents""")
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.text_stats(load(spark, sf_dir, "documents"))


@query("""SELECT p_partkey, '"' || replace(replace(p_name, '\\', '\\\\'), '"', '\\"') || '"' AS quoted, 'word/media/' || p_partkey || '.png' AS part FROM part""".replace("\\\\", "\\"))
def quoting_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.concat(F.lit("../word/./media/"), F.col("p_partkey").cast("string"), F.lit(".png"))
    return load(spark, sf_dir, "part").select("p_partkey", scalar.quote_string(F.col("p_name")).alias("quoted"), scalar.resolve_target(F.lit("word/document.xml"), target).alias("part"))


# --- windows, joins, recursion on tables --------------------------------------------------------------------------


@query("""WITH o AS (SELECT *, o_orderstatus = 'F' AS l, coalesce(o_orderstatus <> lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), true) AS c FROM orders),
g AS (SELECT *, count_if(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM o)
SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS pre, CASE WHEN o_orderstatus <> 'O' THEN dense_rank() OVER (PARTITION BY o_custkey, o_orderstatus <> 'O' ORDER BY g) END::BIGINT AS list_no FROM g""")
def list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal order status as lists; open orders break them."""
    num = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(0)
    p = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("pre"), F.lit(0).alias("level"), num.alias("num_id"))
    return resolve.list_groups(p).select("doc_id", "pre", F.col("list_no").cast("long").alias("list_no"))


@query("""WITH l AS (SELECT user_id, row_number() OVER w AS k, coalesce(event_type <> lag(event_type) OVER w, true) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, count_if(c) OVER (PARTITION BY user_id ORDER BY k) AS g FROM l)
SELECT user_id::VARCHAR AS doc_id, min(k)::BIGINT AS row_idx, count(*)::BIGINT AS rowspan FROM g GROUP BY user_id, g""")
def rowspan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a column of cells; equal event types in a row are one merged cell."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    same = F.col("event_type") == F.lag("event_type").over(w)
    cells = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.lit(0).alias("table_id"), F.row_number().over(w).alias("row_idx"), F.lit(0).alias("col_idx"), same.alias("continues"))
    return resolve.vertical_merges(cells).select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), "rowspan")


@query("""SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS section_idx, coalesce(lead(o_orderstatus) OVER w, o_orderstatus) AS section_type,
 CASE WHEN lead(o_orderkey) OVER w IS NULL THEN o_totalprice ELSE lead(o_totalprice) OVER w END AS width FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def section_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("section_idx"), F.col("o_orderstatus").alias("section_type"), F.col("o_totalprice").alias("width"))
    return resolve.section_shift(s, ["width"])


@query("""WITH s AS (SELECT 'r' || r_regionkey AS style_id, NULL AS based_on, r_name AS font, NULL::DOUBLE AS size FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, NULL, n_nationkey::DOUBLE FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, NULL, CASE WHEN c_acctbal > 0 THEN c_acctbal END FROM customer UNION ALL SELECT '__docDefaults__', NULL, 'default', 11.0)
SELECT style_id, coalesce(font, (SELECT r_name FROM region WHERE 'r' || r_regionkey = b1), (SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE 'n' || n_nationkey = b1), 'default') AS font,
 coalesce(size, (SELECT n_nationkey::DOUBLE FROM nation WHERE 'n' || n_nationkey = b1), 11.0) AS size FROM (SELECT *, based_on AS b1 FROM s)""")
def style_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer styles based on nation styles based on region styles based on document defaults."""
    none = F.lit(None)
    cols = lambda i, b, f, s: [F.lit("d").alias("doc_id"), i.alias("style_id"), b.cast("string").alias("based_on"), f.cast("string").alias("font"), s.cast("double").alias("size")]
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = load(spark, sf_dir, "region").select(*cols(key("r", "r_regionkey"), none, F.col("r_name"), none))
    s = s.unionByName(load(spark, sf_dir, "nation").select(*cols(key("n", "n_nationkey"), key("r", "n_regionkey"), none, F.col("n_nationkey"))))
    s = s.unionByName(load(spark, sf_dir, "customer").select(*cols(key("c", "c_custkey"), key("n", "c_nationkey"), none, F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))))
    s = s.unionByName(spark.range(1).select(*cols(F.lit("__docDefaults__"), none, F.lit("default"), F.lit(11.0))))
    return resolve.resolve_styles(s, ["font", "size"]).select("style_id", "font", "size")


@query("""SELECT n_regionkey::VARCHAR AS doc_id, 'n' || n_nationkey AS style_id, n_name AS font, coalesce(CASE WHEN k % 2 = 0 THEN n_nationkey END, p, l)::BIGINT AS size, true AS cyclic FROM (
  SELECT *, row_number() OVER w AS k, CASE WHEN row_number() OVER w % 2 = 1 THEN lag(n_nationkey) OVER w END AS p, CASE WHEN row_number() OVER w = 1 THEN last_value(CASE WHEN m % 2 = 0 THEN n_nationkey ELSE q END) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS l
  FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS m, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS q FROM nation) WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))""")
def style_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of a region as a ring of styles, each based on the one before it and the first on the last; every second one sets a size."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    last = F.last("n_nationkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    base = F.coalesce(F.lag("n_nationkey").over(w), last)
    s = load(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("doc_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("style_id"), F.concat(F.lit("n"), base.cast("string")).alias("based_on"), F.col("n_name").alias("font"), F.when(F.row_number().over(w) % 2 == 0, F.col("n_nationkey")).cast("long").alias("size"))
    return resolve.resolve_styles(s, ["font", "size"]).select("doc_id", "style_id", "font", "size", "cyclic")


@query("""SELECT l_orderkey::VARCHAR AS doc_id, l_linenumber AS pre, coalesce(CASE WHEN l_orderkey % 3 = 0 THEN 'upperRoman' END, CASE WHEN l_linenumber <= 4 THEN 'lowerLetter' END, 'decimal') AS num_format,
  coalesce(CASE WHEN l_orderkey % 3 = 0 THEN 7 END, CASE WHEN l_linenumber <= 4 THEN 3 END, 1)::INTEGER AS start FROM lineitem""")
def numbering_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("pre"), F.lit(1).alias("num_id"), (F.col("l_linenumber") - 1).alias("level"), "l_orderkey")
    docs = p.select("doc_id", "l_orderkey").distinct()
    inst = docs.select("doc_id", F.lit(1).alias("num_id"), F.lit(5).alias("abstract_id"))
    levels = docs.select("doc_id", F.lit(5).alias("abstract_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"), F.lit("lowerLetter").alias("num_format"), F.lit("%1)").alias("text"), F.lit(3).alias("start"))
    over = docs.where("l_orderkey % 3 = 0").select("doc_id", F.lit(1).alias("num_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("level"), F.lit("upperRoman").alias("num_format"), F.lit(None).cast("string").alias("text"), F.lit(7).alias("start_override"))
    return resolve.numbering_lookup(p, inst, levels, over).select("doc_id", "pre", "num_format", "start")


@query("""SELECT o_orderkey AS ord, o_custkey::VARCHAR AS part FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)""")
def dangling_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.lit("d").alias("doc_id"), F.col("c_custkey").cast("string").alias("name"))
    rels = load(spark, sf_dir, "orders").select(F.lit("d").alias("doc_id"), F.lit("").alias("source_part"), F.lit("r").alias("rel_id"), F.lit("t").alias("type"), F.concat(F.lit("./"), F.col("o_custkey").cast("string")).alias("target"), F.lit("Internal").alias("target_mode"), F.col("o_orderkey").alias("ord"))
    return corpus.dangling_relationships(rels, parts).select("ord", "part")


@query("""SELECT user_id::VARCHAR AS doc_id, event_type AS rel_id, max(event_id)::BIGINT AS ord FROM events GROUP BY 1, 2""")
def last_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.lit("").alias("source_part"), F.col("event_type").alias("rel_id"), F.lit("t").alias("type"), F.lit("x").alias("target"), F.lit(None).cast("string").alias("target_mode"), F.col("event_id").cast("long").alias("ord"))
    return corpus.last_relationships(r).select("doc_id", "rel_id", "ord")


@query("""SELECT p_brand AS doc_id, p_partkey::VARCHAR || '.' || (['png', 'XML', 'bin'])[p_partkey % 3 + 1] AS name, CASE WHEN p_size < 5 THEN 'special' WHEN p_partkey % 3 = 0 THEN 'image/png' WHEN p_partkey % 3 = 1 THEN 'application/xml' END AS content_type FROM part""")
def part_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    name = F.concat(F.col("p_partkey").cast("string"), F.lit("."), F.get(F.array(F.lit("png"), F.lit("XML"), F.lit("bin")), (F.col("p_partkey") % 3).cast("int")))
    parts = p.select(F.col("p_brand").alias("doc_id"), name.alias("name"), "p_size")
    types = parts.where("p_size < 5").select("doc_id", F.lit("override").alias("scope"), F.concat(F.lit("/"), "name").alias("key"), F.lit("special").alias("content_type"))
    for ext, kind in (("PNG", "image/png"), ("xml", "application/xml")):
        types = types.unionByName(p.select(F.col("p_brand").alias("doc_id"), F.lit("default").alias("scope"), F.lit(ext).alias("key"), F.lit(kind).alias("content_type")).distinct())
    return corpus.part_content_types(parts, types)


_CHANGES = "CASE event_id % 5 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' WHEN 2 THEN 'move_from' WHEN 3 THEN 'move_to' END"


@query("SELECT event_id FROM events WHERE event_id % 5 IN (0, 3, 4)")
def revision_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.apply_revisions(load(spark, sf_dir, "events").select("event_id", F.expr(_CHANGES).alias("change_type")), "accept").select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 5 IN (1, 2, 4)")
def revision_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.apply_revisions(load(spark, sf_dir, "events").select("event_id", F.expr(_CHANGES).alias("change_type")), "reject").select("event_id")


@query("""WITH e AS (SELECT *, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS c FROM events), g AS (SELECT *, count_if(c) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e)
SELECT user_id::VARCHAR AS doc_id, any_value(event_type) AS style, string_agg(event_id::VARCHAR || ' ', '' ORDER BY event_id) AS text FROM g GROUP BY user_id, g""")
def coalesce_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.lit(0).alias("block"), F.col("event_id").alias("pre"), F.concat(F.col("event_id").cast("string"), F.lit(" ")).alias("text"), F.col("event_type").alias("style"))
    return resolve.coalesce_runs(r).select("doc_id", "style", "text")


@query("""SELECT * FROM part WHERE lower(p_brand) = lower('brand#1') AND lower(concat_ws(' ', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)) LIKE '%3%'
UNION ALL SELECT * FROM part WHERE lower(p_brand) <> lower('brand#1') AND lower(concat_ws(' ', p_name, p_brand, p_type)) LIKE '%steel%'""")
def matrix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    texts = p.select("p_partkey", "p_name", "p_brand", "p_type")
    hits = corpus.search(texts, query="STEEL").where(F.lower("p_brand") != "brand#1").select("p_partkey")
    own = corpus.search(p, "Brand#1", "3", "p_brand")
    return own.unionByName(p.join(hits, "p_partkey", "left_semi"))


@query("""SELECT user_id::VARCHAR AS doc_id, event_id // 10 AS parent_id FROM (
  SELECT *, event_type < lag(event_type) OVER (PARTITION BY user_id, event_id // 10 ORDER BY event_id) AS bad FROM events) GROUP BY 1, 2 HAVING bool_or(coalesce(bad, false))""")
def child_order_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events, ten numbers at a time, as children; types have to come in alphabetical order."""
    e = load(spark, sf_dir, "events")
    children = e.select(F.col("user_id").cast("string").alias("doc_id"), F.lit("p").alias("part"), F.floor(F.col("event_id") / 10).alias("parent_id"), F.lit("pPr").alias("parent_name"), F.col("event_id").alias("ord"), F.col("event_type").alias("child"))
    types = e.select(F.col("event_type").alias("child")).distinct()
    order = types.select(F.lit("pPr").alias("parent_name"), "child", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("child")).alias("rank"))
    return corpus.child_order_errors(children, order).select("doc_id", "parent_id")


@query("""SELECT p_brand AS doc_id, family, string_agg(DISTINCT v, ',' ORDER BY v) AS variants FROM (SELECT p_brand, unnest([p_type, 'size ' || p_size]) AS family, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'boldItalic' WHEN p_size % 2 = 0 THEN 'bold' WHEN p_size % 3 = 0 THEN 'italic' ELSE 'regular' END AS v FROM part) GROUP BY 1, 2""")
def used_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = load(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), (F.col("p_size") % 2 == 0).alias("bold"), (F.col("p_size") % 3 == 0).alias("italic"), F.col("p_type").alias("ascii"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("east"))
    return corpus.used_fonts(runs, ["ascii", "east"]).select("doc_id", "family", F.array_join("variants", ",").alias("variants"))


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id, sha256(text) AS checksum FROM documents""")
def distinct_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.lit("corpus").alias("doc_id"), F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("data"))
    return corpus.distinct_resources(d).select(F.col("id").alias("doc_id"), "canonical_id", "checksum")


@query("""SELECT source AS doc_id, sha256(unhex(string_agg(hex(doc_id::VARCHAR::BLOB) || '00' || sha256(text), '' ORDER BY doc_id::VARCHAR))) AS digest FROM documents GROUP BY 1""")
def package_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as packages, documents as their parts: the ordered fold of names and part digests."""
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("data"))
    return corpus.package_digest(d)


@query("""SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS pre, (o_orderkey % 7)::VARCHAR || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END AS unique_key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 ORDER BY o_orderkey) AS rn FROM orders)""")
def suffix_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("pre"), (F.col("o_orderkey") % 7).cast("string").alias("key"))
    return resolve.suffix_keys(r).select("doc_id", "pre", F.col("unique").alias("unique_key"))


@query("""SELECT l_orderkey::VARCHAR AS doc_id, (l_linenumber + r)::INTEGER AS r, c::INTEGER AS c, l_linenumber AS origin_row FROM lineitem, unnest(range(0, (l_suppkey % 2 + 1)::BIGINT)) a(r), unnest(range(0, (l_partkey % 3 + 1)::BIGINT)) b(c)""")
def grid_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("table_id"), F.col("l_linenumber").alias("row_idx"), F.lit(0).alias("col_idx"), (F.col("l_partkey") % 3 + 1).cast("int").alias("colspan"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("rowspan"))
    return resolve.grid_occupancy(cells).select("doc_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "origin_row")


@query("""SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS pre FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE o_orderstatus = 'F' AND p = 'F'""")
def table_spacers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "table").otherwise("paragraph")
    b = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit(0).alias("parent"), F.lit("body").alias("slot"), F.col("o_orderkey").alias("pre"), kind.alias("kind"))
    return resolve.table_spacers(b).select("doc_id", "pre")


@query("""SELECT c_mktsegment AS value, 'to_package' AS direction, 'fidelity' AS measure, count(*)::BIGINT AS n FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'to_markup', 'fidelity', count(*) FROM customer GROUP BY 1
UNION ALL SELECT CASE WHEN c_acctbal > 0 THEN 'full' ELSE 'none' END, d, 'implementation', count(*) FROM customer, (VALUES ('to_package'), ('to_markup')) v(d) GROUP BY 1, 2""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    impl = F.when(F.col("c_acctbal") > 0, "full").otherwise("none")
    m = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("to_package"), F.col("c_mktsegment").alias("to_markup"), impl.alias("implementation_to_package"), impl.alias("implementation_to_markup"))
    return corpus.coverage_counts(m)


from vellumgrid import package_queries  # noqa: E402, F401  (registers its own)
