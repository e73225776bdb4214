"""More registered queries, each with DuckDB SQL: tables rendered to markup, written as packages and read back, and operators over rows of the tables. The SQL sees neither markup nor packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.functions import scalar
from vellumgrid.operators import corpus, resolve, sinks
from vellumgrid.plans import convert
from vellumgrid.queries import ORACLES, query
from vellumgrid.sources import docx, markup
from vellumgrid.sources.tables import load, part_tables, region_texts


def packaged(texts: DataFrame) -> DataFrame:
    return sinks.to_packages(markup.parse(texts))


def reread(texts: DataFrame) -> DataFrame:
    """The nodes of texts after a way through packages."""
    return docx.parse(packaged(texts))


def text_of(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, block, text) of blocks (doc_id, block: their pre)."""
    rows = nodes.where("cls = 'inline'").withColumnRenamed("parent", "block").join(blocks.select("doc_id", "block"), ["doc_id", "block"], "left_semi")
    return resolve.plain_text(rows.select("doc_id", "block", "pre", "kind", "text", "attrs"))


def _string(c: str):
    return F.col(c).cast("string")


# --- through packages ---------------------------------------------------------------------------------------------

_SEGMENTS = "SELECT DISTINCT n_regionkey, n_nationkey, c_mktsegment FROM nation JOIN customer ON n_nationkey = c_nationkey"


@query(f"""SELECT n_regionkey::VARCHAR AS doc_id, 1 AS level, 'nation-' || n_nationkey AS label, n_name AS text FROM nation
UNION ALL SELECT n_regionkey::VARCHAR, 2, NULL, c_mktsegment FROM ({_SEGMENTS})""")
def package_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with levels, labels and texts after a way through packages."""
    n = reread(region_texts(spark, sf_dir))
    heads = n.where("kind = 'heading'").select("doc_id", F.col("pre").alias("block"), "level", "label")
    return heads.join(text_of(n, heads), ["doc_id", "block"]).select("doc_id", "level", "label", "text")


@query(ORACLES["list_item_texts"])
def package_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = reread(region_texts(spark, sf_dir))
    return text_of(n, n.where("kind = 'paragraph' AND slot = 'item'").select("doc_id", F.col("pre").alias("block"))).select("doc_id", "text")


@query(f"""WITH s AS ({_SEGMENTS}) SELECT n_regionkey::VARCHAR AS doc_id, kind, sum(n)::BIGINT AS n FROM (
  SELECT n_regionkey, unnest(['heading', 'math_block', 'field', 'field', 'paragraph']) AS kind, 1 AS n FROM nation UNION ALL SELECT n_regionkey, unnest(['heading', 'list']), 1 FROM s
  UNION ALL SELECT n_regionkey, unnest(['list_item', 'paragraph']), 1 FROM nation JOIN customer ON n_nationkey = c_nationkey) GROUP BY 1, 2""")
def package_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of nodes after a way through packages, where references are fields."""
    return reread(region_texts(spark, sf_dir)).where("kind <> 'text' AND kind <> 'bookmark' AND kind <> 'section'").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(f"""SELECT n_regionkey::VARCHAR AS doc_id, '$ ' || 'x_' || n_nationkey || ' = 1' || ' $' AS shown FROM nation""")
def package_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = reread(region_texts(spark, sf_dir)).where("kind = 'math_block'")
    return n.select("doc_id", F.concat(F.lit("$ "), F.regexp_replace(F.regexp_replace("text", r"\s+", ""), "=", " = "), F.lit(" $")).alias("shown"))


_PARTS = {
    "[Content_Types].xml": None, "_rels/.rels": "application/vnd.openxmlformats-package.relationships+xml", "docProps/app.xml": "application/vnd.openxmlformats-officedocument.extended-properties+xml",
    "docProps/core.xml": "application/vnd.openxmlformats-package.core-properties+xml", "word/_rels/document.xml.rels": "application/vnd.openxmlformats-package.relationships+xml",
    **{f"word/{n}.xml": f"application/vnd.openxmlformats-officedocument.wordprocessingml.{k}+xml" for n, k in (("document", "document.main"), ("fontTable", "fontTable"), ("numbering", "numbering"), ("settings", "settings"), ("styles", "styles"))},
    "word/theme/theme1.xml": "application/vnd.openxmlformats-officedocument.theme+xml",
}
_PART_ROWS = ", ".join(f"('{n}', {'NULL' if n[0] == '[' else repr(k)})" for n, k in _PARTS.items())


@query(f"SELECT r_regionkey::VARCHAR AS doc_id, name, CASE WHEN name = '[Content_Types].xml' THEN 'application/xml' ELSE kind END AS content_type FROM region, (VALUES {_PART_ROWS}) v(name, kind)")
def package_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of the packages with its content type."""
    p = packaged(region_texts(spark, sf_dir))
    return corpus.part_content_types(docx.parts(p), docx.content_types(p))


@query("""SELECT r_regionkey::VARCHAR AS doc_id, name FROM region, (VALUES ('word/_rels/document.xml.rels'), ('word/document.xml'), ('word/fontTable.xml'), ('word/numbering.xml'), ('word/settings.xml'), ('word/styles.xml'), ('word/theme/theme1.xml')) v(name)""")
def package_part_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.list_parts(docx.parts(packaged(region_texts(spark, sf_dir))), "word/")


@query("""SELECT r_regionkey::VARCHAR AS doc_id, 'word/document.xml' AS part, 5::BIGINT AS n_targets, 0::BIGINT AS n_external FROM region""")
def package_main_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = docx.relationships(packaged(region_texts(spark, sf_dir)))
    own = corpus.relationship_targets(r.where("source_part = 'word/document.xml'")).groupBy("doc_id").agg(F.count("part").alias("n_targets"), F.count_if("external").alias("n_external"))
    return corpus.main_part(r).join(own, "doc_id")


@query("""SELECT r_regionkey::VARCHAR AS doc_id, true AS valid, '' AS errors, '' AS warnings FROM region""")
def package_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written packages pass every check."""
    v = convert.validate(packaged(region_texts(spark, sf_dir)))
    return v.select("doc_id", "valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(f"""SELECT n_regionkey::VARCHAR AS doc_id, scope, CASE scope WHEN 'level' THEN 9 * n ELSE n END::BIGINT AS n, CASE scope WHEN 'level' THEN 'bullet' END AS num_format FROM (SELECT n_regionkey, count(*) AS n FROM ({_SEGMENTS}) GROUP BY 1), (VALUES ('level'), ('instance')) v(scope)""")
def package_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docx.numbering(packaged(region_texts(spark, sf_dir))).groupBy("doc_id", "scope").agg(F.count("*").alias("n"), F.max("num_format").alias("num_format"))


@query("""SELECT r_regionkey::VARCHAR AS doc_id, style_id, name, based_on, outline, font FROM region, (VALUES ('__docDefaults__', NULL, NULL, NULL, 'Calibri'), ('Normal', 'Normal', NULL, NULL, NULL), ('Title', 'Title', 'Normal', NULL, NULL), ('Quote', 'Quote', 'Normal', NULL, NULL), ('Caption', 'caption', 'Normal', NULL, NULL), ('Code', 'Code', 'Normal', NULL, 'Consolas')) v(style_id, name, based_on, outline, font)
UNION ALL SELECT r_regionkey::VARCHAR, 'Heading' || k, 'heading ' || k, 'Normal', (k - 1)::VARCHAR, NULL FROM region, range(1, 10) t(k)""")
def package_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = docx.styles(packaged(region_texts(spark, sf_dir)))
    return s.select("doc_id", "style_id", "name", "based_on", F.col("paragraph")["outline"].alias("outline"), F.col("text")["font"].alias("font"))


@query("""SELECT n_regionkey::VARCHAR AS doc_id, 'Heading1' AS style_id, '0' AS outline, 'Calibri' AS font, count(*)::BIGINT AS n FROM nation GROUP BY 1""")
def package_effective_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-level headings and their texts with what they inherit from styles and defaults."""
    p = packaged(region_texts(spark, sf_dir))
    n = resolve.styled(docx.parse(p), docx.styles(p))
    heads = n.where("kind = 'heading' AND level = 1").select("doc_id", F.col("pre").alias("parent"), F.col("style")["style_id"].alias("style_id"), F.col("effective")["outline"].alias("outline"))
    texts = n.where("kind = 'text'").select("doc_id", "parent", F.col("effective")["font"].alias("font"))
    return heads.join(texts, ["doc_id", "parent"]).groupBy("doc_id", "style_id", "outline", "font").agg(F.count("*").alias("n"))


@query("""SELECT r_regionkey::VARCHAR AS doc_id, kind || slot AS slot, 'Calibri' AS family FROM region, (VALUES ('major'), ('minor')) k(kind), (VALUES ('Ascii'), ('HAnsi')) s(slot)""")
def package_theme_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docx.theme_fonts(packaged(region_texts(spark, sf_dir)))


@query(ORACLES["table_cells"])
def package_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables after a way through packages."""
    n = reread(part_tables(spark, sf_dir))
    cells = n.where("kind = 'cell'").select("doc_id", F.col("pre").alias("cell"), F.col("attrs")["row"].cast("long").alias("row_idx"), F.col("attrs")["col"].cast("long").alias("col_idx"))
    paragraphs = n.where("kind = 'paragraph' AND slot = 'cell'").select("doc_id", F.col("pre").alias("block"), F.col("parent").alias("cell"))
    return cells.join(paragraphs, ["doc_id", "cell"]).join(text_of(n, paragraphs), ["doc_id", "block"]).select("doc_id", "row_idx", "col_idx", "text")


@query(ORACLES["block_kind_counts"])
def markup_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of nodes after nodes are written as markup and parsed again."""
    texts = sinks.to_markup(markup.parse(region_texts(spark, sf_dir)).where("kind <> 'x'"))
    return markup.parse(texts).where("kind <> 'text'").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT p_partkey::VARCHAR AS doc_id, p_name AS text FROM part")
def exact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts come back from packages as they were, by the counterpart that the package holds."""
    d = load(spark, sf_dir, "part").select(_string("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return convert.packages_to_texts(convert.texts_to_packages(d), "exact")


@query("SELECT p_partkey::VARCHAR AS doc_id, p_name AS text, 'paragraph,text' AS kinds FROM part")
def node_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "part").select(_string("p_partkey").alias("doc_id"), scalar.escape_markup(F.col("p_name")).alias("text"))
    rows = F.from_json("json", "array<struct<pre: int, kind: string, text: string>>")
    return sinks.to_json(markup.parse(d)).select("doc_id", F.array_join(F.transform(rows, lambda r: F.coalesce(r["text"], F.lit(""))), "").alias("text"), F.array_join(F.transform(rows, lambda r: r["kind"]), ",").alias("kinds"))


def supplier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): for each nation a titled text; for each supplier of it, in the order of keys, a section of its own width with a centred line that has a link and a footnote, a list numbered by letters, a quote and a piece of code."""
    s = load(spark, sf_dir, "supplier")
    k, name = _string("s_suppkey"), scalar.escape_markup(F.col("s_name"))
    part = F.concat(
        F.lit("#set page(width: "), (F.col("s_suppkey") % 90 + 300).cast("string"), F.lit('pt, margin: 36pt)\n\n#align(center)[#link("http://x/'), k, F.lit('")['), name, F.lit("]#footnote[Note "), k, F.lit("]]\n\n#[#set enum(numbering: \"a)\")\n+ one "), k, F.lit("\n+ two\n]\n\n#quote(block: true)[Said "), k,
        F.lit("\n\n- inside]\n\n```py\nx = "), k, F.lit('\n\ny = 2\n```\n\n#text(font: "Font '), (F.col("s_suppkey") % 3).cast("string"), F.lit('")[set]\n\n'),
    )
    docs = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", part.alias("t")))), lambda x: x["t"]), "").alias("t"))
    head = F.concat(F.lit('#set document(title: "Nation '), _string("s_nationkey"), F.lit('", author: "A")\n\nFirst.\n\n'))
    return docs.select(_string("s_nationkey").alias("doc_id"), F.concat(head, "t").alias("text"))


_SUPPLIERS = "SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier"


@query(f"""SELECT s_nationkey::VARCHAR AS doc_id, k AS section_no, (s_suppkey % 90 + 300) || 'pt' AS width, '36pt' AS margin_top FROM ({_SUPPLIERS}) UNION ALL SELECT DISTINCT s_nationkey::VARCHAR, 0, '595.3pt', '72pt' FROM supplier""")
def package_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rules between blocks are sections, each with its own size, after a way through packages."""
    n = reread(supplier_texts(spark, sf_dir)).where("kind = 'section'")
    return n.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1).cast("long").alias("section_no"), F.col("attrs")["width"].alias("width"), F.col("attrs")["margin_top"].alias("margin_top"))


@query(f"SELECT s_nationkey::VARCHAR AS doc_id, k::VARCHAR AS note_id, 'Note ' || s_suppkey AS text FROM ({_SUPPLIERS})")
def package_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = reread(supplier_texts(spark, sf_dir))
    notes = n.where("kind = 'note'").select("doc_id", F.col("pre").alias("note"), F.col("attrs")["note_id"].alias("note_id"))
    blocks = n.where("slot = 'note' AND kind = 'paragraph'").select("doc_id", F.col("pre").alias("block"), F.col("parent").alias("note"))
    return notes.join(blocks, ["doc_id", "note"]).join(text_of(n, blocks), ["doc_id", "block"]).select("doc_id", "note_id", "text")


@query("SELECT s_nationkey::VARCHAR AS doc_id, 'http://x/' || s_suppkey AS target, 'center' AS align, s_name AS text FROM supplier")
def package_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with their targets, texts and the alignment of their paragraphs."""
    n = reread(supplier_texts(spark, sf_dir))
    links = n.where("kind = 'link'").select("doc_id", F.col("pre").alias("block"), F.col("parent").alias("p"), F.col("attrs")["target"].alias("target"))
    paragraphs = n.where("kind = 'paragraph'").select("doc_id", F.col("pre").alias("p"), F.col("style")["align"].alias("align"))
    return links.join(paragraphs, ["doc_id", "p"]).join(text_of(n, links), ["doc_id", "block"]).select("doc_id", "target", "align", "text")


@query(f"""SELECT s_nationkey::VARCHAR AS doc_id, 'decimal' AS format, 'a)' AS numbering, 2::BIGINT AS items FROM supplier UNION ALL SELECT s_nationkey::VARCHAR, 'bullet', NULL, 1 FROM supplier""")
def package_list_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with their formats and numbering patterns; a list within a quote is one, too."""
    n = reread(supplier_texts(spark, sf_dir))
    items = n.where("kind = 'list_item'").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.count("*").alias("items"))
    return n.where("kind = 'list'").select("doc_id", "pre", F.col("attrs")["format"].alias("format"), "numbering").join(items, ["doc_id", "pre"]).drop("pre")


@query("""SELECT s_nationkey::VARCHAR AS doc_id, 'code' AS kind, 'x = ' || s_suppkey || chr(10) || chr(10) || 'y = 2' AS text FROM supplier UNION ALL SELECT s_nationkey::VARCHAR, 'quote', 'Said ' || s_suppkey FROM supplier""")
def package_quotes_and_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = reread(supplier_texts(spark, sf_dir))
    said = n.where("slot = 'quote' AND kind = 'paragraph'").select("doc_id", F.col("pre").alias("block"))
    return n.where("kind = 'code'").select("doc_id", "kind", "text").unionByName(text_of(n, said).select("doc_id", F.lit("quote").alias("kind"), "text"))


@query("""SELECT DISTINCT s_nationkey::VARCHAR AS doc_id, name, CASE name WHEN 'title' THEN 'Nation ' || s_nationkey ELSE 'A' END AS value FROM supplier, (VALUES ('title'), ('creator')) v(name)""")
def package_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docx.metadata(packaged(supplier_texts(spark, sf_dir))).where("scope = 'core'").select("doc_id", "name", "value")


@query("""SELECT s_nationkey::VARCHAR AS doc_id, string_agg(DISTINCT f, ',' ORDER BY f) AS families FROM (SELECT s_nationkey, 'Font ' || (s_suppkey % 3) AS f FROM supplier UNION ALL SELECT s_nationkey, unnest(['Calibri', 'Consolas']) FROM supplier) GROUP BY 1""")
def writer_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.writer_fonts(markup.parse(supplier_texts(spark, sf_dir))).select("doc_id", F.array_join("families", ",").alias("families"))


@query("""SELECT DISTINCT s_nationkey::VARCHAR AS doc_id, true AS valid, '' AS errors FROM supplier""")
def package_validation_of_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.validate(packaged(supplier_texts(spark, sf_dir))).select("doc_id", "valid", F.array_join("errors", "; ").alias("errors"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows: each user's events as one paragraph of tracked changes, a text within each."""
    e = load(spark, sf_dir, "events").select(_string("user_id").alias("doc_id"), "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).alias("k"))
    kind = F.get(F.array(*map(F.lit, ["insert", "delete", "move_from", "move_to"])), (F.col("event_id") % 4).cast("int"))
    none, empty = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")

    def rows(df: DataFrame, pre, parent, depth, at, slot, cls, kind, text, attrs) -> DataFrame:
        whole = [pre.alias("pre"), F.lit(0).alias("post"), parent.alias("parent"), F.lit(depth).alias("depth"), at.alias("ord")]
        return df.select("doc_id", *[c.cast("int") for c in whole], F.lit(slot).alias("slot"), F.lit(cls).alias("cls"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(None).cast("int").alias("level"), none.alias("label"), none.alias("numbering"), none.alias("supplement"), attrs.alias("attrs"), empty.alias("style"))

    one = F.lit(0)
    out = rows(e.select("doc_id").distinct(), one, F.lit(None), 0, one, "body", "block", "paragraph", none, empty)
    out = out.unionByName(rows(e, 2 * F.col("k") - 1, one, 1, F.col("k"), "inline", "inline", "change", none, F.create_map(F.lit("type"), kind, F.lit("author"), F.lit("a"))))
    return out.unionByName(rows(e, 2 * F.col("k"), 2 * F.col("k") - 1, 2, one, "inline", "inline", "text", F.concat(_string("event_id"), F.lit(" ")), empty))


@query("SELECT user_id::VARCHAR AS doc_id, string_agg(event_id || ' ', '' ORDER BY event_id) AS text FROM events WHERE event_id % 4 IN (0, 3) GROUP BY 1")
def writer_accepts_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer that doesn't keep changes writes what they insert and moves here."""
    n = docx.parse(sinks.to_packages(_changes(spark, sf_dir), revisions="accept"))
    return resolve.plain_text(n.where("cls = 'inline'").select("doc_id", F.lit(0).alias("block"), "pre", "kind", "text", "attrs")).select("doc_id", "text")


@query("SELECT user_id::VARCHAR AS doc_id, (['insert', 'delete', 'move_from', 'move_to'])[event_id % 4 + 1] AS type, event_id || ' ' AS text FROM events")
def package_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes kept through packages, deleted texts among them."""
    n = docx.parse(sinks.to_packages(_changes(spark, sf_dir)))
    changes = n.where("kind = 'change'").select("doc_id", F.col("pre").alias("parent"), F.col("attrs")["type"].alias("type"))
    return changes.join(n.where("kind = 'text'").select("doc_id", "parent", "text"), ["doc_id", "parent"]).drop("parent")


@query("SELECT user_id::VARCHAR AS doc_id, string_agg(event_id || ' ', '' ORDER BY event_id) AS text FROM events WHERE event_id % 4 IN (1, 2) GROUP BY 1")
def reader_rejects_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = docx.parse(sinks.to_packages(_changes(spark, sf_dir)), revisions="reject")
    return resolve.plain_text(n.where("cls = 'inline'").select("doc_id", F.lit(0).alias("block"), "pre", "kind", "text", "attrs")).select("doc_id", "text")


# --- parsing ------------------------------------------------------------------------------------------------------


@query("""SELECT n_regionkey::VARCHAR AS doc_id, 0 AS level, n_name AS text FROM nation UNION ALL SELECT n_regionkey::VARCHAR, 1, c_name FROM nation JOIN customer ON n_nationkey = c_nationkey UNION ALL SELECT n_regionkey::VARCHAR, 2, c_mktsegment FROM nation JOIN customer ON n_nationkey = c_nationkey""")
def nested_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists three levels deep: nations, their customers, and a numbered item for the segment of each."""
    c = load(spark, sf_dir, "customer").withColumn("t", F.concat(F.lit("  - "), scalar.escape_markup(F.col("c_name")), F.lit("\n    + "), "c_mktsegment", F.lit("\n")))
    c = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "t"))), lambda x: x["t"]), "").alias("t"))
    n = load(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumn("t", F.concat(F.lit("- "), scalar.escape_markup(F.col("n_name")), F.lit("\n"), F.coalesce("t", F.lit(""))))
    d = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "t"))), lambda x: x["t"]), "").alias("text"))
    nodes = markup.parse(d.select(_string("n_regionkey").alias("doc_id"), "text"))
    items = nodes.where("kind = 'list_item'").select("doc_id", F.col("pre").alias("parent"), "level")
    blocks = nodes.where("kind = 'paragraph' AND slot = 'item'").select("doc_id", F.col("pre").alias("block"), "parent")
    return items.join(blocks, ["doc_id", "parent"]).join(text_of(nodes, blocks), ["doc_id", "block"]).select("doc_id", "level", "text")


@query("""SELECT p_partkey::VARCHAR AS doc_id, k = 0 AS has_raw, k = 1 AS has_field, false AS has_change, false AS has_comment, k = 2 AS has_citation, false AS has_control, k = 3 AS has_bibliography FROM (SELECT p_partkey, p_partkey % 5 AS k FROM part)""".replace("k = 1 AS", "k IN (1, 3) AS"))
def feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["#unknown(1)", "#outline()", 'See #cite(label("k")).', '#bibliography("x.bib")', "plain"]
    d = load(spark, sf_dir, "part").select(_string("p_partkey").alias("doc_id"), F.get(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 5).cast("int")).alias("text"))
    return corpus.feature_flags(markup.parse(d))


@query("""SELECT n_nationkey::VARCHAR || '.typ' AS doc_id, CASE WHEN n_nationkey % 4 = 3 THEN 'gone' ELSE 'heading' END AS found, CASE WHEN n_nationkey % 4 = 3 THEN 'include not found: none.typ' ELSE 'R ' || n_regionkey END AS text FROM nation
UNION ALL SELECT 'r' || r_regionkey || '.typ', 'heading', 'R ' || r_regionkey FROM region""")
def included_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations include their region's file; every fourth names one that isn't there."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    target = F.when(F.col("n_nationkey") % 4 == 3, "none.typ").otherwise(F.concat(F.lit("r"), _string("n_regionkey"), F.lit(".typ")))
    files = n.select(F.concat(_string("n_nationkey"), F.lit(".typ")).alias("doc_id"), F.concat(F.lit('#include "'), target, F.lit('"\n')).alias("text"))
    files = files.unionByName(r.select(F.concat(F.lit("r"), _string("r_regionkey"), F.lit(".typ")).alias("doc_id"), F.concat(F.lit("= R "), _string("r_regionkey"), F.lit("\n")).alias("text")))
    nodes = markup.parse_with_includes(files)
    heads = nodes.where("kind = 'heading'").select("doc_id", F.col("pre").alias("block"))
    return text_of(nodes, heads).select("doc_id", F.lit("heading").alias("found"), "text").unionByName(nodes.where("kind = 'warning'").select("doc_id", F.lit("gone").alias("found"), "text"))


# --- operators over rows ------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS pre, CASE WHEN k % 2 = 1 THEN 1 ELSE k // 2 + 1 END::BIGINT AS list_no, CASE WHEN k % 2 = 0 THEN p END AS parent_pre FROM o""")
def nested_list_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second order hangs in a list of its own below the one before."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    p = load(spark, sf_dir, "orders").select(_string("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pre"), ((k + 1) % 2).alias("level"), F.lit(1).alias("num_id"))
    return resolve.nested_lists(p)


@query("""SELECT user_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS field_no, 1::BIGINT AS depth, event_type AS code, event_id::VARCHAR AS result FROM events""")
def field_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(_string("user_id").alias("doc_id"), "event_id", "event_type")
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("event"), t.cast("string").alias("text")) for k, (v, t) in enumerate([("begin", F.lit(None)), ("text", F.concat(F.lit(" "), "event_type")), ("separate", F.lit(None)), ("text", F.col("event_id")), ("end", F.lit(None)), ("text", F.lit("outside"))])])
    return resolve.field_spans(e.select("doc_id", "event_id", F.explode(steps).alias("s")).select("doc_id", (F.col("event_id") * 10 + F.col("s.k")).alias("pos"), "s.event", "s.text"))


@query("""WITH m AS (SELECT user_id, event_id // 2 AS mark_id, event_id % 2 AS e, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 6 = 0 THEN '_h' ELSE 'b' || event_id END END AS name FROM events),
n AS (SELECT m.*, coalesce(name, (SELECT any_value(s.name) FROM m s WHERE s.user_id = m.user_id AND s.mark_id = m.mark_id AND s.e = 0), mark_id::VARCHAR) AS shown FROM m)
SELECT user_id::VARCHAR AS doc_id, mark_id, CASE e WHEN 0 THEN 'start' ELSE 'end' END AS type, shown AS name FROM n WHERE shown NOT LIKE '\\_%' ESCAPE '\\'""".replace("\\\\", "\\"))
def bookmark_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, even = load(spark, sf_dir, "events"), F.col("event_id") % 2 == 0
    name = F.when(even, F.when(F.col("event_id") % 6 == 0, "_h").otherwise(F.concat(F.lit("b"), _string("event_id"))))
    m = e.select(_string("user_id").alias("doc_id"), F.floor(F.col("event_id") / 2).alias("mark_id"), F.when(even, "start").otherwise("end").alias("type"), name.alias("name"))
    return resolve.bookmark_names(m).select("doc_id", "mark_id", "type", "name")


@query("""SELECT o_custkey::VARCHAR AS doc_id, max(o_orderkey) AS pre FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey, o_orderkey // 100""")
def last_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load(spark, sf_dir, "orders").select(_string("o_custkey").alias("doc_id"), F.floor(F.col("o_orderkey") / 100).alias("parent"), F.lit("cell").alias("slot"), F.col("o_orderkey").alias("pre"), F.when(F.col("o_orderstatus") == "O", "table").otherwise("paragraph").alias("kind"))
    return resolve.last_in_cell(b).select("doc_id", "pre")


@query("""SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS pre, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1000000 ELSE count_if(o_orderkey % 2 = 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END::BIGINT AS id FROM orders""")
def next_free_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") + 1_000_000).cast("string")).otherwise(F.concat(F.lit("k"), _string("o_orderkey")))
    return resolve.next_free_ids(load(spark, sf_dir, "orders").select(_string("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pre"), key.alias("key"))).select("doc_id", "pre", "id")


@query(f"""SELECT n_regionkey::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_mktsegment) - 1)::BIGINT AS spec FROM ({_SEGMENTS})""")
def numbering_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.numbering_specs(markup.parse(region_texts(spark, sf_dir))).select("doc_id", "spec")


@query("""SELECT user_id::VARCHAR AS doc_id, event_id::VARCHAR AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id::VARCHAR)::INTEGER AS place FROM events""")
def comments_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "events").select(_string("user_id").alias("doc_id"), F.lit("comment").alias("kind"), F.create_map(F.lit("id"), _string("event_id")).alias("attrs"))
    return resolve.comments_in_order(n).select("doc_id", F.col("attrs")["id"].alias("id"), "place")


@query("""SELECT user_id::VARCHAR AS doc_id, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id)::INTEGER AS place FROM events""")
def schema_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children by a schema's order that knows two of the event types; the rest come last as they stood."""
    c = load(spark, sf_dir, "events").select(_string("user_id").alias("doc_id"), F.lit("p").alias("part"), F.lit(0).alias("parent_id"), F.lit("pPr").alias("parent_name"), F.col("event_id").alias("ord"), F.col("event_type").alias("child"))
    order = spark.createDataFrame([("pPr", "view", 0), ("pPr", "click", 1)], "parent_name string, child string, rank int")
    return corpus.schema_ordered(c, order).select("doc_id", "ord", "place")


@query("""SELECT p_brand AS doc_id, p_type AS id, CASE WHEN bool_or(p_size > 25) THEN 'late' ELSE 'early' END AS version FROM part GROUP BY 1, 2""")
def merge_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_type").alias("id"), "p_size")
    early, late = (d.select("doc_id", "id").distinct().withColumn("version", F.lit(v)) for d, v in ((p, "early"), (p.where("p_size > 25"), "late")))
    return corpus.merge_resources(early, late)


@query("""SELECT p_brand AS doc_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey)::INTEGER AS place FROM part""")
def fonts_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    cased = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    f = load(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), "p_partkey", cased.alias("family"), F.col("p_partkey").alias("variant"))
    return corpus.by_family(f).select("doc_id", "p_partkey", "place")


@query("""WITH r AS (SELECT source, doc_id::VARCHAR AS id, lang || '.txt' AS n, lang, sha256(text) AS h FROM documents), f AS (SELECT *, first(h) OVER (PARTITION BY source, n ORDER BY id) AS f FROM r)
SELECT source AS doc_id, id, CASE WHEN f = h THEN n ELSE lang || '-' || right(id, 8) || '.txt' END AS asset FROM f""")
def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files named by their language: names clash wherever texts differ."""
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), _string("doc_id").alias("id"), F.concat("lang", F.lit(".txt")).alias("filename"), F.col("text").cast("binary").alias("data"))
    return corpus.asset_names(d).select("doc_id", "id", "asset")


@query("""SELECT source AS doc_id, count(*)::BIGINT AS n_parts, sum(strlen(text))::BIGINT AS n_bytes, count_if(doc_id % 2 = 1)::BIGINT AS n_media, coalesce(sum(strlen(text)) FILTER (doc_id % 2 = 1), 0)::BIGINT AS media_bytes FROM documents GROUP BY 1""")
def package_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("doc_id") % 2 == 1, "word/media/").otherwise("word/"), _string("doc_id"))
    return corpus.package_stats(load(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), name.alias("name"), F.col("text").cast("binary").alias("data")))


@query("""SELECT n_regionkey::VARCHAR AS doc_id, string_agg('@book{n' || lpad(n_nationkey::VARCHAR, 2, '0') || ',' || chr(10) || '  author = {A},' || chr(10) || '  title = {' || n_name || '},' || chr(10) || '  zz = {' || n_nationkey || '},' || chr(10) || '}' || chr(10), chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1""")
def bibliography_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    fields = F.create_map(F.lit("zz"), _string("n_nationkey"), F.lit("title"), F.col("n_name"), F.lit("author"), F.lit("A"), F.lit("note"), F.lit(""))
    return corpus.bib_text(n.select(_string("n_regionkey").alias("doc_id"), F.concat(F.lit("n"), F.lpad(_string("n_nationkey"), 2, "0")).alias("tag"), F.lit("book").alias("entry_type"), fields.alias("fields")))


_MATRIX = "SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS id, n_regionkey::VARCHAR AS category, n_name || '|x' AS markup FROM nation"


@query(f"""SELECT '| id | category | markup |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || id || ' | ' || category || ' | ' || replace(markup, '|', '\\|') || ' |', chr(10) ORDER BY id) || chr(10) AS markdown,
 '[' || string_agg(to_json({{'id': id, 'category': category, 'markup': markup}})::VARCHAR, ',' ORDER BY id) || ']' AS json FROM ({_MATRIX})""".replace("\\\\", "\\"))
def matrix_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    rows = n.select(F.lpad(_string("n_nationkey"), 2, "0").alias("id"), _string("n_regionkey").alias("category"), F.concat("n_name", F.lit("|x")).alias("markup"))
    return corpus.matrix_markdown(rows, rows.columns).crossJoin(corpus.matrix_json(rows))  # one row each


@query("""SELECT 'Rows: ' || count(*) || chr(10) || chr(10) || '| id | category | markup | package | to_package | to_markup |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) || string_agg('| ' || id || ' | 1 | ' || n_name || ' | p | full | none |', chr(10) ORDER BY id) || chr(10) AS markdown
FROM (SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS id, n_name FROM nation WHERE n_regionkey = 1)""")
def filtered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    rows = n.select(F.lpad(_string("n_nationkey"), 2, "0").alias("id"), _string("n_regionkey").alias("category"), F.col("n_name").alias("markup"), F.lit("p").alias("package"), F.lit("full").alias("to_package"), F.lit("none").alias("to_markup"), F.lit("more").alias("notes"))
    return corpus.export_matrix(rows, "1")


@query(r"""SELECT p_partkey, left(trim(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '-', 'g'), '-.'), 80) || '-' || p_partkey || '.png' AS filename, lower(replace(p_name, ' ', '')) AS family, '  ' || p_name AS indented, (['typst', 'docx', 'docx', NULL])[p_partkey % 4 + 1] AS format,
 (['a.docx', 'a.typ', 'a.typ', NULL])[p_partkey % 4 + 1] AS output, (['decimal', 'lowerLetter', 'upperRoman', 'decimal'])[p_partkey % 4 + 1] AS number_format, (['1', 'a', 'I', '1'])[p_partkey % 4 + 1] AS pattern,
 '{"a":"' || p_size || '","b":"' || p_brand || '"}' AS json, p_size % 2 = 0 AS empty_style FROM part""")
def names_and_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("p_partkey") % 4).cast("int")
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), k)
    path, kind = pick("a.typ", "a.docx", "a.DOCM", "a.txt"), pick("1.", "a)", "(I)", "-")
    return load(spark, sf_dir, "part").select(
        "p_partkey", scalar.sanitize_filename(F.concat(F.lit("x\\y/"), "p_name", F.lit("-"), _string("p_partkey"), F.lit(".png"))).alias("filename"), scalar.normalized_family(F.col("p_name")).alias("family"), scalar.indent_text(F.col("p_name")).alias("indented"),
        scalar.infer_format(path).alias("format"), scalar.default_output(path).alias("output"), scalar.number_format(kind).alias("number_format"), scalar.number_pattern(scalar.number_format(kind)).alias("pattern"),
        scalar.stable_json(F.create_map(F.lit("b"), F.col("p_brand"), F.lit("a"), _string("p_size"))).alias("json"), scalar.is_empty_style(F.create_map(F.lit("bold"), F.when(F.col("p_size") % 2 == 1, "true"))).alias("empty_style"),
    )


@query("""SELECT event_id, (['1', 'Table of contents', '', ''])[event_id % 4 + 1] AS placeholder, (['image/png', 'image/jpeg', 'application/octet-stream', 'image/png'])[event_id % 4 + 1] AS media_type FROM events""")
def placeholders_and_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("event_id") % 4).cast("int")
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), k)
    data = F.unhex(pick("89504E470D0A1A0A", "FFD8FF00", "00", "89504E470D0A1A0A"))
    return load(spark, sf_dir, "events").select("event_id", scalar.field_placeholder(pick("PAGE", "TOC \\o", "REF x", "DATE")).alias("placeholder"), scalar.media_type(pick("a.png", "a", "a", "b"), data).alias("media_type"))


@query("""SELECT c_custkey::VARCHAR AS doc_id, have AS holds FROM (SELECT c_custkey, c_acctbal > 0 AS have FROM customer)""")
def holds_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = F.when(F.col("c_acctbal") > 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return load(spark, sf_dir, "customer").select(_string("c_custkey").alias("doc_id"), corpus.holds_all(have, F.array(F.lit("b"), F.lit("a"))).alias("holds"))
