"""Analytics over corpora: statistics, package tables, validation checks, the format matrix and its exports. Built-in expressions and joins only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.functions import scalar

MATRIX_COLUMNS = ["id", "category", "markup", "markup_kind", "package", "package_part", "to_package", "to_markup", "implementation_to_package", "implementation_to_markup", "notes"]


# --- statistics ---------------------------------------------------------------------------------------------------


def kind_counts(nodes: DataFrame, scope: str = "document") -> DataFrame:
    """(doc_id, cls, kind, n). Scope `document`: blocks of bodies, items, cells, figures, quotes and controls, and the inlines of their paragraphs, headings and captions, inside links, fields and changes but not notes; `all`: every node but structure."""
    rows = nodes.where("cls IN ('block', 'inline')")
    if scope == "document":
        hidden = nodes.where("kind = 'note'").select(F.col("doc_id").alias("_d"), F.col("pre").alias("_a"), F.col("post").alias("_b"))
        inside = (F.col("doc_id") == F.col("_d")) & (F.col("pre") > F.col("_a")) & (F.col("post") < F.col("_b"))
        rows = rows.join(hidden, inside, "left_anti").where("slot NOT LIKE 'header%' AND slot NOT LIKE 'footer%' AND slot NOT IN ('attribution', 'term', 'comment')")
    return rows.groupBy("doc_id", "cls", "kind").agg(F.count("*").alias("n"))


def document_stats(nodes: DataFrame) -> DataFrame:
    """One row for each document: blocks, inlines, sections, notes, warnings, and feature flags."""
    has = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    return nodes.groupBy("doc_id").agg(
        F.count_if(F.col("cls") == "block").alias("n_blocks"), F.count_if(F.col("cls") == "inline").alias("n_inlines"),
        F.count_if(F.col("kind") == "section").alias("n_sections"), F.count_if(F.col("kind") == "note").alias("n_notes"), F.count_if(F.col("kind") == "warning").alias("n_warnings"),
        has("raw_block", "raw_inline").alias("has_raw"), has("field").alias("has_field"), has("change").alias("has_change"), has("comment_anchor").alias("has_comment"),
        has("citation").alias("has_citation"), has("control").alias("has_control"), F.bool_or((F.col("kind") == "field") & F.coalesce(F.startswith("text", F.lit("BIBLIOGRAPHY")), F.lit(False))).alias("has_bibliography"),
    )


FLAGS = ["has_raw", "has_field", "has_change", "has_comment", "has_citation", "has_control", "has_bibliography"]


def feature_flags(nodes: DataFrame) -> DataFrame:
    """(doc_id, FLAGS): which features a document uses."""
    return document_stats(nodes).select("doc_id", *FLAGS)


def writer_fonts(nodes: DataFrame, always: tuple[str, ...] = ("Calibri", "Consolas")) -> DataFrame:
    """(doc_id, families): the names that a document's package lists, sorted: its texts' fonts and the two of every package."""
    named = nodes.where("kind = 'text'").select("doc_id", F.col("style")["font"].alias("family")).where("family IS NOT NULL AND family <> 'mono'")
    every = nodes.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, always))).alias("family"))
    return named.unionByName(every).groupBy("doc_id").agg(F.array_sort(F.collect_set("family")).alias("families"))


def text_stats(files: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_lines, sha256) of texts."""
    return files.select("doc_id", F.length("text").cast("long").alias("n_chars"), scalar.line_count(F.col("text")).alias("n_lines"), F.sha2("text", 256).alias("sha256"))


def package_stats(parts: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_parts, n_bytes, n_media, media_bytes)."""
    media = F.startswith("name", F.lit("word/media/"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.sum(F.length("data")).alias("n_bytes"), F.count_if(media).alias("n_media"), F.coalesce(F.sum(F.when(media, F.length("data"))), F.lit(0)).cast("long").alias("media_bytes"))


def used_fonts(runs: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, family, variants): runs with boolean bold and italic and several font columns."""
    variant = F.when(F.col("bold") & F.col("italic"), "boldItalic").when(F.col("bold"), "bold").when(F.col("italic"), "italic").otherwise("regular")
    each = runs.select("doc_id", variant.alias("v"), F.explode(F.array_distinct(F.array_compact(F.array(*columns)))).alias("family"))
    return each.groupBy("doc_id", "family").agg(F.array_sort(F.collect_set("v")).alias("variants"))


def resolve_fonts(used: DataFrame, embedded: DataFrame, system: DataFrame) -> DataFrame:
    """(doc_id, family, source): an embedded font first, then one of the system's, else null. Families match by their normalised name."""
    key = scalar.normalized_family(F.col("family"))
    u = used.withColumn("_k", key)
    e = embedded.select("doc_id", key.alias("_k"), F.lit(True).alias("_e")).distinct()
    s = system.groupBy(key.alias("_k")).agg(F.min("path").alias("_path"))
    return u.join(e, ["doc_id", "_k"], "left").join(F.broadcast(s), "_k", "left").select("doc_id", "family", F.when(F.col("_e"), "embedded").otherwise(F.col("_path")).alias("source"))


def distinct_resources(resources: DataFrame) -> DataFrame:
    """Resources (doc_id, id, data) with the first id of equal bytes as `canonical_id`."""
    w = Window.partitionBy("doc_id", "checksum").orderBy("id")
    return resources.withColumn("checksum", F.sha2("data", 256)).withColumn("canonical_id", F.first("id").over(w))


def merge_resources(*tables: DataFrame) -> DataFrame:
    """The union of resource tables (doc_id, id, …) of the same columns; of rows that share an id the later table's wins."""
    names = tables[0].columns
    both = reduce(DataFrame.unionByName, [t.select(*names, F.lit(k).alias("_k")) for k, t in enumerate(tables)])
    won = both.groupBy("doc_id", "id").agg(F.max_by(F.struct(*names), "_k").alias("r"))
    return won.select("r.*")


def by_family(fonts: DataFrame) -> DataFrame:
    """Fonts with their place among a document's, by family whatever its case; equal ones by variant."""
    return fonts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lower("family"), "variant")))


def holds_all(have: Column, want: Column) -> Column:
    """Whether every element of one array is in the other."""
    return F.size(F.array_except(want, have)) == 0


def asset_names(resources: DataFrame) -> DataFrame:
    """File names for resources: on a clash of names with different bytes the later ones get the end of their id."""
    safe = scalar.sanitize_filename(F.col("filename"))
    r = resources.withColumn("_n", safe).withColumn("checksum", F.sha2("data", 256))
    first = F.first("checksum").over(Window.partitionBy("doc_id", "_n").orderBy("id"))
    ext = F.regexp_extract("_n", r"(\.[^.]*)$", 1)
    stem = F.substring("_n", F.lit(1), F.length("_n") - F.length(ext))
    return r.withColumn("asset", F.when(first == F.col("checksum"), F.col("_n")).otherwise(F.concat(stem, F.lit("-"), F.right("id", F.lit(8)), ext))).drop("_n")


# --- packages -----------------------------------------------------------------------------------------------------


def part_content_types(parts: DataFrame, content_types: DataFrame) -> DataFrame:
    """(doc_id, name, content_type): an override by part wins over a default by extension; null if neither is declared."""
    o = content_types.where("scope = 'override'").select("doc_id", F.ltrim(F.col("key"), F.lit("/")).alias("name"), F.col("content_type").alias("_o")).dropDuplicates(["doc_id", "name"])
    d = content_types.where("scope = 'default'").select("doc_id", F.lower("key").alias("_x"), F.col("content_type").alias("_d")).dropDuplicates(["doc_id", "_x"])
    p = parts.select("doc_id", "name").withColumn("_x", F.lower(F.regexp_extract("name", r"\.([^./]*)$", 1)))
    return p.join(o, ["doc_id", "name"], "left").join(d, ["doc_id", "_x"], "left").select("doc_id", "name", F.coalesce("_o", "_d").alias("content_type"))


def last_relationships(relationships: DataFrame) -> DataFrame:
    """The last of relationships that share an id within their source part."""
    r = relationships.groupBy("doc_id", "source_part", "rel_id").agg(F.max_by(F.struct("type", "target", "target_mode", "ord"), "ord").alias("r"))
    return r.select("doc_id", "source_part", "rel_id", "r.*")


def relationship_targets(relationships: DataFrame) -> DataFrame:
    """Relationships with `external` and, for internal ones, `part`, the package path they name."""
    external = F.lower(F.coalesce("target_mode", F.lit(""))) == "external"
    return relationships.withColumn("external", external).withColumn("part", F.when(~external, scalar.resolve_target(F.col("source_part"), F.col("target"))))


def dangling_relationships(relationships: DataFrame, parts: DataFrame) -> DataFrame:
    """Internal relationships whose part is missing."""
    return relationship_targets(relationships).where("NOT external").join(parts.select("doc_id", F.col("name").alias("part")), ["doc_id", "part"], "left_anti")


def main_part(relationships: DataFrame, kind: str = "officeDocument", default: str = "word/document.xml") -> DataFrame:
    """(doc_id, part): the first package relationship of a type, else the default."""
    docs = relationships.select("doc_id").distinct()
    hit = relationship_targets(relationships.where("source_part = ''")).where(F.endswith("type", F.lit("/" + kind))).groupBy("doc_id").agg(F.min_by("part", "ord").alias("part"))
    return docs.join(hit, "doc_id", "left").select("doc_id", F.coalesce("part", F.lit(default)).alias("part"))


def list_parts(parts: DataFrame, prefix: str = "") -> DataFrame:
    return parts.where(F.startswith("name", F.lit(prefix))).select("doc_id", "name").orderBy("doc_id", "name")


def package_digest(parts: DataFrame, ignored: tuple[str, ...] = ("docProps/core.xml", "docProps/app.xml", "word/settings.xml")) -> DataFrame:
    """(doc_id, digest): SHA-256 over name, a zero byte and the SHA-256 of each part (data in canonical form), in the order of names."""
    one = parts.where(~F.col("name").isin(*ignored)).select("doc_id", F.struct("name", F.unhex(F.sha2("data", 256)).alias("h")).alias("p"))
    ordered = F.array_sort(F.collect_list("p"))
    folded = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["name"].cast("binary"), F.unhex(F.lit("00")), p["h"]))
    return one.groupBy("doc_id").agg(F.sha2(folded, 256).alias("digest"))


def child_order_errors(children: DataFrame, order: DataFrame) -> DataFrame:
    """Parents whose known children break the schema's order: children (doc_id, part, parent_id, parent_name, ord, child) against order (parent_name, child, rank); one row for each parent."""
    r = children.join(F.broadcast(order), ["parent_name", "child"])
    w = Window.partitionBy("doc_id", "part", "parent_id").orderBy("ord")
    bad = r.withColumn("_b", F.lag("rank").over(w) > F.col("rank"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "child"))), lambda x: x["child"]), ", ")
    return bad.groupBy("doc_id", "part", "parent_id", "parent_name").agg(F.bool_or(F.coalesce("_b", F.lit(False))).alias("_bad"), names.alias("children")).where("_bad").drop("_bad")


def schema_ordered(children: DataFrame, order: DataFrame) -> DataFrame:
    """Children (doc_id, part, parent_id, parent_name, ord, child) with their `place` in the schema's order (parent_name, child, rank): unknown ones last, equals as they stood. order is a schema's own table and small."""
    r = children.join(order, ["parent_name", "child"], "left")
    w = Window.partitionBy("doc_id", "part", "parent_id").orderBy(F.col("rank").asc_nulls_last(), "ord")
    return r.withColumn("place", F.row_number().over(w)).drop("rank")


def page_numbering(inlines: DataFrame) -> DataFrame:
    """(doc_id, slot, pattern): headers and footers of one paragraph made of text and page fields only, with a safe numbering pattern. inlines: (doc_id, slot, block, pre, kind, text)."""
    cmd = scalar.field_command(F.coalesce("text", F.lit("")))
    ok = (F.col("kind") == "text") | (F.col("kind") == "field") & cmd.isin("PAGE", "NUMPAGES", "SECTIONPAGES")
    shown = F.when(F.col("kind") == "field", "1").otherwise(F.coalesce("text", F.lit("")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", shown.alias("t")))), lambda x: x["t"]), "")
    g = inlines.groupBy("doc_id", "slot").agg(F.bool_and(ok).alias("ok"), F.bool_or((F.col("kind") == "field") & (cmd == "PAGE")).alias("page"), F.count_distinct("block").alias("blocks"), text.alias("t"))
    return g.where("ok AND page AND blocks = 1").withColumn("pattern", scalar.page_pattern(F.col("t"))).where("pattern IS NOT NULL").select("doc_id", "slot", "pattern")


def validate(parts: DataFrame, content_types: DataFrame, relationships: DataFrame, xml_errors: DataFrame, order_errors: DataFrame) -> DataFrame:
    """(doc_id, valid, errors, warnings): the union of all checks, one row for each document. xml_errors: (doc_id, name, error); order_errors as child_order_errors()."""
    err = lambda df, text, level="error": df.select("doc_id", F.lit(level).alias("level"), text.alias("message"))
    docs = parts.select("doc_id").distinct()
    main = main_part(relationships).join(parts.select("doc_id", F.col("name").alias("part")), ["doc_id", "part"], "left_anti")
    doubled = relationships.groupBy("doc_id", "source_part", "rel_id").count().where("count > 1")
    checks = [
        err(docs.join(parts.where("name = '[Content_Types].xml'").select("doc_id"), "doc_id", "left_anti"), F.lit("missing [Content_Types].xml")),
        err(xml_errors, F.concat_ws(": ", "name", "error")),
        err(order_errors, F.concat(F.lit("schema order in "), "part", F.lit(": "), "parent_name", F.lit(" has "), "children")),
        err(main, F.concat(F.lit("missing main part "), "part")),
        err(relationships.where("coalesce(rel_id, '') = ''"), F.concat(F.lit("relationship without id in "), "source_part")),
        err(doubled, F.concat(F.lit("duplicate relationship id "), "rel_id")),
        err(dangling_relationships(relationships, parts), F.concat(F.lit("missing relationship target "), "part")),
        err(part_content_types(parts, content_types).where("content_type IS NULL AND name <> '[Content_Types].xml'"), F.concat(F.lit("no content type for "), "name"), "warning"),
    ]
    found = reduce(DataFrame.unionByName, checks)
    pick = lambda level: F.array_sort(F.collect_list(F.when(F.col("level") == level, F.col("message"))))
    by_doc = found.groupBy("doc_id").agg(pick("error").alias("errors"), pick("warning").alias("warnings"))
    none = F.array().cast("array<string>")
    out = docs.join(by_doc, "doc_id", "left").select("doc_id", F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings"))
    return out.withColumn("valid", F.size("errors") == 0)


def has_notes_unreferenced(notes: DataFrame, references: DataFrame) -> DataFrame:
    """Notes (doc_id, note_type, note_id) that no reference names; separators (negative ids and 0) are none."""
    real = notes.where("NOT startswith(cast(note_id AS string), '-') AND cast(note_id AS string) <> '0'")
    return real.join(references, ["doc_id", "note_type", "note_id"], "left_anti")


# --- the format matrix --------------------------------------------------------------------------------------------


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A coverage matrix from a Markdown table of nine columns (id, category, `construct` (kind), `counterpart` in `part`, two fidelities, two implementations, notes)."""
    cells = F.split(F.regexp_replace(F.regexp_replace("value", r"^\|\s*|\s*\|\s*$", ""), r"\\\|", "\u0001"), r"\s*\|\s*", -1)
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\|\s*M\d+\s*\|")).select(cells.alias("c"))
    cell = lambda k: F.replace(F.get("c", F.lit(k)), F.lit("\u0001"), F.lit("|"))
    both = r"^`(.*)` \((.*?)\)$", r"^`(.*)` in `(.*)`$"
    return rows.select(
        cell(0).alias("id"), cell(1).alias("category"), F.regexp_extract(cell(2), both[0], 1).alias("markup"), F.regexp_extract(cell(2), both[0], 2).alias("markup_kind"),
        F.regexp_extract(cell(3), both[1], 1).alias("package"), F.regexp_extract(cell(3), both[1], 2).alias("package_part"),
        cell(4).alias("to_package"), cell(5).alias("to_markup"), cell(6).alias("implementation_to_package"), cell(7).alias("implementation_to_markup"), cell(8).alias("notes"),
    )


def search(rows: DataFrame, category: str | None = None, query: str | None = None, category_column: str = "category") -> DataFrame:
    """Rows of a category (whole, any case) that hold the query in any of their columns joined by spaces (any case)."""
    if category:
        rows = rows.where(F.lower(category_column) == category.lower())
    if query:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])), F.lit(query.lower())))
    return rows


def coverage_counts(matrix: DataFrame) -> DataFrame:
    """(direction, measure, value, n): rows by implementation and by fidelity for each direction."""
    long = matrix.select(F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(m).alias("measure"), F.col(c).alias("value")) for d, m, c in (("to_package", "fidelity", "to_package"), ("to_markup", "fidelity", "to_markup"), ("to_package", "implementation", "implementation_to_package"), ("to_markup", "implementation", "implementation_to_markup"))])).alias("x")).select("x.*")
    return long.groupBy("direction", "measure", "value").agg(F.count("*").alias("n"))


def export_matrix(matrix: DataFrame, category: str | None = None, query: str | None = None) -> DataFrame:
    """One row `markdown`: the whole matrix with all its columns; what a search leaves of it, headed by its number of rows, with six of them."""
    found = search(matrix, category, query)
    n = found.count()
    if n == matrix.count():
        return matrix_markdown(matrix, matrix.columns)
    short = matrix_markdown(found, ["id", "category", "markup", "package", "to_package", "to_markup"])
    return short.select(F.concat(F.lit(f"Rows: {n}\n\n"), "markdown").alias("markdown"))


def matrix_json(rows: DataFrame) -> DataFrame:
    """One row `json`: the rows in the order of ids. A report, so it gathers its rows in one text."""
    one = F.to_json(F.struct(*rows.columns))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", one.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def matrix_markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row `markdown`: a table of the columns; bars escaped, line feeds as spaces."""
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[esc(c) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n"), F.lit("\n")).alias("markdown"))


def write_csv(rows: DataFrame, path: str, force: bool = False) -> None:
    """A header and the rows; an existing target is an error unless forced."""
    rows.write.mode("overwrite" if force else "errorifexists").option("header", True).option("lineSep", "\r\n").csv(path)


# --- bibliography -------------------------------------------------------------------------------------------------

#: Fields of an entry that come first, in this order.
BIB_FIELDS = [
    "author", "editor", "translator", "title", "shorttitle", "booktitle",
    "journaltitle", "eventtitle", "year", "month", "day", "volume", "number",
    "pages", "edition", "publisher", "institution", "organization", "location",
    "isbn", "issn", "url", "urldate", "type", "howpublished", "venue", "note",
]


def bib_text(entries: DataFrame) -> DataFrame:
    """(doc_id, text): entries (doc_id, tag, entry_type, fields map) as bibliography source, preferred fields first, the rest by name, empty ones left out."""
    rank = F.array(*map(F.lit, BIB_FIELDS))
    keys = F.filter(F.map_keys("fields"), lambda k: F.coalesce(F.element_at(F.col("fields"), k), F.lit("")) != "")
    place = lambda k: F.coalesce(F.nullif(F.array_position(rank, k), F.lit(0)), F.lit(len(BIB_FIELDS) + 1))
    ordered = F.array_sort(F.transform(keys, lambda k: F.struct(place(k).alias("p"), k.alias("k"))))
    lines = F.transform(ordered, lambda x: F.concat(F.lit("  "), x["k"], F.lit(" = "), scalar.bib_value(F.element_at(F.col("fields"), x["k"]))))
    entry = F.concat(F.lit("@"), "entry_type", F.lit("{"), "tag", F.lit(",\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit(",\n"))), ""), F.lit("}\n"))
    return entries.select("doc_id", "tag", entry.alias("e")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tag", "e"))), lambda x: x["e"]), "\n").alias("text"))


def remaining_fields(fields: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(fields), F.array(*map(F.lit, BIB_FIELDS))))
