"""Resolution over node tables: counters, references, styles, numbering, sections, merges, revisions. Joins, windows and recursive queries only, but where the docstring says otherwise. Windows partition by document, so one exchange on doc_id serves them all."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vellumgrid.functions import scalar

LEVELS = 9


def _doc() -> WindowSpec:
    """A document's rows in pre-order."""
    return Window.partitionBy("doc_id").orderBy("pre")


def heading_numbers(nodes: DataFrame) -> DataFrame:
    """Numbered headings with `numbers`, their hierarchical counters, and `number_text`, these through the heading's pattern. Headings without numbering neither count nor reset; level 0 counts as 1."""
    h = nodes.where("kind = 'heading' AND numbering IS NOT NULL").withColumn("lvl", scalar.clamp(F.coalesce("level", F.lit(1)), 1, LEVELS))
    # A counter is its level's running count less that count where a smaller level last stood; all windows share one order.
    so_far = _doc().rowsBetween(Window.unboundedPreceding, 0)
    levels = range(1, LEVELS + 1)
    h = h.select("*", *[F.count_if(F.col("lvl") == k).over(so_far).alias(f"_n{k}") for k in levels])
    h = h.select("*", *[F.coalesce(F.last(F.when(F.col("lvl") < k, F.col(f"_n{k}")), True).over(so_far), F.lit(0)).alias(f"_r{k}") for k in levels])
    h = h.withColumn("numbers", F.slice(F.array(*[F.col(f"_n{k}") - F.col(f"_r{k}") for k in levels]), F.lit(1), F.col("lvl")))
    h = h.withColumn("number_text", scalar.numbering(F.col("numbering"), F.col("numbers")))
    return h.drop("lvl", *[f"_{x}{k}" for x in "nr" for k in levels])


def figure_numbers(nodes: DataFrame) -> DataFrame:
    """Numbered figures with their number within their kind."""
    f = nodes.where("kind = 'figure' AND numbering IS NOT NULL").withColumn("figure_kind", F.coalesce(F.col("attrs")["kind"], F.lit("image")))
    f = f.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "figure_kind").orderBy("pre")).cast("long"))
    return f.withColumn("number_text", scalar.numbering(F.col("numbering"), F.array("number")))


def equation_numbers(nodes: DataFrame) -> DataFrame:
    e = nodes.where("kind = 'math_block' AND numbering IS NOT NULL").withColumn("number", F.row_number().over(_doc()).cast("long"))
    return e.withColumn("number_text", scalar.numbering(F.col("numbering"), F.array("number")))


def label_targets(nodes: DataFrame) -> DataFrame:
    """(doc_id, target, kind, supplement, number_text): what each label names; the last definition of a label wins. Numbers are null for unnumbered targets."""
    labelled = nodes.where("label IS NOT NULL AND kind IN ('heading', 'figure', 'math_block')").select("doc_id", "pre", F.col("label").alias("target"), "kind", "supplement", F.coalesce(F.col("attrs")["kind"], F.lit("image")).alias("figure_kind"))
    numbers = heading_numbers(nodes).select("doc_id", "pre", "number_text").unionByName(figure_numbers(nodes).select("doc_id", "pre", "number_text")).unionByName(equation_numbers(nodes).select("doc_id", "pre", "number_text"))
    default = F.when(F.col("kind") == "heading", "Section").when(F.col("kind") == "math_block", "Equation").when(F.col("figure_kind") == "table", "Table").otherwise("Figure")
    full = labelled.join(numbers, ["doc_id", "pre"], "left").withColumn("supplement", F.coalesce("supplement", default))
    last = full.groupBy("doc_id", "target").agg(F.max_by(F.struct("kind", "supplement", "number_text"), "pre").alias("t"))
    return last.select("doc_id", "target", "t.*")


def resolve_references(nodes: DataFrame) -> DataFrame:
    """References with `resolved` (their text) and `found`. The page form reads 1; an unknown or unnumbered label stays @label."""
    refs = nodes.where("kind = 'reference'").select("doc_id", "pre", F.col("attrs")["target"].alias("target"), F.col("attrs")["form"].alias("form"), F.col("supplement").alias("own"))
    r = refs.join(label_targets(nodes), ["doc_id", "target"], "left")
    number = F.when(F.col("kind") == "heading", F.regexp_replace("number_text", r"[.,:;]+$", "")).otherwise(F.col("number_text"))
    text = F.when(F.col("form") == "page", "1").when(F.col("number_text").isNull(), F.concat(F.lit("@"), "target")).otherwise(F.concat_ws(" ", F.coalesce("own", "supplement"), number))
    return r.select("doc_id", "pre", "target", text.alias("resolved"), (F.col("number_text").isNotNull() | (F.col("form") == "page")).alias("found"))


def unresolved_references(nodes: DataFrame) -> DataFrame:
    """References whose label no node of the document defines."""
    refs = nodes.where("kind = 'reference'").select("doc_id", "pre", F.col("attrs")["target"].alias("target"))
    return refs.join(nodes.where("label IS NOT NULL").select("doc_id", F.col("label").alias("target")), ["doc_id", "target"], "left_anti")


def style_chain(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id, ancestor, depth, cyclic): each style, its based-on chain, nearest first, and the document defaults last. A base that is missing or the style itself leads to the defaults; a cycle ends the chain where it closes, and nothing else cuts it, nor does a limit on recursive rows."""
    view = f"_styles_{uuid.uuid4().hex}"
    styles.select("doc_id", "style_id", "based_on").createOrReplaceTempView(view)
    chain = styles.sparkSession.sql(f"""WITH RECURSIVE c(doc_id, style_id, ancestor, next, depth, path) MAX RECURSION LEVEL 1000000 AS (
        SELECT doc_id, style_id, style_id, based_on, 0, array(style_id) FROM {view}
        UNION ALL SELECT c.doc_id, c.style_id, s.style_id, s.based_on, c.depth + 1, concat(c.path, array(s.style_id))
          FROM c JOIN {view} s ON c.doc_id = s.doc_id AND c.next = s.style_id
          WHERE NOT array_contains(c.path, s.style_id))
      SELECT doc_id, style_id, ancestor, depth, next IS NOT NULL AND array_contains(path, next) AS cyclic FROM c LIMIT ALL""")
    styles.sparkSession.catalog.dropTempView(view)
    ends = chain.groupBy("doc_id", "style_id").agg(F.max("depth").alias("last"), F.bool_or("cyclic").alias("loop"))
    base = ends.where("NOT loop AND style_id <> '__docDefaults__'").join(styles.where("style_id = '__docDefaults__'").select("doc_id").distinct(), "doc_id").select("doc_id", "style_id", F.lit("__docDefaults__").alias("ancestor"), (F.col("last") + 1).alias("depth"), F.lit(False).alias("cyclic"))
    return chain.unionByName(base)


def resolve_styles(styles: DataFrame, scalars: list[str], maps: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Styles with inherited values: the nearest non-null wins for scalars (an explicit false overrides), maps are joined with the nearest winning key by key, and the nearest non-empty list replaces."""
    values = styles.select("doc_id", F.col("style_id").alias("ancestor"), *scalars, *maps, *lists)
    rows = style_chain(styles).join(values, ["doc_id", "ancestor"])
    aggs: list[Column] = [F.expr(f"min_by({c}, depth) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in scalars]
    aggs += [F.expr(f"min_by({c}, depth) FILTER (WHERE size({c}) > 0)").alias(c) for c in lists]
    for c in maps:
        nearest = F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.map_entries(F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))).alias("m"))))
        entries = F.flatten(F.transform(nearest, lambda x: x["m"]))
        kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
        aggs.append(F.map_from_entries(kept).alias(c))
    aggs.append(F.bool_or("cyclic").alias("cyclic"))
    return rows.groupBy("doc_id", "style_id").agg(*aggs)


def styled(nodes: DataFrame, styles: DataFrame) -> DataFrame:
    """Paragraphs, headings and texts with `effective`, their properties with those inherited: what they say themselves first, then their style's chain, then the document defaults. styles: (doc_id, style_id, based_on, paragraph map, text map); a style that isn't there leaves the defaults."""
    rows = nodes.where("kind IN ('paragraph', 'heading', 'text')")
    known = resolve_styles(styles, [], ("paragraph", "text")).select("doc_id", "style_id", "paragraph", "text")
    named, base = known.where("style_id <> '__docDefaults__'").withColumnsRenamed({"paragraph": "_p", "text": "_t"}), known.where("style_id = '__docDefaults__'").select("doc_id", F.col("paragraph").alias("_dp"), F.col("text").alias("_dt"))
    r = rows.withColumn("style_id", F.col("style")["style_id"]).join(named, ["doc_id", "style_id"], "left").join(base, "doc_id", "left")
    run = F.col("kind") == "text"
    inherited = F.coalesce(F.when(run, F.col("_t")).otherwise(F.col("_p")), F.when(run, F.col("_dt")).otherwise(F.col("_dp")), F.create_map().cast("map<string,string>"))
    own = F.coalesce("style", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(inherited, lambda k, v: ~F.map_contains_key(own, k))
    return r.withColumn("effective", F.map_concat(kept, own)).drop("_p", "_t", "_dp", "_dt", "style_id")


def comments_in_order(nodes: DataFrame) -> DataFrame:
    """Comments with their place in the document's list, by their ids as strings: 10 comes before 2."""
    w = _doc().orderBy(F.col("attrs")["id"])
    return nodes.where("kind = 'comment'").withColumn("place", F.row_number().over(w))


def numbering_lookup(paragraphs: DataFrame, instances: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """paragraphs (doc_id, …, num_id, level) with num_format, level_text and start: an override first, then the abstract level, then decimal, `%n.` and 1."""
    o = overrides.select("doc_id", "num_id", "level", F.col("num_format").alias("_of"), F.col("text").alias("_ot"), F.col("start_override").alias("_os"))
    lv = levels.select("doc_id", "abstract_id", "level", F.col("num_format").alias("_lf"), F.col("text").alias("_lt"), F.col("start").alias("_ls"))
    p = paragraphs.join(instances.select("doc_id", "num_id", "abstract_id"), ["doc_id", "num_id"], "left").join(lv, ["doc_id", "abstract_id", "level"], "left").join(o, ["doc_id", "num_id", "level"], "left")
    return p.select(*paragraphs.columns, F.coalesce("_of", "_lf", F.lit("decimal")).alias("num_format"), F.coalesce("_ot", "_lt", F.concat(F.lit("%"), (F.col("level") + 1).cast("string"), F.lit("."))).alias("level_text"), F.coalesce("_os", "_ls", F.lit(1)).alias("start"))


def section_shift(sections: DataFrame, properties: list[str]) -> DataFrame:
    """A section break takes the properties of the section after it, and keeps its own type where that has none."""
    w = Window.partitionBy("doc_id").orderBy("section_idx")
    nxt = F.lead(F.struct("section_type", *properties)).over(w)
    s = sections.withColumn("_n", nxt)
    out = [F.when(F.col("_n").isNull(), F.col(c)).otherwise(F.col(f"_n.{c}")).alias(c) for c in properties]
    return s.select("doc_id", "section_idx", F.coalesce("_n.section_type", "section_type").alias("section_type"), *out)


def vertical_merges(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, table_id, row_idx, col_idx, continues) -> the cells that open a vertical run, with rowspan. A continuation without an open cell starts one."""
    w = Window.partitionBy("doc_id", "table_id", "col_idx").orderBy("row_idx")
    opens = ~F.coalesce(F.col("continues"), F.lit(False)) | F.lag("row_idx").over(w).isNull() | (F.lag("row_idx").over(w) != F.col("row_idx") - 1)
    runs = cells.withColumn("_open", opens).withColumn("_run", F.count_if("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "table_id", "col_idx", "_run").agg(F.min("row_idx").alias("row_idx"), F.count("*").alias("rowspan")).drop("_run")


def islands(rows: DataFrame, partition: list[str], order: list[str], same: list[str], name: str = "group_no") -> DataFrame:
    """rows with a running number of groups of consecutive rows that agree on `same` (nulls are equal)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    now = F.struct(*same)
    change = ~now.eqNullSafe(F.lag(now).over(w)) | F.lag(F.lit(1)).over(w).isNull()
    return rows.withColumn("_change", change).withColumn(name, F.count_if("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def list_groups(paragraphs: DataFrame) -> DataFrame:
    """Flat list grouping: paragraphs (doc_id, pre, level, num_id; null num_id or 0: not in a list) with list_no, one for each run of equal level and list; others have none."""
    is_list = F.coalesce(F.col("num_id"), F.lit(0)) != 0
    g = islands(paragraphs.withColumn("_l", is_list), ["doc_id"], ["pre"], ["_l", "level", "num_id"], "_g")
    w = Window.partitionBy("doc_id", "_l").orderBy("_g")
    return g.withColumn("list_no", F.when(F.col("_l"), F.dense_rank().over(w))).drop("_l", "_g")


def nested_lists(paragraphs: DataFrame) -> DataFrame:
    """Nested list grouping, an ordered fold over each document's paragraphs in pandas: (doc_id, pre, list_no, parent_pre): a stack of (level, num_id); any other block clears it, a deeper level hangs below the last item."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, stack, count = [], [], 0
        for r in pdf.sort_values("pre").itertuples():
            if pd.isna(r.num_id) or r.num_id == 0:
                stack = []
                continue
            while stack and (stack[-1][0] > r.level or stack[-1][0] == r.level and stack[-1][1] != r.num_id):
                stack.pop()
            if not stack or stack[-1][0] < r.level:
                count += 1
                stack.append([r.level, r.num_id, count, stack[-1][3] if stack else None, None])
                stack[-1][4] = stack[-2][3] if len(stack) > 1 else None
            stack[-1][3] = r.pre
            out.append((r.doc_id, r.pre, stack[-1][2], stack[-1][4]))
        return pd.DataFrame(out, columns=["doc_id", "pre", "list_no", "parent_pre"]).astype({"parent_pre": "Int64"})

    return paragraphs.select("doc_id", "pre", "level", "num_id").groupBy("doc_id").applyInPandas(fold, "doc_id string, pre long, list_no long, parent_pre long")


def field_spans(events: DataFrame) -> DataFrame:
    """Field characters and runs (doc_id, pos, event in begin/separate/end/text, text) -> (doc_id, field_no, depth, code, result): text before its field's separator is code, after it the result; nested fields are their own rows and a field left open ends with the document. The innermost open field owns a run, by an ordered fold in pandas."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        done, open_ = [], []
        for r in pdf.sort_values("pos").itertuples():
            if r.event == "begin":
                open_.append([len(done) + len(open_), len(open_) + 1, "", "", False])
            elif r.event == "separate" and open_:
                open_[-1][4] = True
            elif r.event == "end" and open_:
                done.append(open_.pop())
            elif r.event == "text" and open_:
                open_[-1][3 if open_[-1][4] else 2] += r.text or ""
        done += open_
        doc = pdf["doc_id"].iloc[0]
        return pd.DataFrame([(doc, n, d, c.strip(), t) for n, d, c, t, _ in sorted(done)], columns=["doc_id", "field_no", "depth", "code", "result"])

    return events.groupBy("doc_id").applyInPandas(fold, "doc_id string, field_no long, depth long, code string, result string")


def apply_revisions(rows: DataFrame, policy: str, change: str = "change_type") -> DataFrame:
    """accept keeps inserts and moves here, reject keeps deletions and moves away; annotate and preserve keep all. Rows outside a change stay."""
    if policy not in ("accept", "reject", "annotate", "preserve"):
        raise ValueError(f"unknown revision policy: {policy}")
    c = F.col(change)
    if policy in ("annotate", "preserve"):
        return rows
    return rows.where(c.isNull() | c.isin(*(("insert", "move_to") if policy == "accept" else ("delete", "move_from"))))


def coalesce_runs(runs: DataFrame) -> DataFrame:
    """Texts (doc_id, block, pre, text, style) -> consecutive ones of equal style as one; empty texts stay by themselves."""
    marked = runs.withColumn("_e", F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.col("pre")))
    g = islands(marked, ["doc_id", "block"], ["pre"], ["style", "_e"], "run_no")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "")
    return g.groupBy("doc_id", "block", "run_no").agg(F.first("style").alias("style"), joined.alias("text"))


def plain_text(inlines: DataFrame) -> DataFrame:
    """(doc_id, block, text): inline rows (doc_id, block, pre, kind, text, attrs) in order; a tab break is a tab, other breaks are line feeds."""
    t = F.when(F.col("kind") == "break", F.when(F.col("attrs")["type"] == "tab", "\t").otherwise("\n")).otherwise(F.coalesce("text", F.lit("")))
    parts = F.sort_array(F.collect_list(F.struct("pre", t.alias("t"))))
    return inlines.groupBy("doc_id", "block").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"))


def bookmark_names(marks: DataFrame) -> DataFrame:
    """Bookmark ends (doc_id, mark_id, type, name) with their start's name, else their id; names with a leading underscore are hidden and dropped."""
    starts = marks.where("type = 'start'").groupBy("doc_id", "mark_id").agg(F.first("name").alias("_n"))
    out = marks.join(starts, ["doc_id", "mark_id"], "left").withColumn("name", F.coalesce("name", "_n", F.col("mark_id").cast("string"))).drop("_n")
    return out.where(~F.startswith("name", F.lit("_")))


def next_free_ids(rows: DataFrame) -> DataFrame:
    """(doc_id, pre, key) -> id: a numeric key keeps its number if that is free when its turn comes, others take the next free one. Order dependent, hence a fold in pandas for each document."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, used, given, n = pdf.sort_values("pre"), set(), {}, 1
        for key in pdf["key"]:
            if key in given:
                continue
            want = int(key) if isinstance(key, str) and key.isdigit() else None
            if want is None or want in used:
                while n in used:
                    n += 1
                want = n
            used.add(want)
            given[key] = want
        return pdf.assign(id=pdf["key"].map(given))[["doc_id", "pre", "key", "id"]]

    return rows.select("doc_id", "pre", "key").groupBy("doc_id").applyInPandas(fold, "doc_id string, pre long, key string, id long")


def suffix_keys(rows: DataFrame) -> DataFrame:
    """(doc_id, pre, key) -> unique: the key, then key-2, key-3 …, skipping those taken (fold in pandas for each document)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, taken, out = pdf.sort_values("pre"), set(), []
        for key in pdf["key"]:
            k, n = key, 2
            while k in taken:
                k, n = f"{key}-{n}", n + 1
            taken.add(k)
            out.append(k)
        return pdf.assign(unique=out)[["doc_id", "pre", "key", "unique"]]

    return rows.select("doc_id", "pre", "key").groupBy("doc_id").applyInPandas(fold, "doc_id string, pre long, key string, unique string")


def grid_occupancy(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row_idx, col_idx, colspan, rowspan) -> one row for each grid place, with the origin that covers it and whether it continues a row span."""
    c = cells.withColumn("r", F.explode(F.sequence("row_idx", F.col("row_idx") + F.greatest("rowspan", F.lit(1)) - 1))).withColumn("c", F.explode(F.sequence("col_idx", F.col("col_idx") + F.greatest("colspan", F.lit(1)) - 1)))
    return c.select("doc_id", "table_id", "r", "c", F.col("row_idx").alias("origin_row"), F.col("col_idx").alias("origin_col"), (F.col("r") > F.col("row_idx")).alias("continues"))


def max_columns(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, columns): the largest sum of column spans of a row, at least 1."""
    rows = cells.groupBy("doc_id", "table_id", "row_idx").agg(F.sum(F.greatest(F.coalesce("colspan", F.lit(1)), F.lit(1))).alias("n"))
    return rows.groupBy("doc_id", "table_id").agg(F.greatest(F.max("n"), F.lit(1)).alias("columns"))


def table_spacers(blocks: DataFrame) -> DataFrame:
    """Tables whose previous sibling is a table too: a spacer goes before them."""
    w = Window.partitionBy("doc_id", "parent", "slot").orderBy("pre")
    return blocks.withColumn("_p", F.lag("kind").over(w)).where("kind = 'table' AND _p = 'table'").drop("_p")


def last_in_cell(blocks: DataFrame) -> DataFrame:
    """The last paragraph of each cell."""
    w = Window.partitionBy("doc_id", "parent").orderBy(F.col("pre").desc())
    return blocks.where("slot = 'cell' AND kind = 'paragraph'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def numbering_specs(nodes: DataFrame) -> DataFrame:
    """Lists in pre-order with their numbering number from 0; term lists have none."""
    return nodes.where("kind = 'list' AND coalesce(attrs['format'], '') <> 'term'").withColumn("spec", (F.row_number().over(_doc()) - 1).cast("long"))


def descendants(nodes: DataFrame, ancestor_kind: str) -> DataFrame:
    """(doc_id, ancestor, pre) of the nodes inside nodes of a kind, by the interval test on pre and post."""
    a, d = nodes.where(F.col("kind") == ancestor_kind).alias("a"), nodes.alias("d")
    inside = (F.col("a.doc_id") == F.col("d.doc_id")) & (F.col("a.pre") < F.col("d.pre")) & (F.col("d.post") < F.col("a.post"))
    return a.join(d, inside).select(F.col("a.doc_id").alias("doc_id"), F.col("a.pre").alias("ancestor"), F.col("d.pre").alias("pre"))
