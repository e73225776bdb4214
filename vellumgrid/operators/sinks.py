"""Node tables back to files: markup text and packages. A document's nodes meet in one group (its rows never span partitions after the parse) and are rendered bottom-up."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import binary
from vellumgrid.operators import corpus
from vellumgrid.operators.package_writer import PackageWriter
from vellumgrid.sources.markup import Node, tree

_SPECIAL = re.compile(r"([\\#*_`$@<>\[\]~])")
#: Wrappers from the inside out.
_WRAP = [("bold", "strong"), ("italic", "emph"), ("underline", "underline"), ("strike", "strike"), ("small_caps", "smallcaps"), ("caps", "upper")]


def escape(text: str) -> str:
    text = _SPECIAL.sub(r"\\\1", text)
    text = re.sub(r"/(?=[/*])", r"\\/", text)
    return re.sub(r"(?m)^([ \t]*)([=+/-])", r"\1\\\2", text)


def quoted(text: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return f'"{text}"'


# --- markup -------------------------------------------------------------------------------------------------------


class MarkupWriter:
    """One text. The k-th section break sets the page as the section after it does."""

    def page(self, n: Node) -> str | None:
        plain = ("columns", "flipped")
        length = r"[-.0-9]+(pt|mm|cm|in|em)$"
        args = [f"{k}: {v if k in plain or v == 'auto' or re.match(length, v) else quoted(v)}" for k, v in n.attrs.items() if k in ("width", "height", "columns", "paper", "flipped", "numbering")]
        sides = [f"{k[7:]}: {v}" for k, v in n.attrs.items() if k in ("margin_top", "margin_right", "margin_bottom", "margin_left")]
        if sides:
            args.append(f"margin: ({', '.join(sides)})")
        return f"#set page({', '.join(args)})" if args else None

    def text(self, nodes: list[Node]) -> str:
        head = ["#set document(" + ", ".join(f"{k}: {quoted(v)}" for k, v in n.attrs.items()) + ")" for n in nodes if n.kind == "document" and n.attrs]
        self.sections = [n for n in nodes if n.kind == "section"]
        if self.sections and (first := self.page(self.sections.pop(0))):
            head.append(first)
        body = self.blocks([n for n in nodes if n.cls == "block"])
        # Comments go by their ids as strings.
        notes = sorted((n for n in nodes if n.kind == "comment"), key=lambda n: n.attrs.get("id", ""))
        comments = [f"// comment {n.attrs.get('id', '')} by {n.attrs.get('author', '')}: " + self.plain(n).replace("\n", " ") for n in notes]
        return "\n".join(head) + ("\n\n" if head else "") + body + ("\n\n" + "\n".join(comments) if comments else "") + "\n"

    def plain(self, n: Node) -> str:
        return (n.text or "") + "".join(map(self.plain, n.children))

    def blocks(self, nodes: list[Node]) -> str:
        return "\n\n".join(t for n in nodes if (t := self.block(n)))

    def block(self, n: Node) -> str:
        mark = f" <{n.label}>" if n.label else ""
        inner = [c for c in n.children if c.cls == "inline"]
        if n.kind == "paragraph":
            return self.inlines(inner)
        if n.kind == "heading":
            return f"#title[{self.inlines(inner)}]{mark}" if n.level == 0 else f"{'=' * (n.level or 1)} {self.inlines(inner)}{mark}"
        if n.kind == "list":
            pattern = n.numbering if n.attrs.get("format") == "decimal" and n.numbering not in (None, "1.") else None
            return f"#[#set enum(numbering: {quoted(pattern)})\n{self.list(n, 0)}\n]" if pattern else self.list(n, 0)
        if n.kind == "code":
            fence = "`" * max(3, 1 + max((len(m) for m in re.findall(r"`+", n.text or "")), default=0))
            return f"{fence}{n.attrs.get('language', '')}\n{n.text or ''}\n{fence}"
        if n.kind == "math_block":
            return f"$ {n.text or ''} ${mark}"
        if n.kind == "break_block":
            if n.attrs.get("type") == "section" and self.sections and (rule := self.page(self.sections.pop(0))):
                return rule
            return "#colbreak()" if n.attrs.get("type") == "column" else "#pagebreak()"
        if n.kind == "divider":
            return "#line(length: 100%)"
        if n.kind == "quote":
            who = self.inlines([c for c in inner if c.slot == "attribution"])
            return f"#quote(block: true{f', attribution: [{who}]' if who else ''})[{self.blocks([c for c in n.children if c.cls == 'block'])}]"
        if n.kind == "table":
            rows = []
            for r in n.children:
                cells = []
                for c in r.children:
                    spans = [f"{k}: {c.attrs[k]}" for k in ("colspan", "rowspan") if c.attrs.get(k, "1") != "1"]
                    body = f"[{self.blocks(c.children)}]"
                    cells.append(f"table.cell({', '.join(spans)}){body}" if spans else body)
                header = bool(r.children) and all(c.attrs.get("header") == "true" for c in r.children)
                rows.append("  " + (f"table.header({', '.join(cells)})" if header else ", ".join(cells)) + ",\n")
            return f"#table(\n  columns: {n.attrs.get('columns', '1')},\n{''.join(rows)}){mark}"
        if n.kind == "figure":
            body = self.blocks([c for c in n.children if c.slot == "figure_body"])
            caption = self.inlines([c for c in n.children if c.slot == "caption"])
            args = [f"kind: {quoted(n.attrs['kind'])}" if n.attrs.get("kind") not in (None, "image", "table") else "", f"supplement: [{escape(n.supplement)}]" if n.supplement else "", f"caption: [{caption}]" if caption else ""]
            return f"#figure({', '.join(a for a in args if a)})[{body}]{mark}"
        if n.kind == "control":
            return self.blocks(n.children)
        return n.text or "" if n.kind == "raw_block" and n.attrs.get("format") is None else ""

    def list(self, n: Node, depth: int) -> str:
        marker = {"decimal": "+", "term": "/"}.get(n.attrs.get("format", "bullet"), "-")
        out = []
        for item in n.children:
            first = next((c for c in item.children if c.kind == "paragraph"), None)
            body = self.inlines(first.children) if first else ""
            term = f"{item.attrs['term']}: " if "term" in item.attrs else ""
            out.append(f"{'  ' * depth}{marker} {term}{body}")
            out += [self.list(c, depth + 1) for c in item.children if c.kind == "list"]
        return "\n".join(out)

    def inlines(self, nodes: list[Node]) -> str:
        return "".join(self.inline(n, nodes[k + 1] if k + 1 < len(nodes) else None) for k, n in enumerate(nodes))

    def inline(self, n: Node, after: Node | None) -> str:
        k, a = n.kind, n.attrs
        if k == "text":
            return self.styled(n)
        if k == "break":
            return "\t" if a.get("type") == "tab" else "#pagebreak()" if a.get("type") == "page" else "#linebreak()"
        if k == "link":
            target = f"<{a['target']}>" if a.get("internal") == "true" else quoted(a.get("target", ""))
            return f"#link({target})[{self.inlines(n.children)}]"
        if k == "reference":
            if a.get("form") == "page":
                return f'#ref(<{a["target"]}>, form: "page")'
            return f"#ref(<{a['target']}>{f', supplement: [{escape(n.supplement)}]' if n.supplement else ''})"
        if k == "bookmark":
            return f"<{a['name']}>" if a.get("type") == "start" else ""
        if k == "math":
            return f"${n.text or ''}$"
        if k == "note":
            return f"#footnote[{self.blocks(n.children)}]"
        if k == "citation":
            return f"#cite(label({quoted(a.get('keys', ''))}))"
        if k == "image" and "path" in a:
            size = "".join(f", {s}: {a[s]}" for s in ("width", "height") if s in a)
            return f"#image({quoted(a['path'])}{size}{', alt: ' + quoted(a['alt']) if 'alt' in a else ''})"
        if k == "field":
            code = (n.text or "").split(" ")[0].upper()
            native = {"PAGE": "#context counter(page).display()", "NUMPAGES": "#context counter(page).final().first()", "SECTIONPAGES": "#context counter(page).final().first()", "TOC": "#outline()", "DATE": "#datetime.today().display()"}
            return native.get(code) or self.inlines(n.children)
        if k == "change":
            return self.inlines(n.children) if a.get("type") in ("insert", "move_to") else ""
        return n.text or "" if k == "raw_inline" and "tag" not in a else ""

    def styled(self, n: Node) -> str:
        s = n.style
        if s.get("raw") == "true":
            return f"#raw({quoted(n.text or '')})"
        out = escape(n.text or "")
        for key, name in _WRAP:
            if s.get(key, "false") not in ("false", "none"):
                out = f"#{name}[{out}]"
        if s.get("vertical") in ("superscript", "subscript"):
            out = f"#{'super' if s['vertical'] == 'superscript' else 'sub'}[{out}]"
        if "highlight" in s and s["highlight"] != "none":
            out = f"#highlight[{out}]"
        args = [f"{k}: {v}" for k, v in (("size", s.get("size")),) if v] + [f"font: {quoted(s['font'])}" for _ in (0,) if s.get("font") not in (None, "mono")]
        if re.fullmatch(r"[0-9A-Fa-f]{6}", s.get("color", "")):
            args.append(f'fill: rgb("#{s["color"].upper()}")')
        return f"#text({', '.join(args)})[{out}]" if args else out


# --- tables of nodes ---------------------------------------------------------------------------------------------


def _rows(pdf: pd.DataFrame) -> list[dict]:
    rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
    for r in rows:
        r["parent"] = None if r["parent"] is None else int(r["parent"])
        r["level"] = None if r["level"] is None else int(r["level"])
    return rows


def _render(nodes: DataFrame, make_one: Callable[[list[Node]], object], column: str, kind: str) -> DataFrame:
    """(doc_id, column): what make_one makes of each document. Documents pass by in the order of their ids, so that a small one costs no group of its own."""
    schema = pa.schema([("doc_id", pa.string()), (column, {"string": pa.string(), "binary": pa.binary()}[kind])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        rows = (r for batch in batches for at in range(0, batch.num_rows, 1000) for r in batch.slice(at, 1000).to_pylist())
        for doc, own in groupby(rows, itemgetter("doc_id")):
            made.append((doc, make_one(tree(list(own)))))
            if len(made) >= 200:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    # A number of its own keeps the partitions apart: small rows make large packages, and much work.
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    used = nodes.select("doc_id", "pre", "parent", "kind", "slot", "text", "level", "label", "numbering", "supplement", "attrs", "style")
    return used.repartition(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, f"doc_id string, {column} {kind}")


def to_markup(nodes: DataFrame) -> DataFrame:
    """(doc_id, text)."""
    return _render(nodes, lambda n: MarkupWriter().text(n), "text", "string")


def to_packages(nodes: DataFrame, media: DataFrame | None = None, revisions: str = "keep") -> DataFrame:
    """(doc_id, content). media (doc_id, key, filename, data): images by resource id or path; one without a row is written as its alternative text. revisions: keep them as such, or accept them."""
    if media is None:
        return _render(nodes, lambda n: PackageWriter(revisions=revisions).package(n), "content", "binary")

    def run(pdf: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"doc_id": [], "content": []})
        rows = _rows(pdf)
        own = {r["key"]: (r["filename"], bytes(r["data"])) for r in files.to_dict("records") if r["data"] is not None}
        return pd.DataFrame({"doc_id": [rows[0]["doc_id"]], "content": [PackageWriter(own, revisions).package(tree(rows))]})

    files = media.select(F.col("doc_id").cast("string"), F.col("key").cast("string"), F.col("filename").cast("string"), "data")
    return nodes.groupBy("doc_id").cogroup(files.groupBy("doc_id")).applyInPandas(run, "doc_id string, content binary")


def write_assets(resources: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes resources (doc_id, id, filename, data) as files path/doc_id/asset, by the names of corpus.asset_names(). Each task writes its own through the cluster's file system API; a file that exists is an error unless overwritten."""
    named = corpus.asset_names(resources).select(F.col("doc_id").cast("string"), "asset", "data")

    def run(batches):
        import os

        from pyarrow import fs

        for batch in batches:
            for doc_id, asset, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, root = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
                target = f"{root.rstrip('/')}/{binary.safe_name(doc_id)}/{asset}"
                if not overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
                    raise FileExistsError(target)
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(data or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    named.dropDuplicates(["doc_id", "asset"]).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def to_json(nodes: DataFrame) -> DataFrame:
    """(doc_id, json): a document's nodes in order; binary data is never part of them, only its length."""
    one = F.to_json(F.struct(*[c for c in nodes.columns if c != "doc_id"]))
    return nodes.select("doc_id", F.struct("pre", one.alias("j")).alias("x")).groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda v: v["j"]), ","), F.lit("]")).alias("json"))
