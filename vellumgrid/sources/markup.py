"""Lightweight markup to rows: a text becomes one row for each node of its tree, numbered in pre- and post-order.

The scanner is sequential by nature, so it runs as Python over Arrow batches of texts; all that follows (counters,
references, statistics) is SQL over the rows. Nothing is evaluated: what would need an evaluator becomes a raw node.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import scan

NODE_SCHEMA = "doc_id string, pre int, post int, parent int, depth int, ord int, slot string, cls string, kind string, text string, level int, label string, numbering string, supplement string, attrs map<string,string>, style map<string,string>"
_NODES = pa.schema([("doc_id", pa.string()), ("pre", pa.int32()), ("post", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("ord", pa.int32()), ("slot", pa.string()), ("cls", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("label", pa.string()), ("numbering", pa.string()), ("supplement", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("style", pa.map_(pa.string(), pa.string()))])
STRUCTURE = ("list_item", "row", "cell")
BLOCKS = ("paragraph", "heading", "list", "table", "figure", "quote", "code", "math_block", "divider", "break_block", "control", "raw_block")
INLINES = ("text", "break", "link", "reference", "bookmark", "image", "math", "note", "field", "citation", "comment_anchor", "change", "raw_inline")
SHAPES = ("rect", "square", "circle", "ellipse", "line", "polygon", "curve")
LAYOUT = ("par", "align", "block", "box", "pad", "columns", "place", "rotate", "scale", "skew", "move", "hide", "stack")
TEXT_KEYS = {"font": "font", "size": "size", "fill": "color", "lang": "lang", "region": "region", "tracking": "tracking", "baseline": "baseline", "weight": "weight", "style": "slant", "dir": "dir", "highlight": "highlight"}
PAR_KEYS = {"first-line-indent": "first_line", "hanging-indent": "hanging", "leading": "leading", "justify": "justify", "spacing": "spacing"}
WRAPPERS = {"strong": ("bold", "true"), "emph": ("italic", "true"), "underline": ("underline", "true"), "overline": ("overline", "true"), "strike": ("strike", "true"), "smallcaps": ("small_caps", "true"), "upper": ("caps", "true"), "super": ("vertical", "superscript"), "sub": ("vertical", "subscript"), "highlight": ("highlight", "yellow")}
MAX_INCLUDE_DEPTH = 16


@dataclass
class Node:
    kind: str
    slot: str = "body"
    text: str | None = None
    level: int | None = None
    label: str | None = None
    numbering: str | None = None
    supplement: str | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    style: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    @property
    def cls(self) -> str:
        return "structure" if self.kind in STRUCTURE else "inline" if self.kind in INLINES else "section" if self.kind in ("section", "document", "resource", "warning") else "block"


@dataclass
class Context:
    """Set rules and variables in force; nested content gets a copy."""

    text: dict[str, str] = field(default_factory=dict)
    par: dict[str, str] = field(default_factory=dict)
    rules: dict[str, dict[str, str]] = field(default_factory=dict)
    variables: dict = field(default_factory=dict)

    def nested(self) -> Context:
        return Context(dict(self.text), dict(self.par), {k: dict(v) for k, v in self.rules.items()}, dict(self.variables))

    def rule(self, element: str, key: str) -> str | None:
        return scan.text_value(self.rules.get(element, {}).get(key))


class Parser:
    def __init__(self) -> None:
        self.document: dict[str, str] = {}
        self.sections: list[dict[str, str]] = [{}]
        self.warnings: list[str] = []
        self.notes = 0
        self.depth = 0
        self.filled = False  # whether a block of the text itself came before what is looked at

    # --- blocks -------------------------------------------------------------------------------------------------

    def blocks(self, s: str, ctx: Context) -> list[Node]:
        self.depth += 1
        try:
            return self._blocks(s, ctx)
        finally:
            self.depth -= 1

    def _blocks(self, s: str, ctx: Context) -> list[Node]:
        out: list[Node] = []
        open_: list[str] = []

        def flush() -> None:
            if open_:
                inlines = self.inlines("\n".join(open_), ctx)
                if inlines:
                    out.append(Node("paragraph", style=dict(ctx.par), children=inlines))
                open_.clear()

        lines, i = s.split("\n"), 0
        starts = [0]
        for line in lines:
            starts.append(starts[-1] + len(line) + 1)

        def line_of(place: int, at: int) -> int:
            while at + 1 < len(lines) and starts[at + 1] <= place:
                at += 1
            return at

        while i < len(lines):
            line = lines[i]
            t = line.strip()
            if not t:
                flush()
                i += 1
            elif t.startswith("//"):
                i += 1
            elif t.startswith("/*"):
                end = scan.comment_end(s, starts[i] + line.index("/*"))
                k = line_of(end, i)
                rest = s[end : starts[k] + len(lines[k])]
                lines[k] = rest if k > i or end < starts[i] + len(line) else ""
                starts[k] = end if lines[k] else starts[k]
                i = k if lines[k].strip() else k + 1
            elif m := re.match(r"(`{3,})\s*([A-Za-z0-9_+-]*)\s*$", t):
                flush()
                k = i + 1
                while k < len(lines) and not lines[k].strip().startswith(m[1]):
                    k += 1
                out.append(Node("code", text="\n".join(lines[i + 1 : k]), attrs={"language": m[2]} if m[2] else {}, style={"font": "mono", "scale": "0.8"}))
                i = k + 1
            elif m := re.match(r"(=+)\s+(.*)$", t):
                flush()
                body, label = self.trailing_label(m[2])
                out.append(self.heading(body, min(6, len(m[1])), label, ctx))
                i += 1
            elif re.match(r"[-+/](\s|$)", t):
                flush()
                i = self.markup_list(lines, i, ctx, out)
            elif t.startswith("$") and (found := self.math_block(s, starts[i] + line.index("$"))):
                flush()
                end, math, label = found
                out.append(self.equation(math, label, ctx))
                i = line_of(end, i) + 1
            elif t.startswith("#") and (call := scan.hash_expression(s, starts[i] + line.index("#"))):
                end_line = line_of(max(call.end - 1, 0), i)
                rest = s[call.end : starts[end_line] + len(lines[end_line])]
                if self.depth == 1:
                    self.filled = bool(out or open_)
                nodes = self.top(call, ctx) if not rest.strip(" \t;") or call.command else None
                if nodes is None:
                    # Part of a paragraph; a call may span lines.
                    open_.extend(lines[i : end_line + 1])
                else:
                    flush()
                    out.extend(nodes)
                i = end_line + 1
            else:
                open_.append(line)
                i += 1
        flush()
        return out

    @staticmethod
    def trailing_label(s: str) -> tuple[str, str | None]:
        m = re.match(r"(.*?)\s*<([A-Za-z0-9_.:-]+)>\s*$", s, re.S)
        return (m[1], m[2]) if m else (s, None)

    def heading(self, body: str, level: int, label: str | None, ctx: Context, numbering: str | None = None, supplement: str | None = None) -> Node:
        style = dict(ctx.text)
        if "size" in style and (size := re.match(r"([\d.]+)(\w*)$", style["size"])):
            style["size"] = f"{float(size[1]) * {1: 1.4, 2: 1.2}.get(level, 1.0):g}{size[2]}"
        return Node("heading", level=level, label=label, numbering=numbering or ctx.rule("heading", "numbering"), supplement=supplement or ctx.rule("heading", "supplement"), style=style, children=self.inlines(body, ctx))

    def equation(self, math: str, label: str | None, ctx: Context, numbering: str | None = None) -> Node:
        return Node("math_block", text=math.strip(), label=label, numbering=numbering or ctx.rule("math.equation", "numbering"), supplement=ctx.rule("math.equation", "supplement"))

    @staticmethod
    def math_block(s: str, i: int) -> tuple[int, str, str | None] | None:
        """A display equation: white space inside both dollars, and nothing after it on its line but a label."""
        j = i + 1
        while j < len(s) and s[j] != "$":
            j += 2 if s[j] == "\\" else scan.string_end(s, j) - j if s[j] == '"' else 1
        if j >= len(s):
            return None
        math = s[i + 1 : j]
        if not (math[:1].isspace() and math[-1:].isspace()):
            return None
        m = re.compile(r"[ \t]*(?:<([A-Za-z0-9_.:-]+)>)?[ \t]*(?=\n|$)").match(s, j + 1)
        return (m.end(), math, m[1]) if m else None

    def markup_list(self, lines: list[str], i: int, ctx: Context, out: list[Node]) -> int:
        """Nested lists by indent; a change of marker at the same indent starts a new list."""
        stack: list[tuple[int, Node]] = []
        first = None
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                break
            indent = len(line) - len(line.lstrip(" \t"))
            m = re.match(r"([-+/])(?:\s+(.*))?$", line.strip())
            if first is None:
                first = indent
            if not m:
                if indent > first and stack and stack[-1][1].children:
                    item = stack[-1][1].children[-1]
                    para = next((c for c in item.children if c.kind == "paragraph"), None)
                    extra = self.inlines(" " + line.strip(), ctx)
                    if para is None:
                        item.children.insert(0, Node("paragraph", "item", children=extra))
                    else:
                        para.children = merged(para.children + extra)
                    i += 1
                    continue
                break
            if indent < first:
                break
            kind = {"-": "bullet", "+": "decimal", "/": "term"}[m[1]]
            while stack and indent < stack[-1][0]:
                stack.pop()
            if not (stack and stack[-1][0] == indent and stack[-1][1].attrs["format"] == kind):
                new = Node("list", attrs={"format": kind, "ordered": str(kind == "decimal").lower(), "start": "1"}, numbering=ctx.rule("enum", "numbering") if kind == "decimal" else None)
                if stack and indent > stack[-1][0] and stack[-1][1].children:
                    new.slot = "item"
                    stack[-1][1].children[-1].children.append(new)
                else:
                    if stack and stack[-1][0] == indent:
                        stack.pop()
                    if stack and stack[-1][1].children:
                        new.slot = "item"
                        stack[-1][1].children[-1].children.append(new)
                    else:
                        out.append(new)
                stack.append((indent, new))
            body = m[2] or ""
            item = Node("list_item", "item", level=len(stack) - 1)
            if kind == "term":
                term, _, body = body.partition(":")
                item.attrs["term"] = term.strip()
            content = self.inlines(body.strip(), ctx)
            if content:
                item.children.append(Node("paragraph", "item", children=content))
            stack[-1][1].children.append(item)
            i += 1
        return i

    # --- expressions in block position ---------------------------------------------------------------------------

    def content(self, raw: str, ctx: Context, slot: str = "body") -> list[Node]:
        """Nested content as blocks, with a copy of the context."""
        v = scan.literal(raw, ctx.variables)
        nodes = self.blocks(v[1] if isinstance(v, tuple) else str(v if v is not None else ""), ctx.nested())
        for n in nodes:
            n.slot = slot
        return nodes

    def bodies(self, call: scan.Call) -> list[str]:
        return [p for p in call.positional if p.startswith("[")] + [f"[{b}]" for b in call.bodies]

    def top(self, call: scan.Call, ctx: Context) -> list[Node] | None:
        name, arg = call.name, lambda k: scan.text_value(call.named.get(k), ctx.variables)
        if call.command == "set":
            # A page rule after content begins a page of its own, i.e. a section that keeps what isn't set anew.
            new = call.name == "page" and self.depth == 1 and self.filled
            if new:
                self.sections.append(dict(self.sections[-1]))
            self.set_rule(call, ctx)
            return [Node("break_block", attrs={"type": "section"})] if new else []
        if call.command == "let":
            m = re.match(r"([A-Za-z_][\w-]*)\s*(\([^)]*\))?\s*=\s*(.*)$", call.argument, re.S)
            if m:
                ctx.variables[m[1]] = m[3].strip() if m[2] else scan.literal(m[3], ctx.variables)
            return []
        if call.command == "include":
            return [Node("raw_block", text=call.source, attrs={"include": scan.text_value(call.argument) or ""})]
        if call.command in ("import", "show"):
            return [Node("raw_block", text=call.source, attrs={"command": call.command})]
        first = call.positional[0] if call.positional else None
        if name == "pagebreak":
            return [Node("break_block", attrs={"type": "page"})]
        if name == "colbreak":
            return [Node("break_block", attrs={"type": "column"})]
        if name in ("line", "divider") and not call.bodies and (name == "divider" or "100%" in call.named.get("length", "")):
            return [Node("divider")]
        if name in ("heading", "title"):
            level = 0 if name == "title" else int(scan.literal(call.named.get("level") or call.named.get("depth") or "1") or 1)
            body = next(iter(self.bodies(call)), first or "")
            return [self.heading(scan.text_value(body, ctx.variables) or "", level, call.label or None, ctx, arg("numbering"), arg("supplement"))]
        if name in ("table", "grid"):
            return [self.table(call, ctx)]
        if name == "figure":
            return [self.figure(call, ctx)]
        if name == "quote":
            n = Node("quote", attrs={"block": arg("block") or "false"}, children=[c for b in self.bodies(call) for c in self.content(b, ctx, "quote")])
            if "attribution" in call.named:
                n.children += [replace(x, slot="attribution") for x in self.inlines(arg("attribution") or "", ctx)]
            return [n]
        if name == "raw":
            if arg("block") != "true":
                return None
            return [Node("code", text=scan.text_value(first) or "", attrs={"language": arg("lang")} if arg("lang") else {})]
        if name == "math.equation":
            body = (call.bodies or [first or ""])[0]
            return [self.equation(body.strip().strip("$"), call.label or None, ctx, arg("numbering"))]
        if name in ("list", "enum", "terms"):
            return [self.list_call(call, ctx)]
        if name in ("image", *SHAPES):
            return [Node("paragraph", children=[self.image(call, ctx)])]
        if name in ("outline", "bibliography"):
            code = "TOC" if name == "outline" else "BIBLIOGRAPHY"
            return [Node("paragraph", children=[Node("field", text=code, attrs={"source": call.source})])]
        if name in LAYOUT and self.bodies(call):
            inner = ctx.nested()
            if name == "align" and first:
                inner.par["align"] = first.split("+")[-1].strip()
            for key, own in PAR_KEYS.items():
                if name in ("par", "block") and key in call.named:
                    inner.par[own] = arg(key) or ""
            return [n for b in self.bodies(call) for n in self.blocks(scan.text_value(b) or "", inner)]
        if not name and call.bodies:
            b = call.bodies[0]
            return self.blocks(b[1:-1], ctx.nested()) if b[0] == "[" else [Node("raw_block", text=call.source)]
        if name in ("text", "emph", "strong", "link", "ref", "cite", "footnote", "h", "box", *WRAPPERS, "counter", "datetime", "context", "linebreak", "label", "metadata") or name in ctx.variables:
            return None
        if name == "v":
            return []
        return [Node("raw_block", text=call.source, attrs={"call": name})]

    def set_rule(self, call: scan.Call, ctx: Context) -> None:
        name, named = call.name, {k: v for k, v in call.named.items()}
        text = {k: scan.text_value(v, ctx.variables) or "" for k, v in named.items()}
        if name == "document":
            self.document.update({k: v for k, v in text.items() if k in ("title", "author", "description", "keywords", "date")})
        elif name in ("page", "columns"):
            own = self.sections[-1]
            margin = scan.literal(named.get("margin"), ctx.variables) if "margin" in named else None
            if isinstance(margin, dict):
                for side, axes in (("top", "y"), ("bottom", "y"), ("left", "x"), ("right", "x")):
                    if (v := margin.get(side, margin.get(axes, margin.get("rest")))) is not None:
                        own[f"margin_{side}"] = str(v)
            elif margin is not None:
                own.update({f"margin_{side}": str(margin) for side in ("top", "bottom", "left", "right")})
            own.update({k: v for k, v in text.items() if k in ("width", "height", "columns", "numbering", "number-align", "paper", "flipped", "gutter", "header", "footer")})
        elif name == "text":
            ctx.text.update({TEXT_KEYS[k]: v for k, v in text.items() if k in TEXT_KEYS})
            if call.positional and re.match(r"[\d.]+(pt|em|mm|cm|in)$", call.positional[0]):
                ctx.text["size"] = call.positional[0]
        elif name == "par":
            ctx.par.update({PAR_KEYS[k]: v for k, v in text.items() if k in PAR_KEYS})
        elif name in ("heading", "figure", "math.equation", "list", "enum"):
            ctx.rules.setdefault(name, {}).update(named)
        else:
            self.warnings.append(f"unsupported set rule: {name}")

    def cell(self, raw: str, ctx: Context) -> Node:
        n = Node("cell", "cell", attrs={"colspan": "1", "rowspan": "1"})
        m = re.match(r"(?:table|grid)\.cell\s*\(", raw)
        if m:
            end = scan.balanced(raw, m.end() - 1)
            positional, named = scan.arguments(raw[m.end() : end - 1])
            for k in ("colspan", "rowspan", "fill", "align", "x", "y"):
                if k in named:
                    n.attrs[k] = scan.text_value(named[k]) or ""
            body = raw[end:].strip() or next((p for p in positional if p.startswith("[")), positional[0] if positional else "")
            n.children = self.content(body, ctx, "cell")
        else:
            n.children = self.content(raw, ctx, "cell")
        return n

    def table(self, call: scan.Call, ctx: Context) -> Node:
        columns = scan.literal(call.named.get("columns", "1"), ctx.variables)
        wide = columns if isinstance(columns, int) else len(columns) if isinstance(columns, list) else 1
        cells: list[tuple[Node, bool]] = []
        for raw in [*call.positional, *(f"[{b}]" for b in call.bodies)]:
            m = re.match(r"(?:table|grid)\.(header|footer)\s*\(", raw)
            if m:
                positional, _ = scan.arguments(raw[m.end() : scan.balanced(raw, m.end() - 1) - 1])
                cells += [(self.cell(p, ctx), m[1] == "header") for p in positional]
            elif not re.match(r"(?:table|grid)\.(hline|vline)", raw):
                cells.append((self.cell(raw, ctx), False))
        n = Node("table", label=call.label or None, attrs={"columns": str(max(wide, 1)), "widths": call.named.get("columns", "")})
        n.children = place_cells(cells, max(wide, 1))
        return n

    def figure(self, call: scan.Call, ctx: Context) -> Node:
        arg = lambda k: scan.text_value(call.named.get(k), ctx.variables)
        body = next(iter(call.positional), None) or (f"[{call.bodies[0]}]" if call.bodies else "")
        inner = self.content(body, ctx, "figure_body") if body.startswith("[") else [replace(x, slot="figure_body") for x in (self.blocks("#" + body, ctx.nested()) if body else [])]
        kind = arg("kind") or ("table" if any(x.kind == "table" for x in inner) else "image")
        given = call.named.get("numbering", ctx.rules.get("figure", {}).get("numbering", '"1"'))
        n = Node("figure", label=call.label or None, numbering=scan.text_value(given), supplement=arg("supplement") or ctx.rule("figure", "supplement"), attrs={"kind": kind}, children=inner)
        if "caption" in call.named:
            n.children += [replace(x, slot="caption") for x in self.inlines(arg("caption") or "", ctx)]
        return n

    def list_call(self, call: scan.Call, ctx: Context) -> Node:
        kind = {"list": "bullet", "enum": "decimal", "terms": "term"}[call.name]
        n = Node("list", attrs={"format": kind, "ordered": str(kind == "decimal").lower(), "start": scan.text_value(call.named.get("start")) or "1"}, numbering=scan.text_value(call.named.get("numbering")) or ctx.rule("enum", "numbering"))
        for raw in self.bodies(call):
            n.children.append(Node("list_item", "item", level=0, children=self.content(raw, ctx, "item")))
        return n

    def image(self, call: scan.Call, ctx: Context) -> Node:
        arg = lambda k: scan.text_value(call.named.get(k), ctx.variables)
        attrs = {k: v for k in ("width", "height", "alt", "fill", "stroke", "radius") if (v := arg(k))}
        if call.name == "image":
            attrs["path"] = scan.text_value(call.positional[0], ctx.variables) if call.positional else ""
        else:
            attrs["shape"] = call.name
        return Node("image", attrs=attrs)

    # --- inlines -------------------------------------------------------------------------------------------------

    def inlines(self, s: str, ctx: Context, style: dict[str, str] | None = None) -> list[Node]:
        style = dict(ctx.text) if style is None else style
        out: list[Node] = []
        buf: list[str] = []

        def flush() -> None:
            if buf:
                out.append(Node("text", "inline", "".join(buf), style=dict(style)))
                buf.clear()

        i = 0
        while i < len(s):
            c = s[i]
            if s.startswith(("//", "/*"), i):
                i = scan.comment_end(s, i)
            elif c == "\\":
                if i + 1 >= len(s) or s[i + 1] in "\n ":
                    flush()
                    out.append(Node("break", "inline", attrs={"type": "line"}))
                elif m := re.compile(r"\\u\{([0-9A-Fa-f]+)\}").match(s, i):
                    buf.append(chr(int(m[1], 16)))
                    i = m.end() - 2
                else:
                    buf.append(s[i + 1])
                i += 2
            elif c in "*_" and (end := self.closer(s, i, c)) > 0:
                flush()
                out += self.inlines(s[i + 1 : end], ctx, style | ({"bold": "true"} if c == "*" else {"italic": "true"}))
                i = end + 1
            elif c == "`":
                n = len(s[i:]) - len(s[i:].lstrip("`"))
                end = scan.raw_end(s, i)
                raw = s[i + n : end - n] if n != 2 else ""
                flush()
                if raw:
                    out.append(Node("text", "inline", raw, style=style | {"font": "mono", "raw": "true"}))
                i = end
            elif c == "$" and (end := self.closer(s, i, "$")) > 0:
                flush()
                out.append(Node("math", "inline", s[i + 1 : end].strip()))
                i = end + 1
            elif c == "#" and (call := scan.hash_expression(s, i)):
                flush()
                out += self.expression(call, ctx, style)
                i = call.end + (call.end < len(s) and s[call.end] == ";")
            elif c == "@" and (m := re.compile(r"@([A-Za-z0-9_.:-]+)").match(s, i)) and (key := m[1].rstrip(".,;!?:")):
                flush()
                end = i + 1 + len(key)
                n = Node("reference", "inline", attrs={"target": key, "form": "normal"})
                if end < len(s) and s[end] == "[" and (close := scan.balanced(s, end)) > 0:
                    n.supplement, end = s[end + 1 : close - 1], close
                out.append(n)
                i = end
            elif c == "<" and (m := scan.LABEL.match(s, i)):
                flush()
                out.append(Node("bookmark", "inline", attrs={"name": m[1], "type": "start"}))
                i = m.end()
            elif c == "h" and (m := re.compile(r"https?://[^\s<>\[\]\"]+").match(s, i)):
                url = m[0].rstrip(".,;:!?)")
                flush()
                out.append(Node("link", "inline", attrs={"target": url}, children=[Node("text", "inline", url, style=dict(style))]))
                i += len(url)
            else:
                buf.append(" " if c == "\n" else c)
                i += 1
        flush()
        return merged(out)

    @staticmethod
    def closer(s: str, i: int, c: str) -> int:
        j = i + 1
        while j < len(s):
            if s[j] == "\\":
                j += 2
            elif s[j] == c:
                return j
            elif c == "$" and s[j] == '"':
                j = scan.string_end(s, j)
            elif c != "$" and s[j] == "`":
                j = scan.raw_end(s, j)
            else:
                j += 1
        return -1

    def expression(self, call: scan.Call, ctx: Context, style: dict[str, str]) -> list[Node]:
        name = call.name
        arg = lambda k: scan.text_value(call.named.get(k), ctx.variables)
        first = scan.text_value(call.positional[0], ctx.variables) if call.positional else None
        body = call.bodies[-1] if call.bodies else first or ""
        mark = [Node("bookmark", "inline", attrs={"name": call.label, "type": "start"})] if call.label and name not in ("ref",) else []
        if call.command == "set":
            # A page rule after content begins a page of its own, i.e. a section that keeps what isn't set anew.
            new = call.name == "page" and self.depth == 1 and self.filled
            if new:
                self.sections.append(dict(self.sections[-1]))
            self.set_rule(call, ctx)
            return [Node("break_block", attrs={"type": "section"})] if new else []
        if call.command:
            return [Node("raw_inline", "inline", call.source)]
        if name in WRAPPERS:
            key, value = WRAPPERS[name]
            if name == "highlight" and "fill" in call.named:
                value = call.named["fill"]
            return self.inlines(body, ctx, style | {key: value}) + mark
        if name == "lower":
            return self.inlines(body.lower(), ctx, style) + mark
        if name == "text":
            own = {TEXT_KEYS[k]: scan.text_value(v, ctx.variables) or "" for k, v in call.named.items() if k in TEXT_KEYS}
            for p in call.positional:
                if re.match(r"[\d.]+(pt|em|mm|cm|in)$", p):
                    own["size"] = p
            if own.get("weight") in ("bold", "semibold", "extrabold", "black") or own.get("weight", "").isdigit() and int(own["weight"]) >= 600:
                own["bold"] = "true"
            if own.get("slant") in ("italic", "oblique"):
                own["italic"] = "true"
            return self.inlines(body, ctx, style | own) + mark
        if name == "link":
            target = first or ""
            shown = call.bodies[-1] if call.bodies else target
            return [Node("link", "inline", attrs={"target": target.strip("<>"), "internal": str(target.startswith("<")).lower()}, children=self.inlines(shown, ctx, style) if call.bodies else [Node("text", "inline", shown, style=dict(style))])]
        if name in ("image", *SHAPES):
            n = self.image(call, ctx)
            n.slot = "inline"
            return [n]
        if name in ("linebreak", "parbreak"):
            return [Node("break", "inline", attrs={"type": "line"})]
        if name == "pagebreak":
            return [Node("break", "inline", attrs={"type": "page"})]
        if name == "footnote":
            self.notes += 1
            n = Node("note", "inline", attrs={"note_type": "footnote", "note_id": str(self.notes)})
            n.children = self.content(f"[{body}]", ctx, "note")
            return [n]
        if name == "ref":
            target = (call.positional[0] if call.positional else "").strip("<>")
            return [Node("reference", "inline", supplement=arg("supplement"), attrs={"target": target, "form": arg("form") or "normal"})]
        if name == "cite":
            key = call.positional[0] if call.positional else ""
            m = re.match(r'label\("([^"]*)"\)', key)
            return [Node("citation", "inline", supplement=arg("supplement"), attrs={"keys": m[1] if m else key.strip("<>")})]
        if name == "raw":
            return [Node("text", "inline", first or "", style=style | {"font": "mono", "raw": "true"})]
        if name in LAYOUT and self.bodies(call):
            return [x for b in self.bodies(call) for x in self.inlines(scan.text_value(b) or "", ctx, style)] + mark
        if name == "h":
            return [Node("text", "inline", " ", style=dict(style))]
        if name == "v":
            return []
        if name == "counter" and call.positional[:1] == ["page"]:
            return [Node("field", "inline", "NUMPAGES" if "final" in call.tail else "PAGE", children=[Node("text", "inline", "1")])]
        if name == "context":
            return [Node("raw_inline", "inline", call.source)]
        if name == "datetime.today":
            return [Node("field", "inline", "DATE")]
        if name == "metadata":
            return []
        if not name and call.bodies and call.bodies[0][0] == "[":
            return self.inlines(call.bodies[0][1:-1], ctx, style) + mark
        if name in ctx.variables and not call.positional and not call.bodies:
            v = ctx.variables[name]
            return self.inlines(v[1], ctx, style) if isinstance(v, tuple) else [Node("text", "inline", str(v), style=dict(style))]
        return [Node("raw_inline", "inline", call.source)]


def merged(nodes: list[Node]) -> list[Node]:
    """Adjacent texts of equal style as one."""
    out: list[Node] = []
    for n in nodes:
        if n.kind == "text" and out and out[-1].kind == "text" and out[-1].style == n.style and out[-1].text:
            out[-1] = replace(out[-1], text=out[-1].text + (n.text or ""))
        else:
            out.append(n)
    return out


def place_cells(cells: list[tuple[Node, bool]], wide: int) -> list[Node]:
    """Rows of cells by greedy first fit: a cell takes the first free place that its column span fits; spans block the places below."""
    blocked: dict[int, int] = {}  # column -> first row that is free again
    rows: dict[int, Node] = {}
    r = c = 0
    for cell, header in cells:
        span = min(max(int(cell.attrs.get("colspan") or 1), 1), wide)
        down = max(int(cell.attrs.get("rowspan") or 1), 1)
        while True:
            if c + span > wide:
                r, c = r + 1, 0
            elif any(blocked.get(k, 0) > r for k in range(c, c + span)):
                c += 1
            else:
                break
        for k in range(c, c + span):
            blocked[k] = r + down
        cell.attrs |= {"row": str(r), "col": str(c), "header": str(header).lower(), "colspan": str(span), "rowspan": str(down)}
        rows.setdefault(r, Node("row", "row", attrs={"row": str(r)})).children.append(cell)
        c += span
    return [rows[k] for k in sorted(rows)]


def expanded(text: str | None, sources: dict[str, str | None], path: str, depth: int = 0) -> list[Node]:
    """Top-level nodes of a text with the blocks and warnings of the files it includes in their places, MAX_INCLUDE_DEPTH deep; set rules and variables of a file stay its own, and one that isn't there leaves a warning."""
    out: list[Node] = []
    for n in parse_text(text):
        target = n.attrs.get("include") if n.kind == "raw_block" else None
        if target is None:
            if n.kind == "warning" or depth == 0 or n.cls == "block":
                out.append(n)
            continue
        folder = path.rpartition("/")[0]
        other = re.sub(r"^\./", "", target)
        other = f"{folder}/{other}" if folder else other
        if depth >= MAX_INCLUDE_DEPTH:
            out.append(Node("warning", "meta", f"include too deep: {target}"))
        elif re.match(r"/|.*\.\.", target) or other not in sources:
            out.append(Node("warning", "meta", f"include not found: {target}"))
        else:
            out += expanded(sources[other], sources, other, depth + 1)
    return [n for n in out if n.kind != "warning"] + [n for n in out if n.kind == "warning"]


def parse_text(text: str | None) -> list[Node]:
    """Top-level nodes of a text: its blocks, then a document node and its section and warning nodes."""
    p = Parser()
    out = p.blocks((text or "").replace("\r\n", "\n"), Context())
    if p.document:
        out.append(Node("document", "meta", attrs=p.document))
    out += [Node("section", "meta", attrs=s) for s in p.sections if s or len(p.sections) > 1]
    return out + [Node("warning", "meta", w) for w in p.warnings]


def flatten(doc_id: str | None, nodes: list[Node]) -> Iterator[dict]:
    """Rows of a forest, numbered in pre- and post-order."""
    count = [0, 0]

    def walk(n: Node, parent: int | None, depth: int, at: int) -> Iterator[dict]:
        pre = count[0]
        count[0] += 1
        row = {"doc_id": doc_id, "pre": pre, "parent": parent, "depth": depth, "ord": at, "slot": n.slot, "cls": n.cls, "kind": n.kind, "text": n.text, "level": n.level, "label": n.label, "numbering": n.numbering, "supplement": n.supplement, "attrs": list(n.attrs.items()), "style": list(n.style.items())}
        below = [x for k, c in enumerate(n.children) for x in walk(c, pre, depth + 1, k)]
        row["post"] = count[1]
        count[1] += 1
        yield row
        yield from below

    for k, n in enumerate(nodes):
        yield from walk(n, None, 0, k)


def tree(rows: list[dict]) -> list[Node]:
    """Inverse of flatten() for one document's rows."""
    made: dict[int, Node] = {}
    roots: list[Node] = []
    for r in sorted(rows, key=lambda r: r["pre"]):
        n = Node(r["kind"], r["slot"], r["text"], r["level"], r["label"], r["numbering"], r["supplement"], dict(r["attrs"] or {}), dict(r["style"] or {}))
        made[r["pre"]] = n
        (roots if r["parent"] is None else made[r["parent"]].children).append(n)
    return roots


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[dict] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.extend(flatten(doc_id, parse_text(text)))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_pylist(rows, schema=_NODES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_NODES)


def parse(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The node table (NODE_SCHEMA) of texts; works on batch and streaming frames alike, as it keeps no state."""
    return docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_parse_batches, NODE_SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row for each file under path, its path the key."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def includes(files: DataFrame) -> DataFrame:
    """(doc_id, included, depth): files reached by static includes, up to MAX_INCLUDE_DEPTH deep. Paths are relative to the including file and can't leave the corpus: one that names no row is dropped."""
    hit = F.explode(F.regexp_extract_all("text", F.lit(r'(?m)^\s*#include\s+"([^"]+)"'), F.lit(1)))
    folder = F.regexp_extract("doc_id", r"^(.*/)?[^/]*$", 1)
    edges = files.select("doc_id", hit.alias("p"), folder.alias("folder")).where(~F.col("p").rlike(r"(^/|\.\.)")).select("doc_id", F.concat("folder", F.regexp_replace("p", r"^\./", "")).alias("included"))
    edges = edges.join(files.select(F.col("doc_id").alias("included")), "included", "left_semi").select("doc_id", "included").distinct()
    view = f"_includes_{uuid.uuid4().hex}"
    edges.createOrReplaceTempView(view)
    try:
        return files.sparkSession.sql(f"""WITH RECURSIVE reach(doc_id, included, depth) AS (
        SELECT doc_id, included, 1 FROM {view}
        UNION ALL SELECT r.doc_id, e.included, r.depth + 1 FROM reach r JOIN {view} e ON r.included = e.doc_id WHERE r.depth < {MAX_INCLUDE_DEPTH})
      SELECT doc_id, included, min(depth) AS depth FROM reach GROUP BY doc_id, included""")
    finally:
        files.sparkSession.catalog.dropTempView(view)


def parse_with_includes(files: DataFrame) -> DataFrame:
    """The node table of texts (doc_id: their path, text) with included files merged in. A text meets the files it reaches, no others."""
    texts = files.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    reached = includes(texts).join(texts.select(F.col("doc_id").alias("included"), F.col("text").alias("source")), "included")
    own = reached.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("included", "source"))).alias("sources"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, sources in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(flatten(doc_id, expanded(text, dict(sources or ()), doc_id or "")))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_NODES)

    return texts.join(own, "doc_id", "left").select("doc_id", "text", "sources").mapInArrow(run, NODE_SCHEMA)
