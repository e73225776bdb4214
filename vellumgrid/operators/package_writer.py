"""One document's nodes as a word-processor package. Every id follows from the nodes' order, so equal nodes give equal bytes."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from vellumgrid.functions import binary, mathml
from vellumgrid.functions import ooxml as x
from vellumgrid.functions.ooxml import in_order, make
from vellumgrid.sources.markup import Node

OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WML = "application/vnd.openxmlformats-officedocument.wordprocessingml."
#: Families that every package names: of running text and of code.
BODY_FONT, MONO_FONT = "Calibri", "Consolas"
# Raw elements that may stand among blocks and among inlines.
RAW_BLOCKS = ("p", "tbl", "sdt", "customXml", "altChunk", "ins", "del", "moveFrom", "moveTo")
RAW_INLINES = ("r", "hyperlink", "sdt", "customXml", "smartTag", "fldSimple", "bookmarkStart", "bookmarkEnd", "commentRangeStart", "commentRangeEnd", "ins", "del", "moveFrom", "moveTo", "oMath", "oMathPara")
# Paper sizes in points, and media types by extension.
PAPERS = {"a3": (841.89, 1190.55), "a4": (595.28, 841.89), "a5": (419.53, 595.28), "us-letter": (612.0, 792.0), "us-legal": (612.0, 1008.0)}
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "bmp": "image/bmp", "tiff": "image/tiff", "webp": "image/webp", "emf": "image/x-emf", "wmf": "image/x-wmf"}
HIGHLIGHTS = ("black", "blue", "cyan", "darkBlue", "darkCyan", "darkGray", "darkGreen", "darkMagenta", "darkRed", "darkYellow", "green", "lightGray", "magenta", "red", "white", "yellow")
FORMATS = {"1": "decimal", "a": "lowerLetter", "A": "upperLetter", "i": "lowerRoman", "I": "upperRoman"}
_XML = "{http://www.w3.org/XML/1998/namespace}"


def points(length: str | None) -> float | None:
    m = re.match(r"(-?[\d.]+)(pt|mm|cm|in)$", length or "")
    return None if not m else float(m[1]) * {"pt": 1, "mm": 72 / 25.4, "cm": 72 / 2.54, "in": 72}[m[2]]


def twips(length: str | None) -> int | None:
    return None if (v := points(length)) is None else round(v * 20)


def on(s: dict[str, str], key: str) -> bool:
    return s.get(key, "false") not in ("false", "none")


def switch(s: dict[str, str], key: str, tag: str) -> ET.Element | None:
    """A property that is set, be it to false."""
    return None if key not in s else make(f"w:{tag}") if on(s, key) else make(f"w:{tag}", w__val="0")


def text_element(text: str, tag: str = "w:t") -> ET.Element:
    e = make(tag, text=text)
    e.set(f"{_XML}space", "preserve")
    return e


def run_properties(s: dict[str, str]) -> ET.Element | None:
    size, font = twips(s.get("size")), s.get("font")
    family = MONO_FONT if font == "mono" else font
    items = [make("w:rFonts", w__ascii=family, w__hAnsi=family) if font else None]
    items += [switch(s, key, tag) for key, tag in (("bold", "b"), ("italic", "i"), ("caps", "caps"), ("small_caps", "smallCaps"), ("strike", "strike"), ("double_strike", "dstrike"), ("outline", "outline"), ("shadow", "shadow"), ("emboss", "emboss"), ("imprint", "imprint"), ("hidden", "vanish"))]
    if re.fullmatch(r"#?[0-9A-Fa-f]{6}", s.get("color", "")):
        items.append(make("w:color", w__val=s["color"].lstrip("#").upper()))
    for key, tag, per_point in (("tracking", "spacing", 20), ("kern", "kern", 2), ("baseline", "position", 2)):
        if (v := points(s.get(key))) is not None:
            items.append(make(f"w:{tag}", w__val=round(v * per_point)))
    items.append(make("w:sz", w__val=round(size / 10)) if size else None)
    items.append(make("w:highlight", w__val=s["highlight"] if s["highlight"] in HIGHLIGHTS else "yellow") if on(s, "highlight") else None)
    items.append(make("w:u", w__val="single" if s["underline"] == "true" else s["underline"]) if on(s, "underline") else None)
    items.append(make("w:vertAlign", w__val=s["vertical"]) if "vertical" in s else None)
    items.append(make("w:lang", w__val=s["lang"]) if "lang" in s else None)
    items = [i for i in items if i is not None]
    return in_order(make("w:rPr", *items)) if items else None


def paragraph_properties(s: dict[str, str], style: str | None = None, num: int | None = None, level: int = 0) -> ET.Element | None:
    items = [make("w:pStyle", w__val=style) if style else None]
    items += [switch(s, key, tag) for key, tag in (("keep_next", "keepNext"), ("keep_lines", "keepLines"), ("page_break_before", "pageBreakBefore"), ("widow_control", "widowControl"), ("bidi", "bidi"), ("contextual", "contextualSpacing"))]
    if num is not None:
        items.append(make("w:numPr", make("w:ilvl", w__val=level), make("w:numId", w__val=num)))
    borders = []
    for side in ("top", "left", "bottom", "right", "between", "bar"):
        if m := re.fullmatch(r"(\S+) ([\d.]+)pt (\S+)", s.get(f"border_{side}", "")):
            borders.append(make(f"w:{side}", w__val=m[1], w__sz=round(float(m[2]) * 8), w__color=m[3]))
    items.append(make("w:pBdr", *borders) if borders else None)
    if tabs := re.findall(r"(\w+)@(-?[\d.]+)pt", s.get("tabs", "")):
        items.append(make("w:tabs", *[make("w:tab", w__val=k, w__pos=round(float(v) * 20)) for k, v in tabs]))
    line, rule = None, None
    if m := re.fullmatch(r"([\d.]+)(pt|em)?", s.get("line", "") or s.get("leading", "")):
        own = "line" in s
        if m[2] == "pt":
            line, rule = round(float(m[1]) * 20), "exact"
        elif own or m[2] == "em":  # leading is what a line has beyond half its size
            line, rule = round((float(m[1]) + (0 if own else 0.5)) * 240), "auto"
    spacing = {"w__before": twips(s.get("before")), "w__after": twips(s.get("after") or s.get("spacing")), "w__line": line, "w__lineRule": rule}
    items.append(make("w:spacing", **spacing) if any(v is not None for v in spacing.values()) else None)
    ind = {"w__left": twips(s.get("left")), "w__right": twips(s.get("right")), "w__firstLine": twips(s.get("first_line")), "w__hanging": twips(s.get("hanging"))}
    items.append(make("w:ind", **ind) if any(v is not None for v in ind.values()) else None)
    align = "both" if s.get("align") == "justify" or on(s, "justify") else s.get("align")
    items.append(make("w:jc", w__val=align) if align in ("left", "center", "right", "both", "start", "end", "distribute") else None)
    items = [i for i in items if i is not None]
    return in_order(make("w:pPr", *items)) if items else None


def level_formats(fmt: str, pattern: str | None) -> list[tuple[str, str]]:
    """(number format, level text) of nine levels: of a numbering pattern, the last of its counters for all deeper ones."""
    if fmt != "decimal":
        return [("bullet", "•") if fmt == "bullet" else ("none", "")] * 9
    found = re.findall(r"([^1aAiI]*)([1aAiI])", pattern or "1.") or [("", "1")]
    last = re.search(r"[^1aAiI]*$", pattern or "1.")[0]
    out = []
    for lvl in range(9):
        before, symbol = found[min(lvl, len(found) - 1)]
        out.append((FORMATS[symbol], f"{before if lvl < len(found) and lvl == 0 else before.strip('.)')}%{lvl + 1}{last}"))
    return out


class PackageWriter:
    def __init__(self, media: dict[str, tuple[str, bytes]] | None = None, revisions: str = "keep") -> None:
        if revisions not in ("keep", "accept"):
            raise ValueError(f"unknown revision policy: {revisions}")
        self.media, self.revisions = media or {}, revisions
        self.at = "word/document.xml"
        self.rels: dict[str, list[tuple[str, str, str]]] = {}
        self.parts: dict[str, bytes] = {}
        self.kinds: dict[str, str] = {}
        self.lists: list[tuple[str, int, str | None]] = []
        self.notes: dict[str, list[ET.Element]] = {"footnote": [], "endnote": []}
        self.marks: dict[str, int] = {}
        self.comments: dict[str, int] = {}
        self.fonts = {BODY_FONT, MONO_FONT}
        self.changes = self.images = 0
        self.even = False

    # --- parts --------------------------------------------------------------------------------------------------

    def rel(self, kind: str, target: str, mode: str = "") -> str:
        """The id of a relationship of the part being written; equal ones share it."""
        own = self.rels.setdefault(self.at, [])
        key = (f"{OFFICE}/{kind}", target, mode)
        if key not in own:
            own.append(key)
        return f"rId{own.index(key) + 1}"

    def put(self, name: str, root: ET.Element, kind: str, relation: str) -> str:
        """Adds a part that the main part names; the id of that relationship."""
        self.parts[name], self.kinds[name] = x.dump(root), kind
        return self.rel(relation, name.removeprefix("word/"))

    def within(self, name: str, blocks: list[Node]) -> list[ET.Element]:
        """Blocks of another part, with relationships of its own."""
        before, self.at = self.at, name
        out = self.blocks(blocks)
        self.at = before
        return out

    def package(self, nodes: list[Node], extra: dict[str, bytes] | None = None) -> bytes:
        remarks = [n for n in nodes if n.kind == "comment"]
        self.comments = {n.attrs.get("id", str(k)): k for k, n in enumerate(remarks)}
        self.sections = [n for n in nodes if n.kind == "section"] or [Node("section", "meta")]
        self.section_no = 0
        body = make("w:body", *self.body([n for n in nodes if n.cls == "block" and n.kind != "comment"]))
        body.append(self.section(self.sections[min(self.section_no, len(self.sections) - 1)]))
        self.put("word/styles.xml", self.styles(), WML + "styles+xml", "styles")
        self.put("word/theme/theme1.xml", theme(), "application/vnd.openxmlformats-officedocument.theme+xml", "theme")
        for kind, made in self.notes.items():
            if made:
                separators = [make(f"w:{kind}", make("w:p", make("w:r", make(f"w:{k}"))), w__type=k, w__id=n) for n, k in ((-1, "separator"), (0, "continuationSeparator"))]
                self.put(f"word/{kind}s.xml", make(f"w:{kind}s", *separators, *made), f"{WML}{kind}s+xml", f"{kind}s")
        if remarks:
            each = [make("w:comment", *(self.within("word/comments.xml", [c for c in n.children if c.cls == "block"]) or [make("w:p")]), w__id=k, w__author=n.attrs.get("author", ""), w__initials=n.attrs.get("initials"), w__date=n.attrs.get("date")) for k, n in enumerate(remarks)]
            self.put("word/comments.xml", make("w:comments", *each), WML + "comments+xml", "comments")
        if self.lists:
            self.put("word/numbering.xml", self.numbering(), WML + "numbering+xml", "numbering")
        self.put("word/settings.xml", make("w:settings", make("w:evenAndOddHeaders") if self.even else None, make("w:defaultTabStop", w__val=720)), WML + "settings+xml", "settings")
        self.put("word/fontTable.xml", make("w:fonts", *[make("w:font", w__name=f) for f in sorted(self.fonts)]), WML + "fontTable+xml", "fontTable")
        self.parts["word/document.xml"], self.kinds["word/document.xml"] = x.dump(make("w:document", body)), WML + "document.main+xml"
        self.properties(next((n.attrs for n in nodes if n.kind == "document"), {}))
        for name, rels in self.rels.items():
            folder, _, base = name.rpartition("/")
            self.parts[f"{folder}/_rels/{base}.rels"] = relationships(rels)
        core = "http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties"
        top = [(f"{OFFICE}/officeDocument", "word/document.xml", ""), (core, "docProps/core.xml", ""), (f"{OFFICE}/extended-properties", "docProps/app.xml", "")]
        if "docProps/custom.xml" in self.parts:
            top.append((f"{OFFICE}/custom-properties", "docProps/custom.xml", ""))
        self.parts["_rels/.rels"] = relationships(top)
        parts = self.parts | (extra or {})
        parts["[Content_Types].xml"] = self.content_types(parts)
        return binary.zip_bytes(parts)

    def content_types(self, parts: dict[str, bytes]) -> bytes:
        root = ET.Element(f"{{{x.CT}}}Types")
        seen = {name.rpartition(".")[2].lower() for name in parts}
        for ext, kind in [("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"), *((e, k) for e, k in MEDIA.items() if e in seen)]:
            ET.SubElement(root, f"{{{x.CT}}}Default", Extension=ext, ContentType=kind)
        for part, kind in sorted(self.kinds.items()):
            ET.SubElement(root, f"{{{x.CT}}}Override", PartName="/" + part, ContentType=kind)
        return x.dump(root)

    def properties(self, document: dict[str, str]) -> None:
        known = {"title": "dc:title", "author": "dc:creator", "description": "dc:description", "keywords": "cp:keywords"}
        self.parts["docProps/core.xml"] = x.dump(make("cp:coreProperties", *[make(name, text=document[k]) for k, name in known.items() if k in document]))
        self.kinds["docProps/core.xml"] = "application/vnd.openxmlformats-package.core-properties+xml"
        app = ET.Element(f"{{{x.EP}}}Properties")
        ET.SubElement(app, f"{{{x.EP}}}Application").text = "vellumgrid"
        self.parts["docProps/app.xml"], self.kinds["docProps/app.xml"] = x.dump(app), "application/vnd.openxmlformats-officedocument.extended-properties+xml"
        rest = {k: v for k, v in document.items() if k not in known}
        if rest:
            root = ET.Element(f"{{{x.CUST}}}Properties")
            for k, (name, value) in enumerate(rest.items(), 2):
                ET.SubElement(ET.SubElement(root, f"{{{x.CUST}}}property", fmtid="{D5CDD505-2E9C-101B-9397-08002B2CF9AE}", pid=str(k), name=name), f"{{{x.VT}}}lpwstr").text = value
            self.parts["docProps/custom.xml"], self.kinds["docProps/custom.xml"] = x.dump(root), "application/vnd.openxmlformats-officedocument.custom-properties+xml"

    def styles(self) -> ET.Element:
        style = lambda sid, name, *more: in_order(make("w:style", make("w:name", w__val=name), *more, w__type="paragraph", w__styleId=sid))
        based = lambda: make("w:basedOn", w__val="Normal")
        heads = [style(f"Heading{k}", f"heading {k}", based(), make("w:pPr", make("w:outlineLvl", w__val=k - 1))) for k in range(1, 10)]
        defaults = make("w:docDefaults", make("w:rPrDefault", make("w:rPr", make("w:rFonts", w__ascii=BODY_FONT, w__hAnsi=BODY_FONT), make("w:sz", w__val=22))), make("w:pPrDefault", make("w:pPr")))
        code = make("w:rPr", make("w:rFonts", w__ascii=MONO_FONT, w__hAnsi=MONO_FONT))
        return make("w:styles", defaults, style("Normal", "Normal"), style("Title", "Title", based()), *heads, style("Quote", "Quote", based()), style("Caption", "caption", based()), style("Code", "Code", based(), code))

    def numbering(self) -> ET.Element:
        root = make("w:numbering")
        for k, (fmt, start, pattern) in enumerate(self.lists):
            levels = [make("w:lvl", make("w:start", w__val=start), make("w:numFmt", w__val=form), make("w:lvlText", w__val=text), w__ilvl=lvl) for lvl, (form, text) in enumerate(level_formats(fmt, pattern))]
            root.append(make("w:abstractNum", *levels, w__abstractNumId=k))
        for k in range(len(self.lists)):
            root.append(make("w:num", make("w:abstractNumId", w__val=k), w__numId=k + 1))
        return root

    # --- sections -----------------------------------------------------------------------------------------------

    def section(self, n: Node) -> ET.Element:
        a = n.attrs
        paper = PAPERS.get(a.get("paper", ""), PAPERS["a4"])
        w, h = twips(a.get("width")) or round(paper[0] * 20), twips(a.get("height")) or round(paper[1] * 20)
        if a.get("flipped") == "true":
            w, h = h, w
        orient = a.get("orientation") or ("landscape" if w > h else None)
        margins = {f"w__{side}": 1440 if (v := twips(a.get(f"margin_{side}"))) is None else v for side in ("top", "right", "bottom", "left")}
        margins |= {f"w__{side}": twips(a.get(f"margin_{side}")) for side in ("header", "footer", "gutter")}
        refs = []
        for kind in ("header", "footer"):
            for use in ("default", "first", "even"):
                blocks = [c for c in n.children if c.slot == f"{kind}_{use}"]
                if not blocks and kind == "footer" and use == "default" and "numbering" in a:
                    blocks = [self.page_number(a["numbering"], a.get("number-align", "center"))]
                if blocks:
                    self.even |= use == "even"
                    name = f"word/{kind}{1 + sum(p.startswith(f'word/{kind}') for p in self.parts)}.xml"
                    made = make(f"w:{'hdr' if kind == 'header' else 'ftr'}", *self.within(name, blocks))
                    refs.append(make(f"w:{kind}Reference", w__type=use, r__id=self.put(name, made, f"{WML}{kind}+xml", kind)))
        title = a.get("title_page") == "true" or any(c.slot in ("header_first", "footer_first") for c in n.children)
        number = make("w:pgNumType", w__start=a.get("page_start"), w__fmt=a.get("page_format")) if "page_start" in a or "page_format" in a else None
        return in_order(make("w:sectPr", *refs, make("w:type", w__val=a["type"]) if "type" in a else None, make("w:pgSz", w__w=w, w__h=h, w__orient=orient), make("w:pgMar", **margins), number, make("w:cols", w__num=a["columns"]) if a.get("columns", "1") != "1" else None, make("w:titlePg") if title else None))

    @staticmethod
    def page_number(pattern: str, align: str) -> Node:
        """A footer that shows a numbering pattern: its first counter is the page, its second the number of pages."""
        codes, inlines = ["PAGE", "NUMPAGES"], []
        for piece in re.split(r"([1aAiI])", pattern):
            if re.fullmatch(r"[1aAiI]", piece) and codes:
                inlines.append(Node("field", "inline", codes.pop(0), children=[Node("text", "inline", "1")]))
            elif piece:
                inlines.append(Node("text", "inline", piece))
        return Node("paragraph", "footer_default", style={"align": align.split("+")[0].strip()}, children=inlines)

    def body(self, nodes: list[Node]) -> list[ET.Element]:
        """Top-level blocks; a section break puts its section's properties into the paragraph before it."""
        out: list[ET.Element] = []
        part: list[Node] = []
        for n in nodes:
            if n.kind != "break_block" or n.attrs.get("type") != "section":
                part.append(n)
                continue
            out += self.blocks(part)
            part = []
            if not out or x.local(out[-1].tag) != "p" or out[-1].find(f"{x.q('w:pPr')}/{x.q('w:sectPr')}") is not None:
                out.append(make("w:p"))
            ppr = out[-1].find(x.q("w:pPr"))
            if ppr is None:
                ppr = make("w:pPr")
                out[-1].insert(0, ppr)
            ppr.append(self.section(self.sections[min(self.section_no, len(self.sections) - 1)]))
            in_order(ppr)
            self.section_no += 1
        return out + self.blocks(part)

    # --- blocks -------------------------------------------------------------------------------------------------

    def blocks(self, nodes: list[Node], num: int | None = None, level: int = 0, style: str | None = None) -> list[ET.Element]:
        out: list[ET.Element] = []
        for n in nodes:
            made = self.block(n, num, level, style)
            if made and out and x.local(out[-1].tag) == "tbl" and x.local(made[0].tag) == "tbl":
                out.append(make("w:p"))  # tables that touch would merge
            out += made
        return out

    def paragraph(self, inlines: list[Node], own: dict[str, str] | None = None, style: str | None = None, num: int | None = None, level: int = 0, label: str | None = None) -> ET.Element:
        marks = ([self.mark(label, "start")], [self.mark(label, "end")]) if label else ([], [])
        return make("w:p", paragraph_properties(own or {}, style, num, level), *marks[0], *self.inlines(inlines), *marks[1])

    def mark(self, name: str, kind: str) -> ET.Element:
        k = self.marks.setdefault(name, len(self.marks))
        return make("w:bookmarkStart", w__id=k, w__name=name) if kind == "start" else make("w:bookmarkEnd", w__id=k)

    def block(self, n: Node, num: int | None, level: int, style: str | None) -> list[ET.Element]:
        inner, below = [c for c in n.children if c.cls == "inline"], [c for c in n.children if c.cls == "block"]
        if n.kind == "paragraph":
            return [self.paragraph(inner, n.style, style, num, level)]
        if n.kind == "heading":
            align = {k: v for k, v in n.style.items() if k in ("align", "before", "after", "keep_next", "page_break_before")}
            return [self.paragraph(inner, align, "Title" if n.level == 0 else f"Heading{n.level}", label=n.label)]
        if n.kind == "list":
            return self.list(n, style)
        if n.kind == "table":
            return [self.table(n)]
        if n.kind == "code":
            lines = (n.text or "").split("\n")
            runs = [r for k, line in enumerate(lines) for r in ([make("w:r", make("w:br"))] if k else []) + [make("w:r", text_element(line))]]
            return [make("w:p", make("w:pPr", make("w:pStyle", w__val="Code")), *runs)]
        if n.kind == "math_block":
            inside = [make("m:oMathPara", mathml.to_omml(n.text or ""))]
            return [make("w:p", *([self.mark(n.label, "start"), *inside, self.mark(n.label, "end")] if n.label else inside))]
        if n.kind == "break_block":
            kind = n.attrs.get("type")
            return [make("w:p", make("w:r", make("w:br", w__type="column" if kind == "column" else "page")))]
        if n.kind == "quote":
            said = [c for c in inner if c.slot == "attribution"]
            return self.blocks(below, style="Quote") + ([self.paragraph([Node("text", "inline", "— "), *said], {"align": "right"}, "Quote")] if said else [])
        if n.kind == "figure":
            caption = [c for c in n.children if c.slot == "caption"]
            return self.blocks(below) + ([self.paragraph(caption, None, "Caption", label=n.label)] if caption or n.label else [])
        if n.kind == "control":
            return [make("w:sdt", self.control(n.attrs), make("w:sdtContent", *(self.blocks(below) or [make("w:p")])))]
        if n.kind == "divider":
            return [make("w:p", make("w:pPr", make("w:pBdr", make("w:bottom", w__val="single", w__sz=6))))]
        if n.kind == "raw_block" and n.attrs.get("format") == "xml":
            return self.raw(n, RAW_BLOCKS)
        return []

    @staticmethod
    def raw(n: Node, allowed: tuple[str, ...]) -> list[ET.Element]:
        """A kept element, if it may stand here."""
        e = ET.fromstring(binary.ungzip_b64(n.text or ""))
        return [e] if x.local(e.tag) in allowed and e.tag[1:].split("}")[0] in (x.W, x.M) else []

    @staticmethod
    def control(a: dict[str, str]) -> ET.Element:
        items = [make(f"w:{k}", w__val=a[k]) for k in ("alias", "tag") if k in a]
        if a.get("xpath"):
            items.append(make("w:dataBinding", w__xpath=a["xpath"], w__storeItemID=a.get("store"), w__prefixMappings=a.get("prefixes")))
        if a.get("control"):
            items.append(make(f"w:{a['control']}"))
        return make("w:sdtPr", *items)

    def list(self, n: Node, style: str | None) -> list[ET.Element]:
        self.lists.append((n.attrs.get("format", "bullet"), int(n.attrs.get("start", "1") or 1), n.numbering))
        own, out = len(self.lists), []
        for item in n.children:
            at = item.level or 0
            first = [c for c in item.children if c.kind == "paragraph"][:1]
            if "term" in item.attrs:
                first = [Node("paragraph", "item", style=first[0].style if first else {}, children=[Node("text", "inline", item.attrs["term"], style={"bold": "true"}), Node("text", "inline", " "), *(first[0].children if first else [])])]
                out += self.blocks(first, own, at, style)
                out += self.blocks([c for c in item.children if c.kind != "paragraph"], own, at, style)
                continue
            out += self.blocks(first, own, at, style) or [self.paragraph([], None, style, own, at)]
            rest = [c for c in item.children if not (first and c is first[0])]
            # What follows an item's first paragraph stands under it, without a number of its own.
            out += [e for c in rest for e in (self.blocks([c], None, 0, style) if c.kind != "paragraph" else [self.paragraph([i for i in c.children if i.cls == "inline"], {"left": f"{36 * (at + 1)}pt"} | c.style, style)])]
        return out

    def table(self, n: Node) -> ET.Element:
        columns = int(n.attrs.get("columns", "1"))
        held: dict[tuple[int, int], tuple[int, int]] = {}
        for r in n.children:
            for c in r.children:
                row, col = int(c.attrs.get("row", 0)), int(c.attrs.get("col", 0))
                for k in range(1, int(c.attrs.get("rowspan", "1"))):
                    held[row + k, col] = (int(c.attrs.get("colspan", "1")), k)
        t = make("w:tbl", make("w:tblPr", make("w:tblW", w__w=0, w__type="auto")), make("w:tblGrid", *[make("w:gridCol") for _ in range(columns)]))
        rows = {int(r.attrs.get("row", k)): r for k, r in enumerate(n.children)}
        for k in range(max([*rows, *(r for r, _ in held)], default=-1) + 1):
            cells = {int(c.attrs.get("col", 0)): c for c in (rows[k].children if k in rows else [])}
            header = bool(cells) and all(c.attrs.get("header") == "true" for c in cells.values())
            tr = make("w:tr", make("w:trPr", make("w:tblHeader")) if header else None)
            col = 0
            while col < columns:
                c = cells.get(col)
                span = int(c.attrs.get("colspan", "1")) if c else held.get((k, col), (1, 0))[0]
                down = int(c.attrs.get("rowspan", "1")) if c else 1
                merge = make("w:vMerge", w__val="restart") if down > 1 else make("w:vMerge") if (k, col) in held and not c else None
                fill = make("w:shd", w__val="clear", w__color="auto", w__fill=c.attrs["fill"].lstrip("#").upper()) if c and re.fullmatch(r"#?[0-9A-Fa-f]{6}", c.attrs.get("fill", "")) else None
                made = (self.blocks(c.children) if c else []) or [make("w:p")]
                if x.local(made[-1].tag) != "p":
                    made.append(make("w:p"))  # a cell ends with a paragraph
                tr.append(make("w:tc", make("w:tcPr", make("w:gridSpan", w__val=span) if span > 1 else None, merge, fill), *made))
                col += span
            t.append(tr)
        return t

    # --- inlines ------------------------------------------------------------------------------------------------

    def inlines(self, nodes: list[Node], deleted: bool = False) -> list[ET.Element]:
        out: list[ET.Element] = []
        run = lambda *e: make("w:r", *e)
        for n in nodes:
            k, a = n.kind, n.attrs
            if k == "text":
                if n.style.get("font") not in (None, "mono"):
                    self.fonts.add(n.style["font"])
                out.append(run(run_properties(n.style), text_element(n.text or "", "w:delText" if deleted else "w:t")))
            elif k == "break":
                out.append(run(make("w:tab") if a.get("type") == "tab" else make("w:br", w__type={"page": "page", "column": "column"}.get(a.get("type")))))
            elif k == "link":
                link = {"w__anchor": a["target"]} if a.get("internal") == "true" else {"r__id": self.rel("hyperlink", a.get("target", ""), "External")}
                out.append(make("w:hyperlink", *self.inlines(n.children, deleted), **link))
            elif k == "reference":
                out.append(make("w:fldSimple", run(text_element("@" + a.get("target", ""))), w__instr=f"{'PAGEREF' if a.get('form') == 'page' else 'REF'} {a.get('target', '')}"))
            elif k == "bookmark":
                out.append(self.mark(a["name"], a.get("type", "start")))
                if a.get("type", "start") == "start" and not any(m.kind == "bookmark" and m.attrs.get("name") == a["name"] and m.attrs.get("type") == "end" for m in nodes):
                    out.append(self.mark(a["name"], "end"))
            elif k == "math":
                out.append(mathml.to_omml(n.text or ""))
            elif k == "note":
                out.append(self.note(n))
            elif k == "field":
                out.append(make("w:fldSimple", *self.inlines(n.children, deleted), w__instr=n.text or ""))
            elif k == "citation":
                out.append(make("w:fldSimple", run(text_element(f"[{a.get('keys', '')}]")), w__instr=f"CITATION {a.get('keys', '')}"))
            elif k == "change":
                out += self.change(n)
            elif k == "comment_anchor":
                out += self.anchor(a)
            elif k == "raw_inline" and "tag" in a:
                out += self.raw(n, RAW_INLINES)
            elif k == "raw_inline":
                out.append(run(text_element(n.text or "")))
            elif k == "image":
                out.append(self.image(a))
        return out

    def note(self, n: Node) -> ET.Element:
        kind = "endnote" if n.attrs.get("note_type") == "endnote" else "footnote"
        made = make(f"w:{kind}", w__id=len(self.notes[kind]) + 1)
        self.notes[kind].append(made)
        made.extend(self.within(f"word/{kind}s.xml", [c for c in n.children if c.cls == "block"]) or [make("w:p")])
        return make("w:r", make(f"w:{kind}Reference", w__id=made.get(x.q("w:id"))))

    def change(self, n: Node) -> list[ET.Element]:
        kind = n.attrs["type"]
        if self.revisions == "accept":
            return self.inlines(n.children) if kind in ("insert", "move_to") else []
        self.changes += 1
        tag = {"insert": "w:ins", "delete": "w:del", "move_to": "w:moveTo", "move_from": "w:moveFrom"}[kind]
        return [make(tag, *self.inlines(n.children, deleted=kind == "delete"), w__id=self.changes, w__author=n.attrs.get("author"), w__date=n.attrs.get("date") or None)]

    def anchor(self, a: dict[str, str]) -> list[ET.Element]:
        """A comment's anchor by its number; one without a comment leaves a mark in the text where it is referred to."""
        k = self.comments.get(a.get("id", ""))
        if k is None:
            return [make("w:r", text_element(f"[comment {a.get('id', '')}]"))] if a.get("type") == "reference" else []
        if a.get("type") == "reference":
            return [make("w:r", make("w:commentReference", w__id=k))]
        return [make("w:commentRangeStart" if a.get("type") == "start" else "w:commentRangeEnd", w__id=k)]

    def image(self, a: dict[str, str]) -> ET.Element:
        found = self.media.get(a.get("resource_id", "")) or self.media.get(a.get("path", ""))
        if found is None:
            return make("w:r", text_element(a.get("alt") or f"[{a.get('path') or a.get('shape') or 'image'}]"))
        filename, data = found
        ext = filename.rpartition(".")[2].lower()
        name = f"word/media/{binary.sha256(data)[:16]}.{ext if ext in MEDIA else 'png'}"
        self.parts[name] = data
        size = binary.fitted_points(data, points(a.get("width")), points(a.get("height"))) or (points(a.get("width")) or 100.0, points(a.get("height")) or 100.0)
        cx, cy = (round(v * 12700) for v in size)
        self.images += 1
        graphic = make(
            "a:graphic",
            make("a:graphicData", make(
                "pic:pic",
                make("pic:nvPicPr", make("pic:cNvPr", id=self.images, name=filename, descr=a.get("alt")), make("pic:cNvPicPr")),
                make("pic:blipFill", make("a:blip", r__embed=self.rel("image", name.removeprefix("word/"))), make("a:stretch", make("a:fillRect"))),
                make("pic:spPr", make("a:xfrm", make("a:off", x=0, y=0), make("a:ext", cx=cx, cy=cy)), make("a:prstGeom", make("a:avLst"), prst="rect")),
            ), uri=x.PIC),
        )
        return make("w:r", make("w:drawing", make("wp:inline", make("wp:extent", cx=cx, cy=cy), make("wp:docPr", id=self.images, name=filename, descr=a.get("alt")), graphic, distT=0, distB=0, distL=0, distR=0)))


def relationships(rels: list[tuple[str, str, str]]) -> bytes:
    root = ET.Element(f"{{{x.REL}}}Relationships")
    for k, (kind, target, mode) in enumerate(rels, 1):
        ET.SubElement(root, f"{{{x.REL}}}Relationship", Id=f"rId{k}", Type=kind, Target=target, **({"TargetMode": mode} if mode else {}))
    return x.dump(root)


def theme() -> ET.Element:
    """A plain theme: two fonts, twelve colours, and three entries in each list of styles."""
    colours = {"dk1": "000000", "lt1": "FFFFFF", "dk2": "333333", "lt2": "EEEEEE", "accent1": "336699", "accent2": "993333", "accent3": "669933", "accent4": "663399", "accent5": "339999", "accent6": "CC6600", "hlink": "0000EE", "folHlink": "551A8B"}
    colour = lambda: make("a:solidFill", make("a:schemeClr", val="phClr"))
    font = lambda kind: make(f"a:{kind}Font", make("a:latin", typeface=BODY_FONT), make("a:ea", typeface=""), make("a:cs", typeface=""))
    lists = [
        make("a:fillStyleLst", *[colour() for _ in range(3)]),
        make("a:lnStyleLst", *[make("a:ln", colour(), w=w) for w in (6350, 12700, 19050)]),
        make("a:effectStyleLst", *[make("a:effectStyle", make("a:effectLst")) for _ in range(3)]),
        make("a:bgFillStyleLst", *[colour() for _ in range(3)]),
    ]
    scheme = make("a:clrScheme", *[make(f"a:{k}", make("a:srgbClr", val=v)) for k, v in colours.items()], name="plain")
    return make("a:theme", make("a:themeElements", scheme, make("a:fontScheme", font("major"), font("minor"), name="plain"), make("a:fmtScheme", *lists, name="plain")), name="plain")
