"""Word-processor packages to rows: parts, relationships, content types, styles, numbering, notes, comments, metadata, and the node table of markup.NODE_SCHEMA. The codecs run over Arrow batches of packages; joins and windows over their tables are SQL."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import binary, mathml
from vellumgrid.functions import ooxml as x
from vellumgrid.sources.markup import _NODES, NODE_SCHEMA, Node, flatten, merged


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of package files under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "content")


def _each(docs: DataFrame, rows_of: Callable[[str, dict[str, bytes]], Iterator[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = binary.unzip(data or b"")
                except Exception:
                    continue  # errors() lists packages that don't open
                rows = list(rows_of(doc_id, found))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, schema)


def _strings(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.string()) for n in names])


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, name, data)."""
    return _each(docs, lambda d, p: ({"doc_id": d, "name": k, "data": v} for k, v in p.items()), "doc_id string, name string, data binary", pa.schema([("doc_id", pa.string()), ("name", pa.string()), ("data", pa.binary())]))


def canonical_parts(docs: DataFrame) -> DataFrame:
    """parts() with XML in canonical form, for digests."""
    return _each(docs, lambda d, p: ({"doc_id": d, "name": k, "data": x.canonical(v) if k.endswith((".xml", ".rels")) else v} for k, v in p.items()), "doc_id string, name string, data binary", pa.schema([("doc_id", pa.string()), ("name", pa.string()), ("data", pa.binary())]))


def content_types(docs: DataFrame) -> DataFrame:
    def rows(d, p):
        for e in x.parse(p["[Content_Types].xml"]):
            default = x.local(e.tag) == "Default"
            yield {"doc_id": d, "scope": "default" if default else "override", "key": e.get("Extension") if default else e.get("PartName"), "content_type": e.get("ContentType")}

    return _each(docs, rows, "doc_id string, scope string, key string, content_type string", _strings("doc_id", "scope", "key", "content_type"))


def relationships(docs: DataFrame) -> DataFrame:
    def rows(d, p):
        for name, data in sorted(p.items()):
            if m := re.fullmatch(r"(.*/)?_rels/(.*)\.rels", name):
                try:
                    root = x.parse(data)
                except (ET.ParseError, ValueError):
                    continue
                for k, e in enumerate(root):
                    yield {"doc_id": d, "source_part": (m[1] or "") + m[2], "rel_id": e.get("Id"), "type": x.relationship_type(e.get("Type", "")), "target": e.get("Target"), "target_mode": e.get("TargetMode"), "ord": k}

    return _each(docs, rows, "doc_id string, source_part string, rel_id string, type string, target string, target_mode string, ord long", pa.schema([*[(n, pa.string()) for n in ("doc_id", "source_part", "rel_id", "type", "target", "target_mode")], ("ord", pa.int64())]))


def xml_errors(docs: DataFrame) -> DataFrame:
    """(doc_id, name, error) of XML parts that don't parse."""

    def rows(d, p):
        for name, data in p.items():
            if name.endswith((".xml", ".rels")):
                try:
                    x.parse(data)
                except (ET.ParseError, ValueError) as e:
                    yield {"doc_id": d, "name": name, "error": str(e)}

    return _each(docs, rows, "doc_id string, name string, error string", _strings("doc_id", "name", "error"))


def ordered_children(docs: DataFrame, parents: tuple[str, ...] = ("pPr", "rPr", "style", "sectPr", "lvl")) -> DataFrame:
    """(doc_id, part, parent_id, parent_name, ord, child) of elements whose children have a schema order."""

    def rows(d, p):
        for name, data in p.items():
            if name.startswith("word/") and name.endswith(".xml"):
                try:
                    root = x.parse(data)
                except (ET.ParseError, ValueError):
                    continue
                for k, e in enumerate(root.iter()):
                    if x.local(e.tag) in parents:
                        for i, c in enumerate(e):
                            yield {"doc_id": d, "part": name, "parent_id": k, "parent_name": x.local(e.tag), "ord": i, "child": x.local(c.tag)}

    return _each(docs, rows, "doc_id string, part string, parent_id long, parent_name string, ord long, child string", pa.schema([("doc_id", pa.string()), ("part", pa.string()), ("parent_id", pa.int64()), ("parent_name", pa.string()), ("ord", pa.int64()), ("child", pa.string())]))


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, scope, name, kind, value): core, app and custom properties; values stay text."""

    def rows(d, p):
        for scope, part in (("core", "docProps/core.xml"), ("app", "docProps/app.xml"), ("custom", "docProps/custom.xml")):
            if part in p:
                for e in x.parse(p[part]):
                    inner = e[0] if scope == "custom" and len(e) else e
                    yield {"doc_id": d, "scope": scope, "name": e.get("name") if scope == "custom" else x.local(e.tag), "kind": x.local(inner.tag) if scope == "custom" else "string", "value": inner.text}

    return _each(docs, rows, "doc_id string, scope string, name string, kind string, value string", _strings("doc_id", "scope", "name", "kind", "value"))


def theme_of(p: dict[str, bytes]) -> dict[str, str]:
    """The families of a package's theme by slot."""
    out: dict[str, str] = {}
    for name, data in sorted(p.items()):
        if re.fullmatch(r"word/theme/theme\d*\.xml", name):
            for kind in ("major", "minor"):
                for e in x.parse(data).iter(x.q(f"a:{kind}Font")):
                    for tag, slots in (("latin", ("Ascii", "HAnsi")), ("ea", ("EastAsia",)), ("cs", ("Bidi",))):
                        face = e.find(x.q(f"a:{tag}"))
                        for slot in slots if face is not None and face.get("typeface") else ():
                            out.setdefault(f"{kind}{slot}", face.get("typeface"))
    return out


def run_style(rpr: ET.Element | None, theme: dict[str, str] | None = None) -> dict[str, str]:
    """A run's properties as a flat map; what isn't set isn't there, so that inheritance can tell. A font named by a theme's slot is that slot's family, or not there if the theme has none."""
    if rpr is None:
        return {}
    out: dict[str, str] = {}
    for key, tag in (("bold", "b"), ("italic", "i"), ("strike", "strike"), ("double_strike", "dstrike"), ("small_caps", "smallCaps"), ("caps", "caps"), ("hidden", "vanish"), ("outline", "outline"), ("shadow", "shadow"), ("emboss", "emboss"), ("imprint", "imprint"), ("rtl", "rtl")):
        if (v := x.flag(rpr, f"w:{tag}")) is not None:
            out[key] = str(v).lower()
    fonts = rpr.find(x.q("w:rFonts"))
    font = next((v for k in ("ascii", "hAnsi", "cs") if (v := x.attr(fonts, f"w:{k}"))), None)
    font = font or next((f for k in ("asciiTheme", "hAnsiTheme", "cstheme") if (f := (theme or {}).get(x.attr(fonts, f"w:{k}") or ""))), None)
    for key, v in (("font", font), ("style_id", x.value(rpr, "w:rStyle")), ("color", x.value(rpr, "w:color")), ("highlight", x.value(rpr, "w:highlight")), ("underline", x.value(rpr, "w:u")), ("vertical", x.value(rpr, "w:vertAlign")), ("lang", x.value(rpr, "w:lang"))):
        if v is not None:
            out[key] = v
    for key, tag, scale in (("size", "sz", 2), ("tracking", "spacing", 20), ("baseline", "position", 2), ("kern", "kern", 2)):
        if (v := x.value(rpr, f"w:{tag}")) and re.fullmatch(r"-?\d+", v):
            out[key] = f"{int(v) / scale:g}pt"
    return out


def paragraph_style(ppr: ET.Element | None) -> dict[str, str]:
    if ppr is None:
        return {}
    out: dict[str, str] = {}
    for key, tag in (("style_id", "pStyle"), ("align", "jc"), ("outline", "outlineLvl")):
        if (v := x.value(ppr, f"w:{tag}")) is not None:
            out[key] = v
    for key, tag in (("keep_next", "keepNext"), ("keep_lines", "keepLines"), ("page_break_before", "pageBreakBefore"), ("widow_control", "widowControl"), ("bidi", "bidi"), ("contextual", "contextualSpacing")):
        if (v := x.flag(ppr, f"w:{tag}")) is not None:
            out[key] = str(v).lower()
    ind, spacing = ppr.find(x.q("w:ind")), ppr.find(x.q("w:spacing"))
    for key, e, name in (("left", ind, "left"), ("right", ind, "right"), ("first_line", ind, "firstLine"), ("hanging", ind, "hanging"), ("before", spacing, "before"), ("after", spacing, "after")):
        if (v := x.attr(e, f"w:{name}")) and re.fullmatch(r"-?\d+", v):
            out[key] = f"{int(v) / 20:g}pt"
    if (v := x.attr(spacing, "w:line")) and v.isdigit():
        auto = x.attr(spacing, "w:lineRule", "auto") == "auto"
        out["line"] = f"{int(v) / 240:g}" if auto else f"{int(v) / 20:g}pt"
    if (borders := ppr.find(x.q("w:pBdr"))) is not None:
        for b in borders:
            out[f"border_{x.local(b.tag)}"] = f"{x.attr(b, 'w:val')} {int(x.attr(b, 'w:sz', '0')) / 8:g}pt {x.attr(b, 'w:color', 'auto')}"
    if (tabs := ppr.find(x.q("w:tabs"))) is not None:
        out["tabs"] = ";".join(f"{x.attr(t, 'w:val')}@{int(x.attr(t, 'w:pos', '0')) / 20:g}pt" for t in tabs)
    return out


def styles(docs: DataFrame) -> DataFrame:
    """(doc_id, style_id, name, style_type, based_on, paragraph map, text map), the defaults as __docDefaults__."""

    def rows(d, p):
        if "word/styles.xml" not in p:
            return
        root = x.parse(p["word/styles.xml"])
        base, theme = root.find(x.q("w:docDefaults")), theme_of(p)
        if base is not None:
            yield {"doc_id": d, "style_id": "__docDefaults__", "name": None, "style_type": "default", "based_on": None, "paragraph": list(paragraph_style(base.find(f"{x.q('w:pPrDefault')}/{x.q('w:pPr')}")).items()), "text": list(run_style(base.find(f"{x.q('w:rPrDefault')}/{x.q('w:rPr')}"), theme).items())}
        for s in root.findall(x.q("w:style")):
            yield {"doc_id": d, "style_id": x.attr(s, "w:styleId"), "name": x.value(s, "w:name"), "style_type": x.attr(s, "w:type"), "based_on": x.value(s, "w:basedOn"), "paragraph": list(paragraph_style(s.find(x.q("w:pPr"))).items()), "text": list(run_style(s.find(x.q("w:rPr")), theme).items())}

    m = pa.map_(pa.string(), pa.string())
    return _each(docs, rows, "doc_id string, style_id string, name string, style_type string, based_on string, paragraph map<string,string>, text map<string,string>", pa.schema([*[(n, pa.string()) for n in ("doc_id", "style_id", "name", "style_type", "based_on")], ("paragraph", m), ("text", m)]))


def numbering(docs: DataFrame) -> DataFrame:
    """(doc_id, scope, key, abstract_id, level, num_format, text, start): scope level (key abstract id), instance (key number id) or override (key number id)."""

    def level(d, scope, key, e, start=None):
        s = start or x.value(e, "w:start")
        return {"doc_id": d, "scope": scope, "key": key, "abstract_id": None, "level": int(x.attr(e, "w:ilvl", "0")), "num_format": x.value(e, "w:numFmt"), "text": x.value(e, "w:lvlText"), "start": int(s) if s else None}

    def rows(d, p):
        if "word/numbering.xml" not in p:
            return
        root = x.parse(p["word/numbering.xml"])
        for a in root.findall(x.q("w:abstractNum")):
            for e in a.findall(x.q("w:lvl")):
                yield level(d, "level", int(x.attr(a, "w:abstractNumId", "0")), e)
        for n in root.findall(x.q("w:num")):
            key = int(x.attr(n, "w:numId", "0"))
            yield {"doc_id": d, "scope": "instance", "key": key, "abstract_id": int(x.value(n, "w:abstractNumId") or 0), "level": None, "num_format": None, "text": None, "start": None}
            for o in n.findall(x.q("w:lvlOverride")):
                e = o.find(x.q("w:lvl"))
                yield level(d, "override", key, o if e is None else e, x.value(o, "w:startOverride"))

    ints = [("key", pa.int32()), ("abstract_id", pa.int32()), ("level", pa.int32())]
    return _each(docs, rows, "doc_id string, scope string, key int, abstract_id int, level int, num_format string, text string, start int", pa.schema([("doc_id", pa.string()), ("scope", pa.string()), *ints, ("num_format", pa.string()), ("text", pa.string()), ("start", pa.int32())]))


def theme_fonts(docs: DataFrame) -> DataFrame:
    """(doc_id, slot, family)."""
    return _each(docs, lambda d, p: ({"doc_id": d, "slot": k, "family": v} for k, v in theme_of(p).items()), "doc_id string, slot string, family string", _strings("doc_id", "slot", "family"))


def bibliography(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, entry_type, fields map) of custom XML sources."""
    kinds = {"JournalArticle": "article", "Book": "book", "BookSection": "incollection", "ConferenceProceedings": "inproceedings", "Report": "report", "InternetSite": "online", "Patent": "patent"}
    names = {"Title": "title", "Year": "date", "JournalName": "journaltitle", "Publisher": "publisher", "City": "location", "Volume": "volume", "Issue": "number", "Pages": "pages", "Edition": "edition", "DOI": "doi", "StandardNumber": "isbn", "URL": "url", "BookTitle": "booktitle"}

    def rows(d, p):
        for name, data in sorted(p.items()):
            if name.startswith("customXml/") and x.B.encode() in data or b"purl.oclc.org/ooxml/officeDocument/bibliography" in data:
                for s in x.parse(data).iter(x.q("b:Source")):
                    text = lambda k, s=s: (s.findtext(x.q(f"b:{k}")) or "").strip()
                    people = []
                    for person in s.findall(f"{x.q('b:Author')}/{x.q('b:Author')}/{x.q('b:NameList')}/{x.q('b:Person')}"):
                        last, first, middle = ((person.findtext(x.q(f"b:{k}")) or "").strip() for k in ("Last", "First", "Middle"))
                        given = " ".join(g for g in (first, middle) if g)
                        people.append(", ".join(g for g in (last, given) if g))
                    corporate = s.findtext(f"{x.q('b:Author')}/{x.q('b:Author')}/{x.q('b:Corporate')}")
                    fields = {v: text(k) for k, v in names.items() if text(k)}
                    author = " and ".join(dict.fromkeys(people)) or (f"{{{corporate.strip()}}}" if corporate else "")
                    yield {"doc_id": d, "tag": text("Tag"), "entry_type": kinds.get(text("SourceType"), "misc"), "fields": list(({"author": author} if author else {} | {}).items()) + list(fields.items())}

    return _each(docs, rows, "doc_id string, tag string, entry_type string, fields map<string,string>", pa.schema([*[(n, pa.string()) for n in ("doc_id", "tag", "entry_type")], ("fields", pa.map_(pa.string(), pa.string()))]))


def embedded_fonts(docs: DataFrame) -> DataFrame:
    """(doc_id, family, variant, data): fonts of the font table, decoded."""

    def rows(d, p):
        if "word/fontTable.xml" not in p:
            return
        rels = {e.get("Id"): e.get("Target") for e in x.parse(p.get("word/_rels/fontTable.xml.rels", b"<a/>"))}
        for f in x.parse(p["word/fontTable.xml"]).findall(x.q("w:font")):
            for tag, variant in (("embedRegular", "regular"), ("embedBold", "bold"), ("embedItalic", "italic"), ("embedBoldItalic", "boldItalic")):
                e = f.find(x.q(f"w:{tag}"))
                target = rels.get(x.attr(e, "r:id") or "")
                if target and (data := p.get("word/" + target)):
                    key = x.attr(e, "w:fontKey")
                    yield {"doc_id": d, "family": x.attr(f, "w:name"), "variant": variant, "data": binary.deobfuscate_font(data, key) if key else data}

    return _each(docs, rows, "doc_id string, family string, variant string, data binary", pa.schema([("doc_id", pa.string()), ("family", pa.string()), ("variant", pa.string()), ("data", pa.binary())]))


# Kinds of content controls, the first that is there counts.
CONTROLS = ("equation", "comboBox", "date", "docPartObj", "docPartList", "dropDownList", "picture", "richText", "text", "citation", "group", "bibliography", "checkbox", "repeatingSection", "repeatingSectionItem")


def control(pr: ET.Element | None) -> dict[str, str]:
    """Name, tag, kind and binding of a content control; checkboxes and repeating sections stand in namespaces of their own."""
    out = {key: v for key in ("alias", "tag") if (v := x.value(pr, f"w:{key}"))}
    if pr is None:
        return out
    there = {x.local(e.tag) for e in pr}
    if kind := next((k for k in CONTROLS if k in there), None):
        out["control"] = kind
    binding = pr.find(x.q("w:dataBinding"))
    for key, name in (("xpath", "xpath"), ("store", "storeItemID"), ("prefixes", "prefixMappings")):
        if v := x.attr(binding, f"w:{name}"):
            out[key] = v
    return out


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, key, filename, media_type, width, height, data): the image parts of packages, the natural size in points where the bytes tell it; keys are the resource ids of nodes."""

    def rows(d, p):
        for name, data in sorted(p.items()):
            if name.startswith("word/media/"):
                size = binary.fitted_points(data, None, None) or (None, None)
                yield {"doc_id": d, "key": binary.sha256(data)[:16], "filename": name.rpartition("/")[2], "media_type": binary.media_type(name, data), "width": size[0], "height": size[1], "data": data}

    kinds = [("doc_id", pa.string()), ("key", pa.string()), ("filename", pa.string()), ("media_type", pa.string()), ("width", pa.float64()), ("height", pa.float64()), ("data", pa.binary())]
    return _each(docs, rows, "doc_id string, key string, filename string, media_type string, width double, height double, data binary", pa.schema(kinds)).dropDuplicates(["doc_id", "key"])


def system_fonts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, family) of the font files under folders, found recursively; each font under every family name it holds. Folders that don't exist are an error of the reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ttf,otf,TTF,OTF,ttc,otc}").load(list(paths)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    families, _ = binary.font_names(data)
                except Exception:
                    continue  # not a font, or a damaged one
                rows += [{"path": path, "family": f} for f in dict.fromkeys(families)]
            yield pa.RecordBatch.from_pylist(rows, schema=_strings("path", "family"))

    return files.mapInArrow(run, "path string, family string")


def theme_errors(docs: DataFrame) -> DataFrame:
    """(doc_id, name, error) of themes whose format scheme lacks a list of styles or has other than three entries in one."""

    def rows(d, p):
        for name, data in sorted(p.items()):
            if not re.fullmatch(r"word/theme/theme\d*\.xml", name):
                continue
            try:
                root = x.parse(data)
            except (ET.ParseError, ValueError):
                continue  # xml_errors() lists it
            scheme = root.find(f"{x.q('a:themeElements')}/{x.q('a:fmtScheme')}")
            if scheme is None:
                yield {"doc_id": d, "name": name, "error": "no format scheme"}
                continue
            for part in ("fillStyleLst", "lnStyleLst", "effectStyleLst", "bgFillStyleLst"):
                e = scheme.find(x.q(f"a:{part}"))
                if e is None or len(e) != 3:
                    yield {"doc_id": d, "name": name, "error": f"{part} has {'no list' if e is None else f'{len(e)} entries'}, not 3"}

    return _each(docs, rows, "doc_id string, name string, error string", _strings("doc_id", "name", "error"))


class Reader:
    """The nodes of one package: body, headers and footers, notes, comments, sections and resources."""

    def __init__(self, p: dict[str, bytes], revisions: str = "annotate", comments: str = "keep", unknown: str = "keep") -> None:
        self.p, self.revisions, self.comments, self.unknown = p, revisions, comments, unknown
        self.styles = {}
        if "word/styles.xml" in p:
            for s in x.parse(p["word/styles.xml"]).findall(x.q("w:style")):
                self.styles[x.attr(s, "w:styleId")] = ((x.value(s, "w:name") or "").lower(), x.value(s.find(x.q("w:pPr")), "w:outlineLvl"))
        self.theme = theme_of(p)
        self.levels = self.list_levels()
        self.notes = {k: self.note_parts(k) for k in ("footnote", "endnote")}
        self.marks: dict[str, str] = {}
        self.resources: dict[str, Node] = {}

    def rels(self, part: str) -> dict[str, tuple[str, bool]]:
        folder, _, name = part.rpartition("/")
        data = self.p.get(f"{folder}/_rels/{name}.rels")
        return {} if data is None else {e.get("Id"): (e.get("Target", ""), e.get("TargetMode", "").lower() == "external") for e in x.parse(data)}

    def list_levels(self) -> dict[tuple[str, int], tuple[str, str, int]]:
        """(format, level text, start) of each level of each list number; an override wins over the abstract level."""
        if "word/numbering.xml" not in self.p:
            return {}
        root = x.parse(self.p["word/numbering.xml"])

        def level(e: ET.Element, old: tuple[str, str, int]) -> tuple[str, str, int]:
            start = x.value(e, "w:start")
            return x.value(e, "w:numFmt") or old[0], x.value(e, "w:lvlText") or old[1], int(start) if start and start.lstrip("-").isdigit() else old[2]

        none = ("decimal", "", 1)
        abstract = {x.attr(a, "w:abstractNumId"): {int(x.attr(e, "w:ilvl", "0")): level(e, none) for e in a.findall(x.q("w:lvl"))} for a in root.findall(x.q("w:abstractNum"))}
        out = {}
        for n in root.findall(x.q("w:num")):
            own = dict(abstract.get(x.value(n, "w:abstractNumId"), {}))
            for o in n.findall(x.q("w:lvlOverride")):
                at = int(x.attr(o, "w:ilvl", "0"))
                e, start = o.find(x.q("w:lvl")), x.value(o, "w:startOverride")
                own[at] = level(e, own.get(at, none)) if e is not None else own.get(at, none)
                if start and start.isdigit():
                    own[at] = (*own[at][:2], int(start))
            out |= {(x.attr(n, "w:numId"), at): v for at, v in own.items()}
        return out

    def list_node(self, num: str, level: int, slot: str) -> Node:
        """A list with its format, first number and, where it isn't `1.`, numbering pattern."""
        attrs = {"num_id": num, "num_level": str(level)}
        if (num, level) not in self.levels:
            return Node("list", slot, attrs=attrs)
        form, text, start = self.levels[num, level]
        kind = {"bullet": "bullet", "none": "term"}.get(form, "decimal")
        symbol = {"lowerLetter": "a", "upperLetter": "A", "lowerRoman": "i", "upperRoman": "I"}.get(form, "1")
        pattern = re.sub(r"%\d", symbol, text) if kind == "decimal" and text else None
        return Node("list", slot, numbering=pattern if pattern != "1." else None, attrs=attrs | {"format": kind, "ordered": str(kind == "decimal").lower(), "start": str(start)})

    def note_parts(self, kind: str) -> dict[str, ET.Element]:
        data = self.p.get(f"word/{kind}s.xml")
        found = {} if data is None else {x.attr(n, "w:id"): n for n in x.parse(data).findall(x.q(f"w:{kind}"))}
        return {k: v for k, v in found.items() if k and not k.startswith("-") and x.attr(v, "w:type") in (None, "normal")}

    def document(self) -> list[Node]:
        self.at = self.rels("word/document.xml")
        body = x.parse(self.p["word/document.xml"]).find(x.q("w:body"))
        out = self.blocks(body, "body")
        sections = [self.section(e) for e in body.iter(x.q("w:sectPr"))]
        out += [n for s in sections for n in s]
        if self.comments != "drop" and "word/comments.xml" in self.p:
            for c in x.parse(self.p["word/comments.xml"]).findall(x.q("w:comment")):
                n = Node("comment", "comment", attrs={k: v for k in ("id", "author", "initials", "date") if (v := x.attr(c, f"w:{k}"))})
                n.children = self.blocks(c, "comment")
                out.append(n)
        return out + list(self.resources.values())

    def section(self, s: ET.Element) -> list[Node]:
        a: dict[str, str] = {}
        for tag, names in (("pgSz", ("w", "h")), ("pgMar", ("top", "right", "bottom", "left", "header", "footer", "gutter"))):
            e = s.find(x.q(f"w:{tag}"))
            for name in names:
                if (v := x.attr(e, f"w:{name}")) and re.fullmatch(r"-?\d+", v):
                    # A zero margin or size counts as missing.
                    a[{"w": "width", "h": "height"}.get(name, f"margin_{name}")] = f"{(int(v) or 1440) / 20:g}pt"
        for key, tag, name in (("columns", "cols", "num"), ("page_start", "pgNumType", "start"), ("page_format", "pgNumType", "fmt"), ("orientation", "pgSz", "orient"), ("type", "type", "val")):
            if v := x.attr(s.find(x.q(f"w:{tag}")), f"w:{name}"):
                a[key] = v
        if x.flag(s, "w:titlePg"):
            a["title_page"] = "true"
        n = Node("section", "meta", attrs=a)
        for kind in ("header", "footer"):
            for ref in s.findall(x.q(f"w:{kind}Reference")):
                target = self.at.get(x.attr(ref, "r:id") or "", ("", True))
                if not target[1] and (data := self.p.get("word/" + target[0])):
                    before, self.at = self.at, self.rels("word/" + target[0])
                    n.children += self.blocks(x.parse(data), f"{kind}_{x.attr(ref, 'w:type', 'default')}")
                    self.at = before
        return [n]

    def keeps(self, tag: str) -> bool:
        return {"accept": tag in ("ins", "moveTo"), "reject": tag in ("del", "moveFrom")}.get(self.revisions, True)

    def blocks(self, parent: ET.Element, slot: str) -> list[Node]:
        out: list[Node] = []
        for e in parent:
            k = x.local(e.tag)
            if k == "p":
                out += self.paragraph(e, slot)
            elif k == "tbl":
                out.append(self.table(e, slot))
            elif k == "sdt":
                pr, content = e.find(x.q("w:sdtPr")), e.find(x.q("w:sdtContent"))
                n = Node("control", slot, attrs=control(pr))
                n.children = self.blocks(content, "body") if content is not None else []
                out.append(n)
            elif k in ("customXml", "smartTag"):
                out += self.blocks(e, slot)
            elif k in ("ins", "del", "moveTo", "moveFrom"):
                if self.keeps(k):
                    out += self.blocks(e, slot)
            elif k in ("oMathPara", "oMath"):
                out.append(Node("math_block", slot, mathml.from_omml(e)))
            elif k == "altChunk":
                out.append(Node("raw_block", slot, attrs={"format": "altChunk", "description": x.attr(e, "r:id") or ""}))
            elif k not in ("sectPr", "tcPr", "bookmarkStart", "bookmarkEnd", "proofErr", "permStart", "permEnd", "sdtPr", "pPr", "footnoteRef", "annotationRef") and self.unknown == "keep":
                out.append(Node("raw_block", slot, binary.gzip_b64(ET.tostring(e)), attrs={"format": "xml", "tag": k}))
        return self.grouped(out)

    def grouped(self, nodes: list[Node]) -> list[Node]:
        """Consecutive list paragraphs as nested lists: a stack of (level, number); any other block clears it. Consecutive paragraphs of the quote style are a quote."""
        nodes = self.quoted(nodes)
        out: list[Node] = []
        stack: list[tuple[int, str, Node]] = []
        for n in nodes:
            num = n.attrs.pop("num_id", None) if n.kind == "paragraph" else None
            level = int(n.attrs.pop("num_level", 0)) if n.kind == "paragraph" else 0
            if num in (None, "0"):
                stack = []
                out.append(n)
                continue
            while stack and (stack[-1][0] > level or stack[-1][0] == level and stack[-1][1] != num):
                stack.pop()
            if not stack or stack[-1][0] < level:
                made = self.list_node(num, level, "item" if stack else n.slot)
                (stack[-1][2].children[-1].children if stack else out).append(made)
                stack.append((level, num, made))
            n.slot = "item"
            stack[-1][2].children.append(Node("list_item", "item", level=level, children=[n]))
        return out

    def quoted(self, nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        for n in nodes:
            if n.kind == "paragraph" and "num_id" not in n.attrs and self.styles.get(n.style.get("style_id"), ("", None))[0] in ("quote", "intense quote"):
                if not (out and out[-1].kind == "quote"):
                    out.append(Node("quote", n.slot, attrs={"block": "true"}))
                n.slot = "quote"
                out[-1].children.append(n)
            else:
                out.append(n)
        return out

    def paragraph(self, p: ET.Element, slot: str) -> list[Node]:
        ppr = p.find(x.q("w:pPr"))
        style = paragraph_style(ppr)
        maths = [e for e in p if x.local(e.tag) not in ("pPr", "bookmarkStart", "bookmarkEnd", "proofErr")]
        if len(maths) == 1 and x.local(maths[0].tag) == "oMathPara":
            return [Node("math_block", slot, " ".join(mathml.from_omml(m) for m in maths[0].findall(x.q("m:oMath"))))]
        inlines = self.inlines(p)
        breaks = []
        if any(n.kind == "break" and n.attrs.get("type") in ("page", "column") for n in inlines) and all(n.kind in ("break", "bookmark") for n in inlines):
            return [Node("break_block", slot, attrs={"type": n.attrs["type"]}) for n in inlines if n.kind == "break"]
        name, outline = self.styles.get(style.get("style_id"), ("", None))
        level = style.get("outline", outline)
        if level is None and (m := re.fullmatch(r"heading (\d)", name)):
            level = int(m[1]) - 1
        elif level is None and name == "title":
            level = -1
        if ppr is not None and ppr.find(x.q("w:sectPr")) is not None:
            breaks = [Node("break_block", slot, attrs={"type": "section"})]
        if level is not None and -1 <= int(level) <= 8:
            label = next((n.attrs["name"] for n in inlines if n.kind == "bookmark" and n.attrs.get("type") == "start"), None)
            return [Node("heading", slot, level=0 if name == "title" else int(level) + 1, label=label, style=style, children=[n for n in inlines if n.kind != "bookmark"]), *breaks]
        if name == "code" and all(n.kind in ("text", "break") for n in inlines):
            return [Node("code", slot, "".join(n.text or "" if n.kind == "text" else "\t" if n.attrs.get("type") == "tab" else "\n" for n in inlines)), *breaks]
        if not inlines and set(style) == {"border_bottom"}:
            return [Node("divider", slot), *breaks]
        n = Node("paragraph", slot, style=style, children=inlines)
        num = ppr.find(x.q("w:numPr")) if ppr is not None else None
        if num is not None and x.value(num, "w:numId"):
            n.attrs |= {"num_id": x.value(num, "w:numId"), "num_level": x.value(num, "w:ilvl") or "0"}
        return ([n] if inlines or style or not breaks else []) + breaks

    def inlines(self, parent: ET.Element) -> list[Node]:
        out: list[Node] = []
        fields: list[list] = []  # [code, in result, nodes]

        def put(*nodes: Node) -> None:
            for n in nodes:
                (fields[-1][2] if fields and fields[-1][1] else out if not fields else []).append(n)

        def close() -> None:
            code, _, shown = fields.pop()
            put(Node("field", "inline", re.sub(r"\s+", " ", code).strip(), children=merged(shown)))

        for e in parent:
            k = x.local(e.tag)
            if k == "r":
                for kind, n in self.run(e):
                    if kind == "begin":
                        fields.append(["", False, []])
                    elif kind == "separate" and fields:
                        fields[-1][1] = True
                    elif kind == "end" and fields:
                        close()
                    elif kind == "code" and fields:
                        fields[-1][0] += n.text or ""
                    elif kind == "node":
                        put(n)
            elif k == "hyperlink":
                target, _ = self.at.get(x.attr(e, "r:id") or "", ("", False))
                anchor = x.attr(e, "w:anchor")
                put(Node("link", "inline", attrs={"target": target or anchor or "", "internal": str(not target and bool(anchor)).lower()}, children=self.inlines(e)))
            elif k == "fldSimple":
                put(Node("field", "inline", re.sub(r"\s+", " ", x.attr(e, "w:instr", "")).strip(), children=self.inlines(e)))
            elif k == "bookmarkStart":
                name = x.attr(e, "w:name", "")
                self.marks[x.attr(e, "w:id", "")] = name
                if not name.startswith("_"):
                    put(Node("bookmark", "inline", attrs={"name": name, "type": "start"}))
            elif k == "bookmarkEnd":
                name = self.marks.get(x.attr(e, "w:id", ""), x.attr(e, "w:id", ""))
                if not name.startswith("_"):
                    put(Node("bookmark", "inline", attrs={"name": name, "type": "end"}))
            elif k in ("commentRangeStart", "commentRangeEnd"):
                if self.comments != "drop":
                    put(Node("comment_anchor", "inline", attrs={"id": x.attr(e, "w:id", ""), "type": k[12:].lower()}))
            elif k in ("ins", "del", "moveTo", "moveFrom"):
                if self.keeps(k):
                    inner = self.inlines(e)
                    kind = {"ins": "insert", "del": "delete", "moveTo": "move_to", "moveFrom": "move_from"}[k]
                    put(*(inner if self.revisions in ("accept", "reject") else [Node("change", "inline", attrs={"type": kind, "author": x.attr(e, "w:author", ""), "date": x.attr(e, "w:date", "")}, children=inner)]))
            elif k in ("oMath", "oMathPara"):
                put(Node("math", "inline", mathml.from_omml(e)))
            elif k == "sdt":
                content = e.find(x.q("w:sdtContent"))
                put(*(self.inlines(content) if content is not None else []))
            elif k in ("smartTag", "customXml"):
                put(*self.inlines(e))
            elif k not in ("pPr", "proofErr", "permStart", "permEnd", "sectPr") and self.unknown == "keep":
                put(Node("raw_inline", "inline", binary.gzip_b64(ET.tostring(e)), attrs={"tag": k}))
        while fields:
            close()
        return merged(out)

    def run(self, r: ET.Element) -> Iterator[tuple[str, Node | None]]:
        style = run_style(r.find(x.q("w:rPr")), self.theme)
        node = lambda kind, text=None, **attrs: ("node", Node(kind, "inline", text, attrs=attrs, style=dict(style) if kind == "text" else {}))
        for e in r:
            k = x.local(e.tag)
            if k in ("t", "delText"):
                yield node("text", e.text or "")
            elif k == "instrText":
                yield "code", Node("text", text=e.text or "")
            elif k == "fldChar":
                yield x.attr(e, "w:fldCharType", ""), None
            elif k == "tab":
                yield node("break", type="tab")
            elif k in ("br", "cr"):
                yield node("break", type={"page": "page", "column": "column"}.get(x.attr(e, "w:type") or "", "line"))
            elif k == "noBreakHyphen":
                yield node("text", "‑")
            elif k == "softHyphen":
                yield node("text", "­")
            elif k == "sym":
                yield node("text", chr(int(x.attr(e, "w:char", "25A1"), 16)))
            elif k in ("footnoteReference", "endnoteReference"):
                kind, note = k[:-9], x.attr(e, "w:id", "")
                n = Node("note", "inline", attrs={"note_type": kind, "note_id": note})
                if (body := self.notes[kind].get(note)) is not None:
                    before, self.at = self.at, self.rels(f"word/{kind}s.xml")
                    n.children = self.blocks(body, "note")
                    self.at = before
                yield "node", n
            elif k == "commentReference":
                if self.comments != "drop":
                    yield node("comment_anchor", id=x.attr(e, "w:id", ""), type="reference")
            elif k in ("drawing", "pict", "object"):
                yield from (("node", n) for n in self.images(e))
            elif k not in ("rPr", "lastRenderedPageBreak", "footnoteRef", "endnoteRef", "annotationRef", "separator", "continuationSeparator") and self.unknown == "keep":
                yield node("raw_inline", binary.gzip_b64(ET.tostring(e)), tag=k)

    def images(self, e: ET.Element) -> Iterator[Node]:
        extent, pr = next(e.iter(x.q("wp:extent")), None), next(e.iter(x.q("wp:docPr")), None)
        for blip in e.iter(x.q("a:blip")):
            target, external = self.at.get(x.attr(blip, "r:embed") or x.attr(blip, "r:link") or "", ("", False))
            if external:
                yield Node("link", "inline", attrs={"target": target})
            elif target and (data := self.p.get(binary.safe_name("word/" + target))) is not None:
                digest = binary.sha256(data)
                self.resources.setdefault(digest, Node("resource", "meta", attrs={"id": digest[:16], "filename": target.rpartition("/")[2], "sha256": digest, "bytes": str(len(data))}))
                attrs = {"resource_id": digest[:16], "path": target}
                if extent is not None:
                    attrs |= {"width": f"{int(extent.get('cx', 0)) / 12700:g}pt", "height": f"{int(extent.get('cy', 0)) / 12700:g}pt"}
                if pr is not None and pr.get("descr"):
                    attrs["alt"] = pr.get("descr")
                yield Node("image", "inline", attrs=attrs)

    def table(self, t: ET.Element, slot: str) -> Node:
        n = Node("table", slot)
        open_: dict[int, Node] = {}
        widest = 1
        for r, tr in enumerate(t.findall(x.q("w:tr"))):
            row, c = Node("row", "row", attrs={"row": str(r)}), 0
            header = x.flag(tr.find(x.q("w:trPr")), "w:tblHeader")
            for tc in tr.findall(x.q("w:tc")):
                pr = tc.find(x.q("w:tcPr"))
                span = int(x.value(pr, "w:gridSpan") or 1)
                merge = pr.find(x.q("w:vMerge")) if pr is not None else None
                if merge is not None and x.attr(merge, "w:val", "continue") == "continue" and c in open_:
                    open_[c].attrs["rowspan"] = str(int(open_[c].attrs["rowspan"]) + 1)
                else:
                    cell = Node("cell", "cell", attrs={"row": str(r), "col": str(c), "colspan": str(span), "rowspan": "1", "header": str(bool(header)).lower()}, children=self.blocks(tc, "cell"))
                    row.children.append(cell)
                    open_.pop(c, None)
                    if merge is not None:
                        open_[c] = cell
                c += span
            widest = max(widest, c)
            n.children.append(row)
        n.attrs["columns"] = str(widest)
        return n


def parse(docs: DataFrame, revisions: str = "annotate", comments: str = "keep", unknown: str = "keep") -> DataFrame:
    """The node table of packages (doc_id, content)."""
    return _each(docs, lambda d, p: flatten(d, Reader(p, revisions, comments, unknown).document()), NODE_SCHEMA, _NODES)


def errors(docs: DataFrame) -> DataFrame:
    """(doc_id, error) of packages that don't open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    binary.unzip(data or b"")
                except Exception as e:
                    rows.append({"doc_id": doc_id, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=_strings("doc_id", "error"))

    return docs.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, "doc_id string, error string")
