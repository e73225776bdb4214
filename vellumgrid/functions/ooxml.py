"""XML for packages: hardened parsing, namespace forms, canonical bytes, and small accessors."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from functools import lru_cache
from xml.parsers import expat

# Namespaces of the transitional form.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
M = "http://schemas.openxmlformats.org/officeDocument/2006/math"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
PIC = "http://schemas.openxmlformats.org/drawingml/2006/picture"
REL = "http://schemas.openxmlformats.org/package/2006/relationships"
CT = "http://schemas.openxmlformats.org/package/2006/content-types"
CP = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
DC = "http://purl.org/dc/elements/1.1/"
DCT = "http://purl.org/dc/terms/"
B = "http://schemas.openxmlformats.org/officeDocument/2006/bibliography"
PREFIXES = {"w": W, "r": R, "m": M, "a": A, "wp": WP, "pic": PIC, "cp": CP, "dc": DC, "dcterms": DCT, "b": B}
EP = "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"
CUST = "http://schemas.openxmlformats.org/officeDocument/2006/custom-properties"
VT = "http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes"
PREFIXES |= {"ep": EP, "cust": CUST, "vt": VT}
# The strict form's namespaces.
STRICT = {
    "http://purl.oclc.org/ooxml/wordprocessingml/main": W,
    "http://purl.oclc.org/ooxml/officeDocument/relationships": R,
    "http://purl.oclc.org/ooxml/package/relationships": REL,
    "http://purl.oclc.org/ooxml/package/content-types": CT,
    "http://purl.oclc.org/ooxml/drawingml/main": A,
    "http://purl.oclc.org/ooxml/drawingml/wordprocessingDrawing": WP,
    "http://purl.oclc.org/ooxml/drawingml/picture": PIC,
    "http://purl.oclc.org/ooxml/officeDocument/math": M,
    "http://purl.oclc.org/ooxml/package/metadata/core-properties": CP,
    "http://purl.oclc.org/ooxml/officeDocument/extended-properties": EP,
    "http://purl.oclc.org/ooxml/officeDocument/custom-properties": CUST,
    "http://purl.oclc.org/ooxml/officeDocument/docPropsVTypes": VT,
    "http://purl.oclc.org/ooxml/officeDocument/bibliography": B,
}
# Prefixes of the strict form's relationship types.
STRICT_TYPES = {
    "http://purl.oclc.org/ooxml/officeDocument/relationships/": "http://schemas.openxmlformats.org/officeDocument/2006/relationships/",
    "http://purl.oclc.org/ooxml/package/relationships/metadata/": "http://schemas.openxmlformats.org/package/2006/relationships/metadata/",
}
for _prefix, _uri in PREFIXES.items():
    if _prefix not in ("ep", "cust"):
        ET.register_namespace(_prefix, _uri)

# The order that the schema gives to the children of an element.
CHILD_ORDER = {
    "pPr": "pStyle keepNext keepLines pageBreakBefore framePr widowControl numPr suppressLineNumbers pBdr shd tabs suppressAutoHyphens kinsoku wordWrap overflowPunct topLinePunct autoSpaceDE autoSpaceDN bidi adjustRightInd snapToGrid spacing ind contextualSpacing mirrorIndents suppressOverlap jc textDirection textAlignment textboxTightWrap outlineLvl divId cnfStyle rPr sectPr pPrChange",
    "rPr": "rStyle rFonts b bCs i iCs caps smallCaps strike dstrike outline shadow emboss imprint noProof snapToGrid vanish webHidden color spacing w kern position sz szCs highlight u effect bdr shd fitText vertAlign rtl cs em lang eastAsianLayout specVanish oMath rPrChange",
    "style": "name aliases basedOn next link autoRedefine hidden uiPriority semiHidden unhideWhenUsed qFormat locked personal personalCompose personalReply rsid pPr rPr tblPr trPr tcPr tblStylePr",
    "sectPr": "headerReference footerReference footnotePr endnotePr type pgSz pgMar paperSrc pgBorders lnNumType pgNumType cols formProt vAlign noEndnote titlePg textDirection bidi rtlGutter docGrid printerSettings sectPrChange",
    "lvl": "start numFmt lvlRestart pStyle isLgl suff lvlText lvlPicBulletId legacy lvlJc pPr rPr",
}
_RANK = {parent: {c: k for k, c in enumerate(names.split())} for parent, names in CHILD_ORDER.items()}


def in_order(e: ET.Element) -> ET.Element:
    """The element with its children in the schema's order; unknown ones come last, equals stay as they were."""
    rank = _RANK.get(local(e.tag), {})
    e[:] = sorted(e, key=lambda c: rank.get(local(c.tag), len(rank)))
    return e


def _refuse(*_) -> None:
    raise ValueError("document types and entities aren't allowed")


def parse(data: bytes) -> ET.Element:
    """The root of a part: no document type, no entities; strict namespaces become transitional."""
    # Only an encoding of more than one byte a character can hide the word; a parser then says whether it is a declaration.
    if b"DOCTYPE" in data or b"\0" in data[:64]:
        p = expat.ParserCreate()
        p.StartDoctypeDeclHandler = p.EntityDeclHandler = _refuse
        try:
            p.Parse(data, True)
        except expat.ExpatError as e:
            raise ET.ParseError(str(e)) from e
    root = ET.fromstring(data)
    for e in root.iter():
        if e.tag[:1] == "{" and (uri := e.tag[1:].split("}")[0]) in STRICT:
            e.tag = f"{{{STRICT[uri]}}}{local(e.tag)}"
        for k in [k for k in e.attrib if k[:1] == "{" and k[1:].split("}")[0] in STRICT]:
            e.attrib[f"{{{STRICT[k[1:].split('}')[0]]}}}{local(k)}"] = e.attrib.pop(k)
    return root


def relationship_type(kind: str) -> str:
    """A relationship type in the transitional form."""
    for strict, own in (STRICT_TYPES | STRICT).items():
        if kind.startswith(strict):
            return own + kind[len(strict) :]
    return kind


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def q(name: str) -> str:
    prefix, _, tag = name.partition(":")
    return f"{{{PREFIXES[prefix]}}}{tag}"


def attr(e: ET.Element | None, name: str, default: str | None = None) -> str | None:
    return default if e is None else e.get(q(name), default)


def flag(parent: ET.Element | None, name: str) -> bool | None:
    """A switch element: absent is None, bare is true; 0, false, off, no and none are false."""
    e = None if parent is None else parent.find(q(name))
    if e is None:
        return None
    return (attr(e, "w:val", "true") or "").lower() not in ("0", "false", "off", "no", "none")


def value(parent: ET.Element | None, name: str, key: str = "w:val") -> str | None:
    return None if parent is None else attr(parent.find(q(name)), key)


def canonical(data: bytes) -> bytes:
    """Canonical form of a part, or the part itself if it isn't XML. Small parts are remembered: most are the same in every package of a corpus."""
    return _remembered(data) if len(data) <= 1 << 15 else _canonical(data)


def _canonical(data: bytes) -> bytes:
    try:
        parse(data)
        out = io.StringIO()
        ET.canonicalize(data.decode("utf-8-sig"), out=out)
        return out.getvalue().encode()
    except (ET.ParseError, ValueError, UnicodeDecodeError):
        return data


_remembered = lru_cache(128)(_canonical)


def dump(root: ET.Element) -> bytes:
    return b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + ET.tostring(root, encoding="utf-8")


def make(name: str, /, *children: ET.Element | None, text: str | None = None, **attrs) -> ET.Element:
    """An element; attributes with __ are prefixed names (w__val)."""
    e = ET.Element(q(name), {q(k.replace("__", ":")) if "__" in k else k: str(v) for k, v in attrs.items() if v is not None})
    e.extend(c for c in children if c is not None)
    e.text = text
    return e
