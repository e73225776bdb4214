"""Packages: what the writer keeps and the reader finds again, by plain Python on the nodes, and the tables made of them."""

import re
import struct
import xml.etree.ElementTree as ET
import zlib

import pytest

from vellumgrid.functions import binary, ooxml
from vellumgrid.operators import corpus, sinks
from vellumgrid.operators.package_writer import PackageWriter, level_formats
from vellumgrid.plans import convert
from vellumgrid.sources import docx, markup
from vellumgrid.sources.markup import Node, parse_text


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (3 * width + 1) * height)) + chunk(b"IEND", b"")


def written(nodes, **options):
    return binary.unzip(PackageWriter(**options).package(nodes))


def again(nodes, **options):
    return docx.Reader(written(nodes, **options)).document()


def walk(nodes):
    for n in nodes:
        yield n
        yield from walk(n.children)


def plain(n):
    return (n.text or "") + "".join(map(plain, n.children))


def kinds(nodes):
    return [n.kind for n in nodes if n.kind not in ("section", "resource")]


def test_guard_looks_at_the_whole_part():
    bad = b"<?xml version='1.0'?><!--" + b"x" * 70_000 + b"--><!DOCTYPE a [<!ENTITY e 'boom'>]><a>&e;</a>"
    for data in (bad, bad.decode().replace("'1.0'", "'1.0' encoding='utf-16'").encode("utf-16"), b"<!DOCTYPE a><a/>"):
        with pytest.raises((ValueError, ET.ParseError)):
            ooxml.parse(data)
    assert ooxml.parse(b"<a>DOCTYPE and <![CDATA[<!DOCTYPE x>]]></a>").text == "DOCTYPE and <!DOCTYPE x>"
    assert ooxml.parse("<a>é</a>".encode("utf-16")).text == "é"


def test_strict_names():
    e = ooxml.parse(b'<w:p xmlns:w="http://purl.oclc.org/ooxml/wordprocessingml/main" w:x="1"/>')
    assert e.tag == ooxml.q("w:p") and e.attrib == {ooxml.q("w:x"): "1"}
    assert ooxml.parse(b'<Types xmlns="http://purl.oclc.org/ooxml/package/content-types"/>').tag == f"{{{ooxml.CT}}}Types"
    assert ooxml.relationship_type("http://purl.oclc.org/ooxml/officeDocument/relationships/styles").endswith("2006/relationships/styles")


def test_quote_keeps_lists_and_drops_nothing():
    nodes = parse_text("#quote(block: true)[Said\n\n- a\n- b\n- c\n\n#unknown(1)\n\nend]")
    out = again(nodes)
    assert [n.kind for n in out if n.cls == "block"] == ["quote", "list", "quote"]
    assert [plain(n) for n in walk(out) if n.kind == "list_item"] == ["a", "b", "c"]
    assert "Said" in plain(out[0]) and any(plain(n) == "end" for n in walk(out))


def test_paragraph_properties():
    own = {"align": "justify", "left": "36pt", "first_line": "18pt", "before": "6pt", "after": "12pt", "line": "1.15", "keep_next": "true", "widow_control": "false", "border_top": "single 0.5pt FF0000", "tabs": "left@72pt;right@144pt"}
    (p,) = [n for n in again([Node("paragraph", style=own, children=[Node("text", "inline", "x")])]) if n.kind == "paragraph"]
    assert p.style == own | {"align": "both"}
    (p,) = [n for n in again(parse_text("#align(center)[x]")) if n.kind == "paragraph"]
    assert p.style["align"] == "center"
    (p,) = [n for n in again(parse_text("#set par(leading: 0.65em)\n\nx")) if n.kind == "paragraph"]
    assert p.style["line"] == "1.15"


@pytest.mark.parametrize(("pattern", "form"), [("I.", "upperRoman"), ("a)", "lowerLetter"), ("(i)", "lowerRoman"), ("A.", "upperLetter"), ("1)", "decimal")])
def test_list_formats(pattern, form):
    nodes = parse_text(f'#set enum(numbering: "{pattern}")\n\n+ one\n+ two')
    assert f'w:val="{form}"'.encode() in written(nodes)["word/numbering.xml"]
    (found,) = [n for n in again(nodes) if n.kind == "list"]
    assert found.numbering == pattern and found.attrs["format"] == "decimal"
    text = sinks.MarkupWriter().text(again(nodes))
    assert [n.numbering for n in walk(parse_text(text)) if n.kind == "list"] == [pattern]


def test_levels_of_a_pattern():
    assert level_formats("decimal", "1.a.")[:3] == [("decimal", "%1."), ("lowerLetter", "%2."), ("lowerLetter", "%3.")]
    assert level_formats("bullet", None)[0][0] == "bullet" and level_formats("term", None)[0] == ("none", "")


def test_start_of_a_list():
    (found,) = [n for n in again(parse_text("#enum(start: 7)[a][b]")) if n.kind == "list"]
    assert found.attrs["start"] == "7" and len(found.children) == 2


def test_sections():
    text = "#set page(width: 400pt)\n\none\n\n#set page(width: 500pt, height: 300pt)\n\n#table(columns: 1, [x])\n\n#set page(columns: 2)\n\nthree"
    nodes = parse_text(text)
    assert [n.attrs["width"] for n in nodes if n.kind == "section"] == ["400pt", "500pt", "500pt"]
    out = again(nodes)
    sections = [n.attrs for n in out if n.kind == "section"]
    assert [s["width"] for s in sections] == ["400pt", "500pt", "500pt"] and sections[1]["orientation"] == "landscape" and sections[2]["columns"] == "2"
    assert [n.attrs["type"] for n in out if n.kind == "break_block"] == ["section", "section"]
    back = parse_text(sinks.MarkupWriter().text(out))
    assert [n.attrs["width"] for n in back if n.kind == "section"] == ["400pt", "500pt", "500pt"]


def test_page_numbers_and_headers():
    nodes = parse_text('#set page(numbering: "1 of 1", number-align: right)\n\nx')
    section = next(n for n in again(nodes) if n.kind == "section")
    assert [n.text for n in walk(section.children) if n.kind == "field"] == ["PAGE", "NUMPAGES"]
    assert section.children[0].style["align"] == "right" and plain(section.children[0]).replace("NUMPAGES", "").replace("PAGE", "") == "1 of 1"
    head = lambda use, text: Node("paragraph", f"header_{use}", children=[Node("text", "inline", text)])
    first = Node("section", "meta", children=[head("default", "all"), head("first", "cover"), head("even", "left")])
    parts = written([Node("paragraph", children=[Node("text", "inline", "x")]), first])
    assert b"evenAndOddHeaders" in parts["word/settings.xml"] and b"titlePg" in parts["word/document.xml"]
    found = next(n for n in docx.Reader(parts).document() if n.kind == "section")
    assert {(c.slot, plain(c)) for c in found.children} == {("header_default", "all"), ("header_first", "cover"), ("header_even", "left")}


def test_changes_are_valid_and_deleted_text_is_marked():
    text = lambda t: [Node("text", "inline", t)]
    nodes = [Node("paragraph", children=[Node("change", "inline", attrs={"type": k, "author": "a"}, children=text(k)) for k in ("insert", "delete", "move_to", "move_from")])]
    body = written(nodes)["word/document.xml"].decode()
    assert "<w:delText" in body and len(set(re.findall(r'<w:(?:ins|del|moveTo|moveFrom) w:id="(\d+)"', body))) == 4
    assert plain(again(nodes)[0]) == "insertdeletemove_tomove_from"
    assert plain(again(nodes, revisions="accept")[0]) == "insertmove_to"
    with pytest.raises(ValueError):
        PackageWriter(revisions="other")


def test_endnotes_and_links_within_notes():
    note = lambda kind, url: Node("note", "inline", attrs={"note_type": kind}, children=[Node("paragraph", "note", children=[Node("link", "inline", attrs={"target": url}, children=[Node("text", "inline", kind)])])])
    parts = written([Node("paragraph", children=[note("footnote", "http://f"), note("endnote", "http://e"), note("endnote", "http://g")])])
    assert "word/_rels/endnotes.xml.rels" in parts
    found = [(n.attrs["note_type"], n.attrs["note_id"], next(c.attrs["target"] for c in walk(n.children) if c.kind == "link")) for n in walk(docx.Reader(parts).document()) if n.kind == "note"]
    assert found == [("footnote", "1", "http://f"), ("endnote", "1", "http://e"), ("endnote", "2", "http://g")]


def test_comments():
    anchor = lambda k, kind: Node("comment_anchor", "inline", attrs={"id": k, "type": kind})
    remark = Node("comment", "comment", attrs={"id": "c9", "author": "A", "initials": "x"}, children=[Node("paragraph", "comment", children=[Node("text", "inline", "why")])])
    nodes = [Node("paragraph", children=[anchor("c9", "start"), Node("text", "inline", "t"), anchor("c9", "end"), anchor("c9", "reference"), anchor("gone", "reference")]), remark]
    out = again(nodes)
    (c,) = [n for n in out if n.kind == "comment"]
    assert plain(c) == "why" and c.attrs == {"id": "0", "author": "A", "initials": "x"}
    assert [n.attrs["type"] for n in walk(out) if n.kind == "comment_anchor"] == ["start", "end", "reference"] and plain(out[0]) == "t[comment gone]"


def test_images(spark):
    data = png(200, 100)
    nodes = parse_text('#image("p/a.png", width: 60pt, alt: "pic")')
    parts = written(nodes, media={"p/a.png": ("a.png", data)})
    assert [v for k, v in parts.items() if k.startswith("word/media/")] == [data]
    (image,) = [n for n in walk(docx.Reader(parts).document()) if n.kind == "image"]
    assert (image.attrs["width"], image.attrs["height"], image.attrs["alt"]) == ("60pt", "30pt", "pic")
    assert plain(again(nodes)[0]) == "pic", "without its bytes an image is its alternative text"
    frame = spark.createDataFrame([("d", '#image("p/a.png")'), ("e", "x")], "doc_id string, text string")
    files = spark.createDataFrame([("d", "p/a.png", "a.png", bytearray(data))], "doc_id string, key string, filename string, data binary")
    made = sinks.to_packages(markup.parse(frame), files)
    (m,) = docx.media(made).collect()
    assert (m.doc_id, m.media_type, m.width, m.height, bytes(m.data)) == ("d", "image/png", 150.0, 75.0, data) and made.count() == 2
    assert convert.validate(made).where("NOT valid OR size(warnings) > 0").count() == 0


def test_controls_theme_fonts_and_raw_elements():
    a = {"alias": "A", "tag": "T", "control": "date", "xpath": "/x", "store": "{1}"}
    out = again([Node("control", attrs=a, children=[Node("paragraph", children=[Node("text", "inline", "v")])])])
    assert out[0].attrs == a and plain(out[0]) == "v"
    rpr = ooxml.make("w:rPr", ooxml.make("w:rFonts", w__asciiTheme="minorHAnsi"))
    assert docx.run_style(rpr, {"minorHAnsi": "F"}) == {"font": "F"} and docx.run_style(rpr) == {}
    raw = lambda xml: Node("raw_block", text=binary.gzip_b64(xml), attrs={"format": "xml", "tag": "x"})
    w = f'xmlns:w="{ooxml.W}"'
    assert kinds(again([raw(f"<w:p {w}><w:r><w:t>k</w:t></w:r></w:p>".encode()), raw(f"<w:body {w}/>".encode()), raw(b"<script/>")])) == ["paragraph"]


def test_code_divider_and_styles():
    out = again(parse_text("```py\na\n\n  b\n```\n\n#line(length: 100%)\n\nx"))
    assert kinds(out) == ["code", "divider", "paragraph"] and out[0].text == "a\n\n  b"
    assert {"Caption", "Quote", "Code"} <= set(re.findall(r'w:styleId="(\w+)"', written(parse_text("x"))["word/styles.xml"].decode()))


def test_theme_lists_are_checked(spark):
    parts = written(parse_text("x"))
    bad = parts | {"word/theme/theme1.xml": parts["word/theme/theme1.xml"].replace(b"<a:effectStyle><a:effectLst /></a:effectStyle>", b"", 1)}
    df = spark.createDataFrame([("good", bytearray(binary.zip_bytes(parts))), ("bad", bytearray(binary.zip_bytes(bad)))], "doc_id string, content binary")
    got = {r.doc_id: r for r in convert.validate(df).collect()}
    assert got["good"].valid and got["bad"].errors == ["word/theme/theme1.xml: effectStyleLst has 2 entries, not 3"]


def test_children_in_the_schemas_order():
    e = ooxml.make("w:pPr", *[ooxml.make(f"w:{k}") for k in ("zz", "jc", "ind", "pStyle", "aa")])
    assert [ooxml.local(c.tag) for c in ooxml.in_order(e)] == ["pStyle", "ind", "jc", "zz", "aa"]


def test_includes_are_merged_to_a_depth(spark):
    files = [("m.typ", '#set text(font: "M")\n#include "a/n.typ"\n\nlast'), ("a/n.typ", '#set page(width: 9pt)\n= N\n#include "o.typ"\n#include "../x.typ"'), ("a/o.typ", '#include "n.typ"\n\nO')]
    nodes = markup.parse_with_includes(spark.createDataFrame(files, "doc_id string, text string"))
    top = [r.kind for r in nodes.where("doc_id = 'm.typ' AND parent IS NULL").orderBy("pre").collect()]
    assert top.count("heading") == top.count("paragraph") == 8 + 1 or top[0] == "heading"
    assert "section" not in top and set(top) == {"heading", "paragraph", "warning"}
    warnings = {r.text for r in nodes.where("kind = 'warning'").collect()}
    assert "include not found: ../x.typ" in warnings and any(w.startswith("include too deep") for w in warnings)


def test_assets_and_fonts_from_files(spark, tmp_path):
    r = spark.createDataFrame([("d", "id000001", "a b.txt", bytearray(b"1")), ("d", "id000002", "a b.txt", bytearray(b"2")), ("e", "id000003", "a b.txt", bytearray(b"2"))], "doc_id string, id string, filename string, data binary")
    sinks.write_assets(r, str(tmp_path / "out"))
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"d/a-b.txt": b"1", "d/a-b-id000002.txt": b"2", "e/a-b.txt": b"2"}
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.write_assets(r, str(tmp_path / "out"))
    (tmp_path / "fonts" / "deep").mkdir(parents=True)
    (tmp_path / "fonts" / "deep" / "x.ttf").write_bytes(b"no font")
    assert docx.system_fonts(spark, str(tmp_path / "fonts")).count() == 0


def test_matrix_export_and_maps(spark):
    rows = spark.createDataFrame([("1", "A", "m", "p", "full", "none", "n"), ("2", "B", "m", "p", "full", "none", "n")], "id string, category string, markup string, package string, to_package string, to_markup string, notes string")
    assert corpus.export_matrix(rows).first().markdown.startswith("| id | category | markup | package | to_package | to_markup | notes |")
    assert corpus.export_matrix(rows, "b").first().markdown.startswith("Rows: 1\n\n| id | category | markup | package | to_package | to_markup |\n")
