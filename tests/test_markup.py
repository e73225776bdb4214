"""The parser, its inverse, and the package codecs."""

import pytest

from vellumgrid.functions import binary, mathml
from vellumgrid.functions import ooxml as x
from vellumgrid.functions import scan
from vellumgrid.operators.sinks import MarkupWriter, PackageWriter, escape
from vellumgrid.plans import convert
from vellumgrid.sources.docx import Reader
from vellumgrid.sources.markup import flatten, parse_text, tree

TEXT = """#set document(title: "T")
#set page(margin: (x: 2cm, y: 1cm), paper: "a4")
#set heading(numbering: "1.")

= One <a>

See @a and #link("http://e.org")[*bold* _it_] $x^2$ note#footnote[Body].

- b1
- b2
  + n1

+ n2

/ T: term

#table(columns: 5, table.cell(rowspan: 2)[A], [B], table.cell(rowspan: 2)[C], [D], [E], [F], [G], [H])

#figure(caption: [Cap], kind: "chart")[body] <f>

$ a/b $ <eq>

```py
code
```

#quote(block: true, attribution: [Me])[Said]
"""


def kinds(nodes):
    return [n.kind for n in nodes if n.cls == "block"]


def test_blocks():
    n = parse_text(TEXT)
    assert kinds(n) == ["heading", "paragraph", "list", "list", "list", "table", "figure", "math_block", "code", "quote"]
    assert [b.attrs["format"] for b in n if b.kind == "list"] == ["bullet", "decimal", "term"]
    assert n[0].label == "a" and n[0].numbering == "1."
    nested = next(b for b in n if b.kind == "list").children[1].children
    assert [c.kind for c in nested] == ["paragraph", "list"] and nested[1].attrs["format"] == "decimal"


def test_first_fit_places_around_row_spans():
    t = next(b for b in parse_text(TEXT) if b.kind == "table")
    places = [(int(c.attrs["row"]), int(c.attrs["col"])) for r in t.children for c in r.children]
    assert places == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (1, 3), (1, 4)]


def test_checkbox_stays_text():
    item = parse_text("- [x] done")[0].children[0]
    assert item.children[0].children[0].text == "[x] done"


def test_comments():
    assert "".join(c.text for n in parse_text("a /* x */ b // c") for c in n.children) == "a  b "
    assert kinds(parse_text("/* one\ntwo */\n= H")) == ["heading"]
    assert kinds(parse_text("// gone")) == []


@pytest.mark.parametrize("text", ["a*b_c", "http://x.org/y", "= x", "- y", "+ z", "/ w", "a // b", "#let x", "$5 <tag> @me [q] `r` ~ \\", "/* no */"])
def test_escape_is_undone(text):
    (p,) = parse_text(escape(text))
    assert p.kind == "paragraph" and "".join(c.text for c in p.children) == text


def test_render_is_a_fixed_point():
    once = MarkupWriter().text(parse_text(TEXT))
    assert MarkupWriter().text(parse_text(once)) == once


def test_tree_inverts_flatten():
    n = parse_text(TEXT)
    assert tree(list(flatten("d", n))) == n


def test_package_is_deterministic_and_reads_back():
    a, b = (PackageWriter().package(parse_text(TEXT)) for _ in (0, 1))
    assert a == b
    back = Reader(binary.unzip(a)).document()
    assert kinds(back)[:2] == ["heading", "paragraph"]
    table = next(n for n in back if n.kind == "table")
    assert [c.attrs["rowspan"] for c in table.children[0].children] == ["2", "1", "2", "1", "1"]
    assert [m.text for m in back if m.kind == "math_block"] == ["frac(a, b)"]
    assert back[0].label == "a"


def test_math_both_ways():
    for text in ("frac(1, 2) + sqrt(x)", "mat(a, b; c, d)", "x_1^2", "root(3, x)", "sin(x)"):
        assert mathml.from_omml(mathml.to_omml(text)) == text
    assert mathml.from_omml(x.make("m:oMath", x.make("m:r", x.make("m:t", text="MTBF")))) == '"MTBF"'


def test_unsafe_packages_are_refused():
    with pytest.raises(ValueError):
        binary.safe_name("../x")
    with pytest.raises(ValueError):
        binary.unzip(binary.zip_bytes({"a": b""}))
    with pytest.raises(ValueError):
        x.parse(b"<!DOCTYPE a><a/>")


def test_strict_namespaces():
    e = x.parse(b'<d xmlns="http://purl.oclc.org/ooxml/wordprocessingml/main"/>')
    assert e.tag == x.q("w:d")


def test_images_and_fonts():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (4).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"\0" * 9
    assert binary.image_size(png)[:2] == (4, 3)
    assert binary.fitted_points(b'<svg width="200" height="100">', 120, None) == (120, 60)
    data = bytes(range(64))
    key = "{00112233-4455-6677-8899-AABBCCDDEEFF}"
    assert binary.deobfuscate_font(binary.deobfuscate_font(data, key), key) == data
    assert binary.ungzip_b64(binary.gzip_b64(b"x" * 99)) == b"x" * 99


def test_exact_round_trip():
    content = PackageWriter().package(parse_text("= A"))
    text = convert.embed_package("= A\n", content)
    assert convert.extract_package(text) == ("= A\n", content, True)
    assert convert.extract_package(text + "edit")[2] is False
    with pytest.raises(ValueError):
        convert.extract_package(text.replace("// package: ", "// package: " + "0" * 64 + "\n// was: "))
    with pytest.raises(ValueError):
        convert._decide("exact", False, False)


def test_scanners():
    assert scan.split_top('a, (b, c), "d, e", [f, g]') == ["a", "(b, c)", '"d, e"', "[f, g]"]
    assert scan.literal("(1, 2.5, true)") == [1, 2.5, True]
    assert scan.literal('(a: "x", b: none)') == {"a": "x", "b": None}
    assert scan.balanced("(it's [don't)]", 0) == -1
