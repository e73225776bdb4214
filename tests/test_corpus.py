"""Table operators on small frames, and the lifecycles."""

from pyspark.sql import functions as F

from vellumgrid.functions import scalar
from vellumgrid.operators import corpus, resolve, sinks
from vellumgrid.plans import convert
from vellumgrid.sources import docx, markup
from vellumgrid.streaming import markup_nodes

TEXT = '#set heading(numbering: "1.")\n= One <a>\n\nSee @a.\n\n== Two\n\n- x\n- y\n'


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    lit = F.lit
    cases = [
        (scalar.parse_length(lit("1.5em")), 16.5), (scalar.parse_length(lit("2fr")), None), (scalar.format_length(lit(28.3464567)), "28.346pt"), (scalar.format_length(lit(None).cast("double")), "auto"),
        (scalar.normalize_colour(lit("#abc")), "AABBCC"), (scalar.highlight_to_hex(lit("darkCyan")), "008080"), (scalar.hex_to_highlight(lit("#ff0")), "yellow"), (scalar.markup_colour(lit("red")), 'rgb("#FF0000")'),
        (scalar.points_to_half_points(lit(1.25)), 2), (scalar.counter(lit(27).cast("long"), lit("a")), "aa"), (scalar.counter(lit(0).cast("long"), lit("I")), "I"),
        (scalar.unescape_string(scalar.escape_string(lit('a"\\n\n\t\\'))), 'a"\\n\n\t\\'), (scalar.sanitize_filename(lit("C:\\x\\my file!.png")), "my-file-.png"), (scalar.safe_part_name(lit("word/../a/./b")), "a/b"),
        (scalar.rels_part_for(lit("word/document.xml")), "word/_rels/document.xml.rels"), (scalar.media_type(lit("x"), lit(b"\xff\xd8\xff").cast("binary")), "image/jpeg"), (scalar.page_pattern(lit("1 of 1")), "1 of 1"), (scalar.page_pattern(lit("Page 1")), None),
        (scalar.field_markup(lit("CITATION k \\p 3"), lit(""), lit(True)), '#cite(label("k"), supplement: [p. 3])'), (scalar.people(lit("L"), lit("F"), lit("M"), lit(None)), "L, F M"), (scalar.default_output(lit("a.typ")), "a.docx"),
    ]
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    for k, (_, want) in enumerate(cases):
        assert row[k] == want, (k, row[k], want)


def test_nested_lists_and_fields(spark):
    p = spark.createDataFrame([("d", 0, 0, 1), ("d", 1, 1, 1), ("d", 2, 0, 1), ("d", 3, 0, None), ("d", 4, 0, 1)], "doc_id string, pre long, level int, num_id int")
    rows = {r.pre: (r.list_no, r.parent_pre) for r in resolve.nested_lists(p).collect()}
    assert rows == {0: (1, None), 1: (2, 0), 2: (1, None), 4: (3, None)}
    e = [("begin", ""), ("text", "REF "), ("begin", ""), ("text", "PAGE"), ("end", ""), ("separate", ""), ("text", "seen"), ("end", ""), ("begin", ""), ("text", "DATE")]
    ev = spark.createDataFrame([("d", k, a, t) for k, (a, t) in enumerate(e)], "doc_id string, pos long, event string, text string")
    assert sorted((r.depth, r.code, r.result) for r in resolve.field_spans(ev).collect()) == [(1, "DATE", ""), (1, "REF", "seen"), (2, "PAGE", "")]


def test_ids_and_bookmarks(spark):
    r = spark.createDataFrame([("d", 0, "5"), ("d", 1, "x"), ("d", 2, "5"), ("d", 3, "1")], "doc_id string, pre long, key string")
    assert [x.id for x in resolve.next_free_ids(r).orderBy("pre").collect()] == [5, 1, 5, 2]
    b = spark.createDataFrame([("d", 1, "start", "n"), ("d", 1, "end", None), ("d", 2, "start", "_h"), ("d", 3, "end", None)], "doc_id string, mark_id int, type string, name string")
    assert sorted((x.mark_id, x.type, x.name) for x in resolve.bookmark_names(b).collect()) == [(1, "end", "n"), (1, "start", "n"), (3, "end", "3")]


def test_styles_with_maps_and_false(spark):
    s = spark.createDataFrame([("d", "a", "b", False, {"x": "1"}), ("d", "b", "gone", True, {"x": "0", "y": "2"}), ("d", "__docDefaults__", None, None, {"z": "3"})], "doc_id string, style_id string, based_on string, bold boolean, borders map<string,string>")
    r = {x.style_id: x for x in resolve.resolve_styles(s, ["bold"], ("borders",)).collect()}
    assert r["a"].bold is False and r["a"].borders == {"x": "1", "y": "2", "z": "3"} and r["b"].bold is True


def test_long_style_chain(spark):
    rows = [("d", f"s{k:03d}", f"s{k + 1:03d}" if k < 105 else None, "Far" if k == 105 else None) for k in range(106)]
    rows += [("d", "__docDefaults__", None, "Default"), ("d", "a", "b", None), ("d", "b", "a", "Loop")]
    out = {r.style_id: r for r in resolve.resolve_styles(spark.createDataFrame(rows, "doc_id string, style_id string, based_on string, font string"), ["font"]).collect()}
    assert out["s000"].font == "Far" and not out["s000"].cyclic
    assert out["a"].font == "Loop" and out["a"].cyclic


def test_style_chains_of_any_number(spark):
    key = "spark.sql.cteRecursionRowLimit"
    rows = [("d", f"s{k}", "base", None) for k in range(40)] + [("d", "base", None, "Far"), ("e", "solo", None, "Own")]
    spark.conf.set(key, "50")  # a stand-in for the million rows by default: 82 rows of chains
    try:
        out = resolve.resolve_styles(spark.createDataFrame(rows, "doc_id string, style_id string, based_on string, font string"), ["font"]).collect()
    finally:
        spark.conf.unset(key)
    assert sorted((r.style_id, r.font) for r in out) == sorted([*((f"s{k}", "Far") for k in range(40)), ("base", "Far"), ("solo", "Own")])


def test_exact_round_trip_makes_each_package_once(spark):
    d = spark.createDataFrame([(str(k), f"plain {k}") for k in range(9)], "doc_id string, text string")
    packages = sinks.to_packages(markup.parse(d))
    assert packages.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")), "small rows are not put into one task"
    back = convert.packages_to_texts(convert.texts_to_packages(d), "exact")
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("probe(content") == 1, "neither a filter nor a parser asks again"
    assert sorted(map(tuple, back.collect())) == [(str(k), f"plain {k}") for k in range(9)]


def test_convert_inspect_validate(spark):
    files = spark.createDataFrame([("d", TEXT), ("e", "= Solo")], "doc_id string, text string")
    packages = convert.texts_to_packages(files, embed=False).cache()
    back = {r.doc_id: r.text for r in convert.packages_to_texts(packages, mode="semantic", embed=False).collect()}
    assert "= One <a>" in back["d"] and "- x" in back["d"]
    exact = convert.packages_to_texts(packages, mode="semantic", embed=True)
    again = {r.doc_id: bytes(r.content) for r in convert.texts_to_packages(exact, mode="exact").collect()}
    assert again == {r.doc_id: bytes(r.content) for r in packages.collect()}
    v = {r.doc_id: (r.valid, r.errors) for r in convert.validate(packages.unionByName(spark.createDataFrame([("bad", b"no zip")], "doc_id string, content binary"))).collect()}
    assert v["d"] == (True, []) and v["e"][0] and not v["bad"][0]
    assert convert.inspect(files, "markup").count() == 2 and convert.inspect(packages, "package").count() == 2


def test_dangling_relationship_is_found(spark):
    from vellumgrid.functions import binary
    from vellumgrid.operators.sinks import PackageWriter

    parts = binary.unzip(PackageWriter().package(markup.parse_text("= A")))
    del parts["word/styles.xml"]
    d = spark.createDataFrame([("d", binary.zip_bytes(parts))], "doc_id string, content binary")
    (r,) = convert.validate(d).collect()
    assert r.errors == ["missing relationship target word/styles.xml"]


def test_digest_ignores_volatile_parts(spark):
    p = spark.createDataFrame([("d", "a.xml", b"<a/>"), ("d", "docProps/core.xml", b"1"), ("e", "a.xml", b"<a/>"), ("f", "a.xml", b"<b/>")], "doc_id string, name string, data binary")
    r = {x.doc_id: x.digest for x in corpus.package_digest(p).collect()}
    assert r["d"] == r["e"] != r["f"]


def test_tracked_changes_and_sections(spark):
    from vellumgrid.functions import binary

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:r><w:t>a</w:t></w:r><w:ins w:author="x"><w:r><w:t>b</w:t></w:r></w:ins><w:del><w:r><w:delText>c</w:delText></w:r></w:del></w:p><w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>'
    content = binary.zip_bytes({"[Content_Types].xml": b"<Types/>", "word/document.xml": body.encode()})
    d = spark.createDataFrame([("d", content)], "doc_id string, content binary")
    text = lambda policy: "".join(r.text for r in docx.parse(d, policy).where("kind = 'text'").orderBy("pre").collect())
    assert (text("accept"), text("reject"), text("annotate")) == ("ab", "ac", "abc")
    assert docx.parse(d).where("kind = 'section'").first().attrs["width"] == "595.3pt"


def test_matrix(spark, tmp_path):
    f = tmp_path / "m.md"
    f.write_text("| ID | x |\n|---|---|\n| M0001 | Text | `a \\| b` (syntax) | `w:p` in `word/document.xml` | exact | high | full | partial | Note. |\n| M0002 | Math | `$x$` (syntax) | `m:oMath` in `x` | none | none | none | none | Other. |\n")
    m = corpus.read_matrix(spark, str(f))
    assert m.first().markup == "a | b" and m.first().package_part == "word/document.xml"
    assert corpus.search(m, "TEXT").count() == 1 and corpus.search(m, None, "other").first().id == "M0002"
    assert {(r.direction, r.measure, r.value): r.n for r in corpus.coverage_counts(m).collect()}[("to_package", "fidelity", "exact")] == 1
    assert "a \\| b" in corpus.matrix_markdown(m, ["id", "markup"]).first().markdown
    corpus.write_csv(m, str(tmp_path / "out"))
    try:
        corpus.write_csv(m, str(tmp_path / "out"))
        raise AssertionError("overwrote a target")
    except Exception as e:
        assert "already exists" in str(e).lower() or "EXISTS" in str(e)


def test_bibliography(spark):
    b = spark.createDataFrame([("d", "k", "book", {"zz": "1", "title": "T {x}", "author": "A"})], "doc_id string, tag string, entry_type string, fields map<string,string>")
    assert corpus.bib_text(b).first().text == "@book{k,\n  author = {A},\n  title = {T \\{x\\}},\n  zz = {1},\n}\n"


def test_includes_and_stream(spark, tmp_path):
    files = spark.createDataFrame([("a/m.typ", '#include "n.typ"'), ("a/n.typ", '#include "o.typ"\n#include "../x.typ"'), ("a/o.typ", '#include "m.typ"')], "doc_id string, text string")
    got = {(r.doc_id, r.included): r.depth for r in markup.includes(files).collect()}
    assert got[("a/m.typ", "a/o.typ")] == 2 and ("a/n.typ", "x.typ") not in got
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.typ").write_text(TEXT)
    s = markup_nodes(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("nodes_seen").start()
    s.processAllAvailable()
    s.stop()
    assert spark.table("nodes_seen").where("kind = 'heading'").count() == 2
