"""Scalar functions on Columns, all of them built-in expressions (no Python runs per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------------------

#: Colour names -> six upper hex digits (two are kept as words).
COLOURS = {
    "black": "000000", "white": "FFFFFF", "red": "FF0000", "green": "008000", "blue": "0000FF", "yellow": "FFFF00",
    "gray": "808080", "grey": "808080", "silver": "C0C0C0", "maroon": "800000", "purple": "800080", "fuchsia": "FF00FF",
    "lime": "00FF00", "olive": "808000", "navy": "000080", "teal": "008080", "aqua": "00FFFF", "orange": "FFA500",
    "transparent": "transparent", "auto": "auto",
}
#: Word's highlight names -> hex; "none" has none.
HIGHLIGHTS = {
    "black": "000000", "blue": "0000FF", "cyan": "00FFFF", "green": "00FF00", "magenta": "FF00FF", "red": "FF0000",
    "yellow": "FFFF00", "white": "FFFFFF", "darkBlue": "000080", "darkCyan": "008080", "darkGreen": "008000",
    "darkMagenta": "800080", "darkRed": "800000", "darkYellow": "808000", "darkGray": "808080", "lightGray": "C0C0C0",
}
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
#: Points in a unit of length.
UNITS = {"pt": 1.0, "in": 72.0, "cm": 72.0 / 2.54, "mm": 72.0 / 25.4}
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "emf": "image/x-emf", "wmf": "image/x-wmf", "pdf": "application/pdf"}
#: First bytes -> media type.
MAGIC = [("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("25504446", "application/pdf")]


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _look(pairs: dict, key: Column) -> Column:
    return F.element_at(_map(pairs), key)


# --- Text --------------------------------------------------------------------------------------------------------


def escape_markup(text: Column) -> Column:
    """Text as markup that parses back to it: special characters, comment openers, bare addresses and list or heading markers at a line's start take a backslash."""
    x = F.regexp_replace(text, r"([\\#*_`$@<>\[\]~])", r"\\$1")
    x = F.regexp_replace(x, r"/(?=[/*])", r"\\/")
    return F.regexp_replace(x, r"(?m)^([ \t]*)([=+/-])", r"$1\\$2")


def escape_string(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def quote_string(text: Column) -> Column:
    return F.concat(F.lit('"'), escape_string(text), F.lit('"'))


def unescape_string(text: Column) -> Column:
    r"""Inverse of escape_string; a backslash before any other character stands for that character."""
    # Escapes are read left to right: pairs of backslashes first set aside, so that none is read twice.
    x = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.replace(F.regexp_replace(x, r"\\(.)", "$1"), F.lit("\u0000"), F.lit("\\"))


def sanitize_filename(name: Column, fallback: str = "asset") -> Column:
    base = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    base = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    base = F.when(base == "", F.lit(fallback)).otherwise(base)
    suffix = F.regexp_extract(base, r"^.*[^.].*?(\.[^.]*)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(suffix))
    return F.concat(F.substring(stem, 1, 80), F.substring(suffix, 1, 16))


def safe_label(text: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.:-]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("label"))


def safe_bookmark(text: Column) -> Column:
    x = F.regexp_replace(text, r"(?U)[^\w]", "_")
    return F.substring(F.when(x.rlike(r"^\p{L}"), x).otherwise(F.concat(F.lit("b_"), x)), 1, 40)


def safe_style_id(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"(?U)[^\w]", ""), 1, 253)


def stable_numeric_id(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).otherwise(F.conv(F.substring(F.sha2(text, 256), 1, 7), 16, 10).cast("long"))


def normalized_family(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[ _-]", ""))


def indent_text(text: Column, spaces: int = 2) -> Column:
    return F.regexp_replace(text, r"(?m)^(?=.)", " " * spaces)


def trailing_label(text: Column) -> Column:
    """(body, label) of a line that may end in <label>."""
    pattern = r"^(.*?)\s*<([A-Za-z0-9_.:-]+)>\s*$"
    return F.struct(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text).alias("body"), F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).alias("label"))


def line_count(text: Column) -> Column:
    """Line feeds, and one more unless the text ends in one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def infer_format(path: Column) -> Column:
    p = F.lower(path)
    return F.when(F.endswith(p, F.lit(".typ")), "typst").when(F.endswith(p, F.lit(".docx")) | F.endswith(p, F.lit(".docm")), "docx")


def default_output(path: Column) -> Column:
    return F.when(infer_format(path) == "typst", F.regexp_replace(path, r"(?i)\.typ$", ".docx")).when(infer_format(path) == "docx", F.regexp_replace(path, r"(?i)\.doc[xm]$", ".typ"))


def safe_part_name(name: Column) -> Column:
    """A package path with . and .. resolved; one that leaves the package is an error."""
    parts = F.filter(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    done = F.aggregate(parts, empty, lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p == "..", F.array(F.raise_error(F.concat(F.lit("unsafe package path: "), name)).cast("string"))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(done, "/")


def resolve_target(source_part: Column, target: Column) -> Column:
    t = F.replace(target, F.lit("\\"), F.lit("/"))
    folder = F.regexp_extract(source_part, r"^(.*/)?[^/]*$", 1)
    return safe_part_name(F.when(F.startswith(t, F.lit("/")), t).otherwise(F.concat(folder, t)))


def rels_part_for(source_part: Column) -> Column:
    return F.concat(F.regexp_extract(source_part, r"^(.*/)?[^/]*$", 1), F.lit("_rels/"), F.regexp_extract(source_part, r"([^/]*)$", 1), F.lit(".rels"))


# --- Numbers and lengths -----------------------------------------------------------------------------------------


def parse_int(x: Column) -> Column:
    return F.trim(x).try_cast("long")


def parse_float(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def points_to_twips(points: Column) -> Column:
    return F.bround(points * 20).cast("long")


def twips_to_points(twips: Column) -> Column:
    return twips.try_cast("double") / 20


def points_to_half_points(points: Column) -> Column:
    return F.bround(points * 2).cast("long")


def half_points_to_points(x: Column) -> Column:
    return x.try_cast("double") / 2


def points_to_emu(points: Column) -> Column:
    return F.bround(points * 12700).cast("long")


def emu_to_points(x: Column) -> Column:
    return x.try_cast("double") / 12700


def border_eighths(width_pt: Column) -> Column:
    return clamp(F.bround(width_pt * 8).cast("long"), 2, 96)


def parse_length(text: Column, em_pt: float = 11.0, percent_base_pt: float | None = None) -> Column:
    """Points of a length like 12pt, 1.5em or 2cm; a bare number is points; fr, deg and rad are none."""
    pattern = r"^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*(pt|mm|cm|in|em|fr|%|deg|rad)?\s*$"
    number, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2)
    out = F.when(unit.isin("", "pt"), number)
    for name in ("in", "cm", "mm"):
        out = out.when(unit == name, number * 72.0 / {"in": 1.0, "cm": 2.54, "mm": 25.4}[name])
    out = out.when(unit == "em", number * em_pt)
    if percent_base_pt is not None:
        out = out.when(unit == "%", number * percent_base_pt / 100.0)
    return F.when(text.rlike(pattern), out)


def format_length(points: Column) -> Column:
    """At most three decimals and six significant digits, without trailing zeros, in pt; null is `auto`."""
    r = F.bround(points, 3)
    a = F.abs(r)
    digits = F.when(a < 1000, F.format_string("%.3f", r)).when(a < 10000, F.format_string("%.2f", F.bround(r, 2))).when(a < 100000, F.format_string("%.1f", F.bround(r, 1))).otherwise(F.format_string("%.0f", r))
    short = F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    whole = r.cast("long").cast("string")
    return F.when(points.isNull(), "auto").otherwise(F.concat(F.when(r == F.floor(r), whole).otherwise(short), F.lit("pt")))


# --- Colours -----------------------------------------------------------------------------------------------------


def normalize_colour(value: Column, default: Column | None = None) -> Column:
    default = F.lit(None).cast("string") if default is None else default
    x = F.regexp_replace(F.trim(value), "^#+", "")
    named = _look(COLOURS, F.lower(x))
    tripled = F.upper(F.regexp_replace(x, "(.)", "$1$1"))
    return F.when(named.isNotNull(), named).when(x.rlike("^[0-9A-Fa-f]{3}$"), tripled).when(x.rlike("^([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), F.upper(x)).otherwise(default)


def markup_colour(value: Column) -> Column:
    n = normalize_colour(value, value)
    return F.when(value.isNull() | (value == ""), "black").when(value.isin("auto", "transparent"), value).when(n.rlike("^[0-9A-F]{6}([0-9A-F]{2})?$"), F.concat(F.lit('rgb("#'), n, F.lit('")'))).otherwise(value)


def highlight_to_hex(name: Column) -> Column:
    return _look(HIGHLIGHTS, name)


def hex_to_highlight(value: Column) -> Column:
    return _look({v: k for k, v in HIGHLIGHTS.items()}, normalize_colour(value))


def colour_value(expression: Column) -> Column:
    """The colour of an expression: a # number anywhere, rgb(r, g, b), or a name."""
    hexed = F.regexp_extract(expression, "#([0-9A-Fa-f]{8}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})", 1)
    rgb = r"^\s*rgb\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*\)\s*$"
    part = lambda k: F.lpad(F.hex(F.regexp_extract(expression, rgb, k).try_cast("long")), 2, "0")
    return F.when(hexed != "", normalize_colour(hexed)).when(expression.rlike(rgb), F.concat(part(1), part(2), part(3))).otherwise(normalize_colour(expression))


# --- Counters ----------------------------------------------------------------------------------------------------


def counter(value: Column, token: Column) -> Column:
    """A counter as 1, a, A, i or I; letters are bijective base 26; 0 counts as 1 but for digits."""
    n = F.greatest(F.lit(1).cast("long"), value.cast("long"))
    letters = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.alias("n"), F.lit("").alias("s")), lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).alias("n"), F.concat(F.chr((97 + (a["n"] - 1) % 26).cast("long")), a["s"]).alias("s"))).otherwise(a), lambda a: a["s"])
    steps = F.array(*[F.struct(F.lit(v).cast("long").alias("v"), F.lit(s).alias("s")) for v, s in ROMAN])
    roman = F.aggregate(steps, F.struct(n.alias("n"), F.lit("").alias("s")), lambda a, x: F.struct((a["n"] % x["v"]).alias("n"), F.concat(a["s"], F.repeat(x["s"], F.floor(a["n"] / x["v"]).cast("int"))).alias("s")), lambda a: a["s"])
    return F.when(token == "a", letters).when(token == "A", F.upper(letters)).when(token == "i", F.lower(roman)).when(token == "I", roman).otherwise(value.cast("string"))


def numbering(pattern: Column, numbers: Column) -> Column:
    """Numbers through a pattern. One symbol: all numbers, joined by the suffix or a dot, between prefix and suffix; several: one number each, surplus numbers dropped, surplus symbols left as they are; none: the last number."""
    symbols = F.regexp_extract_all(pattern, F.lit("([1aAiI])"), F.lit(1))
    prefix, suffix = F.regexp_extract(pattern, "^([^1aAiI]*)", 1), F.regexp_extract(pattern, "^[^1aAiI]*[1aAiI](.*)$", 1)
    first = F.get(symbols, F.lit(0))
    joined = F.array_join(F.transform(numbers, lambda n: counter(n, first)), "\u0001")
    one = F.concat(prefix, F.replace(joined, F.lit("\u0001"), F.coalesce(F.nullif(suffix, F.lit("")), F.lit("."))), suffix)
    literal = F.split(pattern, "[1aAiI]", -1)
    each = F.transform(symbols, lambda s, i: F.concat(F.when(i < F.size(numbers), counter(F.get(numbers, i), s)).otherwise(s), F.get(literal, i + 1)))
    several = F.concat(F.get(literal, F.lit(0)), F.array_join(each, ""))
    return F.when(F.size(numbers) == 0, "").when(F.size(symbols) == 0, F.element_at(numbers, -1).cast("string")).when(F.size(symbols) == 1, one).otherwise(several)


def number_format(pattern: Column) -> Column:
    """Word's number format for the first symbol of a pattern."""
    return F.coalesce(_look({"1": "decimal", "a": "lowerLetter", "A": "upperLetter", "i": "lowerRoman", "I": "upperRoman"}, F.regexp_extract(pattern, "([1aAiI])", 1)), F.lit("decimal"))


def number_pattern(name: Column) -> Column:
    return F.coalesce(_look({"decimal": "1", "lowerLetter": "a", "upperLetter": "A", "lowerRoman": "i", "upperRoman": "I"}, name), F.lit("1"))


# --- Media -------------------------------------------------------------------------------------------------------


def media_type(filename: Column, data: Column | None = None) -> Column:
    """By extension, then by the first bytes."""
    known = _look(MEDIA_TYPES, F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1)))
    if data is None:
        return F.coalesce(known, F.lit("application/octet-stream"))
    head = F.hex(F.substring(data, 1, 12))
    out = known
    for magic, kind in MAGIC:
        out = F.coalesce(out, F.when(F.startswith(head, F.lit(magic)), kind))
    out = F.coalesce(out, F.when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "image/webp"), F.when(F.hex(F.substring(data, 1, 256)).rlike("3C737667"), "image/svg+xml"))
    return F.coalesce(out, F.lit("application/octet-stream"))


def extension(kind: Column) -> Column:
    return F.coalesce(_look({"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/svg+xml": "svg", "image/tiff": "tiff", "image/webp": "webp", "image/x-emf": "emf", "image/x-wmf": "wmf", "application/pdf": "pdf"}, kind), F.lit("bin"))


# --- Fields ------------------------------------------------------------------------------------------------------


def field_command(code: Column) -> Column:
    return F.upper(F.substring_index(F.trim(F.regexp_replace(code, r"\s+", " ")), " ", 1))


def field_markup(code: Column, cached: Column, has_bibliography: Column | None = None, bibliography: Column | None = None, keys: Column | None = None) -> Column:
    """A field as native markup, or null where only a wrapper would do. `cached` is its rendered result ('' if none); keys maps citation keys."""
    has = F.lit(False) if has_bibliography is None else has_bibliography
    c = F.trim(F.regexp_replace(code, r"\s+", " "))
    u = F.upper(c)
    cmd = field_command(code)
    shown = lambda x: F.coalesce(F.nullif(cached, F.lit("")), x)
    ref = F.regexp_extract(c, r"(?i)^(?:PAGEREF|REF|NOTEREF)\s+([^ \\]+)", 1)
    link = F.regexp_extract(c, r'(?i)^HYPERLINK\s+(?:\\l\s+)?"([^"]+)"', 1)
    raw = F.regexp_extract(c, r'(?i)^CITATION\s+("[^"]+"|[^ \\]+)', 1)
    bare = lambda x: F.regexp_replace(x, '^"(.*)"$', "$1")
    mapped = lambda x: F.coalesce(F.element_at(keys, x), x) if keys is not None else x
    more = F.transform(F.regexp_extract_all(c, F.lit(r'(?i)\\m\s+("[^"]+"|[^ \\]+)'), F.lit(1)), lambda k: mapped(bare(k)))
    all_keys = F.concat(F.array(mapped(bare(raw))), more)
    page = F.regexp_extract(c, r'(?i)\\p\s+("[^"]*"|[^ \\]+)', 1)
    pages = F.when(bare(page).rlike(r"(?i)^pp?\.?\s"), bare(page)).otherwise(F.concat(F.lit("p. "), bare(page)))
    cite = lambda k, x="": F.concat(F.lit("#cite(label("), quote_string(k), F.lit(")" + x))
    single = F.concat(cite(F.get(all_keys, F.lit(0))), F.when(bare(page) != "", F.concat(F.lit(", supplement: ["), escape_markup(pages), F.lit("]"))).otherwise(""), F.lit(")"))
    several = F.concat(F.array_join(F.transform(all_keys, lambda k: cite(k, ", form: none)")), ""), shown(F.array_join(F.transform(all_keys, lambda k: cite(k, ")")), "")))
    bib = F.lit(None).cast("string") if bibliography is None else F.when(bibliography.isNotNull(), F.concat(F.lit("#bibliography("), quote_string(bibliography), F.lit(", title: none)")))
    return (
        F.when(cmd == "PAGE", "#context counter(page).display()")
        .when(cmd.isin("NUMPAGES", "SECTIONPAGES"), "#context counter(page).final().first()")
        .when(cmd == "TOC", "#outline()")
        .when((cmd == "PAGEREF") & (ref != ""), F.concat(F.lit("#ref(<"), safe_label(ref), F.lit('>, form: "page")')))
        .when(cmd.isin("REF", "NOTEREF") & (ref != ""), F.concat(F.lit("#link(<"), safe_label(ref), F.lit(">)["), shown(escape_markup(ref)), F.lit("]")))
        .when((cmd == "HYPERLINK") & (link != ""), F.concat(F.lit("#link("), quote_string(link), F.lit(")["), shown(escape_markup(link)), F.lit("]")))
        .when(cmd == "BIBLIOGRAPHY", F.coalesce(bib, F.nullif(cached, F.lit(""))))
        .when((cmd == "CITATION") & (raw != ""), F.when(~has, F.nullif(cached, F.lit(""))).when(F.size(all_keys) == 1, single).otherwise(several))
        .when(cmd.isin("DATE", "TIME", "CREATEDATE", "SAVEDATE", "PRINTDATE"), shown(F.lit("#datetime.today().display()")))
        .when(cmd == "QUOTE", cached)
        .when(u.rlike(r"^SYMBOL\s+[0-9]+"), cached)
    )


def field_placeholder(code: Column) -> Column:
    """What a field shows before it is first updated."""
    cmd = field_command(code)
    return F.when(cmd.isin("PAGE", "NUMPAGES", "SECTIONPAGES"), "1").when(cmd == "TOC", "Table of contents").otherwise("")


def page_pattern(text: Column) -> Column:
    """The numbering pattern of a footer whose page fields stand as 1; null for prose."""
    p = F.trim(text)
    safe = p.rlike(r"(?i)^[()\[\].:\-\s0-9]*1(?:\s+of\s+1)?[()\[\].:\-\s0-9]*$") | p.isin("i", "I", "a", "A")
    return F.when(safe, F.coalesce(F.nullif(p, F.lit("")), F.lit("1")))


# --- Shapes and people -------------------------------------------------------------------------------------------


def shape_svg(shape: Column, width: Column, height: Column, fill: Column, stroke: Column) -> Column:
    """A drawn shape as SVG text: ellipses, lines and polygons; every other shape is its rectangle."""
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%spt" height="%spt" viewBox="0 0 %s %s">', width, height, width, height)
    paint = F.format_string('fill="%s" stroke="%s"', F.coalesce(fill, F.lit("none")), F.coalesce(stroke, F.lit("#000000")))
    body = (
        F.when(shape.isin("circle", "ellipse"), F.format_string('<ellipse cx="50%%" cy="50%%" rx="50%%" ry="50%%" %s/>', paint))
        .when(shape == "line", F.format_string('<line x1="0" y1="0" x2="100%%" y2="100%%" %s/>', paint))
        .when(shape == "polygon", F.format_string('<polygon points="0,%s %s,%s %s,0" %s/>', height, width, height, width, paint))
        .otherwise(F.format_string('<rect width="100%%" height="100%%" %s/>', paint))
    )
    return F.concat(head, body, F.lit("</svg>"))


def bib_value(value: Column) -> Column:
    return F.concat(F.lit("{"), F.regexp_replace(F.regexp_replace(value, r"([\\{}])", r"\\$1"), r"\s+", " "), F.lit("}"))


def people(last: Column, first: Column, middle: Column, suffix: Column) -> Column:
    """`Last, First Middle, Suffix` without the parts that are missing."""
    given = F.trim(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(middle, F.lit(""))))
    return F.concat_ws(", ", F.nullif(last, F.lit("")), F.nullif(given, F.lit("")), F.nullif(suffix, F.lit("")))


# --- Maps --------------------------------------------------------------------------------------------------------


def stable_json(m: Column) -> Column:
    """A map of strings as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def is_empty_style(m: Column) -> Column:
    """Whether a map of properties says nothing: it is null, or all its values are."""
    return F.coalesce(~F.exists(F.map_values(m), lambda v: v.isNotNull()), F.lit(True))
