"""Lifecycles over corpora: convert, inspect, validate, and the exact round trip by embedded counterparts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from vellumgrid.functions import binary, ooxml
from vellumgrid.operators import corpus, sinks
from vellumgrid.sources import docx, markup

HEADER = "// vellumgrid counterpart"
PART = "customXml/vellumgrid-source.xml"
MODES = ("auto", "exact", "semantic", "off")


def embed_package(body: str, content: bytes, width: int = 100) -> str:
    """A text headed by its counterpart package as comments, with the digests of both."""
    data = binary.gzip_b64(content)
    lines = [HEADER, f"// body: {binary.sha256(body.encode())}", f"// package: {binary.sha256(content)}", *(f"//> {data[k : k + width]}" for k in range(0, len(data), width)), "// end"]
    return "\n".join(lines) + "\n" + body


def extract_package(text: str) -> tuple[str, bytes | None, bool]:
    """(body, counterpart, unchanged). A counterpart that fails its own digest is an error."""
    if not text.startswith(HEADER + "\n"):
        return text, None, False
    head, _, body = text.partition("\n// end\n")
    digests = dict(re.findall(r"^// (body|package): ([0-9a-f]{64})$", head, re.M))
    content = binary.ungzip_b64("".join(re.findall(r"^//> (.*)$", head, re.M)))
    if binary.sha256(content) != digests.get("package"):
        raise ValueError("embedded package fails its digest")
    return body, content, binary.sha256(body.encode()) == digests.get("body")


def source_part(text: str, digest: str) -> bytes:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<source digest="{digest}" sha256="{binary.sha256(text.encode())}">{binary.gzip_b64(text.encode())}</source>'.encode()


def digest_of(parts: dict[str, bytes]) -> str:
    """The digest of corpus.package_digest() for one package, without the part that holds its source."""
    import hashlib

    total = hashlib.sha256()
    for name in sorted(parts):
        if name in ("docProps/core.xml", "docProps/app.xml", "word/settings.xml", PART):
            continue
        data = ooxml.canonical(parts[name]) if name.endswith((".xml", ".rels")) else parts[name]
        total.update(name.encode() + b"\0" + hashlib.sha256(data).digest())
    return total.hexdigest()


def extract_source(content: bytes) -> tuple[str | None, bool]:
    """(embedded source, unchanged) of a package."""
    parts = binary.unzip(content)
    if PART not in parts:
        return None, False
    m = re.search(rb'digest="([0-9a-f]*)" sha256="([0-9a-f]*)">([^<]*)<', parts[PART])
    text = binary.ungzip_b64(m[3].decode()).decode()
    if binary.sha256(text.encode()) != m[2].decode():
        raise ValueError("embedded source fails its digest")
    return text, digest_of(parts) == m[1].decode()


def _decide(mode: str, present: bool, unchanged: bool) -> bool:
    """Whether the embedded counterpart is the result; exact mode without an unchanged one is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "exact" and not (present and unchanged):
        raise ValueError("no unchanged counterpart")
    return mode in ("auto", "exact") and present and unchanged


def texts_to_packages(files: DataFrame, mode: str = "auto", embed: bool = True) -> DataFrame:
    """(doc_id, content) of texts (doc_id, text): the exact counterpart where it is embedded and unchanged, else parsed and written."""

    @arrow_udf("struct<body: string, content: binary>")
    def probe(text: pa.Array) -> pa.Array:
        rows = []
        for t in text.to_pylist():
            if t is None:  # chained UDFs may see rows that a filter between them drops
                rows.append({"body": None, "content": None})
                continue
            body, content, unchanged = extract_package(t)
            rows.append({"body": body, "content": content if _decide(mode, content is not None, unchanged) else None})
        return pa.array(rows, pa.struct([("body", pa.string()), ("content", pa.binary())]))

    @arrow_udf("binary")
    def sourced(content: pa.Array, text: pa.Array) -> pa.Array:
        out = []
        for c, t in zip(content.to_pylist(), text.to_pylist(), strict=True):
            parts = binary.unzip(c)
            types = parts["[Content_Types].xml"]
            out.append(binary.zip_bytes(parts | {PART: source_part(t, digest_of(parts)), "[Content_Types].xml": types}))
        return pa.array(out, pa.binary())

    probed = files.withColumn("_p", probe(F.col("text"))).select("doc_id", F.col("_p.body").alias("text"), F.col("_p.content").alias("content"))
    exact = probed.where("content IS NOT NULL").select("doc_id", "content")
    rest = probed.where("content IS NULL").select(F.col("doc_id").cast("string"), "text")
    made = sinks.to_packages(markup.parse(rest))
    if embed and mode in ("auto", "semantic"):
        made = made.join(rest, "doc_id").select("doc_id", sourced(F.col("content"), F.col("text")).alias("content"))
    return exact.unionByName(made)


def packages_to_texts(docs: DataFrame, mode: str = "auto", embed: bool = True, revisions: str = "annotate", comments: str = "keep") -> DataFrame:
    """(doc_id, text) of packages (doc_id, content)."""

    @arrow_udf("string")
    def probe(content: pa.Array) -> pa.Array:
        out = []
        for c in content.to_pylist():
            text, unchanged = (None, False) if c is None else extract_source(c)
            out.append(text if c is not None and _decide(mode, text is not None, unchanged) else None)
        return pa.array(out, pa.string())

    @arrow_udf("string")
    def headed(text: pa.Array, content: pa.Array) -> pa.Array:
        return pa.array([embed_package(t, c) for t, c in zip(text.to_pylist(), content.to_pylist(), strict=True)], pa.string())

    # Not called again for the filters over it.
    probed = docs.withColumn("text", probe.asNondeterministic()(F.col("content")))
    if mode == "exact":  # every package has its source or is an error: none is parsed, nor made a second time for that
        return probed.where("text IS NOT NULL").select(F.col("doc_id").cast("string"), "text")
    rest = probed.where("text IS NULL").select(F.col("doc_id").cast("string"), "content")
    made = sinks.to_markup(docx.parse(rest, revisions, comments))
    if embed and mode in ("auto", "semantic"):
        made = made.join(rest, "doc_id").select("doc_id", headed(F.col("text"), F.col("content")).alias("text"))
    return probed.where("text IS NOT NULL").select("doc_id", "text").unionByName(made)


def inspect(docs: DataFrame, kind: str) -> DataFrame:
    """One row of statistics for each text or package."""
    if kind == "markup":
        return corpus.document_stats(markup.parse(docs)).join(corpus.text_stats(docs.select(F.col("doc_id").cast("string"), "text")), "doc_id")
    return corpus.document_stats(docx.parse(docs)).join(corpus.package_stats(docx.parts(docs)), "doc_id")


def validate(docs: DataFrame) -> DataFrame:
    """(doc_id, errors, warnings, valid) of packages; one that doesn't open has that error alone."""
    order = docs.sparkSession.createDataFrame([(p, c, k) for p, names in ooxml.CHILD_ORDER.items() for k, c in enumerate(names.split())], "parent_name string, child string, rank int")
    bad = corpus.child_order_errors(docx.ordered_children(docs), order)
    found = corpus.validate(docx.parts(docs), docx.content_types(docs), docx.relationships(docs), docx.xml_errors(docs).unionByName(docx.theme_errors(docs)), bad)
    none = F.array().cast("array<string>")
    closed = docx.errors(docs).select("doc_id", F.array("error").alias("errors"), none.alias("warnings"), F.lit(False).alias("valid"))
    return found.unionByName(closed)
