"""What the operators of this subpackage share: text expressions, scratch tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and the control characters from tab to carriage return.
BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a session in one JVM that names none gets a temporary folder; a cluster has to name its own."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.vellumgrid.scratch", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="vellumgrid-")
        spark.conf.set("spark.vellumgrid.scratch", where)
    return where


@contextmanager
def _shuffles_go_with_the_query(spark: SparkSession):
    """A written table needs its shuffle files no longer; otherwise they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there, so a lost executor costs no recomputation. The folder goes when the session's JVM ends, or with drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellumgrid/{uuid.uuid4().hex}"
    with _shuffles_go_with_the_query(spark):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._vellumgrid_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by materialise(); nothing may read them afterwards."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._vellumgrid_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def result_name(base: str, columns: Iterable[str]) -> str:
    """The name of a column that an operator adds: base, with underscores appended while the input has a column of that name."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def identified(docs: DataFrame) -> DataFrame:
    """(doc, mark, text, row): each row's identity and rank (doc, mark), its text, and the row itself as a struct, so that no column of it clashes with another.

    doc is doc_id, the least long for none, so that rows without an id rank first; mark is a hash of whether there is an
    id and of the text. Rows that share a doc_id but not the text are thus different documents; rows equal in both are
    one document, since nothing tells which of them is the earlier.
    """
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc, F.lit(LEAST_LONG)).alias("doc"), F.xxhash64(doc.isNull(), text).alias("mark"), text.alias("text"), F.struct("*").alias("row"))


LEAST_LONG = -(1 << 63)


def restored(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of docs out of `row`, with this text, and n_chars counted anew where the text changed and there is such a column."""
    kinds = dict(docs.dtypes)
    out = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            old = text
        elif c == "n_chars":
            old = F.when(text.eqNullSafe(F.col("text")), old).otherwise(F.length(text).cast(kinds[c]))
        out.append(old.alias(c))
    return out


def chunks(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut to pieces of some `size` characters in column `text`; a longer text is a piece of its own."""
    for batch in batches:
        length = pa.compute.fill_null(pa.compute.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(np.concatenate(([0], length))), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of edges (a long, b long), with alternating large and small stars.

    Returns a written table (node, component), component being the smallest node reachable; nodes without an edge to
    another node are absent. Null ends are ignored. Every round writes its edges to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e, before = materialise(e), None
    for _ in range(rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialise(large)
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rest = large.join(first, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        nxt = materialise(rest.unionByName(first.select("hi", F.col("m").alias("lo"))).distinct())
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        drop(large, e)
        e = nxt
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    out = materialise(e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()))
    drop(e)
    return out
