"""Fixtures as markup: the relational tables rendered as one text for each region, so that a plain SQL query over the tables gives what the engine has to find in the markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import scalar


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ordered(by: str, column: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, column))), lambda x: x[column]), "")


def region_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): for each region a numbered heading for each nation (labelled by its key), a heading for each market segment, an item for each customer, an equation, and a reference to every nation."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    item = c.withColumn("line", F.concat(F.lit("- "), scalar.escape_markup(F.col("c_name")), F.lit("\n")))
    seg = item.groupBy("c_nationkey", "c_mktsegment").agg(_ordered("c_custkey", "line").alias("items"))
    seg = seg.withColumn("part", F.concat(F.lit("\n== "), "c_mktsegment", F.lit("\n\n"), "items"))
    nat = seg.groupBy("c_nationkey").agg(_ordered("c_mktsegment", "part").alias("parts"))
    n = load(spark, sf_dir, "nation").join(nat, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    key = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit("\n= "), scalar.escape_markup(F.col("n_name")), F.lit(" <nation-"), key, F.lit(">\n\nSee @nation-"), key, F.lit(" and @missing-"), key, F.lit(".\n\n$ x_"), key, F.lit(" = 1 $ <eq-"), key, F.lit(">\n"), F.coalesce("parts", F.lit("")))
    docs = n.select("n_regionkey", "n_nationkey", body.alias("body")).groupBy("n_regionkey").agg(_ordered("n_nationkey", "body").alias("t"))
    head = '#set heading(numbering: "1.")\n#set math.equation(numbering: "(1)")\n'
    return docs.select(F.col("n_regionkey").cast("string").alias("doc_id"), F.concat(F.lit(head), "t").alias("text"))


def part_tables(spark: SparkSession, sf_dir: str, columns: int = 3) -> DataFrame:
    """(doc_id, text): a table of part names for each brand, and a figure for each part of size under 10 by type."""
    p = load(spark, sf_dir, "part")
    cell = F.concat(F.lit("  ["), scalar.escape_markup(F.col("p_name")), F.lit("],\n"))
    fig = F.when(F.col("p_size") < 10, F.concat(F.lit('#figure(kind: "'), "p_type", F.lit('", caption: ['), scalar.escape_markup(F.col("p_name")), F.lit("])[x] <p-"), F.col("p_partkey").cast("string"), F.lit(">\n\n"))).otherwise("")
    d = p.select("p_brand", "p_partkey", cell.alias("cell"), fig.alias("fig")).groupBy("p_brand").agg(_ordered("p_partkey", "cell").alias("cells"), _ordered("p_partkey", "fig").alias("figs"))
    return d.select(F.col("p_brand").alias("doc_id"), F.concat(F.lit(f"#table(\n  columns: {columns},\n"), "cells", F.lit(")\n\n"), "figs").alias("text"))
