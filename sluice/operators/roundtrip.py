"""Round trips: XML to JSON, back to XML, and the comparison of both by canonical fingerprint; reports over the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.convert import to_json, to_xml
from sluice.operators.nodes import fingerprint, nodes
from sluice.schema.xsd import Schema
from sluice.session import cut


def validate_roundtrip(df: DataFrame, xml: str = "xml", schema: Schema | None = None) -> DataFrame:
    """Add ``json``, ``regenerated``, ``success``, ``error``, and the measured ``ms_to_json`` and ``ms_to_xml`` of each document.

    Both copies are converted once and written with a key of the row, so two texts under one doc_id stay apart.  Equality is
    decided by fingerprints of the node tables (sums of line hashes) of both copies in one pass; only two narrow rows a
    document meet.  That comparison has no time of its own per document.
    """
    there = to_json(df, xml, "json", schema, timed="ms_to_json").withColumnRenamed("error", "_e1").drop("errors")
    back = to_xml(there, "json", "regenerated", schema, timed="ms_to_xml").withColumnRenamed("error", "_e2").drop("errors")
    back = cut(back.withColumn("_row", F.expr("uuid()")), "roundtrip")
    copies = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("text")) for side, c in (("1", xml), ("2", "regenerated"))]))
    both = back.select("_row", copies.alias("c")).select(F.concat("c.side", "_row").alias("doc_id"), F.col("c.text").alias("text"))
    prints = fingerprint(_comparable(nodes(both, "text")))
    pairs = prints.groupBy(F.substring("doc_id", 2, 36).alias("_row")).agg(F.count_distinct("hash").alias("_n"), F.count("*").alias("_copies"))
    out = back.join(pairs, "_row", "left")
    failed = F.coalesce("_e1", "_e2")
    success = failed.isNull() & (F.col("_n") == 1) & (F.col("_copies") == 2)
    success = F.coalesce(success, F.lit(False))
    return out.withColumns({"success": success, "error": F.when(~success, F.coalesce(failed, F.lit("the copies differ")))}).drop("_e1", "_e2", "_n", "_copies", "_row")


def _comparable(node: DataFrame) -> DataFrame:
    """Without the link attributes that have one possible value."""
    fixed = (F.col("ns_uri") == "http://www.w3.org/1999/xlink") & ((F.col("local") == "type") & (F.col("value") == "simple") | (F.col("local") == "show") & (F.col("value") == "embed"))
    return node.where(~F.coalesce(fixed, F.lit(False)))


def report(results: DataFrame) -> DataFrame:
    """Per category and in all: total, passed, failed and milliseconds, by one rollup."""
    ms = F.coalesce("ms", F.lit(0))
    out = results.rollup("category").agg(F.count("*").alias("total"), F.count_if(F.coalesce("success", F.lit(False))).alias("passed"), F.sum(ms).alias("ms"), F.grouping("category").alias("all"))
    return out.select(F.when(F.col("all") == 1, "(all)").otherwise(F.coalesce("category", F.lit("(none)"))).alias("category"), "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), "ms")


def failures(results: DataFrame) -> DataFrame:
    return results.where(~F.coalesce("success", F.lit(False))).select("category", "doc_id", "error")
