"""Problem 4: nested JSON manifests become flat tables that keep their parent-child links.

``flatten`` is a single pass: a depth-first visitor (with its own stack, so depth has no limit) emits one tagged row for
each program, namespace binding, object with ``$value`` and object at all: ``tag, doc_id, path, parent_path, value``.
``write_tables`` writes the rows partitioned by tag; ``typed`` applies the schema of one table.  There is one Python stage
and no shuffle; a document is never split or held together with others.

Defined results: a null document gives no row, a text that is not a JSON object one row with tag ``reject``; a number
keeps its text; an object or array as ``$value`` is given as JSON text; a repeated member counts once, with its last
value; repeated documents repeat their rows (queries take distinct rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.jsontext import loads, scalar_text, storable
from sluice.session import ensure_checkpoint_dir, scan, ship

ROWS = "doc_id string, tag string, path string, parent_path string, value string"


def visit(root: dict) -> Iterator[tuple[str, str, str, str]]:
    """``tag, path, parent_path, value`` of all rows of one document, parents before children."""
    programs = root.get("ProgramInformation")
    alone = isinstance(programs, dict)
    for i, p in enumerate([programs] if alone else programs if isinstance(programs, list) else []):
        if isinstance(p, dict):
            title = p.get("Title")
            yield "program", "ProgramInformation" + ("" if alone else f"[{i}]"), "", scalar_text(title.get("$value") if isinstance(title, dict) else title)
    registry = root.get("$ns")
    for uri, binding in registry.items() if isinstance(registry, dict) else ():
        yield "ns", uri, "", scalar_text(binding.get("prefix") if isinstance(binding, dict) else binding)
    stack: list[tuple[str, str, object]] = [("", "", root)]
    while stack:
        path, parent, node = stack.pop()
        if isinstance(node, dict):
            yield "object", path, parent, ""
            if "$value" in node:
                yield "value", path, parent, scalar_text(node["$value"])
            dot = path + "." if path else ""
            stack.extend((dot + k, path, v) for k, v in reversed(node.items()) if isinstance(v, (dict, list)) and (k != "$ns" or not path))
        else:
            stack.extend((f"{path}[{i}]", parent, node[i]) for i in range(len(node) - 1, -1, -1) if isinstance(node[i], (dict, list)))


def _flatten(tags: frozenset[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, out = batch.column("doc_id").to_pylist(), []
            for doc, raw in zip(docs, batch.column(text).to_pylist()):
                if raw is None:
                    continue
                try:
                    root = loads(raw)
                    if not isinstance(root, dict):
                        raise ValueError("the root is not an object")
                except ValueError as e:
                    if "reject" in tags:
                        out.append((doc, "reject", "", "", str(e)))
                    continue
                out.extend((doc, tag, storable(p), storable(q), storable(v)) for tag, p, q, v in visit(root) if tag in tags)
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["doc_id", "tag", "path", "parent_path", "value"])


def flatten(docs: DataFrame, text: str = "mpd", tags=("program", "ns", "value", "object", "reject")) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select("doc_id", text).mapInArrow(_flatten(frozenset(tags), text), ROWS)


def write_tables(rows: DataFrame, folder: str) -> None:
    """One folder per tag."""
    rows.write.mode("overwrite").partitionBy("tag").parquet(folder)


def typed(rows: DataFrame, tag: str) -> DataFrame:
    """One flat table with its own column names."""
    names = {"program": ("path", "title"), "ns": ("uri", "prefix"), "value": ("path", "value"), "object": ("path", None), "reject": (None, "reason")}[tag]
    cols = [F.col("doc_id")] + [F.col(c).alias(n) for c, n in zip(("path", "value"), names) if n] + ([F.col("parent_path")] if tag in ("value", "object") else [])
    return rows.where(F.col("tag") == tag).select(*cols)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = flatten(scan(spark, folder, "mpd_json", "doc_id", "mpd"), tags=("program", "ns", "value"))
    return rows.select("doc_id", F.col("tag").alias("kind"), "path", "parent_path", "value").distinct()


def p4_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All flat tables of the documents, written by tag into the checkpoint folder and read back as typed tables."""
    at = f"{ensure_checkpoint_dir(spark)}/p4_tables-{uuid4()}"
    write_tables(flatten(scan(spark, folder, "mpd_json", "doc_id", "mpd")).distinct(), at)
    rows = spark.read.schema(ROWS).parquet(at)
    parts = [typed(rows, tag).withColumn("table", F.lit(tag)) for tag in ("program", "ns", "value", "object", "reject")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
