"""Readers and writers of manifests, patches, URL maps and catalogues, on Spark's file sources."""

from __future__ import annotations

import os
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.columns import category, is_mpd_url, minify_json, minify_xml


def read_manifests(spark: SparkSession, path: str, glob: str = "*.mpd", recursive: bool = True, only: str | None = None) -> DataFrame:
    """``doc_id`` (the path), ``file_name``, ``category``, ``bytes``, ``xml`` of the files under a path or Hadoop glob.

    ``only`` keeps base names that match a pattern of ``*`` and ``?``.
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    df = df.select(F.col("path").alias("doc_id"), F.substring_index("path", "/", -1).alias("file_name"), category(F.col("path")).alias("category"), F.col("length").alias("bytes"), F.col("content").cast("string").alias("xml"))
    if only:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in only)
        df = df.where(F.col("file_name").rlike(f"^{pattern}$"))
    return df.withColumn("xml", F.regexp_replace("xml", "^﻿", ""))


def read_json_manifests(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """``doc_id``, ``json``: one document a file."""
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("json"))


def read_patches(spark: SparkSession, path: str, glob: str = "*.mpp") -> DataFrame:
    """``doc_id``, ``xml`` of XML patch documents."""
    return read_manifests(spark, path, glob).select("doc_id", "xml")


def read_url_map(spark: SparkSession, path: str) -> DataFrame:
    """``file_name``, ``url`` from lines of a URL, a tab and a file name."""
    df = spark.read.option("sep", "\t").schema("url string, file_name string").csv(path)
    return df.select(F.trim("file_name").alias("file_name"), F.trim("url").alias("url")).where((F.col("url") != "") & (F.col("file_name") != ""))


def read_url_report(spark: SparkSession, path: str) -> DataFrame:
    """``file_name``, ``url`` from a report in which a ``URL:`` line is followed by its ``Saved as:`` line."""
    df = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^\s+(?:URL|Saved as):\s+\S"))  # URL lines and their answers, in order
    pairs = F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    text = lambda c: F.trim(F.regexp_replace(c, r"^\s+[^:]+:\s+", ""))
    found = df.select(F.explode(pairs).alias("x")).where(F.col("x.a").rlike(r"^\s+URL:") & F.col("x.b").rlike(r"^\s+Saved as:"))
    return found.select(text(F.col("x.b")).alias("file_name"), text(F.col("x.a")).alias("url"))


def read_catalogue(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Rows of a separated catalogue with a header, as text."""
    return spark.read.option("sep", sep).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def urls_in_json(df: DataFrame, column: str = "json") -> DataFrame:
    """The distinct manifest URLs among all strings of nested JSON texts."""
    strings = F.regexp_extract_all(column, F.lit(r'"((?:[^"\\]|\\.)*+)"'), F.lit(1))
    url = F.trim(F.replace(F.col("u"), F.lit("\\/"), F.lit("/")))
    return df.select(F.explode(strings).alias("u")).select(url.alias("url")).where(F.col("url").rlike(r"(?i)^https?://") & F.col("url").rlike(r"(?i)\.mpd(\?.*)?$")).distinct()


def with_source_url(files: DataFrame, urls: DataFrame) -> DataFrame:
    """Files with their source URL, if known (the optimizer broadcasts the map where it is small)."""
    return files.join(urls.groupBy("file_name").agg(F.max("url").alias("url")), "file_name", "left")


def fix_url(c, old: str, new: str):
    """A URL's leading part rewritten, for hosts whose development path has moved to a stable one."""
    return F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1_000_000))).otherwise(c)


def write_json(df: DataFrame, folder: str, column: str = "json", minified: bool = False, gzip: bool = False) -> None:
    """One JSON text a line; ``minified`` drops white space, ``gzip`` compresses."""
    out = df.select((minify_json(F.col(column)) if minified else F.regexp_replace(column, r"\r?\n\s*", " ")).alias("value"))
    out.write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(folder)


def _own_name(by: str):
    """An id as a file name; one that has to be changed for it gets a digest, so that no two ids share a name."""
    clean = F.regexp_replace(by, r"[^A-Za-z0-9._-]+", "_")
    return F.when(clean == F.col(by), clean).otherwise(F.concat(clean, F.lit("-"), F.substring(F.sha2(F.col(by), 256), 1, 12)))


def write_xml(df: DataFrame, folder: str, column: str = "xml", by: str = "doc_id", minified: bool = True, gzip: bool = False) -> None:
    """XML texts partitioned by a column (a document's folder holds its text)."""
    out = df.select(_own_name(by).alias(by), (minify_xml(F.col(column)) if minified else F.col(column)).alias("value"))
    out.write.mode("overwrite").partitionBy(by).option("compression", "gzip" if gzip else "none").text(folder)


def write_named(df: DataFrame, folder: str, **columns: str) -> DataFrame:
    """One file a document and column in a folder that all executors mount: ``write_named(df, "/out", json=".json",
    regenerated="-regenerated.mpd")``.  A file is its document's base name and the suffix; it appears whole (written aside and renamed), so
    a task that runs again does no harm.  Null texts have no file.  Returns ``doc_id, name, bytes`` of the files, lazily: the files
    are written when it is read."""
    base = F.regexp_replace(F.substring_index("doc_id", "/", -1), r"\.[A-Za-z0-9]+$", "")
    clean = F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_")
    name = F.concat(clean, F.when(clean == F.col("doc_id"), F.lit("")).otherwise(F.concat(F.lit("-"), F.substring(F.sha2("doc_id", 256), 1, 12))))
    files = F.explode(F.array(*[F.struct(F.concat(name, F.lit(suffix)).alias("name"), F.col(c).alias("text")) for c, suffix in columns.items()]))
    rows = df.where(F.col("doc_id").isNotNull()).select("doc_id", files.alias("f")).select("doc_id", "f.name", "f.text").where(F.col("text").isNotNull())

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            sizes = []
            for file, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                data = text.encode("utf-8", "replace")
                aside = os.path.join(folder, f".{file}.{uuid4()}")
                with open(aside, "wb") as f:
                    f.write(data)
                os.replace(aside, os.path.join(folder, file))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), pa.array(sizes, pa.int64())], names=["doc_id", "name", "bytes"])

    return rows.mapInArrow(run, "doc_id string, name string, bytes long")


__all__ = ["read_manifests", "read_json_manifests", "read_patches", "read_url_map", "read_url_report", "read_catalogue", "urls_in_json", "with_source_url", "fix_url", "write_json", "write_xml", "write_named", "is_mpd_url"]
