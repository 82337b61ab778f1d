"""Remote elements: stubs are replaced by what their links hold, level by level, one join a level.

Stubs of Periods (or any array) are exploded with their place, joined with the remote table, and put back in order.
The table of remote bodies is joined by shuffle or broadcast as its size allows (the optimizer decides).  A failed link, a
body that is no JSON object, a cycle or a link deeper than ``depth`` removes the stub; so does the sentinel.
"""

from __future__ import annotations

import json
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.convert import dumps, read_json
from sluice.session import ship

# The elements that may be remote.
KINDS = ("Period", "EventStream", "InitializationSet", "AdaptationSet", "SegmentList", "UrlQueryInfo")
RESOLVE_TO_ZERO = "urn:mpeg:dash:resolve-to-zero:2013"  # fixed value: the sentinel


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link resolved against a base; what is no URL stays as it is."""

    def one(b: str | None, u: str | None) -> str | None:
        try:
            return urljoin(b or "", u) if u is not None else None
        except ValueError:
            return u

    return pd.Series([one(b, u) for b, u in zip(base, link)], dtype=object)


@F.pandas_udf(T.StringType())
def merged(stub: pd.Series, body: pd.Series) -> pd.Series:
    """The body's members, the stub's where the body has none, and no link of the stub's."""

    def one(s: str, b: str) -> str | None:
        if s is None or b is None:
            return b
        new, old = json.loads(b), json.loads(s)
        if not isinstance(new, dict) or not isinstance(old, dict):
            return b
        return json.dumps({**{k: v for k, v in old.items() if k != "xlink" and k not in new}, **new}, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(s, b) for s, b in zip(stub, body)], dtype=object)


def _href(body: Column) -> Column:
    return F.get_json_object(body, "$.xlink.href")


def resolve(stubs: DataFrame, remote: DataFrame, mode: str = "all", depth: int = 5) -> DataFrame:
    """``doc_id, place, body`` after resolution.

    ``stubs``: doc_id, place (array<int>, compared in order), body (JSON of one element).  ``remote``: href, status, body (an
    object or an array of objects).  ``mode`` ``onLoad`` leaves elements whose link is not to be loaded at once.
    """
    ship(stubs.sparkSession)
    good = F.col("status").between(200, 299) & F.col("rbody").rlike(r"^\s*[\[{]")
    links = remote.select(F.col("href").alias("link"), "status", F.col("body").alias("rbody")).where(good)
    items = F.from_json("rbody", "array<string>")  # an object alone becomes an array of one
    links = links.select("link", F.when(F.ltrim("rbody").startswith("["), items).otherwise(F.array("rbody")).alias("items"))
    links = links.where(F.col("items").isNotNull()).groupBy("link").agg(F.min("items").alias("items"))
    now = stubs.select("doc_id", "place", "body", F.array().cast("array<string>").alias("visited"))
    for _ in range(depth):
        href = _href(F.col("body"))
        wanted = href.isNotNull() & (F.lit(True) if mode == "all" else F.coalesce(F.get_json_object("body", "$.xlink.actuate"), F.lit("onRequest")) == "onLoad")
        asked = now.withColumn("link", F.when(wanted, F.when(F.size("visited") > 0, absolute(F.get("visited", F.size("visited") - 1), href)).otherwise(href)))
        usable = F.col("link").isNotNull() & (F.col("link") != RESOLVE_TO_ZERO) & ~F.array_contains("visited", F.col("link"))
        # each level reads the one before once; elements without a link get keys of their own, so that they do not meet in one task
        key = F.when(usable, F.concat(F.lit("="), "link")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id", "place").cast("string")))
        met = asked.withColumn("_key", key).join(links.select(F.concat(F.lit("="), "link").alias("_key"), "items"), "_key", "left")
        kept = F.col("link").isNull()
        items = F.filter(F.transform("items", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda y: F.ltrim(y["x"]).startswith("{"))
        out = F.when(kept, F.array(F.struct(F.lit(0).alias("i"), F.col("body").alias("x")))).otherwise(items)
        got = met.select("doc_id", "place", "visited", "link", F.col("body").alias("stub"), kept.alias("kept"), F.explode(out).alias("o"))
        new = F.when(~F.col("kept") & (F.col("o.i") == 0), merged("stub", "o.x")).otherwise(F.col("o.x"))
        place = F.when(F.col("kept"), F.col("place")).otherwise(F.concat("place", F.array("o.i")))
        now = got.select("doc_id", place.alias("place"), new.alias("body"), F.when(F.col("kept"), F.col("visited")).otherwise(F.concat("visited", F.array("link"))).alias("visited"))
    left = _href(F.col("body")).isNotNull() & (F.lit(True) if mode == "all" else F.coalesce(F.get_json_object("body", "$.xlink.actuate"), F.lit("onRequest")) == "onLoad")
    return now.where(~left).select("doc_id", "place", "body")


def _walk(node, kind: str | None = None):
    """``holder, key, index`` of every element of a kind that can be remote and has a link, outermost only, in document order."""
    if isinstance(node, dict):
        for key, value in node.items():
            for i, x in enumerate(value) if isinstance(value, list) else [(None, value)]:
                if key in KINDS and isinstance(x, dict) and isinstance(x.get("xlink"), dict) and isinstance(x["xlink"].get("href"), str):
                    yield node, key, i
                else:
                    yield from _walk(x)
    elif isinstance(node, list):
        for x in node:
            yield from _walk(x)


def stubs_of(docs: DataFrame, column: str = "json") -> DataFrame:
    """``doc_id, place, body`` of the remote elements of JSON manifests, numbered in document order."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = list(_walk(read_json(text or "")))
                except (ValueError, RecursionError):
                    continue
                rows += [(doc, [n], dumps(holder[key] if i is None else holder[key][i])) for n, (holder, key, i) in enumerate(found)]
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.list_(pa.int32())), pa.array(c, pa.string())], names=["doc_id", "place", "body"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), column).mapInArrow(run, "doc_id string, place array<int>, body string")


def resolve_manifests(docs: DataFrame, remote: DataFrame, column: str = "json", mode: str = "all", depth: int = 5) -> DataFrame:
    """``doc_id`` and the JSON text with its remote elements in place: one stub may become several elements, or none.  An element
    that stood alone takes the first.  ``doc_id`` must be unique; unreadable texts stay as they are."""
    elements = resolve(stubs_of(docs, column), remote, mode, depth)
    new = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "body"))).alias("_new"))  # one document's elements
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), column).join(new, "doc_id", "left")

    def put(text: str, new: list[dict] | None) -> str:
        doc = read_json(text)
        by: dict[int, list] = {}
        for e in new or ():
            by.setdefault(e["place"][0], []).append(read_json(e["body"]))
        after: dict[tuple[int, str], list] = {}
        found = list(_walk(doc))
        for n, (holder, key, i) in enumerate(found):
            if i is None:
                if by.get(n):
                    holder[key] = by[n][0]
                else:
                    del holder[key]
            else:
                after.setdefault((id(holder), key), [holder, {}])[1][i] = by.get(n, [])
        for (_, key), (holder, at) in after.items():
            holder[key] = [y for i, x in enumerate(holder[key]) for y in at.get(i, [x])]
            if not holder[key]:
                del holder[key]
        return dumps(doc)

    def run(batches):
        for batch in batches:
            out = []
            for text, new in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    out.append(put(text, new) if text is not None else None)
                except (ValueError, RecursionError):
                    out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", column])

    return rows.mapInArrow(run, f"doc_id string, `{column}` string")


def reassemble(elements: DataFrame) -> DataFrame:
    """``doc_id, body``: a JSON array of each document's elements in order (one document's elements only)."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "body")))
    return elements.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["body"]), ","), F.lit("]")).alias("body"))
