"""Manifests as a table of nodes, and what is read from it: namespaces, canonical form, child order.

``node``: doc_id, node_id (document order), parent_id, ord (place among siblings), depth, kind (elem, attr, text), ns_uri,
prefix, local, path, value; extension content, order and raw values are kept.  The table is made by one Arrow stage; all
else here is Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.functions.xmltree import DASH, BadXml, Node, parse
from sluice.session import ship

NODE = "doc_id string, node_id bigint, parent_id bigint, ord int, depth int, kind string, ns_uri string, prefix string, local string, path string, value string"
_NAMES = ("doc_id", "node_id", "parent_id", "ord", "depth", "kind", "ns_uri", "prefix", "local", "path", "value")
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 6)


def rows_of(doc: str, root: Node) -> Iterator[tuple]:
    """All nodes of one document in document order; ``bad`` rows have the reason as value."""
    number = 0
    todo: list[tuple[Node, int | None, int, int, str]] = [(root, None, 1, 0, f"/{root.name}[1]")]
    while todo:
        node, parent, place, depth, path = todo.pop()
        me = number
        yield doc, me, parent, place, depth, "elem", node.uri, node.prefix, node.local, path, None
        number += 1
        for i, (k, v) in enumerate(node.attrs.items()):
            p, _, local = k.rpartition(":")
            uri = "http://www.w3.org/2000/xmlns/" if k == "xmlns" or p == "xmlns" else node.scope.get(p) if p else None
            yield doc, number, me, i + 1, depth + 1, "attr", uri, p, local, f"{path}/@{k}", v
            number += 1
        if node.text:
            yield doc, number, me, 0, depth + 1, "text", None, "", "", f"{path}/text()", node.text
            number += 1
        seen: dict[str, int] = {}
        below = []
        for i, c in enumerate(node.children):
            seen[c.name] = seen.get(c.name, 0) + 1
            below.append((c, me, i + 1, depth + 1, f"{path}/{c.name}[{seen[c.name]}]"))
        todo.extend(reversed(below))


def _explode(xml: str):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=list(_NAMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column(xml).to_pylist()):
                if text is None:
                    continue
                try:
                    rows.extend(rows_of(doc, parse(text)))
                except BadXml as e:
                    rows.append((doc, 0, None, 0, 0, "bad", None, "", "", "", str(e)))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return run


def nodes(df: DataFrame, xml: str = "xml") -> DataFrame:
    """The node table; a document that is not well-formed has one node of kind ``bad``, a null one none."""
    ship(df.sparkSession)
    return df.select("doc_id", xml).mapInArrow(_explode(xml), NODE)


def namespace_registry(node: DataFrame) -> DataFrame:
    """``doc_id, ns_uri, prefix, attributes``: the first prefix of each namespace and its attributes' names, sorted."""
    foreign = node.where((F.col("ns_uri") != DASH) & ~F.col("ns_uri").isin("http://www.w3.org/2001/XMLSchema-instance", "http://www.w3.org/2000/xmlns/"))
    names = F.array_sort(F.collect_set(F.when(F.col("kind") == "attr", F.col("local"))))  # as many as the namespace has names
    prefix = F.min_by(F.when(F.col("prefix") == "", F.col("local")).otherwise(F.col("prefix")), "node_id")
    return foreign.groupBy("doc_id", "ns_uri").agg(prefix.alias("prefix"), names.alias("attributes"))


def namespace_violations(node: DataFrame) -> DataFrame:
    """``doc_id, rule, name``: prefixes bound to several namespaces, and namespaces with several prefixes."""
    declared = node.where((F.col("kind") == "attr") & (F.col("prefix") == "xmlns")).select("doc_id", F.col("local").alias("p"), F.col("value").alias("uri"))
    rebound = declared.groupBy("doc_id", F.col("p").alias("name")).agg(F.count_distinct("uri").alias("n")).where("n > 1").select("doc_id", F.lit("prefix_rebinding").alias("rule"), "name")
    aliased = declared.groupBy("doc_id", F.col("uri").alias("name")).agg(F.count_distinct("p").alias("n")).where("n > 1").select("doc_id", F.lit("uri_aliasing").alias("rule"), "name")
    reserved = declared.where(F.col("p").isin("$ns", "$value")).select("doc_id", F.lit("reserved_prefix").alias("rule"), F.col("p").alias("name"))
    return rebound.unionByName(aliased).unionByName(reserved)


def canonical_value(name: Column, value: Column, booleans: tuple[str, ...], numbers: tuple[str, ...]) -> Column:
    """White space collapsed; 1/0 of booleans as true/false; numbers by value (a leading number counts)."""
    tight = F.trim(F.regexp_replace(value, r"\s+", " "))
    number = F.regexp_extract(tight, r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    sign, whole, part = (F.regexp_extract(number, r"^([+-]?)0*(\d*)(?:\.(\d*?)0*)?$", i) for i in (1, 2, 3))
    # digits are kept as they are, so numbers beyond a double's precision stay unlike; only an exponent needs arithmetic
    digits = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    exact = F.when((sign == "-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    scaled = F.regexp_replace(number.try_cast("double").try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    as_number = F.when(number.rlike("[eE]"), F.coalesce(F.nullif(scaled, F.lit("")), number)).otherwise(exact)
    return (
        F.when(name.isin(*booleans) & tight.isin("1", "true"), "true")
        .when(name.isin(*booleans) & tight.isin("0", "false"), "false")
        .when(name.isin(*numbers) & (number != ""), as_number)
        .otherwise(tight)
    )


# Fields compared as booleans and as numbers.
BOOLEANS = ("segmentAlignment", "subsegmentAlignment", "bitstreamSwitching", "codingDependency", "indexRangeExact", "availabilityTimeComplete", "inband", "inAllPeriods")
NUMBERS = ("bandwidth", "width", "height", "startWithSAP", "maxPlayoutRate", "qualityRanking", "group", "timescale", "duration", "startNumber", "t", "d", "r", "n", "k")


def canonical_lines(node: DataFrame, namespaces: bool = True) -> DataFrame:
    """``doc_id, line``: each attribute and text with its canonical path and value, declarations and hints left out.

    Paths count occurrences per name, so the order of attributes and of unlike siblings does not matter.
    """
    skipped = F.coalesce(F.col("ns_uri"), F.lit("")).isin("http://www.w3.org/2001/XMLSchema-instance", "http://www.w3.org/2000/xmlns/")
    kept = node.where(F.col("kind").isin("elem", "attr", "text") & ~skipped)
    value = F.coalesce(canonical_value(F.col("local"), F.col("value"), BOOLEANS, NUMBERS), F.lit(""))
    owner = F.coalesce(F.col("ns_uri"), F.lit("")) if namespaces else F.lit("")
    return kept.select("doc_id", F.concat_ws("\t", "path", owner, "kind", value).alias("line"))


def fingerprint(node: DataFrame) -> DataFrame:
    """``doc_id, lines, hash``: equal documents have equal hashes.  Lines are added as 128-bit numbers, so no document is gathered."""
    lines = canonical_lines(node)
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "line").cast("decimal(38,0)")).cast("string")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sha2(F.concat_ws("/", part(0), part(1)), 256).alias("hash"))


def line_differences(left: DataFrame, right: DataFrame, most: int = 20) -> DataFrame:
    """``doc_id, pos, left, right`` of the lines in which two texts (``doc_id, text``) differ, the first ``most`` a document."""

    def lines(df: DataFrame, name: str) -> DataFrame:
        return df.select("doc_id", F.posexplode(F.split("text", "\n"))).select("doc_id", "pos", F.col("col").alias(name))

    unequal = left.join(right.withColumnRenamed("text", "other"), "doc_id", "full_outer").where(~F.col("text").eqNullSafe(F.col("other"))).select("doc_id")
    one, two = lines(left.join(unequal, "doc_id", "left_semi"), "left"), lines(right.join(unequal, "doc_id", "left_semi"), "right")
    both = one.join(two, ["doc_id", "pos"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))
    both = both.select("doc_id", "pos", F.coalesce("left", F.lit("<missing>")).alias("left"), F.coalesce("right", F.lit("<missing>")).alias("right"))
    return both.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).where(F.col("n") <= most).drop("n")


def child_order(node: DataFrame, order: DataFrame) -> DataFrame:
    """``doc_id, parent_id, local, old, new``: children put in schema order (``parent, local, place``), others last as they were."""
    elem = node.where(F.col("kind") == "elem")
    up = elem.select("doc_id", F.col("node_id").alias("parent_id"), F.col("local").alias("parent"))
    placed = elem.join(up, ["doc_id", "parent_id"]).join(F.broadcast(order), ["parent", "local"], "left")  # one row a child name of the schema
    new = F.row_number().over(W.partitionBy("doc_id", "parent_id").orderBy(F.coalesce("place", F.lit(2**31 - 1)), "ord"))
    return placed.select("doc_id", "parent_id", "local", F.col("ord").alias("old"), new.alias("new"))


def json_path(path: Column, singles: tuple[str, ...] = ()) -> Column:
    """The place in the JSON form of a node's path; ``singles`` are elements that are no arrays."""
    steps = F.slice(F.split(path, "/"), 3, 1_000_000)
    name = lambda s: F.regexp_extract(s, r"^@?([^\[\(]+)", 1)
    place = lambda s: F.concat(F.lit("["), (F.regexp_extract(s, r"\[(\d+)\]$", 1).cast("int") - 1).cast("string"), F.lit("]"))
    one = lambda s: F.when(s == "text()", "$value").when(s.startswith("@") | name(s).isin(*singles), name(s)).otherwise(F.concat(name(s), place(s)))
    return F.array_join(F.transform(steps, one), ".")
