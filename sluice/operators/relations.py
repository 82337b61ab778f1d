"""Flat relations of typed manifests, and checks of values against the schema's facets, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.convert import model
from sluice.schema.types import BUILT_IN, LEXICAL, java_pattern, kind, struct_of
from sluice.schema.xsd import Complex, Schema, Simple


def typed(df: DataFrame, column: str = "json", schema: Schema | None = None) -> DataFrame:
    """Add ``mpd``, the JSON text as a struct of the schema's types; unused parts of it are pruned by the optimizer."""
    types = schema or model()
    return df.withColumn("mpd", F.from_json(column, struct_of(types, types.types["MPDtype"])))


def _down(df: DataFrame, parent: str, path: str, ordinal: str, name: str) -> DataFrame:
    return df.select("*", F.posexplode(f"{parent}.{path}").alias(ordinal, name)).withColumn(ordinal, F.col(ordinal) + 1)


def periods(df: DataFrame) -> DataFrame:
    return _down(df, "mpd", "Period", "period_ord", "period")


def adaptation_sets(df: DataFrame) -> DataFrame:
    return _down(periods(df), "period", "AdaptationSet", "as_ord", "aset")


def representations(df: DataFrame) -> DataFrame:
    return _down(adaptation_sets(df), "aset", "Representation", "rep_ord", "rep")


def segments(df: DataFrame) -> DataFrame:
    """S elements of AdaptationSets' timelines."""
    return _down(adaptation_sets(df), "aset", "SegmentTemplate.SegmentTimeline.S", "s_ord", "s")


def events(df: DataFrame) -> DataFrame:
    return _down(_down(periods(df), "period", "EventStream", "stream_ord", "stream"), "stream", "Event", "event_ord", "event")


def base_urls(df: DataFrame) -> DataFrame:
    """BaseURLs at all four levels: ``doc_id, level, value``."""
    url = lambda rows, path, level: rows.select("doc_id", F.lit(level).alias("level"), F.explode(path).alias("u")).select("doc_id", "level", F.col("u").getField("$value").alias("value"))
    return url(df, "mpd.BaseURL", "MPD").unionByName(url(periods(df), "period.BaseURL", "Period")).unionByName(url(adaptation_sets(df), "aset.BaseURL", "AdaptationSet")).unionByName(url(representations(df), "rep.BaseURL", "Representation"))


def descriptors(df: DataFrame) -> DataFrame:
    """ContentProtection, EssentialProperty, SupplementalProperty and Role of AdaptationSets: ``doc_id, period_ord, as_ord, kind, ord, schemeIdUri, value``."""
    sets = adaptation_sets(df)
    out = None
    for name in ("ContentProtection", "EssentialProperty", "SupplementalProperty", "Role"):
        one = sets.select("doc_id", "period_ord", "as_ord", F.lit(name).alias("kind"), F.posexplode(f"aset.{name}").alias("ord", "x"))
        one = one.select("doc_id", "period_ord", "as_ord", "kind", (F.col("ord") + 1).alias("ord"), "x.schemeIdUri", "x.value")
        out = one if out is None else out.unionByName(one)
    return out


def fault(value: Column, t: Simple, path: str) -> Column:
    """A struct of path and message where a text does not fit a simple type; null where it fits or is null."""
    v = F.trim(value) if kind(t) != "string" else value
    bad = F.lit(False)
    k = kind(t)
    if k == "boolean":
        bad = ~v.isin("true", "false", "1", "0")
    elif k == "integer":
        number = v.try_cast("decimal(38,0)")
        _, low, high = BUILT_IN[t.base]
        bad = ~v.rlike(r"^[+-]?\d+$") | number.isNull()
        facets = dict(t.facets)
        low, high = (int(facets.get("minInclusive", low)) if facets.get("minInclusive", low) is not None else None), (int(facets.get("maxInclusive", high)) if facets.get("maxInclusive", high) is not None else None)
        if low is not None:
            bad = bad | (number < F.lit(low).cast("decimal(38,0)"))
        if high is not None:
            bad = bad | (number > F.lit(high).cast("decimal(38,0)"))
    elif k == "number":
        bad = ~v.rlike(r"^(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|-?INF|NaN)$")
    elif k == "list" and kind(t.item) == "integer":
        bad = F.exists(F.split(F.trim(v), r"\s+"), lambda x: ~x.rlike(r"^\d+$"))
    elif k == "string":
        if t.base in LEXICAL:
            bad = bad | ~v.rlike(f"^(?:{LEXICAL[t.base]})$")
        facets = dict(t.facets)
        if "minLength" in facets:
            bad = bad | (F.length(v) < int(facets["minLength"]))
        if "maxLength" in facets:
            bad = bad | (F.length(v) > int(facets["maxLength"]))
    if t.enum:
        bad = bad | ~v.isin(*t.enum)
    if t.patterns:
        bad = bad | ~_any(v, t.patterns)
    return F.when(value.isNotNull() & bad, F.struct(F.lit(path).alias("path"), F.concat(F.lit(f"not {t.name}: "), value).alias("msg")))


def _any(v: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | v.rlike(java_pattern(p))
    return out


def faults(columns: dict[str, Column], c: Complex, path: str = "") -> Column:
    """An array of all faults of an element whose attributes are text columns: bad values and missing required ones."""
    found = []
    for a in c.attributes.values():
        if a.name in columns:
            found.append(fault(columns[a.name], a.type, f"{path}/@{a.name}"))
            if a.required:
                found.append(F.when(columns[a.name].isNull(), F.struct(F.lit(f"{path}/@{a.name}").alias("path"), F.lit("required").alias("msg"))))
    empty = F.array().cast("array<struct<path string, msg string>>")
    return F.array_compact(F.array(*found)) if found else empty
