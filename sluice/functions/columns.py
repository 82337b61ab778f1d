"""Value functions of manifests as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bind(c: Column) -> Column:
    """The same value, computed once: a non-deterministic part keeps the optimizer from copying the expression into every
    place that uses it, and from pushing filters on it below."""
    return F.when(F.spark_partition_id() >= 0, c)


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without zone means UTC, whatever the session's zone."""
    c = F.col(name).cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(c, F.current_timezone()) if isinstance(df.schema[name].dataType, T.TimestampNTZType) else c)


def to_boolean(c: Column) -> Column:
    """Only ``true``, ``false``, ``1`` and ``0``; else null."""
    t = F.trim(c)
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def to_integer(c: Column, kind: str = "decimal(20,0)") -> Column:
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast(kind))


def to_number(c: Column) -> Column:
    """A double; ``INF``, ``-INF`` and ``NaN`` as in XML Schema."""
    t = F.trim(c)
    special = F.when(t == "INF", F.lit(float("inf"))).when(t == "-INF", F.lit(float("-inf"))).when(t == "NaN", F.lit(float("nan")))
    return F.coalesce(special, F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast("double")))


def to_uint_vector(c: Column) -> Column:
    """Numbers split at white space; an item that is none is null, an empty text an empty array."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(t == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(t, " "), lambda x: F.when(x.rlike(r"^\d+$"), x.try_cast("bigint"))))


def to_string_vector(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def vector_text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def number_text(c: Column) -> Column:
    """A double without a needless point."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def duration_seconds(c: Column) -> Column:
    """Seconds of a duration without years and months; null where the text is none or has them."""
    shape = r"^(-)?P(?=.)(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, shape, i), F.lit("")).try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))
    total = part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    return F.when(c.rlike(shape), F.when(F.regexp_extract(c, shape, 1) == "-", -total).otherwise(total).cast("decimal(20,6)"))


def qname(c: Column) -> Column:
    """``prefix, local`` of a name, split at its first colon."""
    has = F.instr(c, ":") > 0
    return F.struct(F.when(has, F.substring_index(c, ":", 1)).otherwise("").alias("prefix"), F.when(has, F.regexp_replace(c, "^[^:]*:", "")).otherwise(c).alias("local"))


def decode_entities(c: Column) -> Column:
    """The five predefined entities, ``&amp;`` last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def tag_attributes(c: Column) -> Column:
    """A map of the attributes in the text of a tag; the first of a repeated name counts."""
    pattern = r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    names, one, two = (F.regexp_extract_all(c, F.lit(pattern), i) for i in (1, 2, 3))
    entries = F.zip_with(names, F.zip_with(one, two, lambda a, b: F.concat(a, b)), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    first = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.map_from_entries(first)


def category(path: Column) -> Column:
    """The part of the corpus a file belongs to."""
    out = F.when(path.rlike(r"(?:^|/)dash-js/"), "dash-js").when(path.rlike(r"(?:^|/)dash-if/"), "dash-if")
    for annex in ("G", "H", "K"):
        out = out.when(path.rlike(rf"(?:^|/)example_{annex}[^/]*$"), f"iso-annex-{annex}")
    return out.otherwise("misc")


def is_mpd_url(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1).endswith(".mpd")


def is_hls_url(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1).endswith(".m3u8")


def safe_name(url: Column, width: int = 200) -> Column:
    """A file name from a URL: scheme dropped, runs of other characters as one underscore, ended at ``.mpd``, cut to a length."""
    name = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r"[^A-Za-z0-9._-]+", "_")
    return F.substring(F.concat(F.substring_index(name, ".mpd", 1), F.lit(".mpd")), 1, width)


def sanitize(name: Column) -> Column:
    """Letters, digits, - and _ kept, all else an underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")


def minify_json(c: Column) -> Column:
    """Without white space outside strings; the text is left as it is where it holds a control character used as mark."""
    string = r'"(?:[^"\\]|\\.)*+"'
    return F.when(c.contains("\x01"), c).otherwise(F.regexp_replace(c, rf"({string})|[ \t\r\n]+", "$1"))


def minify_xml(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r">\s+<", "><")


def milliseconds_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms"))).otherwise(F.concat(F.replace(F.format_number(ms / 1000, 2), F.lit(","), F.lit("")), F.lit("s")))


def bytes_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / 1048576, 2), F.lit(" MB")))


def looks_like(c: Column, kind: str) -> Column:
    """Whether a text has the lexical form of a built-in type (duration, dateTime, time, date, language and others)."""
    from sluice.schema.types import LEXICAL

    return c.rlike(f"^(?:{LEXICAL[kind]})$")
