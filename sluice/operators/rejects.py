"""Problem 3: records that do not parse are set apart with the reason, the valid ones are loaded with types.

Every row is read permissively (``from_csv`` under an explicit schema, the raw text kept where the reader finds it corrupt).
What the reader marks, and what its lenience may have let through (any quote or line end), is then reclassified by three
checks, in this order: ``quoting`` (RFC 4180), ``column_count`` and ``invalid_value`` (one row a field, for all rows).

The quoting check is linear and has no recursion: every quoted chunk is replaced by one mark, after which a field must be
marks only or plain text without quotes and line ends.  Lists of strings are checked the same way under RFC 8259.  All
work is in Catalyst expressions on the row itself.

Defined results: a null raw is not a record and gives no row; the empty text has one column, so ``column_count``; one
line end after the last field is allowed; repeated texts are judged line by line.  A text with more commas than the reader
has room for is classified first and read after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.columns import bind
from sluice.session import scan

FIELDS = ("doc_id", "category", "success", "xsd_errors", "json_schema_errors", "error", "finished_at", "ms_to_json")
# The categories of a conversion.
CATEGORIES = ("dash-js", "dash-if", "iso-annex-G", "iso-annex-H", "iso-annex-K", "misc")

#: Columns the reader has room for at first.
MOST_COMMAS = 20_000

_MARK, _ESC = "\x01", "\x02"


def _skeleton(raw: Column) -> Column:
    """Each quoted chunk as one mark; marks that the text itself holds become another control character."""
    plain = F.translate(raw, _MARK, _ESC)
    ended = F.regexp_replace(plain, r"\r?\n$", "")
    return F.regexp_replace(F.when(F.substring(plain, -1, 1) == '"', plain).otherwise(ended), r'"[^"]*+"', _MARK)


def _well_quoted(skeleton: Column) -> Column:
    bad = lambda f: f.rlike(f'["\r\n]') | (f.contains(_MARK) & ~f.rlike(f"^{_MARK}+$"))  # noqa: E731, F541
    return ~F.exists(F.split(skeleton, ",", -1), bad)


def is_boolean(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "").isin("true", "false", "1", "0")


def is_json_strings(c: Column) -> Column:
    """An RFC 8259 array of strings."""
    escaped = F.regexp_replace(F.translate(c, _MARK + _ESC, "\x03\x03"), r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})', _ESC)
    marked = F.regexp_replace(escaped, '"[^"\\\\\\x00\\x01\\x03-\\x1f]*+"', _MARK)
    tight = F.regexp_replace(marked, r"[ \t\r\n]++", "")
    return tight.rlike(rf"^\[(?:{_MARK}(?:,{_MARK})*+)?\]$")


def is_date_time(c: Column) -> Column:
    """An xs:dateTime that is a real date and time (white space around is collapsed)."""
    t = F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    shape = r"^-?(?:[1-9]\d{3,}|0\d{3})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|24:00:00(?:\.0+)?)(?:Z|[+-](?:(?:0\d|1[0-3]):[0-5]\d|14:00))?$"
    part = lambda i: F.regexp_extract(t, r"^-?(\d+)-(\d\d)-(\d\d)T", i)
    year, month, day = F.substring(part(1), -4, 4).cast("int"), part(2).cast("int"), part(3).cast("int")
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(t.rlike(shape), (day <= last) & (part(1) != "0000")).otherwise(False)


def is_count(c: Column) -> Column:
    """Decimal digits below 2**63."""
    digits = F.regexp_replace(c, "^0+(?=.)", "")
    return F.when(c.rlike(r"^[0-9]+$"), (F.length(digits) < 19) | ((F.length(digits) == 19) & (digits <= "9223372036854775807"))).otherwise(False)


def read_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``rec`` (all fields as text, null unless quoting and count are right) and ``faults`` (array of reason, field)."""
    options = {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": "_corrupt", "maxCharsPerColumn": "-1", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    ddl = ", ".join(f"{f} string" for f in FIELDS) + ", _corrupt string"
    text = F.col(raw)
    fits = F.length(text) - F.length(F.replace(text, F.lit(","))) < MOST_COMMAS
    df = df.where(text.isNotNull()).withColumn("_read", bind(F.from_csv(F.when(fits, text), ddl, options)))
    marked = F.col("_read.doc_id").isNull() | F.col("_read._corrupt").isNotNull() | text.rlike('["\r\n]')
    df = df.withColumn("_skeleton", bind(F.when(marked, _skeleton(text))))
    wrong = F.when(~_well_quoted(F.col("_skeleton")), "quoting").when(F.size(F.split("_skeleton", ",", -1)) != len(FIELDS), "column_count")
    df = df.withColumn("_reason", bind(F.when(F.col("_skeleton").isNotNull(), wrong)))
    df = df.withColumn("rec", bind(F.when(F.col("_reason").isNull(), F.coalesce("_read", F.from_csv(text, ddl, options)))))
    v = {f: F.coalesce(F.col(f"rec.{f}"), F.lit("")) for f in FIELDS}
    empty = lambda f: v[f] == ""
    good = {
        "doc_id": ~empty("doc_id"),
        "category": v["category"].isin(*CATEGORIES),
        "success": is_boolean(v["success"]),
        "xsd_errors": empty("xsd_errors") | is_json_strings(v["xsd_errors"]),
        "json_schema_errors": empty("json_schema_errors") | is_json_strings(v["json_schema_errors"]),
        "finished_at": is_date_time(v["finished_at"]),
        "ms_to_json": empty("ms_to_json") | is_count(v["ms_to_json"]),
    }
    fault = lambda reason, field: F.struct(reason.alias("reason"), F.lit(field).alias("field"))
    values = F.array(*[F.when(~ok, fault(F.lit("invalid_value"), f)) for f, ok in good.items()])
    faults = F.when(F.col("_reason").isNotNull(), F.array(fault(F.col("_reason"), ""))).otherwise(F.filter(values, lambda x: x.isNotNull()))
    return df.withColumn("faults", bind(faults)).drop("_skeleton", "_reason", "_read")


def load_valid(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The valid records with types; lists of errors as arrays, times as instants."""
    ok = read_records(df, raw).where(F.size("faults") == 0)
    text = lambda f: F.nullif(F.col(f"rec.{f}"), F.lit(""))
    trim = lambda f: F.regexp_replace(F.col(f"rec.{f}"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return ok.select(
        "line_id",
        F.col("rec.doc_id").alias("doc_id"),
        F.col("rec.category").alias("category"),
        trim("success").isin("true", "1").alias("success"),
        F.from_json(text("xsd_errors"), "array<string>").alias("xsd_errors"),
        F.from_json(text("json_schema_errors"), "array<string>").alias("json_schema_errors"),
        F.coalesce(F.col("rec.error"), F.lit("")).alias("error"),
        trim("finished_at").try_cast("timestamp").alias("finished_at"),
        text("ms_to_json").cast("bigint").alias("ms_to_json"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    read = read_records(scan(spark, folder, "conversion_raw", "line_id", "raw"))
    return read.select("line_id", F.explode("faults").alias("x")).select("line_id", "x.reason", "x.field").distinct()


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Per category: valid records, passed ones, errors listed and milliseconds."""
    ok = load_valid(scan(spark, folder, "conversion_raw", "line_id", "raw"))
    listed = F.coalesce(F.size("xsd_errors"), F.lit(0)) + F.coalesce(F.size("json_schema_errors"), F.lit(0))
    return ok.groupBy("category").agg(
        F.count("*").alias("records"), F.count_if("success").alias("passed"), F.sum(F.greatest(listed, F.lit(0)).cast("bigint")).alias("errors"), F.coalesce(F.sum("ms_to_json"), F.lit(0)).alias("ms")
    )
