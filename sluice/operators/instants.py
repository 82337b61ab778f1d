"""Problem 1: instants written in mixed formats, precisions and zones become one UTC form.

Everything is built from Catalyst expressions.  A text is first rewritten by the one spelling rule it matches into a
uniform record ``kind|a|b|c|hour|minute|second|fraction|half|zone|bracket``; the record is then turned into local
microseconds, and the microseconds into an instant with the text's own offset or zone, or else with the zone that the
estimator chose for the writer.

Zone estimation (``estimate_zones``): each zone-less local time is aligned with the time the record was received.  For a
candidate zone (a whole offset history, so summer time is covered) a *violation* is a local time that would lie after
its receipt, or longer before it than ``max_lag``.  The candidate with fewest violations wins; ties go to the declared
zone, then to the least lag, to a zone that another writer declares, and to the name.  A writer that declares no usable zone
is tried against one zone of every offset history that is known, any other against the declared zones.  A declared zone is evidence too: it is overruled only where at least ``least_texts`` texts are
seen and the best candidate mends more than half of them.  Violations are counted by one hash aggregate with map-side combine, so no key is ever gathered.

Defined results: null text gives no row; empty, partial or impossible texts give ``invalid``; a local time that fits two
instants gives ``ambiguous``, one that a clock change skips ``nonexistent``.  Repeated rows give one row.  A zone-less
text of a writer whose zone is neither usable nor estimated (no receipt times) is ``invalid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.columns import bind, utc_micros
from sluice.session import cut, table

# Month names as written in the texts.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s?([AP]M)\b)?"
_ZONE = r"\s*(Z|UTC|GMT|UT|[+-]\d{2}(?::?\d{2})?|[A-Z]+(?:/[A-Z0-9_+-]+)+)?(\[[A-Z0-9_/+-]+\])?"
_MON = r"(" + "|".join(MONTHS) + r")[a-z]*"

# The spellings, each with the record it becomes.
SPELLINGS = (
    (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:T|,? ){_TIME}{_ZONE}$", "ymd|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    (r"^(\d{10}|\d{13}|\d{16}|\d{19})(?:\.(\d{1,9}))?$", "epoch|$1|||||||$2||"),
    (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:T|,? ){_TIME}{_ZONE}$", "num|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    (rf"^(?:[a-z]{{3,9}},? )?(\d{{1,2}})[- ]{_MON}[- ](\d{{4}})(?:T|,? ){_TIME}{_ZONE}$", "mon|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^(?:[a-z]{{3,9}},? )?{_MON} (\d{{1,2}}),? (\d{{4}})(?:T|,? ){_TIME}{_ZONE}$", "mon|$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^(\d{{4}})-?(\d{{3}})T{_TIME}{_ZONE}$", "doy|$1|$2||$3|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{4}})-?W(\d{{2}})-?(\d)T{_TIME}{_ZONE}$", "week|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
)

#: Already one unambiguous form, when it also is a real instant.
SETTLED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?Z$"

_DAY = 86_400_000_000


def known_zones(spark: SparkSession) -> list[str]:
    """Names of the zones that the session's JVM knows (about 600; fixed by its zone data, not by the input)."""
    jvm = spark.sparkContext._jvm
    names = jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(",")
    return sorted(z for z in names if "/" in z or z in ("UTC", "GMT"))


def distinct_histories(spark: SparkSession, zones: list[str], first: list[str]) -> list[str]:
    """One zone of each offset history, from ``first`` where it has one."""
    jvm = spark.sparkContext._jvm
    by = jvm.java.util.LinkedHashMap()
    for z in [*first, *zones]:
        by.putIfAbsent(jvm.java.time.ZoneId.of(z).getRules(), z)
    return sorted({*first, *by.values()})


def _among(name: str, zones: list[str]) -> Column:
    """Whether a column is one of the zones, as one expression text (hundreds of literals are slow to build one by one)."""
    return F.expr(f"`{name}` IN ({', '.join(repr(z) for z in zones)})") if zones else F.lit(False)


def _listed(zones: list[str]) -> Column:
    return F.split(F.lit(",".join(zones)), ",") if zones else F.array().cast("array<string>")


def _record(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, record in reversed(SPELLINGS):
        out = F.when(text.rlike("(?i)" + pattern), F.regexp_replace(text, "(?i)" + pattern, record)).otherwise(out)
    return out


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _micros(fraction: Column) -> Column:
    return F.substring(F.rpad(fraction, 6, "0"), 1, 6).cast("bigint")


def parse_columns(df: DataFrame, text: str, date_order: str | None = None) -> DataFrame:
    """Add ``_local`` (microseconds of the wall clock, null if impossible), ``_offset`` (seconds, null if none is written)
    and ``_zone`` (a zone name written in the text, null if none).

    An epoch number gets offset 0.  A fraction finer than microseconds is cut.  ``date_order`` is a column with ``dmy``,
    ``mdy`` or ``ymd`` for numeric dates whose year is not first; null counts as ``dmy``.
    """
    kept = df.columns
    order = F.coalesce(F.col(date_order), F.lit("dmy")) if date_order else F.lit("dmy")
    df = df.withColumn("_p", bind(F.split(_record(F.col(text)), r"\|", -1)))
    p = [F.get("_p", F.lit(i)) for i in range(11)]
    kind, zone, half = p[0], F.upper(p[9]), F.upper(p[8])
    two = lambda c: F.lpad(c, 2, "0")
    year2 = F.when(F.length(p[3]) == 2, F.concat(F.lit("20"), p[3])).otherwise(p[3])
    y_first = (kind == "num") & (order == "ymd") & (F.length(p[3]) == 2)
    month_no = (F.floor((F.instr(F.lit("".join(MONTHS)), F.lower(F.substring(p[2], 1, 3))) - 1) / 3) + 1).cast("string")
    iso = (
        F.when(kind == "ymd", F.concat_ws("-", p[1], two(p[2]), two(p[3])))
        .when(y_first, F.concat_ws("-", F.concat(F.lit("20"), two(p[1])), two(p[2]), two(p[3])))
        .when((kind == "num") & (order == "mdy"), F.concat_ws("-", year2, two(p[1]), two(p[2])))
        .when(kind == "num", F.concat_ws("-", year2, two(p[2]), two(p[1])))
        .when(kind == "mon", F.concat_ws("-", p[1], two(month_no), two(p[3])))
    )
    digits = F.length(p[1])
    number = p[1].try_cast("bigint")
    epoch = (
        F.when(digits == 10, number * 1_000_000 + F.when(p[8] == "", F.lit(0).cast("bigint")).otherwise(_micros(p[8])))
        .when(p[8] != "", F.lit(None).cast("bigint"))
        .when(digits == 13, number * 1000)
        .when(digits == 16, number)
        .otherwise(F.substring(p[1], 1, 16).try_cast("bigint"))  # nanoseconds, cut
    )
    hour0, minute, second = _int(p[4]), _int(p[5]), F.coalesce(_int(p[6]), F.lit(0))
    hour = F.when(half == "", F.when(hour0 <= 23, hour0)).otherwise(F.when(hour0.between(1, 12), hour0 % 12 + F.when(half == "PM", 12).otherwise(0)))
    fraction = F.when(p[7] == "", F.lit(0).cast("bigint")).otherwise(_micros(p[7]))
    clock = F.when((minute <= 59) & (second <= 59), ((hour * 60 + minute) * 60 + second).cast("bigint") * 1_000_000 + fraction)
    is_offset = zone.rlike(r"^[+-]")
    off_h, off_m = F.substring(zone, 2, 2).cast("int"), F.when(F.length(zone) > 3, F.substring(zone, -2, 2).cast("int")).otherwise(0)
    seconds = F.when((off_h <= 18) & (off_m <= 59), (off_h * 3600 + off_m * 60) * F.when(zone.startswith("-"), -1).otherwise(1))
    bracket = F.regexp_extract(p[10], r"^\[(.*)\]$", 1)
    # each step is computed once; the next refers to it by name
    df = df.withColumns({
        "_kind": bind(kind), "_iso": bind(iso), "_epoch": bind(F.when(kind == "epoch", epoch)), "_clock": bind(F.when(kind != "epoch", clock)), "_seconds": bind(F.when(is_offset, seconds)), "_is": bind(F.coalesce(is_offset, F.lit(False))),
        "_y": bind(F.when(kind.isin("doy", "week"), _int(p[1]))), "_zone": bind(F.when(kind != "epoch", F.when(zone.contains("/"), p[9]).when(bracket != "", bracket))),
    })
    y = F.col("_y")
    df = df.withColumns({
        "_doy": bind(F.when((F.col("_kind") == "doy") & (y > 0), F.date_add(F.make_date(y, F.lit(1), F.lit(1)), _int(p[2]) - 1))),
        "_week": bind(F.when((F.col("_kind") == "week") & (y > 0), F.date_add(F.trunc(F.make_date(y, F.lit(1), F.lit(4)), "week"), (_int(p[2]) - 1) * 7 + _int(p[3]) - 1))),
    })
    date = (
        F.when(F.col("_iso").isNotNull(), F.when(~F.col("_iso").startswith("0000"), F.col("_iso").try_cast("date")))
        .when(F.col("_doy").isNotNull(), F.when((_int(p[2]) >= 1) & (F.year("_doy") == y), F.col("_doy")))
        .when(F.col("_week").isNotNull(), F.when(_int(p[3]).between(1, 7) & _int(p[2]).between(1, 53) & (F.year(F.date_add(F.trunc("_week", "week"), 3)) == y), F.col("_week")))
    )
    utc = (F.col("_kind") == "epoch") | zone.isin("Z", "UTC", "GMT", "UT")
    bad_offset = F.col("_is") & F.col("_seconds").isNull()
    local = F.when(F.col("_kind") == "epoch", F.col("_epoch")).when(~bad_offset, F.unix_date(date).cast("bigint") * _DAY + F.col("_clock"))
    df = df.withColumns({"_local": bind(local), "_offset": bind(F.when(utc, F.lit(0)).otherwise(F.col("_seconds")))})
    return df.select(*kept, "_local", "_offset", "_zone")


def _ts(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def resolve_columns(df: DataFrame, zone: str, zones: list[str], local: str = "_local", offset: str = "_offset") -> DataFrame:
    """Add ``status`` and ``_utc`` (microseconds) from a wall clock, an offset if there is one, and a zone.

    The offsets a zone has a day before and a day after bracket any clock change; an offset counts if it leads back to
    the same wall clock.  None does: nonexistent.  Two do: ambiguous.
    """
    df = df.withColumn("_known", bind(F.when(_among(zone, zones), F.col(zone))))
    safe = F.coalesce("_known", F.lit("UTC"))
    wall = F.col(local)
    offset_at = lambda micros: F.unix_micros(F.from_utc_timestamp(_ts(micros), safe)) - micros
    needed = F.col(offset).isNull() & F.col("_known").isNotNull()
    df = df.withColumns({"_before": bind(F.when(needed, wall - offset_at(wall - _DAY))), "_after": bind(F.when(needed, wall - offset_at(wall + _DAY)))})
    fits = lambda micros: F.coalesce(F.when(needed, micros + offset_at(micros) == wall), F.lit(False))
    df = df.withColumns({"_b": bind(fits(F.col("_before"))), "_a": bind(fits(F.col("_after")))})
    two = F.col("_a") & F.col("_b") & (F.col("_before") != F.col("_after"))
    status = (
        F.when(wall.isNull(), "invalid")
        .when(F.col(offset).isNotNull(), "ok")
        .when(F.col("_known").isNull(), "invalid")
        .when(two, "ambiguous")
        .when(F.col("_a") | F.col("_b"), "ok")
        .otherwise("nonexistent")
    )
    utc = F.when(F.col(offset).isNotNull(), wall - F.col(offset).cast("bigint") * 1_000_000).when(F.col("_b"), F.col("_before")).otherwise(F.col("_after"))
    df = df.withColumn("status", bind(status))
    return df.withColumn("_utc", F.when(F.col("status") == "ok", utc)).drop("_before", "_after", "_a", "_b", "_known")


def format_utc(micros: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` whatever the session's zone."""
    rest = F.pmod(micros, F.lit(_DAY))
    day = ((micros - rest) / _DAY).cast("int")
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    date = F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")
    s = (rest - rest % 1_000_000) / 1_000_000
    return F.concat(date, F.lit("T"), two((s - s % 3600) / 3600), F.lit(":"), two((s % 3600 - s % 60) / 60), F.lit(":"), two(s % 60), F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))


def estimate_zones(parsed: DataFrame, writer: str, received: str, declared: DataFrame, zones: list[str], max_lag_s: int = 900, least_texts: int = 10) -> DataFrame:
    """Choose the zone of each writer: ``writer, declared, zone, texts, violations``.

    ``parsed`` has ``_local``, ``_offset``, ``_zone`` and the receipt time; ``declared`` has one row per writer with
    ``writer`` and ``tz`` (null where nothing is declared).  The candidates are the zones that any writer declares, and for
    a writer without a usable one all known offset histories.  A writer without any zone-less text keeps its declared zone.
    """
    d = declared.select(F.col(writer), F.col("tz").alias("declared"))
    candidates = sorted(r.tz for r in declared.select("tz").where(_among("tz", zones)).distinct().collect())  # at most as many as there are zones
    usable = F.coalesce(_among("declared", zones), F.lit(False))
    every = distinct_histories(parsed.sparkSession, zones, candidates) if d.where(~usable).limit(1).count() else candidates
    wall = F.col("_local")
    seen = utc_micros(parsed, received)
    loose = parsed.where(wall.isNotNull() & F.col("_offset").isNull() & F.col("_zone").isNull() & F.col(received).isNotNull())
    # one row per writer, wall clock and lag in steps of five minutes is enough: the count of violations is additive
    step = 300_000_000
    binned = loose.groupBy(F.col(writer), (wall - wall % step).alias("_wall"), F.round((seen - wall) / step).cast("bigint").alias("_lag")).agg(F.count("*").alias("n"))
    few, all_ = _listed(candidates), _listed(every)
    undeclared = F.broadcast(d.where(~usable).select(writer, F.lit(True).alias("_all")).distinct())
    tried = binned.join(undeclared, writer, "left").withColumn("zone", F.explode(F.when(F.col("_all"), all_).otherwise(few))).drop("_all")
    lag = F.col("_lag") * step + (F.unix_micros(F.from_utc_timestamp(_ts(F.col("_wall")), F.col("zone"))) - F.col("_wall"))
    bad = (lag < -step) | (lag > F.lit(max_lag_s * 1_000_000 + step))
    scored = tried.groupBy(writer, "zone").agg(F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("violations"), F.sum("n").alias("texts"), F.sum(F.abs(lag) * F.col("n")).alias("_lags"))
    scored = scored.join(F.broadcast(d), writer, "left")
    best = scored.groupBy(writer, "declared").agg(
        F.min(F.struct("violations", (~F.col("zone").eqNullSafe(F.col("declared"))).alias("_o"), "_lags", (~_among("zone", candidates)).alias("_new"), "zone", "texts")).alias("b"),
        F.max(F.when(F.col("zone") == F.col("declared"), F.col("violations"))).alias("declared_violations"),
    )
    chosen = best.select(writer, F.col("b.zone").alias("zone"), F.col("b.texts").alias("texts"), F.col("b.violations").alias("violations"), "declared_violations")
    contradicted = (F.col("texts") >= least_texts) & (F.col("declared_violations") - F.col("violations") > F.col("texts") / 2)
    zone = F.when(~usable | contradicted, F.coalesce("zone", "declared")).otherwise(F.col("declared"))
    return d.join(chosen, writer, "left").withColumn("zone", zone)


def normalise_instants(ops: DataFrame, packager: DataFrame, fields=("publish_time", "original_publish_time"), keys=("patch_id",), writer: str = "packager_id", received: str = "received_at", max_lag_s: int = 900) -> DataFrame:
    """All texts of ``fields`` with ``keys, field, text, status, utc`` and ``_utc`` in microseconds (the keys may hold the writer).

    Rows are reduced to their distinct texts before anything is parsed, with partial results made where they are read; the
    parsed table is narrow and written once, as the estimate and the result both read it.  The zone of a writer's zone-less
    texts is the one that ``estimate_zones`` chose.
    """
    spark = ops.sparkSession
    zones = known_zones(spark)
    dim = packager.select(F.col(writer), "tz", "date_order").groupBy(writer).agg(F.min("tz").alias("tz"), F.min("date_order").alias("date_order"))
    keys, own = tuple(keys), tuple(dict.fromkeys((*keys, writer)))
    rows = ops.groupBy(*own, *fields).agg(F.min(received).alias(received))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    rows = rows.select(*own, received, pairs.alias("_f")).select(*own, received, "_f.field", "_f.text").where(F.col("text").isNotNull())
    parsed = cut(parse_columns(rows.join(F.broadcast(dim.select(writer, "date_order")), writer, "left"), "text", "date_order").drop("date_order"), "instants")
    chosen = estimate_zones(parsed.where(F.col("field") == fields[0]), writer, received, dim, zones, max_lag_s)
    chosen = chosen.select(writer, F.col("zone").alias("_home"))
    out = parsed.join(F.broadcast(chosen), writer, "left").withColumn("_in", F.coalesce("_zone", "_home"))  # one row a writer
    out = resolve_columns(out, "_in", zones)
    return out.select(*keys, "field", "text", "status", F.coalesce(format_utc(F.col("_utc")), F.lit("")).alias("utc"), "_utc").distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    ops = table(spark, folder, "patch_op").select("patch_id", "packager_id", "publish_time", "original_publish_time", "received_at")
    got = normalise_instants(ops, table(spark, folder, "packager"))
    settled = F.col("text").rlike(SETTLED) & (F.col("status") == "ok")
    return got.where(~settled).select("patch_id", "field", "status", "utc").distinct()


def writer_zones(ops: DataFrame, packager: DataFrame) -> DataFrame:
    """The zones that ``estimate_zones`` chooses from all deliveries, as ``normalise_instants`` does."""
    rows = ops.where(F.col("publish_time").isNotNull()).groupBy("patch_id", "packager_id", F.col("publish_time").alias("text")).agg(F.min("received_at").alias("received_at"))
    dim = packager.groupBy("packager_id").agg(F.min("tz").alias("tz"), F.min("date_order").alias("date_order"))
    parsed = parse_columns(rows.join(F.broadcast(dim), "packager_id", "left"), "text", "date_order")
    return estimate_zones(parsed, "packager_id", "received_at", dim, known_zones(ops.sparkSession))


def p1_zones(spark: SparkSession, folder: str) -> DataFrame:
    """What the estimator makes of each writer, beside what is declared."""
    return writer_zones(table(spark, folder, "patch_op"), table(spark, folder, "packager"))
