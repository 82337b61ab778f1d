from datetime import datetime
from zoneinfo import ZoneInfo

import pytest

from sluice.operators.instants import estimate_zones, known_zones, normalise_instants, parse_columns

PACKAGER = [(1, "Europe/Berlin", "dmy"), (2, "America/New_York", "mdy"), (3, None, None), (4, "Asia/Tokyo", "ymd")]
SCHEMA = "patch_id long, packager_id int, publish_time string, original_publish_time string, received_at timestamp, extra string"

CASES = [
    (1, "2025-03-30T02:30:00", "nonexistent", ""),
    (1, "2025-10-26 02:30:00", "ambiguous", ""),
    (1, "2025-10-26T02:30:00+01:00", "ok", "2025-10-26T01:30:00.000000Z"),
    (1, "01/04/2025 10:00:00", "ok", "2025-04-01T08:00:00.000000Z"),
    (2, "01/04/2025 10:00:00", "ok", "2025-01-04T15:00:00.000000Z"),
    (2, "04/15/26, 08:19:59", "ok", "2026-04-15T12:19:59.000000Z"),
    (4, "25/03/31 08:00:00", "ok", "2025-03-30T23:00:00.000000Z"),
    (1, "Apr 5, 2026 2:07:17 PM", "ok", "2026-04-05T12:07:17.000000Z"),
    (1, "Apr 5, 2026 12:00:00 AM", "ok", "2026-04-04T22:00:00.000000Z"),
    (1, "Mon, 10 Nov 2025 14:35:35 GMT", "ok", "2025-11-10T14:35:35.000000Z"),
    (1, "2025-163T20:48:20.208Z", "ok", "2025-06-12T20:48:20.208000Z"),
    (1, "2025-W14-1T13:56:37Z", "ok", "2025-03-31T13:56:37.000000Z"),
    (1, "2020-W53-7T00:00:00Z", "ok", "2021-01-03T00:00:00.000000Z"),
    (1, "2021-W53-1T00:00:00Z", "invalid", ""),
    (1, "2025-366T00:00:00Z", "invalid", ""),
    (1, "1743296484", "ok", "2025-03-30T01:01:24.000000Z"),
    (1, "1743296484123", "ok", "2025-03-30T01:01:24.123000Z"),
    (1, "1743296484123456", "ok", "2025-03-30T01:01:24.123456Z"),
    (1, "1743296484.5", "ok", "2025-03-30T01:01:24.500000Z"),
    (1, "1761449400123456999", "ok", "2025-10-26T03:30:00.123456Z"),
    (1, "9999999999999999999", "ok", "2286-11-20T17:46:39.999999Z"),
    (1, "99999999999999999999", "invalid", ""),
    (1, "20250430T014739Z", "ok", "2025-04-30T01:47:39.000000Z"),
    (1, "20250330T020126+0100", "ok", "2025-03-30T01:01:26.000000Z"),
    (1, "2025-07-19 00:18:07 America/Los_Angeles", "ok", "2025-07-19T07:18:07.000000Z"),
    (1, "2025-07-19T00:18:07 Nowhere/Atall", "invalid", ""),
    (1, "2025-12-01T00:00:00,25+09:00[Asia/Tokyo]", "ok", "2025-11-30T15:00:00.250000Z"),
    (1, "2025-11-10T15:47", "ok", "2025-11-10T14:47:00.000000Z"),
    (1, "2025-02-30T02:53:13Z", "invalid", ""),
    (1, "2025-13-01T02:53:13Z", "invalid", ""),
    (1, "2025-01-01T25:00:00Z", "invalid", ""),
    (1, "0000-00-00 00:00:00", "invalid", ""),
    (1, "2025-04-", "invalid", ""),
    (1, "", "invalid", ""),
    (1, "now", "invalid", ""),
    (3, "2025-01-01T00:00:00Z", "ok", "2025-01-01T00:00:00.000000Z"),
    (1, "x" * 5000, "invalid", ""),
]


def test_spellings(spark):
    rows = [(i, p, t, None, datetime(2026, 1, 1), "e") for i, (p, t, _, _) in enumerate(CASES)]
    got = normalise_instants(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(PACKAGER, "packager_id int, tz string, date_order string"))
    seen = {r.patch_id: (r.status, r.utc) for r in got.collect()}
    for i, (_, text, status, utc) in enumerate(CASES):
        assert seen[i] == (status, utc), text


def test_nulls_repeats_and_empty(spark):
    dim = spark.createDataFrame(PACKAGER, "packager_id int, tz string, date_order string")
    rows = [(1, 1, None, "2025-01-01", None, "e"), (2, None, "2025-01-01T00:00:00", None, None, "e"), (3, 1, "2025-01-01T00:00:00Z", None, None, "e"), (3, 1, "2025-01-01T00:00:00Z", None, None, "f")]
    got = sorted((r.patch_id, r.field, r.status) for r in normalise_instants(spark.createDataFrame(rows, SCHEMA), dim).collect())
    assert got == [(1, "original_publish_time", "invalid"), (2, "publish_time", "invalid"), (3, "publish_time", "ok")]
    assert normalise_instants(spark.createDataFrame([], SCHEMA), dim).count() == 0


def test_zone_is_estimated_by_alignment(spark):
    zones = {1: "Europe/Berlin", 2: "America/New_York", 3: "Asia/Tokyo"}
    rows = []
    for w, z in zones.items():
        for month in range(1, 13):
            local = datetime(2025, month, 10, 12, month)
            received = local.replace(tzinfo=ZoneInfo(z)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None, second=7)
            rows.append((w, local.strftime("%Y-%m-%dT%H:%M:%S"), received))
    df = spark.createDataFrame(rows, "packager_id int, text string, received_at timestamp")
    dim = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "Asia/Tokyo"), (5, "America/New_York"), (6, "Europe/Berlin")], "packager_id int, tz string")
    got = {r.packager_id: (r.zone, r.violations) for r in estimate_zones(parse_columns(df, "text"), "packager_id", "received_at", dim, known_zones(spark)).collect()}
    for w, z in zones.items():
        assert got[w] == (z, 0)
    assert got[4][0] == "Asia/Tokyo"
    wrong = spark.createDataFrame([(1, "Asia/Tokyo"), (2, "America/New_York"), (3, None), (6, "Europe/Berlin")], "packager_id int, tz string")
    got = {r.packager_id: r.zone for r in estimate_zones(parse_columns(df, "text"), "packager_id", "received_at", wrong, known_zones(spark)).collect()}
    assert got[1] == "Europe/Berlin" and got[2] == "America/New_York", "a declared zone that the texts contradict is overruled"
    few = df.where("month(received_at) < 3")
    got = {r.packager_id: r.zone for r in estimate_zones(parse_columns(few, "text"), "packager_id", "received_at", wrong, known_zones(spark)).collect()}
    assert got[1] == "Asia/Tokyo", "a few texts do not overrule"


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe"])
def test_local_times_agree_with_zoneinfo(spark, zone):
    from datetime import timedelta

    walls = [datetime(2025, m, d, h, 15 * q) for m, d in ((3, 9), (3, 30), (4, 6), (10, 5), (10, 26), (11, 2)) for h in range(0, 5) for q in range(4)]
    rows = [(i, 1, w.strftime("%Y-%m-%d %H:%M:%S"), None, datetime(2026, 1, 1), "") for i, w in enumerate(walls)]
    dim = spark.createDataFrame([(1, zone, "dmy")], "packager_id int, tz string, date_order string")
    got = {r.patch_id: (r.status, r.utc) for r in normalise_instants(spark.createDataFrame(rows, SCHEMA), dim).collect()}
    for i, w in enumerate(walls):
        fits = {u for fold in (0, 1) if (u := w.replace(tzinfo=ZoneInfo(zone), fold=fold).astimezone(ZoneInfo("UTC"))).astimezone(ZoneInfo(zone)).replace(tzinfo=None, fold=0) == w}
        status = {0: "nonexistent", 1: "ok", 2: "ambiguous"}[len(fits)]
        assert got[i][0] == status, (zone, w)
        if len(fits) == 1:
            assert got[i][1] == fits.pop().strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    assert timedelta(0) == timedelta(0)


def test_session_zone_does_not_matter(spark):
    from datetime import datetime as at

    from sluice.functions.columns import utc_micros

    rows = [(i, 1, f"2025-06-0{i} 10:00:00", None, at(2025, 6, i, 8, 0, 5), "") for i in range(1, 9)] + [(9, 1, "2025-03-30 02:30:00", None, at(2025, 3, 30), "")]
    dim = spark.createDataFrame([(1, "Europe/Berlin", "dmy")], "packager_id int, tz string, date_order string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = []
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame(rows, SCHEMA.replace("received_at timestamp", "received_at timestamp_ntz"))
            got = normalise_instants(df, dim)
            seen.append((sorted((r.patch_id, r.status, r.utc) for r in got.collect()), sorted(r.m for r in df.select(utc_micros(df, "received_at").alias("m")).collect())))
        assert seen[0] == seen[1] and seen[0][0][0] == (1, "ok", "2025-06-01T08:00:00.000000Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("tz", [None, "Not/AZone"])
def test_zones_that_nobody_declares(spark, tmp_path, tz):
    """Without any usable declared zone the texts still get an instant, and the replay applies their documents."""
    from sluice.operators.instants import p1_found, p1_zones
    from sluice.operators.replay import p6_found

    rows, want = [], set()
    for w, z in ((1, "Asia/Kathmandu"), (2, "America/St_Johns"), (3, "Europe/Berlin")):
        for k in range(12):
            local = datetime(2025, k + 1, 11, 9, 7, k)
            utc = local.replace(tzinfo=ZoneInfo(z)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
            n = 100 * w + k
            rows.append((f"m{w}", n, w, local.strftime("%Y-%m-%dT%H:%M:%S"), None, 0, "replace", "/MPD/Period[1]/AdaptationSet[1]/Representation[1]/@bandwidth", None, None, None, None, str(n), None, utc.replace(second=30)))
            want.add((n, "publish_time", "ok", utc.strftime("%Y-%m-%dT%H:%M:%S.000000Z")))
    ops = "mpd_id string, patch_id long, packager_id int, publish_time string, original_publish_time string, op_idx int, op string, sel string, pos string, attr string, payload_name string, payload_json string, value string, ws string, received_at timestamp_ntz"
    reps = "mpd_id string, period_id string, as_id int, as_ord int, ord int, rep_id string, bandwidth long, width int, height int, codecs string"
    for name, data, schema in (("patch_op", rows, ops), ("packager", [(w, "x", tz if w < 3 else "Europe/Berlin", "dmy") for w in (1, 2, 3)], "packager_id int, packager_name string, tz string, date_order string"), ("representation", [(f"m{w}", "p", 1, 1, 1, "r", 1, None, None, None) for w in (1, 2, 3)], reps)):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {tuple(r) for r in p1_found(spark, str(tmp_path)).collect()} == want
    assert {(r.packager_id, r.violations) for r in p1_zones(spark, str(tmp_path)).collect()} == {(1, 0), (2, 0), (3, 0)}
    assert {(r.mpd_id, r.bandwidth) for r in p6_found(spark, str(tmp_path)).collect()} == {("m1", 111), ("m2", 211), ("m3", 311)}
