import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.operators.rejects import is_json_strings, load_valid, read_records

GOOD = 'd,misc,true,"[""a""]",,"x, ""y""",2025-01-01T00:00:00Z,5'


def faults(spark, raws):
    df = spark.createDataFrame([(i, r, "own") for i, r in enumerate(raws)], "line_id long, raw string, faults_before string")
    return {r.line_id: [(f.reason, f.field) for f in r.faults] for r in read_records(df).collect()}


def test_reasons(spark):
    cases = [
        (GOOD, []),
        (GOOD + "\r\n", []),
        ("", [("column_count", "")]),
        (GOOD + ",", [("column_count", "")]),
        (GOOD.replace('"x, ""y"""', 'x "y"'), [("quoting", "")]),
        (GOOD.replace('"x, ""y"""', '"open'), [("quoting", "")]),
        (GOOD.replace('"x, ""y"""', '"a" b'), [("quoting", "")]),
        (GOOD.replace('"x, ""y"""', "a\nb"), [("quoting", "")]),
        (GOOD.replace('"x, ""y"""', '"a\nb"'), []),
        (",Misc,yes,[1],[,e,2025-02-30T00:00:00Z,1e3", [("invalid_value", f) for f in ("doc_id", "category", "success", "xsd_errors", "json_schema_errors", "finished_at", "ms_to_json")]),
        ("d,misc,0,,,,2024-02-29T24:00:00,9223372036854775807", []),
        ("d,misc,0,,,,2023-02-29T00:00:00,9223372036854775808", [("invalid_value", "finished_at"), ("invalid_value", "ms_to_json")]),
        ("d,misc,1,[],[ ],,2025-01-01T00:00:00.123+14:00,000", []),
        ('d,misc,1,"[""' + "a" * 200_000 + '""]",,,2025-01-01T00:00:00Z,', []),
        ('d,misc,1,"[' + ",".join(['""x""'] * 50_000) + ']",,,2025-01-01T00:00:00Z,', []),
        ("\x01,misc,1,,,,2025-01-01T00:00:00Z,", []),
        ("d" + "," * 30_000, [("column_count", "")]),
    ]
    got = faults(spark, [c for c, _ in cases] + [None])
    for i, (raw, want) in enumerate(cases):
        assert got[i] == want, raw[:80]
    assert len(cases) not in got


@given(st.lists(st.lists(st.text(alphabet='ab",\n\r é', max_size=6), min_size=8, max_size=8), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_written_records_are_never_misread(spark, records):
    raws = []
    for r in records:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(r)
        raws.append(out.getvalue())
    df = spark.createDataFrame(list(enumerate(raws)), "line_id long, raw string")
    for row in read_records(df).collect():
        assert all(f.reason == "invalid_value" for f in row.faults)
        assert [(x or "").replace("\r\n", "\n").replace("\r", "\n") for x in row.rec[:8]] == [x.replace("\r\n", "\n").replace("\r", "\n") for x in records[row.line_id]]


def test_json_lists(spark):
    import json

    texts = ["[]", '["a"]', '["a","b"]', '[ "a" , "b" ]', '["a",]', '["a"', "[1]", "[null]", '[["a"]]', '{"a":"b"}', '"a"', "['a']", '["\\u12g4"]', '["\\""]', '["a\tb"]', '["\\t"]', '["a" "b"]', "", "[", '["\x01"]', '["\\\\"]', '﻿["a"]']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", is_json_strings(F.col("t")).alias("ok")).collect():
        try:
            v = json.loads(r.t)
            want = isinstance(v, list) and all(isinstance(x, str) for x in v)
        except ValueError:
            want = False
        assert r.ok == want, r.t


def test_loaded(spark):
    df = spark.createDataFrame([(1, GOOD), (2, "bad"), (3, None)], "line_id long, raw string")
    rows = load_valid(df).collect()
    assert len(rows) == 1 and rows[0].success is True and rows[0].xsd_errors == ["a"] and rows[0].error == 'x, "y"' and rows[0].ms_to_json == 5
    assert load_valid(spark.createDataFrame([], "line_id long, raw string")).count() == 0
