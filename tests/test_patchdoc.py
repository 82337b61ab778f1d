import json

import pytest

from sluice.functions.xmltree import BadXml
from sluice.operators.convert import Rejected
from sluice.operators.patchdoc import apply_patch, convert_patch, is_supported, patch_operations, replay_documents
from sluice.streaming.live import live_state, step
from sluice.operators.convert import dumps, model

BASE = {"id": "m", "type": "dynamic", "PatchLocation": [{"$value": "p", "ttl": 60}], "Period": [{"id": "1", "AdaptationSet": [{"id": 1, "SegmentTemplate": {"timescale": 1, "SegmentTimeline": {"S": [{"t": 0, "d": 2, "r": 5}, {"t": 10, "d": 2}]}}, "Representation": [{"id": "a", "bandwidth": 1}]}, {"id": 2}]}, {"id": "2"}]}
TIMELINE = "/MPD/Period[@id='1']/AdaptationSet[@id='1']/SegmentTemplate/SegmentTimeline"


def run(*ops, doc=BASE, **kw):
    return apply_patch(json.loads(json.dumps(doc)), list(ops), **kw)


def test_operations_in_order():
    out, n, why = run(
        {"replace": {"sel": "/MPD/@publishTime", "$value": "t"}},
        {"replace": {"sel": "/MPD/PatchLocation[1]", "$value": "q"}},
        {"remove": {"sel": f"{TIMELINE}/S[1]", "ws": "both"}},
        {"add": {"sel": TIMELINE, "S": {"t": 20, "d": 2}}},
        {"add": {"sel": TIMELINE, "pos": "prepend", "S": [{"t": 1, "d": 1}, {"t": 2, "d": 1}]}},
        {"replace": {"sel": f"{TIMELINE}/S[3]/@d", "$value": "9"}},
        {"add": {"sel": "/MPD/Period[2]", "pos": "before", "Period": {"id": "1b"}}},
        {"add": {"sel": "/MPD/Period[@id='2']", "type": "@start", "$value": "PT1S"}},
        {"add": {"sel": "/MPD", "BaseURL": {"$value": "u"}}},
        {"replace": {"sel": "/MPD/Period[@id='1']/AdaptationSet[@id='01']/SegmentTemplate/@timescale", "$value": "90000"}},
    )
    assert why is None and n == 10 and out["publishTime"] == "t" and out["PatchLocation"] == [{"$value": "q", "ttl": 60}]
    s = out["Period"][0]["AdaptationSet"][0]["SegmentTemplate"]
    assert s["SegmentTimeline"]["S"] == [{"t": 1, "d": 1}, {"t": 2, "d": 1}, {"t": 10, "d": 9}, {"t": 20, "d": 2}] and s["timescale"] == 90000
    assert [p["id"] for p in out["Period"]] == ["1", "1b", "2"] and out["Period"][2]["start"] == "PT1S" and out["BaseURL"] == [{"$value": "u"}]


def test_remove_and_replace_elements():
    out, _, why = run({"remove": {"sel": "/MPD/Period[1]/AdaptationSet[1]/SegmentTemplate"}}, {"remove": {"sel": "/MPD/@type"}}, {"remove": {"sel": "/MPD/PatchLocation"}}, {"replace": {"sel": "/MPD/Period[1]/AdaptationSet[2]", "AdaptationSet": {"id": 3}}})
    assert why is None and "SegmentTemplate" not in out["Period"][0]["AdaptationSet"][0] and "type" not in out and "PatchLocation" not in out and out["Period"][0]["AdaptationSet"][1] == {"id": 3}


@pytest.mark.parametrize(
    "op",
    [
        {"remove": {"sel": "/MPD/Period[3]"}}, {"remove": {"sel": "/MPD/Period[@id='x']"}}, {"remove": {"sel": "/MPD/Period[1]/text()"}}, {"remove": {"sel": "/MPD/Nothing"}}, {"remove": {"sel": "/MPD"}}, {"move": {"sel": "/MPD"}},
        {"replace": {"sel": "/MPD/Period[1]", "BaseURL": {}}}, {"add": {"sel": "/MPD/Period[1]", "pos": "after", "BaseURL": {}}}, {"replace": {"sel": f"{TIMELINE}/S[1]/@d", "$value": "x"}}, {"remove": {"sel": "/MPD/Period[1]/AdaptationSet[@id='z']"}}, {"remove": {}}, {},
    ],
)
def test_a_failure_changes_nothing(op):
    out, n, why = run({"replace": {"sel": "/MPD/@id", "$value": "changed"}}, op)
    assert out == BASE and n == 0 and why


def test_absent_attributes():
    assert run({"remove": {"sel": "/MPD/@nothing"}})[2] is None and run({"remove": {"sel": "/MPD/@nothing"}}, strict=True)[2]


def test_inverse():
    out, _, _ = run({"add": {"sel": "/MPD", "Period": {"id": "3"}}}, {"add": {"sel": "/MPD/Period[1]", "type": "@start", "$value": "PT0S"}})
    back, _, _ = run({"remove": {"sel": "/MPD/Period[@id='3']"}}, {"remove": {"sel": "/MPD/Period[1]/@start"}}, doc=out)
    assert back == BASE


def test_supported():
    assert is_supported("/MPD/BaseURL[.='x y']") and not is_supported("/MPD/BaseURL[.='x']/@a") and not is_supported("/MPD/BaseURL[1][.='x']")
    out, _, why = run({"remove": {"sel": "/MPD/PatchLocation[.='p']"}})
    assert why is None and out["PatchLocation"] == []


PATCH = """<Patch xmlns="urn:mpeg:dash:schema:mpd-patch:2020" mpdId="m" publishTime="2" originalPublishTime="1"><!-- <remove sel="/MPD"/> -->
<replace sel="/MPD/@minimumUpdatePeriod">PT2S</replace><replace sel="/MPD/PatchLocation[1]"><PatchLocation ttl="30">x &amp; y</PatchLocation></replace>
<remove sel="/MPD/Period[@id='1']/AdaptationSet[@id='1']/SegmentTemplate/SegmentTimeline/S[1]"/>
<add sel="/MPD/Period[@id='1']/AdaptationSet[@id='1']/SegmentTemplate/SegmentTimeline" pos="prepend"><S t="7" d="1"/><S t="8" d="1"/></add>
<add sel="/MPD/Period[1]/AdaptationSet[1]/Representation[1]" type="@qualityRanking">3</add><add sel="/MPD/Period[1]" pos="after"><Period id="n"><AdaptationSet id="5"/></Period></add><replace sel="/MPD/Period[2]"></replace></Patch>"""


def test_convert_patch():
    p = convert_patch(PATCH)
    ops = p["operations"]
    assert (p["mpdId"], p["publishTime"], p["originalPublishTime"], len(ops)) == ("m", "2", "1", 7)
    assert ops[0] == {"replace": {"sel": "/MPD/@minimumUpdatePeriod", "$value": "PT2S"}} and ops[1]["replace"]["PatchLocation"] == {"ttl": 30, "$value": "x & y"}
    assert ops[3]["add"]["S"] == [{"t": 7, "d": 1}, {"t": 8, "d": 1}] and ops[4]["add"]["$value"] == 3
    assert ops[5]["add"]["Period"] == {"id": "n", "AdaptationSet": [{"id": 5}]} and ops[6]["replace"]["$value"] == ""
    out, n, why = apply_patch(BASE, ops[:6])
    assert why is None and n == 6 and [s["t"] for s in out["Period"][0]["AdaptationSet"][0]["SegmentTemplate"]["SegmentTimeline"]["S"]] == [7, 8, 10]
    for bad in ("<Patch/>", '<X mpdId="1" publishTime="1" originalPublishTime="1"/>'):
        with pytest.raises(Rejected):
            convert_patch(bad)
    with pytest.raises(BadXml):
        convert_patch("<Patch")


def test_rows(spark):
    ops = patch_operations(spark.createDataFrame([(PATCH,), ("<bad",), (None,)], "xml string"))
    rows = ops.collect()
    assert len(rows) == 8 and [r.op for r in rows if r.op is None] == [None]
    from pyspark.sql import functions as F

    feed = ops.where("op is not null and op_idx < 6").withColumn("seq", F.col("publish_time"))
    docs = spark.createDataFrame([("m", json.dumps(BASE)), ("n", "{bad"), ("k", None)], "mpd_id string, json string")
    orphan = spark.createDataFrame([("z", "1", 0, "remove", '{"sel":"/MPD"}')], "mpd_id string, seq string, op_idx int, op string, body string")
    got = {r.mpd_id: r for r in replay_documents(docs, feed.select(*orphan.columns).unionByName(orphan)).collect()}
    assert got["m"].applied == 1 and got["m"].rejected == 0 and json.loads(got["m"].json)["Period"][1]["id"] == "n"
    assert got["n"].json is None and got["k"].json is None and got["z"].rejected == 1


def row(kind, publish, original, body):
    return {"kind": kind, "publish_time": publish, "original_publish_time": original, "body": body}


def test_live_steps():
    types = model()
    add = lambda i: dumps([{"add": {"sel": "/MPD", "Period": {"id": i}}}])
    state, (applied, dropped, _) = step((None, None, ""), [row("patch", "3", "2", add("c")), row("patch", "2", "1", add("b"))], types)
    assert applied == 0 and dropped == 0
    state, (applied, dropped, _) = step(state, [row("mpd", "1", None, '{"Period":[{"id":"a"}]}')], types)
    assert applied == 2 and state[0] == "3" and [p["id"] for p in json.loads(state[1])["Period"]] == ["a", "b", "c"]
    state, (applied, dropped, _) = step(state, [row("patch", "2", "1", add("b")), row("patch", "9", "8", add("z")), row("mpd", "0", None, "{}"), row("patch", "4", "3", "{bad")], types)
    assert (applied, dropped) == (0, 3) and "8" in state[2]
    state, (applied, _, _) = step(state, [row("mpd", "8", None, "{}")], types)
    assert applied == 1 and json.loads(state[1]) == {"Period": [{"id": "z"}]}


def test_live_times_are_instants():
    """Other spellings and offsets of an instant link and order as the instant; a patch that fails moves nothing."""
    types = model()
    add = lambda i: dumps([{"add": {"sel": "/MPD", "Period": {"id": i}}}])
    state, _ = step((None, None, ""), [row("mpd", "2026-01-01T02:00:00+02:00", None, '{"Period":[]}')], types)
    state, (applied, _, _) = step(state, [row("patch", "2026-01-01T00:00:10.5Z", "2026-01-01T00:00:00Z", add("a")), row("patch", "2026-01-01T01:00:20+01:00", "2026-01-01T00:00:10.500000z", add("b"))], types)
    assert applied == 2 and state[0] == "2026-01-01T00:00:20.000000Z"
    bad = dumps([{"remove": {"sel": "/MPD/Period[9]"}}])
    after, (applied, dropped, error) = step(state, [row("patch", "2026-01-01T00:00:30Z", "2026-01-01T00:00:20Z", bad)], types)
    assert (applied, dropped) == (0, 1) and error and after[:2] == state[:2]


def test_live_stream(spark, tmp_path):
    from datetime import datetime

    schema = "mpd_id string, kind string, publish_time string, original_publish_time string, body string, ts timestamp"
    add = '[{"add":{"sel":"/MPD","Period":{"id":"b"}}}]'
    parts = [[("m", "patch", "2", "1", add, datetime(2026, 1, 1)), ("k", "mpd", "1", None, "{}", datetime(2026, 1, 1))], [("m", "mpd", "1", None, '{"Period":[{"id":"a"}]}', datetime(2026, 1, 1, 0, 1)), ("m", "patch", "2", "1", add, datetime(2026, 1, 1, 0, 1))]]
    src = tmp_path / "in"
    query = None
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        query = live_state(spark.readStream.schema(schema).parquet(str(src))).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / f"cp{i}")).trigger(availableNow=True).start()
        query.awaitTermination(100)
    rows = [r for r in spark.table("live").collect() if r.mpd_id == "m"]
    assert any(r.publish_time == "2" and [p["id"] for p in json.loads(r.json)["Period"]] == ["a", "b"] for r in rows)
