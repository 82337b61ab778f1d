import json

from sluice.operators.xlink import RESOLVE_TO_ZERO, reassemble, resolve, resolve_manifests

STUB = "doc_id string, place array<int>, body string"
REMOTE = "href string, status int, body string"


def run(spark, stubs, remote, **kw):
    got = resolve(spark.createDataFrame(stubs, STUB), spark.createDataFrame(remote, REMOTE), **kw)
    return {r.doc_id: json.loads(r.body) for r in reassemble(got).collect()}


def link(href, **kw):
    return json.dumps({**kw, "xlink": {"href": href}})


def test_merge_expand_and_remove(spark):
    stubs = [
        ("a", [0], '{"id":"0"}'), ("a", [1], link("http://x/1", id="p1", start="PT300S")), ("a", [2], '{"id":"2"}'),
        ("b", [0], link("http://x/many", start="s")), ("b", [1], '{"id":"z"}'), ("c", [0], link(RESOLVE_TO_ZERO)), ("c", [1], '{"id":"k"}'),
        ("d", [0], link("http://x/404")), ("d", [1], link("http://x/text")), ("d", [2], link("http://x/none")), ("d", [3], '{"id":"left"}'),
    ]
    remote = [("http://x/1", 200, '{"duration":"PT60S","AdaptationSet":[{"id":1}]}'), ("http://x/many", 200, '[{"id":"m1"},{"id":"m2"}]'), ("http://x/404", 404, "{}"), ("http://x/text", 200, "oops"), ("http://x/unused", 200, None), (None, 200, "{}")]
    got = run(spark, stubs, remote)
    assert got["a"] == [{"id": "0"}, {"id": "p1", "start": "PT300S", "duration": "PT60S", "AdaptationSet": [{"id": 1}]}, {"id": "2"}]
    assert got["b"] == [{"start": "s", "id": "m1"}, {"id": "m2"}, {"id": "z"}] and got["c"] == [{"id": "k"}] and got["d"] == [{"id": "left"}]


def test_chains_cycles_and_depth(spark):
    remote = [("http://x/a/1", 200, link("2", n=1)), ("http://x/a/2", 200, '{"id":"end"}'), ("http://c/1", 200, link("http://c/2")), ("http://c/2", 200, link("http://c/1"))]
    stubs = [("a", [0], link("http://x/a/1")), ("c", [0], link("http://c/1")), ("c", [1], '{"id":"k"}')]
    assert run(spark, stubs, remote) == {"a": [{"n": 1, "id": "end"}], "c": [{"id": "k"}]}
    assert run(spark, stubs, remote, depth=1) == {"c": [{"id": "k"}]}


def test_modes_and_empty(spark):
    lazy, eager = link("http://x/1", id="l"), json.dumps({"id": "e", "xlink": {"href": "http://x/1", "actuate": "onLoad"}})
    remote = [("http://x/1", 200, '{"start":"s"}')]
    got = run(spark, [("a", [0], lazy), ("a", [1], eager)], remote, mode="onLoad")["a"]
    assert got[0]["xlink"] == {"href": "http://x/1"} and got[1] == {"id": "e", "start": "s"}
    assert run(spark, [], remote) == {} and run(spark, [("a", [0], None), ("b", [0], "{}")], [])["b"] == [{}]


def test_manifests(spark):
    """Elements of the kinds that may be remote are taken out, resolved and put back; others, and bad texts, stay."""
    doc = {"Period": [{"xlink": {"href": "http://x/two"}}, {"id": "k", "EventStream": [{"xlink": {"href": "http://x/none"}}], "AdaptationSet": [{"id": 1, "SegmentList": {"xlink": {"href": "http://x/list"}}}]}], "BaseURL": [{"xlink": {"href": "http://x/two"}}]}
    rows = [("a", json.dumps(doc)), ("b", '{"Period":[{"id":"1"}]}'), ("c", "{bad"), ("d", None), ("e", json.dumps({"Period": [{"xlink": {"href": RESOLVE_TO_ZERO}}]}))]
    remote = [("http://x/two", 200, '[{"id":"1"},{"id":"2"}]'), ("http://x/list", 200, '{"duration":7}')]
    got = {r.doc_id: r.json for r in resolve_manifests(spark.createDataFrame(rows, "doc_id string, json string"), spark.createDataFrame(remote, REMOTE)).collect()}
    assert json.loads(got["a"]) == {"Period": [{"id": "1"}, {"id": "2"}, {"id": "k", "AdaptationSet": [{"id": 1, "SegmentList": {"duration": 7}}]}], "BaseURL": [{"xlink": {"href": "http://x/two"}}]}
    assert json.loads(got["b"]) == {"Period": [{"id": "1"}]} and got["c"] == "{bad" and got["d"] is None and json.loads(got["e"]) == {}


def test_plan_grows_by_one_join_a_level(spark):
    stubs, remote = spark.createDataFrame([("a", [0], "{}")], STUB), spark.createDataFrame([("h", 200, "{}")], REMOTE)
    joins = [resolve(stubs, remote, depth=d)._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") for d in (1, 3, 5)]
    assert joins == [1, 3, 5]
