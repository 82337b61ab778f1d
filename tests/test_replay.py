import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.functions.selectors import parse_selector
from sluice.operators.replay import ANY, NO_ID, Replay, commits, documents, in_order, lanes, delivery_instants, replay, touched_periods

OPS = "mpd_id string, patch_id long, instant long, op_idx int, op string, sel string, pos string, attr string, payload_name string, payload_json string, value string, ws string, received_at timestamp, kind string"
REP = "mpd_id string, period_id string, as_id int, as_ord int, ord int, rep_id string, bandwidth long, width int, height int, codecs string, kind string"
LEVELS = ("Period", "AdaptationSet", "Representation")


def simple_replay(state, docs):
    """A plain, independent replay of one manifest: whole copies, linear search."""
    for ops in docs:
        new = copy.deepcopy(state)
        try:
            for op in ops:
                m = re.fullmatch(r"/MPD((?:/[A-Za-z]+(?:\[[^\]]*\])?)*)(?:/@(\w+))?", op["sel"] or "")
                if not m:
                    raise LookupError
                node, parent, at, depth = new, None, 0, 0
                other = False
                for name, pred in re.findall(r"/([A-Za-z]+)(?:\[([^\]]*)\])?", m.group(1)):
                    if name not in LEVELS:
                        other = True
                        continue
                    kids = node["kids"]
                    if re.fullmatch(r"[1-9]\d*", pred):
                        at = int(pred) - 1
                    else:
                        q = re.fullmatch(r"@(\w+)=(['\"])(.*)\2", pred) if pred else None
                        if pred and not q:
                            raise LookupError
                        at = next((i for i, k in enumerate(kids) if not q or k["attrs"].get(q.group(1)) == q.group(3)), len(kids))
                    if at >= len(kids):
                        raise LookupError
                    parent, node, depth = node, kids[at], depth + 1
                attr = m.group(2) or (op["attr"] or "")[1:]
                if other or (depth == 0 and (attr or op["op"] != "add")):
                    continue
                if attr:
                    if op["op"] == "remove":
                        node["attrs"].pop(attr, None)
                    else:
                        node["attrs"][attr] = op["value"]
                elif op["op"] == "remove":
                    del parent["kids"][at]
                else:
                    beside = op["op"] == "replace" or op["pos"] in ("before", "after")
                    if op["payload_name"] != LEVELS[depth - 1 if beside else depth] if depth - beside < 3 else True:
                        continue
                    got = json.loads(op["payload_json"])
                    made = [tree(x, LEVELS.index(op["payload_name"])) for x in (got if isinstance(got, list) else [got])]
                    if op["op"] == "replace":
                        parent["kids"][at : at + 1] = made
                    elif beside:
                        i = at + (op["pos"] == "after")
                        parent["kids"][i:i] = made
                    elif op["pos"] == "prepend":
                        node["kids"][0:0] = made
                    else:
                        node["kids"] += made
            state = new
        except LookupError:
            pass
    return {(p["attrs"].get("id"), int(a["attrs"]["id"]), r["attrs"]["id"], int(r["attrs"]["bandwidth"])) for p in state["kids"] for a in p["kids"] for r in a["kids"]}


def tree(x, level):
    kids = x.get(LEVELS[level + 1], []) if level < 2 else []
    return {"attrs": {k: str(v) for k, v in x.items() if not isinstance(v, list)}, "kids": [tree(k, level + 1) for k in kids]}


@pytest.mark.parametrize(("by_place", "split"), [(True, True), (False, True), (False, False)])
def test_random_feed(spark, by_place, split, monkeypatch):
    """With Periods selected by place a manifest is one lane; by id alone its Periods are replayed apart."""
    import sluice.operators.replay as module

    monkeypatch.setattr(module, "HOT", 64 if split else 1)
    rng = random.Random(5)
    ops, reps, want = [], [], {}
    patch = 0
    for m in ("m1", "m2", "m3"):
        start = {"attrs": {}, "kids": []}
        for p in ("p1", "p2"):
            period = {"attrs": {"id": p}, "kids": []}
            for a in (1, 2):
                aset = {"attrs": {"id": str(a)}, "kids": []}
                for r in (1, 2):
                    aset["kids"].append({"attrs": {"id": f"r{r}", "bandwidth": str(100 * r)}, "kids": []})
                    reps += [(m, p, a, a, r, f"r{r}", 100 * r, None, None, None, "own")] * rng.choice([1, 2])
                period["kids"].append(aset)
            start["kids"].append(period)
        docs = []
        for i in range(120):
            doc = []
            for k in range(rng.choice([1, 2, 3])):
                period = rng.choice(["/Period[@id='p1']", '/Period[@id="p2"]', "/Period[@id='new']"] + ["/Period[1]", "/Period[2]"] * by_place)
                aset = rng.choice(["/AdaptationSet[@id='1']", "/AdaptationSet[2]", "/AdaptationSet[1]", "/AdaptationSet[@id='9']" if rng.random() < 0.2 else "/AdaptationSet[1]"])
                rep = rng.choice(["/Representation[1]", "/Representation[2]", "/Representation[@id='r1']", "/Representation[@bandwidth='100']", f"/Representation[@id='n{rng.randrange(40)}']"])
                new = lambda: {"id": f"n{rng.randrange(40)}", "bandwidth": rng.randrange(1000)}
                kind = rng.choice(["add", "add", "beside", "remove", "replace", "bandwidth", "s", "bad", "period", "rank"])
                o = {"op": "add", "sel": f"/MPD{period}{aset}", "pos": None, "attr": None, "payload_name": "Representation", "payload_json": json.dumps(rng.choice([new(), [new(), new()]])), "value": None}
                if kind == "add":
                    o["pos"] = rng.choice([None, "prepend"])
                elif kind == "beside":
                    o |= {"pos": rng.choice(["before", "after"]), "sel": o["sel"] + rep}
                elif kind == "remove":
                    o |= {"op": "remove", "sel": o["sel"] + rep, "payload_name": None, "payload_json": None}
                elif kind == "replace":
                    o |= {"op": "replace", "sel": o["sel"] + rep, "payload_json": json.dumps(new())}
                elif kind == "bandwidth":
                    o |= {"op": "replace", "sel": o["sel"] + rep + "/@bandwidth", "payload_name": None, "payload_json": None, "value": str(rng.randrange(1000))}
                elif kind == "s":
                    o |= {"sel": o["sel"] + "/SegmentTemplate/SegmentTimeline", "payload_name": "S", "payload_json": '{"t":1}'}
                elif kind == "bad" and rng.random() < 0.3:
                    o |= {"sel": rng.choice(["/MPDx/Period[1]", "/MPD/*", "/MPD/Period[0]", "/MPD/Period[1]/text()", "Period", "/MPD/Period[@id='1' and @x='2']", None])}
                elif kind == "period" and rng.random() < 0.3:
                    o |= {"sel": "/MPD", "payload_name": "Period", "pos": rng.choice([None, "prepend"]), "payload_json": json.dumps({"id": rng.choice(["new", "p1"]), "AdaptationSet": [{"id": 1, "Representation": [new()]}]})}
                elif kind == "rank":
                    o |= {"sel": o["sel"] + rep, "attr": "@qualityRanking", "payload_name": None, "payload_json": None, "value": "3"}
                doc.append(o)
            docs.append(doc)
            for _ in range(rng.choice([1, 1, 2])):  # repeated deliveries
                patch += 1
                for k, o in enumerate(doc):
                    ops += [(m, patch, 1000 * i, k, o["op"], o["sel"], o["pos"], o["attr"], o["payload_name"], o["payload_json"], o["value"], None, None, "own")] * rng.choice([1, 1, 2])
        want[m] = simple_replay(start, docs)
    ops.append(("m1", 9999, None, 0, "remove", "/MPD/Period[1]", None, None, None, None, None, None, None, "own"))
    rng.shuffle(ops)
    rng.shuffle(reps)
    got = replay(spark.createDataFrame(reps, REP), spark.createDataFrame(ops, OPS)).collect()
    for m, rows in want.items():
        assert {(r.period_id, r.as_id, r.rep_id, r.bandwidth) for r in got if r.mpd_id == m} == rows


def op(m, instant, idx, sel, **kw):
    base = {"op": "replace", "pos": None, "attr": None, "payload_name": None, "payload_json": None, "value": None}
    base |= kw
    return (m, instant, instant, idx, base["op"], sel, base["pos"], base["attr"], base["payload_name"], base["payload_json"], base["value"], None, None, "")


def test_watermark_and_gaps(spark):
    reps = spark.createDataFrame([("m", "p", 1, 1, 1, "r", 1, None, None, None, "")], REP)
    sel = "/MPD/Period[1]/AdaptationSet[1]/Representation[1]/@bandwidth"
    ops = spark.createDataFrame([op("m", 10, 0, sel, value="10"), op("m", 20, 1, sel, value="20"), op("m", 30, 0, sel, value="30")], OPS)
    last = lambda **kw: [r.bandwidth for r in replay(reps, ops, **kw).collect()]
    assert last() == [30] and last(watermark=20) == [20] and last(watermark=15) == [10] and last(hold_gaps=True) == [10]


def test_gaps_by_predecessor(spark):
    """A document whose predecessor is missing, and all after it, wait; a first document has none."""
    rows = [("a", 10, 5, [0]), ("a", 20, 10, [1, 0]), ("a", 20, None, [1]), ("a", 40, 30, [0]), ("a", 50, 40, [0]), ("b", 10, None, [0]), ("b", 20, None, [0, 2]), ("c", 10, 1, [0]), ("c", 20, None, [0]), ("c", 30, 20, [0]), (None, 1, None, [0]), (None, 3, 2, [0]), ("d", None, 1, [0]), ("e", 1, None, None)]
    got = commits(documents(spark.createDataFrame(rows, "mpd_id string, instant long, before long, numbers array<int>"))).collect()
    assert {r.mpd_id: (r.documents, r.committed, r.held, r.watermark, r.gap) for r in got} == {"a": (4, 2, 2, 20, 40), "b": (2, 1, 1, 10, 20), "c": (3, 3, 0, 30, None), None: (2, 1, 1, 1, 3), "e": (1, 0, 1, None, 1)}


def test_holes_are_numbers():
    """An AdaptationSet at a far place costs nothing; places within the hole can be used, and are undone."""
    state = Replay()
    state.load("p", 1, 1, "r", 5, None, None, None)
    state.load("p", 9, 2_000_000_000, "s", 6, None, None, None)
    add = lambda i, place: (i, None, 1, "add", f"/MPD/Period[1]/AdaptationSet[{place}]", None, None, "Representation", f'{{"id":"n{i}","bandwidth":{place}}}', None)
    assert state.document([add(0, 1_000_000)]) and not state.document([add(1, 7), add(2, 2_000_000_001)]) and state.document([add(3, 2_000_000_000), add(4, 2)])
    assert list(state.rows()) == [("p", 1, "r", 5), ("p", None, "n4", 2), ("p", None, "n0", 1_000_000), ("p", 9, "s", 6), ("p", 9, "n3", 2_000_000_000)]
    assert len(state.root.children[0].children) < 10
    assert [o[1] for o in in_order([(1, 5, 1), (0, None, 2), (1, 4, 3), (0, 1, 1)])] == [None, 4]


def test_edges(spark):
    reps = spark.createDataFrame([("m", "p", 1, 2, 1, "r", 1, None, None, None, ""), (None, None, None, None, None, None, None, None, None, None, None)], REP)
    rep = "/MPD/Period[1]/AdaptationSet[2]/Representation[1]"
    ops = [op("m", 1, 0, rep, op=None), op("m", 2, 0, rep, payload_name="Representation", payload_json="{bad"), op("m", 3, 0, rep + "/@bandwidth", value="x" * 10_000), op("m", 4, 0, rep + "/@bandwidth", value="7"), op("z", 1, 0, "/MPD", op="add", payload_name="Period", payload_json='{"id":"q","AdaptationSet":{"id":4,"Representation":{"id":"k"}}}')]
    got = sorted((str(r.mpd_id), r.period_id, r.as_id, r.rep_id, r.bandwidth) for r in replay(reps, spark.createDataFrame(ops, OPS)).collect())
    assert got == [("None", None, None, None, None), ("m", "p", 1, "r", 7), ("z", "q", 4, "k", None)]
    assert replay(spark.createDataFrame([], REP), spark.createDataFrame([], OPS)).count() == 0


def test_instants_of_deliveries(spark):
    """Only deliveries whose time is one instant are there, and operations meet them by their keys, null keys included."""
    ops = [("m", 1, 1, "2025-10-26 02:30:00"), ("m", 2, 1, "2025-10-26 04:30:00"), ("m", 3, None, "x"), ("m", 4, 1, None), (None, None, None, "2025-10-26T03:30:00Z")]
    frame = spark.createDataFrame([(*o, None) for o in ops], "mpd_id string, patch_id long, packager_id int, publish_time string, received_at timestamp")
    dim = spark.createDataFrame([(1, "Europe/Berlin", "dmy")], "packager_id int, tz string, date_order string")
    instants = delivery_instants(frame, dim, "publish_time").withColumnRenamed("text", "publish_time").drop("field")
    assert sorted((str(r.mpd_id), r.patch_id, r.instant) for r in instants.collect()) == [("None", None, 1761449400000000), ("m", 2, 1761449400000000)]
    rep = "/MPD/Period[1]/AdaptationSet[1]/Representation[1]/@bandwidth"
    rows = [(m, p, w, t, *op(m, 0, 0, rep, value=str(100 + i))[3:]) for i, (m, p, w, t) in enumerate(ops)]
    feed = spark.createDataFrame(rows, OPS.replace("instant long", "packager_id int, publish_time string"))
    reps = spark.createDataFrame([(m, "p", 1, 1, 1, "r", 1, None, None, None, "") for m in ("m", None)], REP)
    got = {r.mpd_id: r.bandwidth for r in replay(reps, feed, instants=instants, keys=("packager_id", "publish_time")).collect()}
    assert got == {"m": 101, None: 104}


def test_selectors():
    good = ["/MPD", "/MPD/@a", "/MPD/Period", "/MPD/Period[3]/@id", "/MPD/Period[@id='a/b]c']/X", '/MPD/a:B[ @c-d = "e" ]']
    bad = ["", None, "MPD", "/MPDx", "/mpd", "//MPD", "/MPD/", "/MPD/*", "/MPD/..", "/MPD/text()", "/MPD/P[0]", "/MPD/P[1][2]", "/MPD/P[@a='1' or @b='2']", "/MPD/@a/b", "/MPD/P[last()]", "/MPD/P[@a]", "/@a", "/MPD/P[-1]"]
    assert all(parse_selector(s) for s in good) and not any(parse_selector(s) for s in bad)


def test_touched_periods(spark):
    cases = [
        ("/MPD/Period[@id='a']/AdaptationSet[1]", None, None, None, ["a"]), ('/MPD/Period[ @id = "b" ]', None, None, None, ["b"]), ("/MPD/Period[@id='a']", None, "Period", '{"id":"n"}', ["a", "n"]),
        ("/MPD/Period[@id='a']", None, "Period", '[{"id":"n"},{}]', ["a", "n", NO_ID]), ("/MPD", None, "Period", '{"id":7}', ["7"]), ("/MPD", None, "Period", "{}", [NO_ID]), ("/MPD", "@id", None, None, []), ("/MPD/@id", None, None, None, []),
        ("/MPD/Period[1]", None, None, None, [ANY]), ("/MPD/Period", None, None, None, [ANY]), ("/MPD/Period[@start='1']/X", None, None, None, [ANY]), ("/MPD/PeriodX[1]", None, None, None, []), ("/MPDx/Period[1]", None, None, None, []), (None, None, None, None, []),
        ("/MPD/Period[@id='a']/@id", None, None, None, [ANY, "a"]), ("/MPD/Period[@id='a']", "@id", None, None, [ANY, "a"]), ("/MPD/Period[@id='a']/@start", None, None, None, ["a"]),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, sel string, attr string, name string, payload string")
    got = {r.i: sorted(r.k) for r in df.select("i", touched_periods(F.col("sel"), F.col("attr"), F.col("name"), F.col("payload")).alias("k")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == sorted(c[4]), c


def test_lanes(spark):
    sel = lambda p: f"/MPD/Period[@id='{p}']/AdaptationSet[1]"
    ops = [op("m", 1, 0, sel("a")), op("m", 1, 1, sel("b")), op("m", 2, 0, sel("c")), op("m", 3, 0, sel("b")), op("m", 3, 1, sel("d")), op("n", 1, 0, sel("x")), op("n", 2, 0, "/MPD/Period[1]"), op("n", 3, 0, "/MPD/@publishTime")]
    reps = spark.createDataFrame([("m", "e", 1, 1, 1, "r", 1, None, None, None, ""), ("n", "y", 1, 1, 1, "r", 1, None, None, None, "")], REP)
    found, docs = lanes(reps, spark.createDataFrame(ops, OPS))
    by = {(r.mpd_id, r.key): r.lane for r in found.collect()}
    assert by["m", "a"] == by["m", "b"] == by["m", "d"] and len({by["m", k] for k in "ace"}) == 3 and by["n", "x"] == by["n", "y"] == ""
    assert docs.count() == 5


def test_split_reads_operations_as_the_replay_does(spark, monkeypatch):
    """Null payload names, attributes without @, members that come twice and numbers as written: the lanes change nothing."""
    import sluice.operators.replay as module

    rep = lambda r: f'"AdaptationSet":{{"id":1,"Representation":{{"id":"{r}","bandwidth":1}}}}'
    inside = lambda p, r: f"/MPD/Period[@id='{p}']/AdaptationSet[1]/Representation[@id='{r}']/@bandwidth"
    feeds = {
        "null name": [op("m", 1, 0, "/MPD", op="add", payload_json=f'{{"id":"q",{rep("k")}}}'), op("m", 2, 0, inside("q", "k"), value="5")],
        "null name replaces": [op("m", 1, 0, "/MPD/Period[@id='a']", payload_json=f'{{"id":"q",{rep("k")}}}'), op("m", 2, 0, inside("q", "k"), value="5")],
        "attr": [op("m", 1, 0, "/MPD/Period[@id='a']", attr="id", value="q"), op("m", 2, 0, inside("q", "ra"), value="5")],
        "twice": [op("m", 1, 0, "/MPD", op="add", payload_name="Period", payload_json=f'{{"id":"b","id":"q",{rep("k")}}}'), op("m", 2, 0, inside("q", "k"), value="5")],
        "number": [op("m", 1, 0, "/MPD", op="add", payload_name="Period", payload_json=f'[{{"id":1e3,{rep("k")}}}]'), op("m", 2, 0, inside("1e3", "k"), value="5")],
    }
    ops = [(m, *o[1:]) for m, os in feeds.items() for o in os]
    reps = [(m, p, 1, 1, 1, f"r{p}", 1, None, None, None, "") for m in feeds for p in "ab"]
    reps, ops = spark.createDataFrame(reps, REP), spark.createDataFrame(ops, OPS)

    def rows(hot):
        monkeypatch.setattr(module, "HOT", hot)
        return {m: sorted((r.period_id, r.rep_id, r.bandwidth) for r in got if r.mpd_id == m) for got in [replay(reps, ops).collect()] for m in feeds}

    whole = rows(1)
    assert whole["null name"] == [("a", "ra", 1), ("b", "rb", 1), ("q", "k", 5)] and whole["attr"] == [("b", "rb", 1), ("q", "ra", 5)] and whole["number"][0] == ("1e3", "k", 5)
    assert rows(64) == whole
