import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.functions.xmltree import BadXml
from sluice.operators.convert import Rejected, dumps, json_to_xml, read_json, to_json, to_xml, xml_to_json
from sluice.operators.nodes import fingerprint, nodes
from sluice.operators.roundtrip import failures, report, validate_roundtrip

NS = 'xmlns="urn:mpeg:dash:schema:mpd:2011"'


def mpd(inner="", attrs=""):
    return f'<MPD {NS} profiles="p" minBufferTime="PT2S" {attrs}>{inner}</MPD>'


def body(inner="", attrs=""):
    return xml_to_json(mpd(inner, attrs))[0]


def test_types_by_place():
    d = body('<Period id="1"><AdaptationSet id="1" audioSamplingRate=" 1  2 " segmentAlignment="0"><Representation id="7" bandwidth="5" maxPlayoutRate="INF"/></AdaptationSet></Period>')
    a = d["Period"][0]["AdaptationSet"][0]
    assert d["Period"][0]["id"] == "1" and a["id"] == 1 and a["audioSamplingRate"] == [1, 2] and a["segmentAlignment"] is False
    assert a["Representation"] == [{"id": "7", "bandwidth": 5, "maxPlayoutRate": "INF"}]


def test_shapes():
    d = body('<BaseURL/><BaseURL serviceLocation="x"> u </BaseURL><Location>l</Location><ProgramInformation><Title>t</Title></ProgramInformation><Period/>')
    assert d["BaseURL"] == [{"$value": ""}, {"serviceLocation": "x", "$value": "u"}] and d["Location"] == ["l"] and d["Period"] == [{}]
    assert d["ProgramInformation"] == [{"Title": "t"}]
    d, errors = xml_to_json(mpd('<Period bitstreamSwitching="yes"/>'))
    assert d["Period"][0]["bitstreamSwitching"] == "yes" and errors[0]["path"] == "MPD/Period/@bitstreamSwitching"


def test_namespaces():
    d = body('<Period x:a="1"><x:B c="2"><x:D>t</x:D><x:D>u</x:D><y:E xmlns:y="urn:y"/></x:B></Period>', 'xmlns:x="urn:x" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="q"')
    assert d["$ns"] == {"urn:x": {"prefix": "x", "attributes": ["a", "c"]}, "urn:y": "y"}
    assert d["Period"][0]["x"] == {"a": "1", "B": {"c": "2", "D": ["t", "u"], "y": {"E": ""}}}
    d = body('<Period xlink:href="h" xlink:type="simple" xlink:show="embed"/>', 'xmlns:xlink="http://www.w3.org/1999/xlink"')
    assert d["$ns"] == {"http://www.w3.org/1999/xlink": "xlink"} and d["Period"][0]["xlink"] == {"href": "h"}
    assert 'xlink:href="h" xlink:type="simple" xlink:show="embed"' in json_to_xml(d)[0]
    d = body('<UTCTiming schemeIdUri="u"><pro xmlns="urn:p">b</pro></UTCTiming>')
    assert d["$ns"] == {"urn:p": {"prefix": "pro", "defaultNs": True}} and d["UTCTiming"][0]["pro"] == {"$value": "b"}
    assert '<pro xmlns="urn:p">b</pro>' in json_to_xml(d)[0]
    assert body('<Period xmlns:x="urn:x"/><Period xmlns:x="urn:x"/>')["$ns"] == {"urn:x": "x"}
    assert xml_to_json(f'<MPD {NS} xmlns:d="urn:mpeg:dash:schema:mpd:2011"><d:Period d:id="1"/></MPD>')[0] == {"Period": [{"id": "1"}]}


@pytest.mark.parametrize(
    "xml",
    [
        mpd('<Period xmlns:x="urn:b"/>', 'xmlns:x="urn:a"'),
        mpd('<Period xmlns:y="urn:a"/>', 'xmlns:x="urn:a"'),
        mpd('<Period:x/>', 'xmlns:Period="urn:a"'),
        mpd('<Period><AdaptationSet xmlns="urn:q"/></Period>'),
        mpd('<a xmlns="urn:q"/><b xmlns="urn:q"/>'),
        f'<m:MPD xmlns:m="urn:mpeg:dash:schema:mpd:2011"/>',  # noqa: F541
        "<Other/>",
    ],
)
def test_rejected(xml):
    with pytest.raises(Rejected):
        xml_to_json(xml)


@pytest.mark.parametrize("xml", ["", "<MPD>", "<MPD><Period></MPD>", '<!DOCTYPE MPD [<!ENTITY a "b">]><MPD>&a;</MPD>', "<x:MPD/>", "text", "<MPD/><MPD/>"])
def test_bad_xml(xml):
    with pytest.raises(BadXml):
        xml_to_json(xml)


def test_writer():
    with pytest.raises(Rejected):
        json_to_xml({"$ns": {"urn:a": "x", "urn:b": {"prefix": "x"}}})
    xml, warnings = json_to_xml({"$ns": {"urn:a": {"prefix": "x", "attributes": ["k"]}}, "Period": [{"$ns": {"u": "v"}, "x": {"k": "1", "e": "2", "f": [{"k": "3", "$value": "t"}]}}], "id": "a\"<&>'"})
    assert len(warnings) == 1 and "<x:e>2</x:e>" in xml and '<x:f k="3">t</x:f>' in xml and 'x:k="1"' in xml
    assert xml_to_json(xml)[0]["id"] == "a\"<&>'"
    assert json_to_xml({}, declaration=False, indent=None)[0] == f"<MPD {NS}/>"


NAME = st.sampled_from(["id", "Foo", "bar"])
TEXT = st.text(alphabet="ab<>&\"' é日", max_size=5).map(str.strip)


@given(st.lists(st.fixed_dictionaries({"id": TEXT, "AdaptationSet": st.lists(st.fixed_dictionaries({"id": st.integers(0, 2**32 - 1), "segmentAlignment": st.booleans(), "Label": st.lists(st.fixed_dictionaries({"$value": TEXT}), min_size=1, max_size=2), "Representation": st.lists(st.fixed_dictionaries({"id": TEXT, "bandwidth": st.integers(0, 9)}), min_size=1, max_size=3)}), min_size=1, max_size=3)}), min_size=1, max_size=3), TEXT)
@settings(max_examples=60, deadline=None)
def test_json_comes_back(periods, title):
    doc = {"profiles": "p", "minBufferTime": "PT1S", "ProgramInformation": [{"Title": title}], "Period": periods}
    xml, _ = json_to_xml(doc)
    assert xml_to_json(xml) == (doc, [])


def test_rows(spark):
    good = mpd('<Period id="1"/>')
    df = spark.createDataFrame([("a", good, "own"), ("b", "<MPD", "own"), ("c", None, "own"), ("d", mpd("<Period/>" * 5000), "own"), (None, good, "own")], "doc_id string, xml string, error string")
    rows = {r.doc_id: r for r in to_json(df).collect()}
    assert json.loads(rows["a"].json)["Period"] == [{"id": "1"}] and rows["a"].error is None and rows["b"].json is None and rows["b"].error and rows["c"].error == "no text"
    back = {r.doc_id: r for r in to_xml(spark.createDataFrame([("a", rows["a"].json), ("b", "[1]"), ("c", None), ("d", "{")], "doc_id string, json string")).collect()}
    assert xml_to_json(back["a"].xml)[0] == json.loads(rows["a"].json) and back["b"].error and back["c"].error and back["d"].error
    assert to_json(df.limit(0)).count() == 0
    big = read_json('{"t":18446744073709551615,"x":0.5,"e":1e2}')
    assert big == {"t": 2**64 - 1, "x": 0.5, "e": 100.0} and dumps({"a": "é"}) == '{"a":"é"}'


def test_fingerprints(spark):
    pairs = [
        ('<a x="1" y="2"><b> q  r </b><c/></a>', "<a y='2' x='1'><!-- n --><b>q r</b>\n<c></c></a>", True),
        ('<a width="0640"/>', '<a width="640.0"/>', True),
        ('<a segmentAlignment="1"/>', '<a segmentAlignment="true"/>', True),
        ("<a><b/><c/></a>", "<a><c/><b/></a>", True),
        ("<a><b>1</b><b>2</b></a>", "<a><b>2</b><b>1</b></a>", False),
        ('<a width="1"/>', '<a width="2"/>', False),
        ("<a><b/></a>", "<a/>", False),
        ('<a xmlns="u"/>', '<a xmlns="v"/>', False),
        ('<a t="9223372036854775807"/>', '<a t="9223372036854775806"/>', False),
        ('<a t="18446744073709551615"/>', '<a t="018446744073709551615.0"/>', True),
        ('<a maxPlayoutRate="0.1234567890123"/>', '<a maxPlayoutRate="0.1234567890124"/>', False),
        ('<a maxPlayoutRate="-0.0"/>', '<a maxPlayoutRate="0"/>', True),
        ('<a maxPlayoutRate=".5"/>', '<a maxPlayoutRate="0.50"/>', True),
        ('<a maxPlayoutRate="1e1"/>', '<a maxPlayoutRate="10"/>', True),
        ('<a width="+7px"/>', '<a width="7"/>', True),
        ('<a width=""/>', '<a width="0"/>', False),
    ]
    df = spark.createDataFrame([(f"{i}{s}", p[k]) for i, p in enumerate(pairs) for k, s in enumerate("lr")], "doc_id string, xml string")
    got = {r.doc_id: r.hash for r in fingerprint(nodes(df)).collect()}
    for i, p in enumerate(pairs):
        assert (got[f"{i}l"] == got[f"{i}r"]) == p[2], p


def test_round_trips_and_report(spark):
    rows = [("a", "x", mpd('<BaseURL serviceLocation="s">u</BaseURL><Period xlink:href="h"><e:x e:k="1"><e:y/></e:x></Period>', 'xmlns:e="urn:e" xmlns:xlink="http://www.w3.org/1999/xlink"')), ("b", "x", "<bad"), ("c", "y", mpd()), ("d", None, mpd('<Period><AdaptationSet id="01" segmentAlignment="1"/></Period>'))]
    got = validate_roundtrip(spark.createDataFrame(rows, "doc_id string, category string, xml string"))
    ok = {r.doc_id: (r.success, r.error) for r in got.select("doc_id", "success", "error").collect()}
    assert ok["a"] == (True, None) and ok["c"] == (True, None) and not ok["b"][0] and ok["b"][1]
    from pyspark.sql import functions as F

    rep = {r.category: (r.total, r.passed, r.failed) for r in report(got.withColumn("ms", F.lit(1))).collect()}
    assert rep["(all)"][0] == 4 and rep["x"] == (2, 1, 1) and failures(got).count() == rep["(all)"][2]


def test_texts_that_share_an_id_are_judged_apart(spark):
    rows = [("a", "x", mpd('<Period id="1"/>')), ("a", "x", mpd('<Period id="2"/>')), ("a", "x", "<bad"), (None, "x", mpd()), ("b", "x", None)]
    got = validate_roundtrip(spark.createDataFrame(rows, "doc_id string, category string, xml string")).collect()
    assert sorted((str(r.doc_id), r.success) for r in got) == [("None", True), ("a", False), ("a", True), ("a", True), ("b", False)]
    assert all(r.ms_to_json >= 0 and r.ms_to_xml >= 0 for r in got)


def test_elements_beyond_the_usual_tree():
    doc, errors = xml_to_json(mpd('<Period><Preselection preselectionComponents="1 2"/><EmptyAdaptationSet id="4"/><Strange bandwidth="5"/><Subset contains="1 2"/></Period><Metrics metrics="m"><Reporting schemeIdUri="u"/></Metrics>'))
    period = doc["Period"][0]
    assert period["Preselection"] == [{"preselectionComponents": ["1", "2"]}] and period["EmptyAdaptationSet"] == [{"id": 4}] and period["Subset"] == [{"contains": [1, 2]}]
    assert doc["Metrics"][0]["Reporting"] == [{"schemeIdUri": "u"}] and [e["path"] for e in errors] == ["MPD/Period/Strange"]
    assert xml_to_json(json_to_xml(doc)[0])[0] == doc
