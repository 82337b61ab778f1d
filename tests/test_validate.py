import json

from sluice.__main__ import main
from sluice.operators.convert import model
from sluice.operators.nodes import json_path
from sluice.operators.validate import check_document, validate
from pyspark.sql import functions as F


def paths(doc):
    return [(e["path"], e["msg"].split(" ")[0]) for e in check_document(doc, model())]


def test_documents():
    good = {"profiles": "p", "minBufferTime": "PT1S", "BaseURL": [{"$value": "u"}], "Period": [{"id": "1", "AdaptationSet": [{"id": 1, "audioSamplingRate": [48000], "Representation": [{"id": "a", "bandwidth": 1, "maxPlayoutRate": "INF"}]}]}]}
    assert paths(good) == []
    bad = json.loads(json.dumps(good))
    bad |= {"minBufferTime": "1s", "type": "other", "BaseURL": [{}], "$ns": {"u": "x", "v": {"prefix": "x"}, "w": {}}}
    a = bad["Period"][0]["AdaptationSet"][0]
    a |= {"id": "1", "audioSamplingRate": [-1], "startWithSAP": 7, "sar": "x", "Representation": [{"bandwidth": 2**32}], "segmentAlignment": 1, "Role": {}}
    del bad["profiles"]
    assert paths(bad) == [
        ("/$ns", "prefix"), ("/$ns", "w"), ("/@minBufferTime", "not"), ("/@profiles", "required"), ("/@type", "not"), ("/BaseURL[1]", "$value"),
        ("/Period[1]/AdaptationSet[1]/@audioSamplingRate", "an"), ("/Period[1]/AdaptationSet[1]/@id", "not"), ("/Period[1]/AdaptationSet[1]/@sar", "does"), ("/Period[1]/AdaptationSet[1]/@segmentAlignment", "not"),
        ("/Period[1]/AdaptationSet[1]/@startWithSAP", "7"), ("/Period[1]/AdaptationSet[1]/Representation[1]/@bandwidth", "4294967296"), ("/Period[1]/AdaptationSet[1]/Representation[1]/@id", "required"), ("/Period[1]/AdaptationSet[1]/Role", "not"),
    ]
    assert paths([]) == [("", "not")] and ("/Period", "required") in paths({})


def test_rows(spark):
    df = spark.createDataFrame([("a", '{"profiles":"p","minBufferTime":"PT1S","Period":[{}]}'), ("b", "{"), ("c", None)], "doc_id string, json string")
    assert {r.doc_id: len(r.errors) for r in validate(df).collect()} == {"a": 0, "b": 1, "c": 1}


def test_paths(spark):
    df = spark.createDataFrame([("/MPD[1]/Period[2]/SegmentTemplate[1]/@media",), ("/MPD[1]",), ("/MPD[1]/BaseURL[1]/text()",)], "p string")
    assert [r.j for r in df.select(json_path(F.col("p"), ("SegmentTemplate",)).alias("j")).collect()] == ["Period[1].SegmentTemplate.media", "", "BaseURL[0].$value"]


def test_command_line(tmp_path, capsys):
    ns = "urn:mpeg:dash:schema:mpd:2011"
    (tmp_path / "a.mpd").write_text(f'<MPD xmlns="{ns}" id="x"><Period id="1"/></MPD>')
    (tmp_path / "p.mpp").write_text('<Patch mpdId="x" publishTime="2" originalPublishTime="1"><replace sel="/MPD/@id">y</replace></Patch>')
    assert main(["apply", str(tmp_path / "a.mpd"), "--patch", str(tmp_path / "p.mpp"), "--minified"]) == 0
    assert json.loads(capsys.readouterr().out)["id"] == "y"
    assert main(["patch2json", str(tmp_path / "p.mpp")]) == 0 and json.loads(capsys.readouterr().out)["mpdId"] == "x"
    (tmp_path / "s.xsd").write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="MPD"><xs:complexType><xs:attribute name="a" type="xs:int"/></xs:complexType></xs:element></xs:schema>')
    assert main(["xsd2jsonschema", str(tmp_path / "s.xsd")]) == 0 and "x-xml-attribute" in capsys.readouterr().out
