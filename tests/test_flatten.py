import json

import pytest

from sluice.functions.jsontext import Raw, _deep, loads
from sluice.operators.flatten import flatten, typed, visit, write_tables


def test_visit():
    doc = loads(
        '{"$ns":{"urn:a":"a","urn:b":{"prefix":"b","attributes":["x"]},"urn:c":{}},"ProgramInformation":[{"Title":{"$value":"T"}},null,{"Title":null},{}],'
        '"x":[{"$value":1.50},[{"$value":true}],{"y":{"$value":null,"$ns":{"u":{"$value":1}}}}],"$value":"root"}'
    )
    rows = list(visit(doc))
    assert [r for r in rows if r[0] == "program"] == [("program", "ProgramInformation[0]", "", "T"), ("program", "ProgramInformation[2]", "", ""), ("program", "ProgramInformation[3]", "", "")]
    assert [r for r in rows if r[0] == "ns"] == [("ns", "urn:a", "", "a"), ("ns", "urn:b", "", "b"), ("ns", "urn:c", "", "")]
    assert sorted(r for r in rows if r[0] == "value") == [
        ("value", "", "", "root"), ("value", "ProgramInformation[0].Title", "ProgramInformation[0]", "T"), ("value", "x[0]", "", "1.50"), ("value", "x[1][0]", "", "true"), ("value", "x[2].y", "x[2]", ""),
    ]
    assert list(visit(loads('{"ProgramInformation":{"Title":5}}')))[0] == ("program", "ProgramInformation", "", "5")


def test_documents(spark, tmp_path):
    deep = '{"a":' * 30_000 + '{"$value":1}' + "}" * 30_000
    rows = [("d1", '{"b":{"$value":"v"}}', "own"), ("d1", '{"b":{"$value":"v"}}', "own"), ("d2", None, "x"), ("d3", "", "x"), ("d4", "[1]", "x"), ("d5", "{", "x"), (None, '{"$value":"\\ud800é"}', "x"), ("d6", deep, "x"), ("d7", '{"$value":"' + "x" * 300_000 + '"}', "x")]
    df = spark.createDataFrame(rows, "doc_id string, mpd string, tag string")
    got = flatten(df, tags=("value", "reject")).distinct().collect()
    values = {r.doc_id: r for r in got if r.tag == "value"}
    assert {r.doc_id for r in got if r.tag == "reject"} == {"d3", "d4", "d5"}
    assert set(values) == {"d1", None, "d6", "d7"} and values["d1"].parent_path == "" and values["d1"].path == "b"
    assert values[None].value == "�é" and values["d6"].path.count("a") == 30_000 and len(values["d7"].value) == 300_000
    write_tables(flatten(df.where("doc_id = 'd1'")), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert typed(back, "value").columns == ["doc_id", "path", "value", "parent_path"] and typed(back, "object").count() == 4
    assert flatten(spark.createDataFrame([], "doc_id string, mpd string")).count() == 0


@pytest.mark.parametrize("text", ['{"a":[1,{"b":null}],"c":"x\\"y"}', "[]", "3", '"s"', "[true,false,null]", '{"a":{}}', "[[[]]]"])
def test_stack_reader_agrees(text):
    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else json.loads(v) if isinstance(v, Raw) else v
    assert plain(_deep(text)) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "1 2", "]", '{"a":1]', "[,1]", '{1:2}', "nul"])
def test_stack_reader_refuses(text):
    with pytest.raises(ValueError):
        _deep(text)


def test_registered_query_writes_and_reads_typed_tables(spark, tmp_path):
    import __spark_entry__ as entry

    docs = [("d", '{"ProgramInformation":{"Title":"t"},"$ns":{"urn:x":"x"},"b":{"$value":1}}')] * 2 + [("bad", "{")]
    spark.createDataFrame(docs, "doc_id string, mpd string").write.parquet(str(tmp_path / "mpd_json.parquet"))
    got = entry.queries()["p4_tables"](spark, str(tmp_path)).collect()
    by = {t: [r for r in got if r.table == t] for t in ("program", "ns", "value", "object", "reject")}
    assert [(r.path, r.title) for r in by["program"]] == [("ProgramInformation", "t")] and [(r.path, r.value, r.parent_path) for r in by["value"]] == [("b", "1", "")]
    assert [(len(by[t])) for t in ("ns", "reject")] == [1, 1] and by["ns"][0].prefix == "x" and by["ns"][0].uri == "urn:x" and by["reject"][0].doc_id == "bad" and by["object"]
    spark.createDataFrame([], "doc_id string, mpd string").write.parquet(str(tmp_path / "e" / "mpd_json.parquet"))
    assert entry.queries()["p4_tables"](spark, str(tmp_path / "e")).count() == 0
