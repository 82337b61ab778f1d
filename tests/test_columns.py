import math

from pyspark.sql import functions as F

from sluice.functions import columns as C
from sluice.operators.convert import model
from sluice.operators.nodes import child_order, line_differences, namespace_registry, namespace_violations, nodes
from sluice.operators.relations import adaptation_sets, base_urls, descriptors, faults, representations, segments, typed


def values(spark, f, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_coercions(spark):
    assert values(spark, C.to_boolean, ["true", " 1 ", "false", "0", "yes", "t", "TRUE", "", None]) == [True, True, False, False] + [None] * 5
    assert [None if v is None else int(v) for v in values(spark, C.to_integer, ["1", "-5", "+7", "1.0", "12abc", "18446744073709551615", "", "9" * 30, None])] == [1, -5, 7, None, None, 2**64 - 1, None, None, None]
    got = values(spark, C.to_number, ["1.5", "1e3", ".5", "5.", "INF", "-INF", "NaN", "abc", "1,5", "", None])
    assert got[:6] == [1.5, 1000.0, 0.5, 5.0, math.inf, -math.inf] and math.isnan(got[6]) and got[7:] == [None] * 4
    assert values(spark, C.to_uint_vector, [" 1  2\t3 ", "", "1 x", None]) == [[1, 2, 3], [], [1, None], None]
    assert values(spark, C.to_string_vector, [" a  b ", "", None]) == [["a", "b"], [], None]
    assert values(spark, lambda c: C.vector_text(C.to_uint_vector(c)), [" 1  2 "]) == ["1 2"]
    assert values(spark, lambda c: C.number_text(c.cast("double")), ["5", "0.5"]) == ["5", "0.5"]
    got = values(spark, C.duration_seconds, ["PT2S", "PT1H30M", "P1DT0.5S", "-PT1S", "P1Y", "PT", "P", "2S", "", None])
    assert [None if v is None else float(v) for v in got] == [2, 5400, 86400.5, -1, None, None, None, None, None, None]


def test_texts(spark):
    assert values(spark, C.qname, ["a:b:c", "b", ""]) == [("a", "b:c"), ("", "b"), ("", "")]
    assert values(spark, C.decode_entities, ["&lt;&amp;lt;&gt;&quot;&apos;", None]) == ["<&lt;>\"'", None]
    assert values(spark, C.tag_attributes, ["<x a=\"1\" b='2' a=\"3\" c=\"it's\">", "<x>", None]) == [{"a": "1", "b": "2", "c": "it's"}, {}, None]
    assert values(spark, C.category, ["dash-js/a.mpd", "/x/dash-if/y/b.mpd", "iso/example_G1.mpd", "example_H2.mpd", "iso/example_K.mpd", "misc/xlink.mpd"]) == ["dash-js", "dash-if", "iso-annex-G", "iso-annex-H", "iso-annex-K", "misc"]
    assert values(spark, C.minify_json, ['{ "a b" : [1, 2 ] ,"c":"x \\" y" }', "[]", None]) == ['{"a b":[1,2],"c":"x \\" y"}', "[]", None]
    assert values(spark, C.minify_xml, [" <a>\n <b> t </b> </a> "]) == ["<a><b> t </b></a>"]
    assert values(spark, C.sanitize, ["a b/c-d_é ", "__x__"]) == ["a_b_c-d_é", "x"]
    assert values(spark, lambda c: C.milliseconds_text(c.cast("long")), ["999", "1005", "1500000"]) == ["999ms", "1.00s", "1500.00s"]
    assert values(spark, lambda c: C.bytes_text(c.cast("long")), ["10", "2048", "3145728"]) == ["10 B", "2.0 KB", "3.00 MB"]
    assert values(spark, lambda c: C.looks_like(c, "dateTime"), ["2025-01-01T00:00:00Z", "2025-01-01", "x"]) == [True, False, False]
    assert values(spark, C.safe_name, ["https://a.b/c d.mpd?x=1"]) == ["a.b_c_d.mpd"]


def test_faults(spark):
    c = model().types["RepresentationType"]
    df = spark.createDataFrame([("a", "5", "16:9", "3"), (None, "-1", "x", "7"), ("b", None, None, None)], "id string, bandwidth string, sar string, sap string")
    got = [sorted(f.path for f in r.e) for r in df.select(faults({"id": F.col("id"), "bandwidth": F.col("bandwidth"), "sar": F.col("sar"), "startWithSAP": F.col("sap")}, c).alias("e")).collect()]
    assert got == [[], ["/@bandwidth", "/@id", "/@sar", "/@startWithSAP"], ["/@bandwidth"]]


def test_relations(spark):
    doc = '{"BaseURL":[{"$value":"u"}],"Period":[{"id":"p","BaseURL":[{"$value":"v"}],"AdaptationSet":[{"id":1,"Role":[{"schemeIdUri":"s","value":"main"}],"SegmentTemplate":{"SegmentTimeline":{"S":[{"t":18446744073709551615,"d":1}]}},"Representation":[{"id":"a","bandwidth":1},{"id":"b","bandwidth":2}]},{}]},{}]}'
    df = typed(spark.createDataFrame([("d", doc), ("e", None), ("f", "{"), ("g", "{}")], "doc_id string, json string"))
    assert [(r.period_ord, r.as_ord, r.rep_ord, r.rep.id, r.rep.bandwidth) for r in representations(df).collect()] == [(1, 1, 1, "a", 1), (1, 1, 2, "b", 2)]
    assert adaptation_sets(df).count() == 2 and int(segments(df).first().s.t) == 2**64 - 1
    assert sorted((r.level, r.value) for r in base_urls(df).collect()) == [("MPD", "u"), ("Period", "v")] and descriptors(df).first().value == "main"


def test_only_used_parts_are_parsed(spark):
    df = representations(typed(spark.createDataFrame([("d", "{}")], "doc_id string, json string"))).select("rep.id")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "PatchLocation" not in plan and "minBufferTime" not in plan


def test_nodes(spark):
    xml = '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" xmlns:p="urn:a" p:k="1"><p:f/><Period xmlns:p="urn:b"/><BaseURL>t</BaseURL><q xmlns="urn:a"/></MPD>'
    n = nodes(spark.createDataFrame([("d", xml, 1), ("bad", "<x", 2), ("none", None, 3)], "doc_id string, xml string, node_id int")).cache()
    rows = n.where("doc_id = 'd'").orderBy("node_id").collect()
    assert rows[0].path == "/MPD[1]" and [r.local for r in rows if r.kind == "elem"] == ["MPD", "f", "Period", "BaseURL", "q"] and [r.value for r in rows if r.kind == "text"] == ["t"]
    assert [r.kind for r in n.where("doc_id = 'bad'").collect()] == ["bad"] and n.where("doc_id = 'none'").count() == 0
    assert {(r.rule, r.name) for r in namespace_violations(n).collect()} == {("prefix_rebinding", "p")}
    assert {(r.ns_uri, r.prefix, tuple(r.attributes)) for r in namespace_registry(n).collect()} == {("urn:a", "p", ("k",))}
    order = spark.createDataFrame([("MPD", "BaseURL", 0), ("MPD", "Period", 1)], "parent string, local string, place int")
    got = sorted((r.new, r.local) for r in child_order(n.where("doc_id = 'd'"), order).collect())
    assert got == [(1, "BaseURL"), (2, "Period"), (3, "f"), (4, "q")]


def test_line_differences(spark):
    one = spark.createDataFrame([("a", "x\ny\nz"), ("b", "same"), ("c", "\n".join("abcdefghij")), ("d", None)], "doc_id string, text string")
    two = spark.createDataFrame([("a", "x\nY"), ("b", "same"), ("c", "\n".join("ABCDEFGHIJ")), ("d", None)], "doc_id string, text string")
    got = sorted((r.doc_id, r.pos, r.left, r.right) for r in line_differences(one, two, most=3).collect())
    assert got == [("a", 1, "y", "Y"), ("a", 2, "z", "<missing>"), ("c", 0, "a", "A"), ("c", 1, "b", "B"), ("c", 2, "c", "C")]
