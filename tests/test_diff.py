from sluice.operators.diff import canonical, compare_copies

SCHEMA = "doc_id string, original_mpd string, regenerated_mpd string, path string, field string"


def found(spark, pairs, **kw):
    df = spark.createDataFrame([(d, a, b, "own", "own") for d, a, b in pairs], SCHEMA)
    return sorted((r.doc_id, r.path, r.field, r.kind) for r in compare_copies(df, "original_mpd", "regenerated_mpd", **kw).collect())


def test_kinds(spark):
    a = '<MPD xmlns="u" type="static" a="1"><!-- c --><Period id="p1"><AdaptationSet id="1" segmentAlignment="true" group="01"><Representation id="r" bandwidth="100" codecs=" x "><BaseURL> b&amp;c </BaseURL></Representation></AdaptationSet></Period><Period id="p2"/></MPD>'
    b = "<MPD xmlns='u' type='dynamic' b=''><Period id=' p1 '><AdaptationSet segmentAlignment='1' id='1' group='1'><Representation codecs='x' id='r' bandwidth='100.0'><BaseURL>b&#38;c</BaseURL></Representation><Representation id='q' width='1'/></AdaptationSet></Period></MPD>"
    want = [("d", "MPD", "a", "only_original"), ("d", "MPD", "b", "only_regenerated"), ("d", "MPD", "type", "differs"), ("d", "MPD/Period[p1]/AdaptationSet[1]/Representation[q]", "", "only_regenerated"), ("d", "MPD/Period[p2]", "", "only_original")]
    for buckets in (1, 1 << 16):
        assert found(spark, [("d", a, b), ("d", a, b), ("e", a, a), (None, b, a.replace("Period", "Period"))][:3], buckets=buckets) == want


def test_missing_copies(spark):
    x = '<MPD><Period id="1"><AdaptationSet id="2"/></Period></MPD>'
    got = found(spark, [("a", x, None), ("b", None, x), ("c", None, None), ("d", x, "<broken"), ("e", '<!DOCTYPE MPD [<!ENTITY e "x">]><MPD a="&e;"/>', x), ("f", "", x), ("g", x, x + "\n")])
    assert got == [("a", "MPD", "", "only_original"), ("b", "MPD", "", "only_regenerated"), ("d", "MPD", "", "only_original"), ("e", "MPD", "", "only_regenerated"), ("f", "MPD", "", "only_regenerated")]
    assert found(spark, []) == []


def test_unlike_rows_of_one_document(spark):
    a, b = '<MPD type="static"><Period id="1"/></MPD>', '<MPD type="dynamic"><Period id="2"/></MPD>'
    both = [("MPD", "type", "differs")] + [(f"MPD/Period[{p}]", "", f"only_{side}") for p in (1, 2) for side in ("original", "regenerated")]
    for buckets in (1, 1 << 16):
        assert found(spark, [("d", a, b), ("d", b, a), ("e", a, None), ("e", None, a)], buckets=buckets) == sorted([("d", *x) for x in both] + [("e", "MPD", "", "only_original"), ("e", "MPD", "", "only_regenerated")])


def test_long_and_repeated(spark):
    reps = "".join(f'<Representation id="{i}" bandwidth="{i}"/>' for i in range(20_000))
    x = f'<MPD><Period id="p"><AdaptationSet id="1">{reps}</AdaptationSet></Period></MPD>'
    assert found(spark, [("a", x, x.replace('bandwidth="777"', 'bandwidth="778"'))]) == [("a", "MPD/Period[p]/AdaptationSet[1]/Representation[777]", "bandwidth", "differs")]


def test_canonical():
    assert canonical("width", " 0640 ") == canonical("width", "640.0") == "640"
    assert canonical("width", "abc") == "abc" and canonical("width", "INF") == "INF" and canonical("frameRate", "25/1") == "25/1"
    assert canonical("segmentAlignment", "1") == canonical("segmentAlignment", "true") and canonical("codecs", "1") == "1"
    assert canonical("maxPlayoutRate", "1e1") == canonical("maxPlayoutRate", "10") and canonical("width", "0") == canonical("width", "-0.0").lstrip("-")
