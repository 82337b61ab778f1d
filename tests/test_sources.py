import gzip

from pyspark.sql import functions as F

from sluice.sources.manifests import fix_url, read_catalogue, read_json_manifests, read_manifests, read_patches, read_url_map, read_url_report, urls_in_json, with_source_url, write_json, write_named, write_xml


def test_reading(spark, tmp_path):
    for name, text in (("dash-js/001_a.mpd", "﻿<MPD/>"), ("dash-if/deep/b.mpd", "<MPD/>"), ("iso/example_G1.mpd", "<MPD/>"), ("iso/skip.txt", "x"), ("p/one.mpp", "<Patch/>"), ("j/one.json", '{\n"a":1}')):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    got = {r.file_name: (r.category, r.xml) for r in read_manifests(spark, str(tmp_path)).collect()}
    assert got == {"001_a.mpd": ("dash-js", "<MPD/>"), "b.mpd": ("dash-if", "<MPD/>"), "example_G1.mpd": ("iso-annex-G", "<MPD/>")}
    assert [r.file_name for r in read_manifests(spark, str(tmp_path), only="0?1_*.mpd").collect()] == ["001_a.mpd"]
    assert read_patches(spark, str(tmp_path)).first().xml == "<Patch/>" and read_json_manifests(spark, str(tmp_path)).first().json == '{\n"a":1}'


def test_url_maps(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("http://x/1 \t001_a.mpd\nbad\n\thttp\n")
    (tmp_path / "r.txt").write_text("Report\n  URL: http://y/lost\n  URL: http://y/2\n  Size: 5\n  Saved as: b.mpd \n\n  URL: http://y/3\n  Saved as: c.mpd\n")
    m = read_url_map(spark, str(tmp_path / "m.tsv"))
    assert [(r.file_name, r.url) for r in m.collect()] == [("001_a.mpd", "http://x/1")]
    r = read_url_report(spark, str(tmp_path / "r.txt"))
    assert sorted((x.file_name, x.url) for x in r.collect()) == [("b.mpd", "http://y/2"), ("c.mpd", "http://y/3")]
    files = spark.createDataFrame([("b.mpd",), ("z.mpd",)], "file_name string")
    assert sorted((x.file_name, x.url) for x in with_source_url(files, m.unionByName(r)).collect()) == [("b.mpd", "http://y/2"), ("z.mpd", None)]


def test_catalogue_and_json_urls(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id;url\n1;"http://a/x;y.mpd"\n2;http://b/z.mpd\n')
    assert [r.url for r in read_catalogue(spark, str(tmp_path / "c.csv")).collect()] == ["http://a/x;y.mpd", "http://b/z.mpd"]
    df = spark.createDataFrame([('{"a":[" https://x/a.mpd ",{"b":"HTTP://y/b.MPD?c=1"}],"c":"https:\\/\\/x\\/a.mpd","d":"x.mpd","e":"https://x/m3u8"}',), (None,)], "json string")
    assert sorted(r.url for r in urls_in_json(df).collect()) == ["HTTP://y/b.MPD?c=1", "https://x/a.mpd"]
    one = spark.createDataFrame([("https://live.example/dev/a",), ("https://b/dev/a",)], "u string").select(fix_url(F.col("u"), "https://live.example/dev/", "https://live.example/").alias("u"))
    assert [r.u for r in one.collect()] == ["https://live.example/a", "https://b/dev/a"]


def test_writing(spark, tmp_path):
    df = spark.createDataFrame([("a/1", '{ "k" : "v w" }', "<a>\n <b/> </a>")], "doc_id string, json string, xml string")
    write_json(df, str(tmp_path / "j"), minified=True, gzip=True)
    texts = [gzip.decompress(p.read_bytes()).decode().strip() for p in (tmp_path / "j").glob("*.gz")]
    assert [t for t in texts if t] == ['{"k":"v w"}']
    write_xml(df, str(tmp_path / "x"))
    (part,) = (tmp_path / "x").glob("doc_id=a_1-*/*.txt")
    assert part.read_text().strip() == "<a><b/></a>"


def test_named_files(spark, tmp_path):
    """Files keep their document's name; ids with one base name stay apart, and a null text has no file."""
    df = spark.createDataFrame([("plain", "{}", "<a/>"), ("x/one.mpd", "[1]", None), ("y/one.mpd", "[2]", "<b/>"), (None, "{}", "<c/>")], "doc_id string, json string, xml string")
    files = {(r.doc_id, r.name.partition("-")[0]): (r.name, r.bytes) for r in write_named(df, str(tmp_path / "out"), json=".json", xml="-regenerated.mpd").collect()}
    texts = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert texts["plain.json"] == "{}" and texts["plain-regenerated.mpd"] == "<a/>" and len(texts) == 5
    ones = sorted(v for k, v in texts.items() if k.startswith("one-") and k.endswith(".json"))
    assert ones == ["[1]", "[2]"] and sum(n for _, n in files.values()) <= sum(map(len, texts.values()))
