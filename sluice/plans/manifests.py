"""Queries over manifests made from the driver's tables, so that SQL over the tables is an independent check of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import columns as C
from sluice.operators import convert, nodes, patchdoc, relations, roundtrip, validate, xlink
from sluice.schema.types import schema_fields
from sluice.session import ship, table

NS = "urn:mpeg:dash:schema:mpd:2011"


def _attr(name: str, value) -> object:
    return F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))


def _join(order, text, sep: str = ""):
    """Texts of a group in order; the groups here are the parts of one manifest."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), sep)


def _cents():
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def order_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, xml``: a manifest a customer, a Period an order, an AdaptationSet a return flag, a Representation a line."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    rep = F.concat(F.lit("<Representation"), _attr("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), _attr("bandwidth", _cents()), _attr("maxPlayoutRate", F.col("l_quantity")), F.lit("/>"))
    sets = line.groupBy("l_orderkey", "l_returnflag").agg(_join(F.struct("l_linenumber", _cents(), "l_quantity"), rep).alias("reps"))
    number = F.instr(F.lit("ANR"), F.col("l_returnflag"))
    aset = F.concat(F.lit("<AdaptationSet"), _attr("id", number), _attr("contentType", F.col("l_returnflag")), _attr("segmentAlignment", F.when(number > 1, "1").otherwise("false")), F.lit(">\n"), F.col("reps"), F.lit("</AdaptationSet>"))
    periods = sets.groupBy("l_orderkey").agg(_join(number, aset).alias("sets"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    period = F.concat(F.lit("<Period"), _attr("id", F.col("o_orderkey")), F.lit(">"), F.col("sets"), F.lit("</Period>"))
    docs = orders.join(periods, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(_join(F.col("o_orderkey"), period, "\n").alias("body"))
    return docs.select(F.col("o_custkey").cast("string").alias("doc_id"), F.concat(F.lit(f'<MPD xmlns="{NS}" profiles="urn:p" minBufferTime="PT2S">'), "body", F.lit("</MPD>")).alias("xml"))


def manifest_representations(spark: SparkSession, folder: str) -> DataFrame:
    """XML to typed JSON, then the relation of Representations."""
    docs = convert.to_json(order_manifests(spark, folder)).select("doc_id", "json")
    reps = relations.representations(relations.typed(docs))
    return reps.select("doc_id", F.col("period.id").alias("period_id"), F.col("aset.id").alias("as_id"), "rep_ord", F.col("rep.id").alias("rep_id"), F.col("rep.bandwidth").alias("bandwidth"), F.col("rep.maxPlayoutRate").alias("rate"))


def bandwidth_by_set(spark: SparkSession, folder: str) -> DataFrame:
    docs = convert.to_json(order_manifests(spark, folder)).select("doc_id", "json")
    reps = relations.representations(relations.typed(docs))
    return reps.groupBy(F.col("aset.contentType").alias("content_type"), F.col("aset.segmentAlignment").alias("aligned")).agg(F.count("*").alias("n"), F.sum("rep.bandwidth").alias("bandwidth"), F.max("rep.bandwidth").alias("top"))


def _spelled():
    """Line values as texts, some of them not of their type."""
    q = F.col("l_quantity").cast("int").cast("string")
    return (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" "), q))
        .when(F.col("l_linenumber") == 2, F.concat(q, F.lit(".50")))
        .when(F.col("l_linenumber") == 3, F.concat(q, F.lit("kb")))
        .when(F.col("l_linenumber") == 4, F.lit("INF"))
        .when(F.col("l_linenumber") == 5, F.concat(q, F.lit("e2")))
        .otherwise(q)
    )


def coerce_types(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", _spelled().alias("s"))
    flag = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "false").otherwise("yes")
    return df.select("l_orderkey", "l_linenumber", C.to_integer(F.col("s")).cast("bigint").alias("as_int"), C.to_number(F.col("s")).alias("as_number"), C.to_boolean(flag).alias("as_bool"))


def vector_attr(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda x: F.round(F.abs(x) * 1000).cast("bigint").cast("string")), "  ").alias("text"))
    v = C.to_uint_vector(F.concat(F.lit(" "), F.col("text"), F.lit(" ")))
    return df.select("vec_id", F.size(v).alias("n"), F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.md5(C.vector_text(v)).alias("text"))


def uint64_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Times above 2**63 through XML, JSON and the typed relation."""
    e = table(spark, folder, "events").select("user_id", "event_id")
    t = (F.col("event_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)")
    s = F.concat(F.lit("<S"), _attr("t", t), F.lit(' d="1"/>'))
    docs = e.groupBy("user_id").agg(_join(F.col("event_id"), s).alias("body"))
    head = f'<MPD xmlns="{NS}" profiles="p" minBufferTime="PT1S"><Period><AdaptationSet><SegmentTemplate><SegmentTimeline>'
    docs = docs.select(F.col("user_id").cast("string").alias("doc_id"), F.concat(F.lit(head), "body", F.lit("</SegmentTimeline></SegmentTemplate></AdaptationSet></Period></MPD>")).alias("xml"))
    rows = relations.segments(relations.typed(convert.to_json(docs.toDF("doc_id", "xml")).select("doc_id", "json")))
    return rows.select("doc_id", "s_ord", F.col("s.t").cast("string").alias("t"))


def array_order(spark: SparkSession, folder: str) -> DataFrame:
    """Places of Events keep the order of the document."""
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    one = F.concat(F.lit("<Event"), _attr("id", F.col("event_id")), F.lit(">"), F.col("event_type"), F.lit("</Event>"))
    docs = e.groupBy("user_id").agg(_join(-F.col("event_id"), one).alias("body"))
    docs = docs.select(F.col("user_id").cast("string").alias("doc_id"), F.concat(F.lit(f'<MPD xmlns="{NS}" profiles="p" minBufferTime="PT1S"><Period><EventStream schemeIdUri="u">'), "body", F.lit("</EventStream></Period></MPD>")).alias("xml"))
    rows = relations.events(relations.typed(convert.to_json(docs).select("doc_id", "json")))
    return rows.select("doc_id", F.col("event_ord").alias("place"), F.col("event.id").cast("bigint").alias("event_id"), F.col("event").getField("$value").alias("event_type"))


def escape_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as JSON labels, to XML and back."""
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    label = F.struct(F.col("text").alias("$value"))
    aset = F.struct(F.array(label).alias("Label"))
    mpd = F.struct(F.lit("p").alias("profiles"), F.lit("PT1S").alias("minBufferTime"), F.array(F.struct(F.array(aset).alias("AdaptationSet"))).alias("Period"))
    xml = convert.to_xml(d.select("doc_id", F.to_json(mpd).alias("json"))).select("doc_id", "xml")
    back = relations.adaptation_sets(relations.typed(convert.to_json(xml).select("doc_id", "json")))
    value = F.element_at("aset.Label", 1).getField("$value")
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(value).alias("digest"), F.length(value).alias("chars"))


def normalize_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Two spellings of an order; every third order also differs in a value."""
    o = table(spark, folder, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    key = F.col("o_orderkey").cast("string")
    one = F.concat(F.lit(f'<MPD xmlns="{NS}"><Period id="'), key, F.lit('" bitstreamSwitching="1"><BaseURL> a  b </BaseURL><Representation bandwidth="'), F.col("c").cast("string"), F.lit('" width="640"/></Period></MPD>'))
    other = F.when(F.col("o_orderkey") % 3 == 0, F.col("c") + 1).otherwise(F.col("c")).cast("string")
    two = F.concat(F.lit(f"<d:MPD xmlns:d='{NS}'><!-- x --><d:Period bitstreamSwitching='true' id=' "), key, F.lit(" '>\n<d:BaseURL>a b</d:BaseURL>\n<d:Representation width='0640' bandwidth='"), other, F.lit(".0'></d:Representation></d:Period></d:MPD>"))
    left, right = o.select(key.alias("doc_id"), one.alias("xml")), o.select(key.alias("doc_id"), F.regexp_replace(two, "(</?)d:", "$1").alias("x")).select("doc_id", F.replace(F.col("x"), F.lit("xmlns:d="), F.lit("xmlns=")).alias("xml"))
    a, b = nodes.fingerprint(nodes.nodes(left)), nodes.fingerprint(nodes.nodes(right))
    return a.join(b.withColumnsRenamed({"hash": "other", "lines": "n"}), "doc_id").select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("hash") == F.col("other")).alias("equal"), F.col("lines").alias("lines"))


def line_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of two texts of a customer, with one line changed and one missing for some."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), "c_custkey", "c_name", "c_mktsegment")
    left = c.select("doc_id", F.concat_ws("\n", "c_name", "c_mktsegment", F.lit("end")).alias("text"))
    right = c.select("doc_id", F.concat_ws("\n", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")), "c_mktsegment", F.when(F.col("c_custkey") % 5 > 0, "end")).alias("text"))
    return nodes.line_differences(left, right)


def _ns_docs(n: DataFrame) -> DataFrame:
    """A manifest a row of ``n_nationkey, n_regionkey``: the region's namespace on prefixes chosen by the key."""
    uri = F.concat(F.lit("urn:r:"), (F.col("n_regionkey") % 2).cast("string"))
    xml = F.concat(
        F.lit(f'<MPD xmlns="{NS}" xmlns:p'), (F.col("n_nationkey") % 4).cast("string"), F.lit('="'), uri, F.lit('" p'), (F.col("n_nationkey") % 4).cast("string"), F.lit(':k="1"><Period xmlns:p'),
        (F.col("n_nationkey") % 3).cast("string"), F.lit('="'), uri, F.lit('" p'), (F.col("n_nationkey") % 3).cast("string"), F.lit(':a="2"/><Period xmlns:p0="urn:z"/></MPD>'),
    )
    return n.select(F.col("n_nationkey").cast("string").alias("doc_id"), xml.alias("xml"))


def _nation_docs(spark: SparkSession, folder: str) -> DataFrame:
    return _ns_docs(table(spark, folder, "nation").select("n_nationkey", "n_regionkey"))


def _customer_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The same over a table that grows."""
    return _ns_docs(table(spark, folder, "customer").select(F.col("c_custkey").alias("n_nationkey"), F.col("c_nationkey").alias("n_regionkey")))


def ns_registry(spark: SparkSession, folder: str, docs=_nation_docs) -> DataFrame:
    got = nodes.namespace_registry(nodes.nodes(docs(spark, folder)))
    return got.select("doc_id", "ns_uri", "prefix", F.array_join("attributes", ",").alias("attributes"))


def ns_violations(spark: SparkSession, folder: str, docs=_nation_docs) -> DataFrame:
    return nodes.namespace_violations(nodes.nodes(docs(spark, folder)))


def ns_registry_customers(spark: SparkSession, folder: str) -> DataFrame:
    return ns_registry(spark, folder, _customer_docs)


def ns_violations_customers(spark: SparkSession, folder: str) -> DataFrame:
    return ns_violations(spark, folder, _customer_docs)


def selector_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Per manifest: the Period at place 2, and the AdaptationSet with id 2 of the first Period, by expressions."""
    m = relations.typed(convert.to_json(order_manifests(spark, folder)).select("doc_id", "json"))
    first = F.element_at("mpd.Period", 1)
    hit = F.get(F.filter(first["AdaptationSet"], lambda a: a["id"] == 2), F.lit(0))
    return m.select("doc_id", F.get("mpd.Period", F.lit(1))["id"].alias("second"), F.size(hit["Representation"]).alias("reps"))


def _event_ops(spark: SparkSession, folder: str):
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    key = F.col("event_id").cast("string")
    rep = F.concat(F.lit('"Representation":{"id":"'), key, F.lit('","bandwidth":"'), key, F.lit('"}'))
    aset = F.lit("\"sel\":\"/MPD/Period[@id='1']/AdaptationSet[1]")
    body = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("{"), aset, F.lit('",'), rep, F.lit("}")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("{"), aset, F.lit('","pos":"prepend",'), rep, F.lit("}")))
        .when(F.col("event_type") == "error", F.concat(F.lit("{"), aset, F.lit('/Representation[1]"}')))
        .when(F.col("event_type") == "click", F.concat(F.lit("{"), aset, F.lit('/@group","$value":"'), key, F.lit('"}')))
        .otherwise(F.lit('{"sel":"/MPD","type":"@id","$value":"v"}'))
    )
    op = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "click", "replace").otherwise("add")
    ops = e.select(F.col("user_id").cast("string").alias("mpd_id"), F.lpad(key, 20, "0").alias("seq"), F.lit(0).alias("op_idx"), op.alias("op"), body.alias("body"))
    docs = e.select(F.col("user_id").cast("string").alias("mpd_id")).distinct()
    docs = docs.withColumn("json", F.lit('{"profiles":"p","minBufferTime":"PT1S","Period":[{"id":"1","AdaptationSet":[{"id":1,"Representation":[{"id":"a","bandwidth":1}]}]}]}'))
    return docs, ops


def patch_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events as a log of patches: the Representations left, in order, the last value of a field, and how many patches
    were applied and how many found nothing."""
    docs, ops = _event_ops(spark, folder)
    got = patchdoc.replay_documents(docs, ops)
    group = F.get_json_object("json", "$.Period[0].AdaptationSet[0].group").cast("bigint")
    reps = F.transform(F.from_json(F.get_json_object("json", "$.Period[0].AdaptationSet[0].Representation"), "array<struct<id:string>>"), lambda r: r["id"])
    return got.select(F.col("mpd_id").alias("user_id"), group.alias("last_click"), F.get_json_object("json", "$.id").alias("id"), "applied", "rejected", F.array_join(reps, ",").alias("reps"))


# Selectors, usable or not.
SELECTORS = (
    ("/MPD/Period[@id='1']/@start", True), ("/MPD/Period[2]", True), ("/MPD/BaseURL[.='x']", True), ("/MPD", True), ("Period[1]", False), ("/MPD/*", False), ("//Period", False), ("/MPD/Period/..", False),
    ("/MPD/Period[1]/text()", False), ("/MPD/Period[@id='1' and @start='2']", False), ("/MPD/Period[0]", False), ("/MPDx/Period", False), ("/MPD/Period[@id='1'][1]", False), ("/MPD/@a/b", False),
)


def patch_reject(spark: SparkSession, folder: str) -> DataFrame:
    """Patches of two operations, the second with one of the selectors; all or nothing is applied."""
    o = table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % len(SELECTORS)).cast("int").alias("k"))
    sel = F.element_at(F.array(*[F.lit(s) for s, _ in SELECTORS]), F.col("k") + 1)
    key = F.col("c_custkey").cast("string")
    docs = o.select(key.alias("mpd_id"), F.lit('{"BaseURL":[{"$value":"x"}],"Period":[{"id":"1"},{"id":"2"}]}').alias("json"))
    first = o.select(key.alias("mpd_id"), F.lit("1").alias("seq"), F.lit(0).alias("op_idx"), F.lit("add").alias("op"), F.lit('{"sel":"/MPD","type":"@id","$value":"n"}').alias("body"))
    value = F.when(sel.contains("@start"), F.lit(',"type":"@start","$value":"PT1S"')).otherwise(F.lit(',"type":"@lang","$value":"PT1S"'))
    second = o.select(key.alias("mpd_id"), F.lit("1").alias("seq"), F.lit(1).alias("op_idx"), F.lit("add").alias("op"), F.concat(F.lit('{"sel":"'), sel, F.lit('"'), value, F.lit("}")).alias("body"))
    got = patchdoc.replay_documents(docs, first.unionByName(second))
    return got.select(F.col("mpd_id").cast("bigint").alias("c_custkey"), F.get_json_object("json", "$.id").isNotNull().alias("applied"))


def xlink_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """A stub a nation linked to its region: region 0 is the sentinel, region 1 has no body, region 2 two elements."""
    n = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    href = F.when(F.col("n_regionkey") == 0, xlink.RESOLVE_TO_ZERO).otherwise(F.concat(F.lit("http://r/"), F.col("n_regionkey").cast("string")))
    body = F.to_json(F.struct(F.col("n_name").alias("id"), F.lit("PT1S").alias("start"), F.struct(href.alias("href")).alias("xlink")))
    stubs = n.select(F.col("n_nationkey").cast("string").alias("doc_id"), F.array(F.lit(0)).alias("place"), body.alias("body"))
    r = table(spark, folder, "region").select("r_regionkey", "r_name")
    one = F.concat(F.lit('{"start":"'), F.col("r_name"), F.lit('"}'))
    rbody = F.when(F.col("r_regionkey") == 2, F.concat(F.lit("["), one, F.lit(',{"id":"second"}]'))).otherwise(one)
    remote = r.select(F.concat(F.lit("http://r/"), F.col("r_regionkey").cast("string")).alias("href"), F.when(F.col("r_regionkey") == 1, 404).otherwise(200).alias("status"), rbody.alias("body"))
    got = xlink.resolve(stubs, remote, depth=3)
    return got.select("doc_id", (F.get("place", F.lit(1)) + 1).alias("nth"), F.get_json_object("body", "$.id").alias("id"), F.get_json_object("body", "$.start").alias("start"))


def xlink_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Remote elements taken from manifests, one a customer, and put back: a Period behind a chain of three links, for every
    seventh a cycle; an AdaptationSet that is missing, becomes two, or one."""
    c = table(spark, folder, "customer").select("c_custkey")
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    x, y = (k % 7).cast("string"), (k % 3).cast("string")
    json = text('{"profiles":"p","minBufferTime":"PT1S","Period":[{"id":"s","xlink":{"href":"http://c/1/', x, '"}},{"id":"p2","AdaptationSet":[{"id":1},{"xlink":{"href":"http://a/', y, '"}}]}]}')
    n = spark.range(7).select(F.col("id").cast("string").alias("x"))
    link = lambda to, more="": text('{"xlink":{"href":"http://c/', to, "/", F.col("x"), '"}' + more + "}")
    chain = [("1", link("2", ',"start":"PT1S"')), ("2", F.when(F.col("x") == "0", link("1")).otherwise(link("3"))), ("3", text('{"id":"end-', F.col("x"), '"}'))]
    remote = None
    for step, body in chain:
        one = n.select(text(f"http://c/{step}/", F.col("x")).alias("href"), F.lit(200).alias("status"), body.alias("body"))
        remote = one if remote is None else remote.unionByName(one)
    remote = remote.unionByName(spark.createDataFrame([("http://a/0", 404, "{}"), ("http://a/1", 200, '[{"id":5},{"id":6}]'), ("http://a/2", 200, '{"id":7}')], "href string, status int, body string"))
    got = xlink.resolve_manifests(c.select(k.cast("string").alias("doc_id"), json.alias("json")), remote)
    m = F.from_json("json", "struct<Period:array<struct<id:string,start:string,AdaptationSet:array<struct<id:string>>>>>")["Period"]
    ids = lambda items: F.array_join(F.transform(items, lambda e: e["id"]), ",")
    return got.select("doc_id", ids(m).alias("periods"), F.get(m, F.lit(0))["start"].alias("start"), ids(F.element_at(m, -1)["AdaptationSet"]).alias("sets"))


def roundtrip_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests that survive the round trip and such that cannot: a prefix bound to two namespaces, a text that is no XML, and texts
    that share a doc_id with others."""
    c = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    good = F.concat(F.lit(f'<MPD xmlns="{NS}" xmlns:e="urn:e" profiles="p" minBufferTime="PT1S"><Period><Preselection preselectionComponents="1 2" id="'), k.cast("string"), F.lit('"/><AdaptationSet e:note="'), F.col("c_mktsegment"), F.lit('" id="1"><e:x>t</e:x></AdaptationSet></Period></MPD>'))
    xml = F.when(k % 4 == 1, F.replace(good, F.lit("<e:x>"), F.lit('<e:x xmlns:e="urn:f">'))).when(k % 4 == 2, F.substring(good, 1, 60)).otherwise(good)
    key = F.when(k % 4 == 3, F.floor(k / 40)).otherwise(k).cast("string")
    got = roundtrip.validate_roundtrip(c.select(key.alias("doc_id"), (k % 4).cast("string").alias("category"), xml.alias("xml")))
    return got.groupBy("category").agg(F.count("*").alias("total"), F.count_if("success").alias("passed"))


def schema_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements outside the usual tree come out as arrays and typed values too."""
    c = table(spark, folder, "customer").select("c_custkey")
    k = F.col("c_custkey")
    xml = F.concat(
        F.lit(f'<MPD xmlns="{NS}" profiles="p" minBufferTime="PT1S"><Metrics metrics="m"><Reporting schemeIdUri="u"/></Metrics><Period><EmptyAdaptationSet id="'), k.cast("string"), F.lit('"/>'),
        F.repeat(F.lit('<Preselection preselectionComponents="1 2 3"/>'), (k % 3 + 1).cast("int")), F.lit('<AdaptationSet><Representation id="r" bandwidth="1"><SegmentList duration="'), k.cast("string"), F.lit('">'),
        F.repeat(F.lit('<SegmentURL media="a"/>'), (k % 2 + 1).cast("int")), F.lit("</SegmentList></Representation></AdaptationSet></Period></MPD>"),
    )
    m = relations.typed(convert.to_json(c.select(k.cast("string").alias("doc_id"), xml.alias("xml"))).select("doc_id", "json"))
    period = F.element_at("mpd.Period", 1)
    segments = F.element_at(F.element_at(period["AdaptationSet"], 1)["Representation"], 1)["SegmentList"]
    return m.select(
        "doc_id", F.size("mpd.Metrics").alias("metrics"), F.element_at(period["EmptyAdaptationSet"], 1)["id"].cast("bigint").alias("empty_id"), F.size(period["Preselection"]).alias("preselections"),
        F.size(F.element_at(period["Preselection"], 1)["preselectionComponents"]).alias("components"), segments["duration"].cast("bigint").alias("duration"), F.size(segments["SegmentURL"]).alias("urls"),
    )


def category_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "roundtrip").select("doc_id", "category", "success", (F.col("ms_to_json") + F.col("ms_to_xml") + F.col("ms_compare")).alias("ms")).distinct()
    return roundtrip.report(rows)


def malformed_reject(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text as XML, and each as the text of an element; counts by outcome."""
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    raw = d.select("doc_id", F.lit("raw").alias("kind"), F.col("text").alias("xml"))
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    wrapped = d.select("doc_id", F.lit("wrapped").alias("kind"), F.concat(F.lit(f'<MPD xmlns="{NS}" id="x">'), safe, F.lit("</MPD>")).alias("xml"))
    got = convert.to_json(raw.unionByName(wrapped))
    return got.groupBy("kind").agg(F.count_if(F.col("error").isNull()).alias("converted"), F.count_if(F.col("error").isNotNull()).alias("rejected"))


def roundtrip_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Original manifests of the round-trip table through the whole chain; counts by category."""
    d = table(spark, folder, "roundtrip").where(F.col("original_mpd").isNotNull()).select("doc_id", "category", F.col("original_mpd").alias("xml")).distinct()
    got = roundtrip.validate_roundtrip(d)
    return got.groupBy("category").agg(F.count("*").alias("total"), F.count_if("success").alias("passed"))


def child_reorder(spark: SparkSession, folder: str) -> DataFrame:
    """Children written in reverse are put in schema order, foreign ones last."""
    c = table(spark, folder, "customer").select("c_custkey")
    xml = F.concat(F.lit(f'<MPD xmlns="{NS}" xmlns:e="urn:e" id="'), F.col("c_custkey").cast("string"), F.lit('"><e:x/><Period/>'), F.when(F.col("c_custkey") % 2 == 0, F.lit("<UTCTiming/>")).otherwise(F.lit("")), F.lit("<BaseURL/><Period/><ProgramInformation/></MPD>"))
    docs = c.select(F.col("c_custkey").cast("string").alias("doc_id"), xml.alias("xml"))
    order = spark.createDataFrame([(c_.name.removesuffix("type"), n, i) for c_ in [convert.model().types["MPDtype"]] for n, i in c_.order.items()], "parent string, local string, place int")
    got = nodes.child_order(nodes.nodes(docs), order)
    return got.select(F.col("doc_id").cast("bigint").alias("doc_id"), "local", "old", "new")


def facets_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Values out of range, of a wrong form or missing, counted by path."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice").cast("bigint").alias("p"))
    k = F.col("o_orderkey")
    values = {
        "id": F.when(k % 7 != 0, k.cast("string")),
        "bandwidth": F.when(k % 5 == 0, F.lit("4294967296")).when(k % 5 == 1, F.lit("-1")).otherwise(F.col("p").cast("string")),
        "startWithSAP": (k % 9).cast("string"),
        "sar": F.when(k % 4 == 0, F.lit("16x9")).otherwise(F.lit("16:9")),
        "codingDependency": F.when(F.col("o_orderstatus") == "O", F.lit("1")).when(F.col("o_orderstatus") == "F", F.lit("true")).otherwise(F.lit("TRUE")),
        "audioSamplingRate": F.when(k % 6 == 0, F.lit("48000 x")).otherwise(F.lit("48000 44100")),
        "maxPlayoutRate": F.when(k % 8 == 0, F.lit("fast")).otherwise(F.lit("INF")),
    }
    found = o.select(F.explode(relations.faults(values, convert.model().types["RepresentationType"])).alias("x"))
    return found.groupBy(F.col("x.path").alias("path")).agg(F.count("*").alias("n"))


def duration_parse(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("PT"), q, F.lit("S"))).when(F.col("l_linenumber") == 2, F.concat(F.lit("PT1H"), q, F.lit("M"))).when(F.col("l_linenumber") == 3, F.concat(F.lit("-P"), q, F.lit("D"))).when(F.col("l_linenumber") == 4, F.concat(F.lit("PT"), q, F.lit(".5S"))).otherwise(F.concat(F.lit("P"), q))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (C.duration_seconds(text) * 10).cast("bigint").alias("tenths"), C.looks_like(text, "duration").alias("is_duration"))


def segment_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps between the events of a user as S elements, read back."""
    from pyspark.sql import Window as W

    e = table(spark, folder, "events")
    e = e.select("user_id", "event_id", C.utc_micros(e, "ts").alias("t"))
    e = e.withColumn("d", F.lead("t").over(W.partitionBy("user_id").orderBy("t", "event_id")) - F.col("t")).where(F.col("d") > 0)
    s = F.concat(F.lit("<S"), _attr("t", F.col("t")), _attr("d", F.col("d")), F.lit("/>"))
    docs = e.groupBy("user_id").agg(_join(F.struct("t", "event_id"), s).alias("body"))
    head = f'<MPD xmlns="{NS}" profiles="p" minBufferTime="PT1S"><Period><AdaptationSet><SegmentTemplate><SegmentTimeline>'
    docs = docs.select(F.col("user_id").cast("string").alias("doc_id"), F.concat(F.lit(head), "body", F.lit("</SegmentTimeline></SegmentTemplate></AdaptationSet></Period></MPD>")).alias("xml"))
    rows = relations.segments(relations.typed(convert.to_json(docs).select("doc_id", "json")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("s.d").cast("string").alias("total"), F.max(F.col("s.t") + F.col("s.d")).cast("string").alias("last"))


def json_minify(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", C.minify_json(F.col("props")).alias("props"))


def tag_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Names, entities and attributes of tags, from customers."""
    c = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    tag = F.concat(F.lit('<x:Node a="'), F.col("c_name"), F.lit("\" b='"), F.col("c_mktsegment"), F.lit("' a=\"no\">"))
    m = C.tag_attributes(tag)
    return c.select("c_custkey", m["a"].alias("a"), m["b"].alias("b"), C.qname(F.concat(F.lit("x:"), F.col("c_mktsegment"), F.lit(":y")))["local"].alias("local"), C.decode_entities(F.concat(F.lit("&lt;&amp;gt;"), "c_name")).alias("decoded"))


def url_names(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    ext = F.when(F.col("c_custkey") % 2 == 0, ".mpd").otherwise(".m3u8")
    url = F.concat(F.lit("https://h.example/a b/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_custkey").cast("string"), ext, F.lit("?x=1"))
    return c.select("c_custkey", C.is_mpd_url(url).alias("mpd"), C.is_hls_url(url).alias("hls"), C.safe_name(url).alias("name"), C.milliseconds_text(F.col("c_custkey")).alias("ms"))


def mpd_json_values(spark: SparkSession, folder: str) -> DataFrame:
    """BaseURLs of the JSON manifests at each level, from the typed relation."""
    d = table(spark, folder, "mpd_json").select("doc_id", F.col("mpd").alias("json")).distinct()
    return relations.base_urls(relations.typed(d)).groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))


def json_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON manifests against the core schema: documents and errors by kind of place (positions left out)."""
    d = table(spark, folder, "mpd_json").select("doc_id", F.col("mpd").alias("json")).distinct()
    found = validate.validate(d).select("doc_id", F.explode("errors").alias("e"))
    place = F.regexp_replace("e.path", r"\[\d+\]", "[]")
    return found.groupBy(place.alias("path"), F.regexp_extract("e.msg", r"^(not an? \w+|\S+)", 1).alias("kind")).agg(F.count("*").alias("errors"), F.count_distinct("doc_id").alias("documents"))


def descriptors(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "mpd_json").select("doc_id", F.col("mpd").alias("json")).distinct()
    return relations.descriptors(relations.typed(d)).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("schemeIdUri").alias("schemes"))


def patch_xml(spark: SparkSession, folder: str) -> DataFrame:
    """XML patches, one a customer, as operations."""
    ship(spark)
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_name")
    key, b = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    xml = F.concat(
        F.lit('<Patch xmlns="urn:mpeg:dash:schema:mpd-patch:2020" mpdId="'), key, F.lit('" publishTime="2026-01-01T00:00:02Z" originalPublishTime="2026-01-01T00:00:01Z"><replace sel="/MPD/Period[1]/AdaptationSet[@id=\'1\']/@group">'), b,
        F.lit('</replace><!-- <remove sel="no"/> --><add sel="/MPD/Period[1]/AdaptationSet[1]" pos="prepend"><Representation id="'), F.col("c_name"), F.lit('" bandwidth="'), b, F.lit('"/></add><remove sel="/MPD/Period[1]/BaseURL[1]" ws="both"/></Patch>'),
    )
    ops = patchdoc.patch_operations(c.select(xml.alias("xml")))
    number = F.coalesce(F.get_json_object("body", "$['$value']"), F.get_json_object("body", "$.Representation.bandwidth")).cast("bigint")
    return ops.select(F.col("mpd_id").cast("bigint").alias("mpd_id"), "op_idx", "op", "sel", number.alias("number"), F.get_json_object("body", "$.Representation.id").alias("rep_id"), F.get_json_object("body", "$.ws").alias("ws"))


def model_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of the schema by path, with type and cardinality."""
    ship(spark)
    return spark.createDataFrame(schema_fields(convert.Schema(str(convert.Path(convert.__file__).resolve().parent.parent / "schema" / "core.xsd")), "MPD"), "path string, owner string, name string, kind string, type string, required boolean, many boolean, default string")


QUERIES = {
    f.__name__: f
    for f in (
        manifest_representations, bandwidth_by_set, coerce_types, vector_attr, uint64_exact, array_order, escape_roundtrip, normalize_compare, line_differences, ns_registry, ns_violations, ns_registry_customers, ns_violations_customers, selector_predicates, patch_apply, patch_reject,
        xlink_resolve, xlink_manifest, roundtrip_mixed, schema_elements, category_report, malformed_reject, roundtrip_corpus, child_reorder, facets_errors, duration_parse, segment_runs, json_minify, tag_parts, url_names, mpd_json_values, json_validation, descriptors, patch_xml, model_fields,
    )
}

_REPS = "FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
_NUMBER = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"
_USABLE = ", ".join(str(i) for i, (_, ok) in enumerate(SELECTORS) if ok)

SQL = {
    "manifest_representations": f"""SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(o_orderkey AS VARCHAR) AS period_id, CAST({_NUMBER} AS BIGINT) AS as_id,
      CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, round(l_extendedprice * 100), l_quantity) AS INTEGER) AS rep_ord,
      l_orderkey || '-' || l_linenumber AS rep_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS bandwidth, l_quantity AS rate {_REPS}""",
    "bandwidth_by_set": f"SELECT l_returnflag AS content_type, l_returnflag <> 'A' AS aligned, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS bandwidth, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS top {_REPS} GROUP BY ALL",
    "coerce_types": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber NOT IN (2, 3, 4, 5) THEN CAST(l_quantity AS BIGINT) END AS as_int,
      CASE l_linenumber WHEN 2 THEN CAST(l_quantity AS INTEGER) + 0.5::DOUBLE WHEN 3 THEN NULL WHEN 4 THEN 'Infinity'::DOUBLE WHEN 5 THEN CAST(l_quantity AS INTEGER) * 100::DOUBLE ELSE CAST(l_quantity AS INTEGER)::DOUBLE END AS as_number,
      CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS as_bool FROM lineitem""",
    "vector_attr": """SELECT vec_id, CAST(len(v) AS INTEGER) AS n, CAST(list_sum(v) AS BIGINT) AS total, md5(array_to_string(v, ' ')) AS text FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(abs(x)::FLOAT * 1000::FLOAT) AS BIGINT)) AS v FROM embeddings)""",
    "uint64_exact": "SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS s_ord, CAST(event_id::HUGEINT + 9223372036854775808::HUGEINT AS VARCHAR) AS t FROM events",
    "array_order": "SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS place, event_id, event_type FROM events",
    "escape_roundtrip": "SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM (SELECT doc_id, trim(text, E' \\t\\r\\n') AS t FROM documents)",
    "normalize_compare": "SELECT o_orderkey AS doc_id, o_orderkey % 3 <> 0 AS equal, 9::BIGINT AS lines FROM orders",
    "line_differences": """SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(pos AS INTEGER) AS pos, l AS left, r AS right FROM (
      SELECT c_custkey, 0 AS pos, c_name AS l, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS r FROM customer
      UNION ALL SELECT c_custkey, 2, 'end', CASE WHEN c_custkey % 5 > 0 THEN 'end' ELSE '<missing>' END FROM customer) WHERE l <> r""",
    "ns_registry": """SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 'urn:r:' || (n_regionkey % 2) AS ns_uri, 'p' || (n_nationkey % 4) AS prefix, 'a,k' AS attributes FROM nation""",
    "ns_violations": """WITH b AS (SELECT n_nationkey AS k, 'p' || (n_nationkey % 4) AS p, 'urn:r:' || (n_regionkey % 2) AS u FROM nation
      UNION SELECT n_nationkey, 'p' || (n_nationkey % 3), 'urn:r:' || (n_regionkey % 2) FROM nation UNION SELECT n_nationkey, 'p0', 'urn:z' FROM nation)
      SELECT CAST(k AS VARCHAR) AS doc_id, 'prefix_rebinding' AS rule, p AS name FROM b GROUP BY k, p HAVING count(DISTINCT u) > 1
      UNION ALL SELECT CAST(k AS VARCHAR), 'uri_aliasing', u FROM b GROUP BY k, u HAVING count(DISTINCT p) > 1""",
    "ns_registry_customers": """SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'urn:r:' || (c_nationkey % 2) AS ns_uri, 'p' || (c_custkey % 4) AS prefix, 'a,k' AS attributes FROM customer""",
    "ns_violations_customers": """WITH b AS (SELECT c_custkey AS k, 'p' || (c_custkey % 4) AS p, 'urn:r:' || (c_nationkey % 2) AS u FROM customer
      UNION SELECT c_custkey, 'p' || (c_custkey % 3), 'urn:r:' || (c_nationkey % 2) FROM customer UNION SELECT c_custkey, 'p0', 'urn:z' FROM customer)
      SELECT CAST(k AS VARCHAR) AS doc_id, 'prefix_rebinding' AS rule, p AS name FROM b GROUP BY k, p HAVING count(DISTINCT u) > 1
      UNION ALL SELECT CAST(k AS VARCHAR), 'uri_aliasing', u FROM b GROUP BY k, u HAVING count(DISTINCT p) > 1""",
    "selector_predicates": f"""WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM (SELECT DISTINCT o_custkey, o_orderkey {_REPS}))
      SELECT CAST(o_custkey AS VARCHAR) AS doc_id, max(CASE WHEN k = 2 THEN CAST(o_orderkey AS VARCHAR) END) AS second,
      CAST(nullif(sum(CASE WHEN k = 1 THEN (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') END), 0) AS INTEGER) AS reps FROM p GROUP BY o_custkey""",
    "patch_apply": """WITH o AS (SELECT user_id, count(*) AS n, list([event_type, CAST(event_id AS VARCHAR)] ORDER BY event_id) AS ops, arg_max(event_id, event_id) FILTER (event_type = 'click') AS last_click,
        max(CASE WHEN event_type NOT IN ('signup', 'purchase', 'error', 'click') THEN 'v' END) AS id FROM events GROUP BY user_id),
      r AS (SELECT *, list_reduce(list_prepend(['0', 'a'], ops), lambda s, o: CASE o[1] WHEN 'signup' THEN list_append(s, o[2]) WHEN 'purchase' THEN [s[1], o[2]] || s[2:]
        WHEN 'error' THEN CASE WHEN len(s) > 1 THEN [s[1]] || s[3:] ELSE [CAST(CAST(s[1] AS INTEGER) + 1 AS VARCHAR)] END ELSE s END) AS s FROM o)
      SELECT CAST(user_id AS VARCHAR) AS user_id, last_click, id, CAST(n - CAST(s[1] AS INTEGER) AS INTEGER) AS applied, CAST(s[1] AS INTEGER) AS rejected, array_to_string(s[2:], ',') AS reps FROM r""",
    "patch_reject": f"SELECT c_custkey, c_custkey % {len(SELECTORS)} IN ({_USABLE}) AS applied FROM customer",
    "xlink_resolve": """SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 1 AS nth, n_name AS id, r_name AS start FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey > 1
      UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 2, 'second', NULL FROM nation WHERE n_regionkey = 2""",
    "xlink_manifest": """SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 7 > 0 THEN 'end-' || (c_custkey % 7) || ',' ELSE '' END || 'p2' AS periods, CASE WHEN c_custkey % 7 > 0 THEN 'PT1S' END AS start,
      CASE c_custkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '1,5,6' ELSE '1,7' END AS sets FROM customer""",
    "roundtrip_mixed": "SELECT CAST(c_custkey % 4 AS VARCHAR) AS category, count(*) AS total, count(*) FILTER (c_custkey % 4 IN (0, 3)) AS passed FROM customer GROUP BY ALL",
    "schema_elements": """SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 1 AS metrics, CAST(c_custkey AS BIGINT) AS empty_id, CAST(c_custkey % 3 + 1 AS INTEGER) AS preselections, 3 AS components, CAST(c_custkey AS BIGINT) AS duration, CAST(c_custkey % 2 + 1 AS INTEGER) AS urls FROM customer""",
    "category_report": """WITH r AS (SELECT DISTINCT doc_id, category, success, ms_to_json + ms_to_xml + ms_compare AS ms FROM roundtrip)
      SELECT CASE WHEN grouping(category) = 1 THEN '(all)' ELSE coalesce(category, '(none)') END AS category, count(*) AS total, count(*) FILTER (coalesce(success, false)) AS passed, count(*) FILTER (NOT coalesce(success, false)) AS failed, CAST(sum(coalesce(ms, 0)) AS BIGINT) AS ms FROM r GROUP BY ROLLUP (category)""",
    "malformed_reject": "SELECT 'raw' AS kind, 0::BIGINT AS converted, count(*) AS rejected FROM documents UNION ALL SELECT 'wrapped', count(*), 0 FROM documents",
    "roundtrip_corpus": "SELECT category, count(*) AS total, count(*) AS passed FROM (SELECT DISTINCT doc_id, category, original_mpd FROM roundtrip WHERE original_mpd IS NOT NULL) GROUP BY category",
    "child_reorder": """SELECT c_custkey AS doc_id, local, CAST(old AS INTEGER) AS old, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY rank, old) AS INTEGER) AS new FROM (
      SELECT c_custkey, x.local, x.rank, row_number() OVER (PARTITION BY c_custkey ORDER BY x.seat) AS old FROM customer,
      (VALUES ('x', 9, 1), ('Period', 4, 2), ('UTCTiming', 5, 3), ('BaseURL', 1, 4), ('Period', 4, 5), ('ProgramInformation', 0, 6)) AS x(local, rank, seat) WHERE NOT (x.local = 'UTCTiming' AND c_custkey % 2 = 1))""",
    "facets_errors": """SELECT path, count(*) AS n FROM (
      SELECT unnest([CASE WHEN o_orderkey % 7 = 0 THEN '/@id' END, CASE WHEN o_orderkey % 5 < 2 THEN '/@bandwidth' END, CASE WHEN o_orderkey % 9 > 6 THEN '/@startWithSAP' END, CASE WHEN o_orderkey % 4 = 0 THEN '/@sar' END,
        CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN '/@codingDependency' END, CASE WHEN o_orderkey % 6 = 0 THEN '/@audioSamplingRate' END, CASE WHEN o_orderkey % 8 = 0 THEN '/@maxPlayoutRate' END]) AS path FROM orders) WHERE path IS NOT NULL GROUP BY path""",
    "duration_parse": """SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber WHEN 1 THEN q * 10 WHEN 2 THEN 36000 + q * 600 WHEN 3 THEN -q * 864000 WHEN 4 THEN q * 10 + 5 END AS BIGINT) AS tenths, l_linenumber < 5 AS is_duration FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""",
    "segment_runs": """SELECT CAST(user_id AS VARCHAR) AS doc_id, count(*) AS n, CAST(CAST(sum(d) AS BIGINT) AS VARCHAR) AS total, CAST(max(t + d) AS VARCHAR) AS last FROM (
      SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - t AS d FROM (SELECT user_id, event_id, epoch_us(ts) AS t FROM events)) WHERE d > 0 GROUP BY user_id""",
    "json_minify": "SELECT event_id, regexp_replace(props, '\\s+', '', 'g') AS props FROM events",
    "tag_parts": "SELECT c_custkey, c_name AS a, c_mktsegment AS b, c_mktsegment || ':y' AS local, '<&gt;' || c_name AS decoded FROM customer",
    "url_names": """SELECT c_custkey, c_custkey % 2 = 0 AS mpd, c_custkey % 2 = 1 AS hls, CASE WHEN c_custkey % 2 = 0 THEN 'h.example_a_b_' || c_mktsegment || '_' || c_custkey || '.mpd' ELSE 'h.example_a_b_' || c_mktsegment || '_' || c_custkey || '.m3u8_x_1.mpd' END AS name,
      CASE WHEN c_custkey < 1000 THEN c_custkey || 'ms' ELSE printf('%.2f', c_custkey / 1000) || 's' END AS ms FROM customer""",
    "mpd_json_values": """WITH d AS (SELECT DISTINCT doc_id, mpd::JSON AS j FROM mpd_json), b AS (
      SELECT 'MPD' AS level, unnest(CAST(j->'$.BaseURL' AS JSON[])) AS u FROM d UNION ALL SELECT 'Period', unnest(CAST(p->'$.BaseURL' AS JSON[])) FROM (SELECT unnest(CAST(j->'$.Period' AS JSON[])) AS p FROM d)
      UNION ALL SELECT 'AdaptationSet', unnest(CAST(a->'$.BaseURL' AS JSON[])) FROM (SELECT unnest(CAST(p->'$.AdaptationSet' AS JSON[])) AS a FROM (SELECT unnest(CAST(j->'$.Period' AS JSON[])) AS p FROM d))
      UNION ALL SELECT 'Representation', unnest(CAST(r->'$.BaseURL' AS JSON[])) FROM (SELECT unnest(CAST(a->'$.Representation' AS JSON[])) AS r FROM (SELECT unnest(CAST(p->'$.AdaptationSet' AS JSON[])) AS a FROM (SELECT unnest(CAST(j->'$.Period' AS JSON[])) AS p FROM d))))
      SELECT level, count(*) AS n, count(DISTINCT u->>'$."$value"') AS values FROM b GROUP BY level""",
    "descriptors": """WITH a AS (SELECT unnest(CAST(p->'$.AdaptationSet' AS JSON[])) AS a FROM (SELECT unnest(CAST(j->'$.Period' AS JSON[])) AS p FROM (SELECT DISTINCT doc_id, mpd::JSON AS j FROM mpd_json))),
      x AS (SELECT k AS kind, unnest(CAST(json_extract(a, '$.' || k) AS JSON[])) AS d FROM a, (VALUES ('ContentProtection'), ('EssentialProperty'), ('SupplementalProperty'), ('Role')) AS v(k))
      SELECT kind, count(*) AS n, count(DISTINCT d->>'$.schemeIdUri') AS schemes FROM x GROUP BY kind""",
    "patch_xml": """SELECT c_custkey AS mpd_id, 0 AS op_idx, 'replace' AS op, '/MPD/Period[1]/AdaptationSet[@id=''1'']/@group' AS sel, CAST(c_nationkey AS BIGINT) AS number, NULL AS rep_id, NULL AS ws FROM customer
      UNION ALL SELECT c_custkey, 1, 'add', '/MPD/Period[1]/AdaptationSet[1]', CAST(c_nationkey AS BIGINT), c_name, NULL FROM customer
      UNION ALL SELECT c_custkey, 2, 'remove', '/MPD/Period[1]/BaseURL[1]', NULL, NULL, 'both' FROM customer""",
}
