import json

import pytest
from pyspark.sql import types as T

from sluice.operators.convert import model
from sluice.schema.json_schema import Options, generate
from sluice.schema.types import coerce, java_pattern, kind, schema_fields, spark_type, struct_of, to_text
from sluice.schema.xsd import Schema

XSD = """<!DOCTYPE s [<!ENTITY d "0-9"><!ENTITY dd "[&d;]{2}">]>
<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:t" xmlns="urn:t">
<xs:element name="R" type="RT"/>
<xs:attributeGroup name="G"><xs:attribute name="g" type="xs:int"/></xs:attributeGroup>
<xs:group name="E"><xs:sequence><xs:element name="one" type="xs:string"/><xs:element ref="many" maxOccurs="3" minOccurs="2"/></xs:sequence></xs:group>
<xs:element name="many" type="ext"/>
<xs:simpleType name="pat"><xs:restriction base="xs:string"><xs:pattern value="&dd;x"/><xs:maxLength value="5"/></xs:restriction></xs:simpleType>
<xs:simpleType name="lst"><xs:list itemType="xs:unsignedInt"/></xs:simpleType>
<xs:simpleType name="lst2"><xs:restriction base="lst"><xs:minLength value="1"/><xs:maxLength value="2"/></xs:restriction></xs:simpleType>
<xs:simpleType name="uni"><xs:union memberTypes="xs:boolean xs:unsignedInt"/></xs:simpleType>
<xs:complexType name="base"><xs:sequence><xs:element name="x" type="xs:double" minOccurs="0"/></xs:sequence><xs:attribute name="id" type="xs:unsignedLong"/><xs:attribute name="gone" type="xs:string"/></xs:complexType>
<xs:complexType name="ext"><xs:complexContent><xs:extension base="base"><xs:choice><xs:element name="p" type="xs:string"/><xs:element name="q" type="xs:string"/></xs:choice><xs:attributeGroup ref="G"/></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="res"><xs:complexContent><xs:restriction base="base"><xs:sequence/><xs:attribute name="gone" use="prohibited"/></xs:restriction></xs:complexContent></xs:complexType>
<xs:complexType name="sc"><xs:simpleContent><xs:extension base="lst2"><xs:attribute name="a" type="uni" default="1"/><xs:attribute name="f" type="xs:string" fixed="z"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:complexType name="RT"><xs:sequence><xs:group ref="E"/><xs:element name="res" type="res" minOccurs="0"/><xs:element name="sc" type="sc"/><xs:element name="self" type="RT" minOccurs="0"/><xs:element name="inl" minOccurs="0"><xs:complexType><xs:attribute name="z" type="pat" use="required"/><xs:anyAttribute/></xs:complexType></xs:element>
<xs:any minOccurs="0"/></xs:sequence></xs:complexType>
</xs:schema>"""


@pytest.fixture(scope="module")
def schema():
    return Schema([], text=XSD)


def test_constructs(schema):
    r = schema.root("R")
    assert list(r.children) == ["one", "many", "res", "sc", "self", "inl"] and r.any_element
    assert r.children["many"].many and (r.children["many"].least, r.children["many"].most) == (2, 3)
    ext = schema.complex("ext")
    assert list(ext.children) == ["x", "p", "q"] and list(ext.attributes) == ["id", "gone", "g"] and ext.base == "base"
    assert ext.children["p"].choice == ext.children["q"].choice and ext.children["p"].least == 0
    assert list(schema.complex("res").attributes) == ["id"]
    sc = schema.complex("sc")
    assert kind(sc.content) == "list" and dict(sc.content.facets) == {"minLength": "1", "maxLength": "2"} and sc.attributes["f"].fixed == "z"
    z = schema.complex("RT.inl").attributes["z"]
    assert z.required and z.type.patterns == ("[0-9]{2}x",) and java_pattern(z.type.patterns[0]) == "^(?:[0-9]{2}x)$"


def test_spark_types(schema):
    t = struct_of(schema, schema.root("R"))
    assert t["many"].dataType.elementType["id"].dataType == T.DecimalType(20, 0) and t["sc"].dataType["$value"].dataType == T.ArrayType(T.LongType())
    assert isinstance(t["self"].dataType, T.StructType) or isinstance(t["self"].dataType, T.StringType)
    text = struct_of(schema, schema.root("R"), leaves="text")
    assert text["many"].dataType.elementType["id"].dataType == T.StringType()
    names = {"long": T.LongType(), "unsignedInt": T.LongType(), "int": T.IntegerType(), "unsignedShort": T.IntegerType(), "byte": T.ByteType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "decimal": T.DecimalType(38, 18), "integer": T.DecimalType(38, 0), "duration": T.StringType()}
    for n, want in names.items():
        assert spark_type(schema.simple(n)) == want, n


def test_coercion(schema):
    s = schema.simple
    assert coerce(" 1 ", s("boolean")) is True and coerce("18446744073709551615", s("unsignedLong")) == 2**64 - 1
    assert coerce("1e3", s("double")) == 1000 and coerce("INF", s("double")) == "INF" and coerce("5.0", s("double")) == 5 and coerce("0.5", s("double")) == 0.5
    assert coerce(" 1  2 ", s("lst")) == [1, 2] and coerce("true", s("uni")) is True and coerce("7", s("uni")) == 7 and coerce("z", s("uni")) == "z"
    for text, name in (("yes", "boolean"), ("1.0", "int"), ("12abc", "double"), ("", "double"), ("1 x", "lst")):
        with pytest.raises(ValueError):
            coerce(text, s(name))
    assert [to_text(v) for v in (True, 5.0, 0.5, [1, 2], "x", 2**64)] == ["true", "5", "0.5", "1 2", "x", str(2**64)]


def test_json_schema(schema):
    out = generate(schema, "R", Options(base_uri="urn:x"))
    defs = out["$defs"]
    assert out["$id"] == "urn:x" and out["$ref"] == "#/$defs/RT"
    assert defs["ext"]["allOf"][0] == {"$ref": "#/$defs/base"} and {"not": {"required": ["p", "q"]}} in defs["ext"]["allOf"]
    assert defs["sc"]["properties"]["$value"] == {"type": "array", "items": {"type": "integer", "minimum": 0, "maximum": 2**32 - 1}, "minItems": 1, "maxItems": 2} and defs["sc"]["required"] == ["$value"]
    assert defs["sc"]["properties"]["f"]["const"] == "z" and defs["sc"]["properties"]["a"]["default"] is True
    assert defs["RT"]["properties"]["many"] == {"type": "array", "items": {"$ref": "#/$defs/ext"}, "minItems": 2, "maxItems": 3}
    assert defs["RT.inl"]["properties"]["z"] == {"type": "string", "maxLength": 5, "pattern": "^(?:[0-9]{2}x)$", "x-xml-attribute": True} and defs["RT"]["x-xml-any"]
    assert "x-xml-attribute" not in json.dumps(generate(schema, "R", Options(mark_attributes=False)))
    json.dumps(generate_core())


def generate_core():
    from pathlib import Path

    import sluice.schema

    return generate(Schema(str(Path(sluice.schema.__file__).parent / "core.xsd")), "MPD")


def test_fields_are_typed_by_path(schema):
    rows = {r[0]: r for r in schema_fields(schema, "R")}
    assert rows["R/many/@id"][4] == "unsignedLong" and rows["R/sc/$value"][3] == "content" and rows["R/many"][6] is True
    core = model()
    assert core.types["AdaptationSetType"].attributes["id"].type.base == "unsignedInt" and core.types["RepresentationType"].attributes["id"].type.base == "string"


def test_imports(tmp_path):
    (tmp_path / "b.xsd").write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:import namespace="u" schemaLocation="http://h/c.xsd"/><xs:simpleType name="B"><xs:restriction base="xs:int"/></xs:simpleType></xs:schema>')
    (tmp_path / "c.xsd").write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:include schemaLocation="a.xsd"/><xs:attribute name="href" type="xs:anyURI"/></xs:schema>')
    (tmp_path / "a.xsd").write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:include schemaLocation="b.xsd"/><xs:element name="A"><xs:complexType><xs:attribute name="v" type="B"/><xs:attribute ref="k:href" default="d"/></xs:complexType></xs:element></xs:schema>')
    a = Schema(str(tmp_path / "a.xsd")).root("A")
    assert a.attributes["v"].type.base == "int" and a.attributes["k:href"].namespace == "k" and a.attributes["k:href"].default == "d"


def test_repeating_choice_is_one_array_of_operations():
    from sluice.schema.json_schema import generate
    from sluice.schema.xsd import Schema

    text = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="Log" type="LogType"/>
      <xs:complexType name="LogType"><xs:choice minOccurs="1" maxOccurs="unbounded"><xs:element name="put" type="xs:int"/><xs:element name="drop" type="xs:string"/><xs:any namespace="##other"/></xs:choice><xs:attribute name="k" type="xs:int"/></xs:complexType></xs:schema>"""
    got = generate(Schema([], text), "Log")["$defs"]["LogType"]
    items = got["properties"]["operations"]["items"]["oneOf"]
    assert [next(iter(i["properties"])) for i in items[:2]] == ["put", "drop"] and items[2]["not"] == {"anyOf": [{"required": ["put"]}, {"required": ["drop"]}]}
    assert got["properties"]["operations"]["minItems"] == 1 and "operations" in got["required"] and "put" not in got["properties"] and "k" in got["properties"]
