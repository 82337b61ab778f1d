"""Command line: ``python -m sluice mpd2json|json2mpd|roundtrip|patch2json|apply|xsd2jsonschema ...`` over files or folders."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sluice")
    p.add_argument("mode", choices=("mpd2json", "json2mpd", "roundtrip", "patch2json", "apply", "xsd2jsonschema"))
    p.add_argument("input", help="a file, or for batch modes a folder or glob")
    p.add_argument("output", nargs="?", help="a folder; standard output without it (a file for xsd2jsonschema)")
    p.add_argument("--schema", help="manifest XSD; the built-in core schema without it")
    p.add_argument("--patch", help="XML patch document, for apply")
    p.add_argument("--root", default="MPD")
    p.add_argument("--minified", action="store_true")
    p.add_argument("--gzip", action="store_true")
    p.add_argument("--only", help="pattern of base names")
    a = p.parse_args(args)

    from sluice.operators import convert

    if a.mode == "xsd2jsonschema":
        from sluice.schema.json_schema import generate
        from sluice.schema.xsd import Schema

        text = json.dumps(generate(Schema(a.input), a.root), indent=2)
        Path(a.output).write_text(text) if a.output else print(text)
        return 0
    types = convert.model(a.schema)
    if a.mode in ("patch2json", "apply"):
        from sluice.operators.patchdoc import apply_patch, convert_patch

        if a.mode == "patch2json":
            print(convert.dumps(convert_patch(Path(a.input).read_text("utf-8"), types), not a.minified))
            return 0
        doc = convert.read_json(Path(a.input).read_text("utf-8")) if a.input.endswith(".json") else convert.xml_to_json(Path(a.input).read_text("utf-8"), types)[0]
        out, _, why = apply_patch(doc, convert_patch(Path(a.patch).read_text("utf-8"), types)["operations"], types)
        print(convert.dumps(out, not a.minified))
        if why:
            print(why, file=sys.stderr)
        return int(why is not None)

    from pyspark.sql import SparkSession

    from sluice.operators.roundtrip import failures, report, validate_roundtrip
    from sluice.sources.manifests import read_json_manifests, read_manifests, write_json, write_named, write_xml

    spark = SparkSession.builder.appName("sluice").getOrCreate()
    if a.mode == "json2mpd":
        rows = convert.to_xml(read_json_manifests(spark, a.input), schema=types)
        if a.output:
            write_xml(rows.where("xml is not null"), a.output, minified=a.minified, gzip=a.gzip)
    else:
        rows = read_manifests(spark, a.input, only=a.only)
        if a.mode == "roundtrip":
            from sluice.session import cut

            done = cut(validate_roundtrip(rows, schema=types).selectExpr("category", "doc_id", "success", "error", "ms_to_json + ms_to_xml AS ms", "json", "regenerated"))
            if a.output:
                write_named(done, a.output, json=".json", regenerated="-regenerated.mpd").count()
            _print(report(done).orderBy("category"))
            return int(_print(failures(done).orderBy("category", "doc_id")) > 0)
        rows = convert.to_json(rows, schema=types, pretty=not a.minified)
        if a.output:
            write_json(rows.where("json is not null"), a.output, minified=a.minified, gzip=a.gzip)
    bad = rows.where("error is not null").select("doc_id", "error")
    if not a.output:
        _print(rows.where("error is null").select("doc_id", "xml" if a.mode == "json2mpd" else "json"))
    return int(_print(bad, sys.stderr) > 0)


def _print(rows, to=None) -> int:
    """All rows as lines of their columns, partition after partition; how many there were."""
    n = 0
    for n, r in enumerate(rows.toLocalIterator(), 1):
        print(*r, sep="\t", file=to)
    return n


if __name__ == "__main__":
    sys.exit(main())
