"""Documents read from files, and those that can't be read."""

import json

from blastradius.sources import artifacts as A

WHOLE = {"nodes": {"model.p.a": {"resource_type": "model", "name": "a", "path": "staging/a.sql", "schema": "s"}}, "sources": {}}


def test_files_are_read_whole_and_failures_are_named(spark, tmp_path):
    texts = {
        "whole": json.dumps(WHOLE, indent=2),
        "cut": json.dumps(WHOLE)[:-3],
        "empty": "",
        "list": json.dumps([WHOLE]),
        "half": json.dumps({"nodes": {}}),
        "other": "{}",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    docs = A.read_documents(spark, f"{tmp_path}/*.json")
    assert [r.id for r in A.manifest_nodes(docs).collect()] == ["dbt:model.p.a"]
    failed = {(r.doc.rsplit("/", 1)[1], r.reason) for r in A.parse_failures(docs, "nodes", "sources").collect()}
    none = "not a JSON object"
    assert failed >= {("cut.json", none), ("list.json", none), ("half.json", "no sources"), ("other.json", "no nodes"), ("other.json", "no sources")}
    assert not [f for f in failed if f[0] == "whole.json"]


def test_null_documents_fail(spark):
    docs = spark.createDataFrame([("d", None)], "doc string, body string")
    assert [tuple(r) for r in A.parse_failures(docs, "nodes").collect()] == [("d", "not a JSON object")]
    assert A.parse_failures(docs.limit(0), "nodes").collect() == []
