"""Nested JSON documents: any depth, the order of the text, types, and schemas."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tideline.operators import documents as D, schemas as S

AS_OF = 1_735_689_600_000_000  # 2025-01-01


def table(spark, docs):
    return spark.createDataFrame([(str(i), d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)], "doc string, document string")


def plain_times(data, path=""):
    """Entries under a name of a time, in the order of the text; what lies inside of one is not looked at."""
    if isinstance(data, dict):
        for k, v in data.items():
            at = f"{path}.{k}" if path else k
            if k.lower() in D.TIME_FIELDS:
                yield at, v
            elif isinstance(v, (dict, list)):
                yield from plain_times(v, at)
    elif isinstance(data, list):
        for i, v in enumerate(data):
            yield from plain_times(v, f"{path}[{i}]")


def test_forty_levels(spark):
    deep, want = {"ts": 5, "image": "x"}, []
    for i in range(40):
        deep = {"zz": [deep], "aa": {"Time": i}} if i % 2 else [{"created_at": i, "in": deep}]
    want = [(p, v * 1_000_000) for p, v in plain_times(deep)]
    docs = table(spark, [deep])
    walked = D.walk(docs, "doc", "document")
    got = D.times(walked, "doc").orderBy("place").collect()
    assert [(r["path"], r["us"]) for r in got] == want and len(want) == 41
    media = D.media_issues(walked, "doc", spark.createDataFrame([], "path string, is_file boolean"), "/base").collect()
    assert len(media) == 1 and media[0]["location"].endswith(".image") and media[0]["location"].count("in") == 20


def test_order_is_that_of_the_text(spark):
    docs = table(spark, ['{"ts": "2024-01-02", "m": {"date": "2024-01-01T10"}, "a": {"time": "2024-01-03T00:00:00Z", "b": {"event_time": 1704067200}}}'])
    got = D.time_issues(D.walk(docs, "doc", "document"), docs, "doc", AS_OF).collect()
    assert {(r["message"], r["location"]) for r in got} == {
        ("Out-of-order timestamps: 2024-01-01T10:00:00+00:00 < 2024-01-02T00:00:00+00:00", "m.date (previous: ts)"),
        ("Out-of-order timestamps: 2024-01-01T00:00:00+00:00 < 2024-01-03T00:00:00+00:00", "a.b.event_time (previous: a.time)"),
    }


@pytest.mark.parametrize(
    ("value", "us"),
    [
        (1701432000, 1701432000_000000), (1701432000000, 1701432000_000000), (1701432000.25, 1701432000_250000), (-5, -5_000000), (True, 1_000000), (None, None), (10**18, None), ("1701432000", None), ("", None), ("12:30", None),
        ("2023-12-01", 1701388800_000000), ("20231201T120000Z", 1701432000_000000), ("2023-12-01T12:00", 1701432000_000000), ("2023-12-01 14:00:00.5+02:00", 1701432000_500000), ("2023-12-01T12:00:00.123456789Z", 1701432000_123456), ("2023-13-01", None), ("2023", None), ([1], None), ({"a": 1}, None),
    ],
)
def test_instants(spark, value, us):
    got = D.times(D.walk(table(spark, [{"ts": value}]), "doc", "document"), "doc").collect()
    assert [r["us"] for r in got] == ([] if us is None else [us])


def test_names_inside_a_time_are_not_looked_at_but_media_are(spark):
    docs = table(spark, [{"time": {"ts": 5, "image": "gone.jpg"}, "Video": {"audio": ""}, "images": ["x"], "image": ["y"], "img": 5}])
    walked = D.walk(docs, "doc", "document")
    assert D.times(walked, "doc").count() == 0
    got = D.media_issues(walked, "doc", spark.createDataFrame([], "path string, is_file boolean")).collect()
    assert {(r["location"], r["severity"]) for r in got} == {("time.image", "ERROR"), ("Video.audio", "WARNING")}


def test_media_found_missing_or_no_file(spark):
    docs = table(spark, [{"a": [{"image": "./one.jpg"}, {"image": "/abs/two.jpg"}, {"image": "dir"}, {"image": "no.jpg"}, {"image": "FTP://x"}]}])
    known = spark.createDataFrame([("/base/one.jpg", True), ("/abs/two.jpg", True), ("/base/dir", False)], "path string, is_file boolean")
    got = D.media_issues(D.walk(docs, "doc", "document"), "doc", known, "/base/").collect()
    assert {(r["location"], r["severity"], r["message"]) for r in got} == {
        ("a[2].image", "ERROR", "Path exists but is not a file: dir"), ("a[3].image", "ERROR", "Media file not found: no.jpg"), ("a[4].image", "INFO", "Skipping remote URL validation"),
    }


def test_no_documents_no_json_and_no_times(spark):
    docs = table(spark, ["{bad", None, '{"a": 1, "a": 2}', "5", "[]", {}, {"ts": "x"}, {"ts": 1}])
    walked = D.walk(docs, "doc", "document")
    issues = D.time_issues(walked, docs, "doc", AS_OF)
    assert {r["doc"] for r in issues.filter("message = 'No timestamps found in data' AND severity = 'WARNING' AND location = 'root'").collect()} == set("0123456")
    assert {r["doc"] for r in D.unreadable(docs, "doc", "document").collect()} == {"0", "1", "2"}
    assert D.walk(docs.limit(0), "doc", "document").count() == 0
    report = {r["doc"]: r["valid"] for r in D.report(docs, issues.unionByName(D.unreadable(docs, "doc", "document")), "doc").collect()}
    assert report == {str(i): i > 2 for i in range(8)}


PERSON = {"type": "object", "required": ["person_id", "samples"], "properties": {"person_id": {"type": "string"}, "metadata": {"type": "object"}, "samples": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["sample_id", "timestamp"], "properties": {"sample_id": {"type": "string"}, "timestamp": {"type": "string", "format": "date-time"}, "image": {"type": "string"}}}}}}


@pytest.mark.parametrize(
    ("document", "want"),
    [
        ({"samples": [{"sample_id": 123, "description": "x"}]}, {("root", "'person_id' is a required property"), ("samples.0.sample_id", "123 is not of type 'string'"), ("samples.0", "'timestamp' is a required property")}),
        ({"person_id": "p", "samples": []}, {("samples", "[] should be non-empty")}),
        ({"person_id": None, "metadata": [], "samples": {}}, {("person_id", "None is not of type 'string'"), ("metadata", "[] is not of type 'object'"), ("samples", "{} is not of type 'array'")}),
        ({"person_id": "p", "samples": [{"sample_id": "a", "timestamp": 1701417600000}, {"sample_id": "b", "timestamp": "t", "image": True}]}, {("samples.0.timestamp", "1701417600000 is not of type 'string'"), ("samples.1.image", "True is not of type 'string'")}),
        ([], {("root", "[] is not of type 'object'")}),
    ],
)
def test_person_schema(spark, document, want):
    got = S.schema_issues(table(spark, [document]), "doc", "document", PERSON).collect()
    assert {(r["location"], r["message"]) for r in got} == want


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": "integer"}, [1, 1.0, -3], [1.5, "1", True, None]),
        ({"type": ["number", "null"]}, [1, 1.5, None], ["1", False, []]),
        ({"enum": [1, "a", None, {"k": [1]}]}, [1, 1.0, "a", None, {"k": [1]}], ["1", True, {"k": [2]}]),
        ({"const": "x"}, ["x"], ["y", None]),
        ({"minimum": 2, "exclusiveMaximum": 5}, [2, 4.9, "text"], [1.9, 5]),
        ({"multipleOf": 0.5}, [1, 1.5], [1.2]),
        ({"minLength": 2, "maxLength": 3, "pattern": "^a"}, ["ab", "aüx", 5], ["a", "abcd", "bb"]),
        ({"items": {"items": {"type": "string"}}}, [[], [["a"], []], [5]], [[["a", 1]]]),
        ({"items": [{"type": "string"}, {"type": "number"}], "additionalItems": False}, [["a"], ["a", 1]], [[1], ["a", 1, 2]]),
        ({"uniqueItems": True, "maxItems": 2}, [[1, 2]], [[1, 1], [1, 2, 3]]),
        ({"properties": {"a": {}}, "patternProperties": {"^x": {"type": "number"}}, "additionalProperties": False}, [{"a": 1, "xy": 2}], [{"b": 1}, {"xy": "n"}]),
        ({"additionalProperties": {"type": "boolean"}, "minProperties": 1}, [{"q": True}], [{"q": 1}, {}]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 6, None], [3]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, [3, 5.5], [7, 1.5]),
        ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1, 2], [0, 3]),
        ({"not": {"type": "string"}}, [1], ["a"]),
        ({"definitions": {"n": {"type": "number"}}, "properties": {"it's": {"$ref": "#/definitions/n"}}}, [{"it's": 1}], [{"it's": "1"}]),
        ({"properties": {"a": False}}, [{}], [{"a": None}]),
    ],
)
def test_keywords(spark, schema, good, bad):
    docs = table(spark, [json.dumps(d) for d in (*good, *bad)])
    rows = {r["doc"] for r in S.schema_issues(docs, "doc", "document", schema).collect()}
    assert rows == {str(i) for i in range(len(good), len(good) + len(bad))}


@pytest.mark.parametrize("schema", [{"contains": {}}, {"type": "text"}, {"$ref": "http://a"}, {"definitions": {"a": {"items": {"$ref": "#/definitions/a"}}}, "$ref": "#/definitions/a"}])
def test_what_is_not_compiled_is_an_error(spark, schema):
    with pytest.raises((ValueError, KeyError)):
        S.compiled(schema, F.parse_json(F.lit("1")), F.lit(""))


def test_a_value_is_worked_out_once(spark):
    """The text is parsed at one place of the plan, whatever the schema asks of it."""
    docs = table(spark, [{"a": {"b": 1}}])
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "required": ["c"], "properties": {"b": {"type": "string", "minLength": 2}}}}}
    found = S.schema_issues(docs, "doc", "document", schema)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1
    assert {r["location"] for r in found.collect()} == {"a", "a.b"}
