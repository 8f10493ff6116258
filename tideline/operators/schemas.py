"""JSON Schema (draft 7), compiled into one projection over VARIANT.

Each keyword becomes a column that is an array of issues; nested schemas nest them, items of an array through
``transform``. So a document is read once, in the JVM, whatever the schema asks. A keyword that isn't known is an error
when it is compiled, instead of a rule that never fails.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F

from tideline.operators.documents import kind_of
from tideline.operators.integrity import issue

#: Keywords that say nothing about validity.
SILENT = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "definitions", "readOnly", "writeOnly", "contentEncoding", "contentMediaType"}
FOUND = "array<struct<location:string, message:string>>"


def _none() -> Column:
    return F.array().cast(FOUND)


def _when(bad: Column, location: Column, message: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(F.when(location == "", "root").otherwise(location).alias("location"), message.alias("message")))).otherwise(_none())


def _bound(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once, however often it is named there."""
    return F.transform(F.array(value), of)[0]


def _below(location: Column, step: Column) -> Column:
    return F.when(location == "", step).otherwise(F.concat(location, F.lit("."), step))


def _step(name: str) -> str:
    return f"$['{name}']" if "'" not in name else f'$["{name}"]'


def quoted(value) -> str:
    """As issues show a value: text in single quotes."""
    return f"'{value}'" if isinstance(value, str) else {True: "True", False: "False", None: "None"}[value] if value is None or isinstance(value, bool) else json.dumps(value)


def shown(value: Column) -> Column:
    """A value in a message: text in single quotes, None, True and False, numbers and containers as JSON."""
    kind, text = kind_of(value), F.to_json(value)
    words = F.when(text == "true", "True").when(text == "false", "False")
    return F.when(kind == "string", F.concat(F.lit("'"), F.try_variant_get(value, "$", "string"), F.lit("'"))).when(kind == "null", "None").when(kind == "boolean", words).otherwise(text)


def _is(value: Column, kind: str) -> Column:
    if kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        return (kind_of(value) == "number") & (number == F.floor(number))
    if kind not in ("object", "array", "string", "boolean", "null", "number"):
        raise ValueError(f"not a type: {kind}")
    return kind_of(value) == kind


def _equal(value: Column, wanted) -> Column:
    """Whether a value is that of the schema; numbers by size, containers by their JSON with sorted keys."""
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return (kind_of(value) == "number") & (F.try_variant_get(value, "$", "double") == float(wanted))
    if isinstance(wanted, str):
        return (kind_of(value) == "string") & (F.try_variant_get(value, "$", "string") == wanted)
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def compiled(schema, value: Column, location: Column, root: dict | None = None, seen: tuple = ()) -> Column:
    """Issues of ``value`` (a VARIANT, null where it is absent) as an array of ``location message``."""
    root = schema if root is None else root
    if schema is True or schema == {}:
        return _none()
    if schema is False:
        return _when(value.isNotNull(), location, F.concat(F.lit("False schema does not allow "), shown(value)))
    if "$ref" in schema:
        name = schema["$ref"]
        if name in seen or not name.startswith("#/"):
            raise ValueError(f"neither recursive nor remote references are compiled: {name}")
        target = root
        for step in name[2:].split("/"):
            target = target[step.replace("~1", "/").replace("~0", "~")]
        return compiled(target, value, location, root, (*seen, name))
    nested = lambda s, v, at: compiled(s, v, at, root, seen)
    fails = lambda s: F.size(nested(s, value, location)) > 0
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    items, members = F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$", "map<string,variant>")
    of = lambda kind, bad: _is(value, kind) & bad
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    out = []
    for word, rule in schema.items():
        if word in SILENT or word == "additionalItems" and not isinstance(schema.get("items"), list):
            continue
        if word == "type":
            kinds = [rule] if isinstance(rule, str) else rule
            fine = _is(value, kinds[0])
            for kind in kinds[1:]:
                fine = fine | _is(value, kind)
            out.append(_when(value.isNotNull() & ~fine, location, said(shown(value), " is not of type ", ", ".join(quoted(k) for k in kinds))))
        elif word in ("enum", "const"):
            wanted = rule if word == "enum" else [rule]
            fine = F.lit(False)
            for w in wanted:
                fine = fine | _equal(value, w)
            tail = f" is not one of [{', '.join(quoted(w) for w in wanted)}]" if word == "enum" else f"{quoted(rule)} was expected"
            out.append(_when(value.isNotNull() & ~fine, location, said(shown(value), tail) if word == "enum" else F.lit(tail)))
        elif word == "required":
            for name in rule:
                out.append(_when(of("object", F.try_variant_get(value, _step(name), "variant").isNull()), location, F.lit(f"{quoted(name)} is a required property")))
        elif word == "properties":
            for name, inner in rule.items():
                out.append(_bound(F.try_variant_get(value, _step(name), "variant"), lambda v: nested(inner, v, _below(location, F.lit(name)))))  # noqa: B023
        elif word == "additionalProperties":
            known, patterns = list(schema.get("properties", ())), list(schema.get("patternProperties", ()))
            extra = lambda k: ~k.isin(known) & ~k.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else ~k.isin(known)  # noqa: B023, E731
            others = F.map_filter(members, lambda k, _: extra(k))
            if rule is False:
                names = F.array_join(F.transform(F.array_sort(F.map_keys(others)), lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", ")
                verb = F.when(F.size(others) == 1, " was unexpected)").otherwise(" were unexpected)")
                out.append(_when(of("object", F.size(others) > 0), location, said("Additional properties are not allowed (", names, verb)))
            elif rule is not True:
                deeper = F.flatten(F.transform(F.map_entries(others), lambda e: nested(rule, e["value"], _below(location, e["key"]))))  # noqa: B023
                out.append(F.when(_is(value, "object"), deeper).otherwise(_none()))
        elif word == "patternProperties":
            for pattern, inner in rule.items():
                hit = F.map_entries(F.map_filter(members, lambda k, _: k.rlike(pattern)))  # noqa: B023
                deeper = F.flatten(F.transform(hit, lambda e: nested(inner, e["value"], _below(location, e["key"]))))  # noqa: B023
                out.append(F.when(_is(value, "object"), deeper).otherwise(_none()))
        elif word == "items":
            if isinstance(rule, list):
                for i, inner in enumerate(rule):
                    out.append(nested(inner, F.try_variant_get(value, f"$[{i}]", "variant"), _below(location, F.lit(str(i)))))
                rest, first = schema.get("additionalItems", True), len(rule)
            else:
                rest, first = rule, 0
            if rest is not True:
                deeper = F.flatten(F.transform(items, lambda v, i: F.when(i >= first, nested(rest, v, _below(location, i.cast("string")))).otherwise(_none())))  # noqa: B023
                out.append(F.when(_is(value, "array"), deeper).otherwise(_none()))
        elif word == "additionalItems":
            continue  # with the list of items
        elif word == "minItems":
            out.append(_when(of("array", F.size(items) < rule), location, said(shown(value), " should be non-empty" if rule == 1 else " is too short")))
        elif word == "maxItems":
            out.append(_when(of("array", F.size(items) > rule), location, said(shown(value), " is too long")))
        elif word == "uniqueItems":
            if rule:
                out.append(_when(of("array", F.size(F.array_distinct(F.transform(items, lambda v: F.to_json(v)))) < F.size(items)), location, said(shown(value), " has non-unique elements")))
        elif word == "minLength":
            out.append(_when(of("string", F.length(text) < rule), location, said(shown(value), " should be non-empty" if rule == 1 else " is too short")))
        elif word == "maxLength":
            out.append(_when(of("string", F.length(text) > rule), location, said(shown(value), " is too long")))
        elif word == "pattern":
            re.compile(rule)
            out.append(_when(of("string", ~text.rlike(rule)), location, said(shown(value), f" does not match {quoted(rule)}")))
        elif word in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            bad, tail = {
                "minimum": (number < rule, " is less than the minimum of "), "maximum": (number > rule, " is greater than the maximum of "),
                "exclusiveMinimum": (number <= rule, " is less than or equal to the minimum of "), "exclusiveMaximum": (number >= rule, " is greater than or equal to the maximum of "),
            }[word]
            out.append(_when(of("number", bad), location, said(shown(value), f"{tail}{quoted(rule)}")))
        elif word == "multipleOf":
            out.append(_when(of("number", number / rule != F.floor(number / rule)), location, said(shown(value), f" is not a multiple of {quoted(rule)}")))
        elif word in ("minProperties", "maxProperties"):
            bad, tail = (F.size(members) < rule, " does not have enough properties") if word == "minProperties" else (F.size(members) > rule, " has too many properties")
            out.append(_when(of("object", bad), location, said(shown(value), tail)))
        elif word == "allOf":
            out += [nested(s, value, location) for s in rule]
        elif word == "anyOf":
            bad = F.lit(True)
            for s in rule:
                bad = bad & fails(s)
            out.append(_when(value.isNotNull() & bad, location, said(shown(value), " is not valid under any of the given schemas")))
        elif word == "oneOf":
            fine = sum((F.when(fails(s), 0).otherwise(1) for s in rule), F.lit(0))
            out.append(_when(value.isNotNull() & (fine == 0), location, said(shown(value), " is not valid under any of the given schemas")))
            out.append(_when(value.isNotNull() & (fine > 1), location, said(shown(value), " is valid under each of several of the given schemas")))
        elif word == "not":
            out.append(_when(value.isNotNull() & ~fails(rule), location, said(shown(value), " should not be valid under the given schema")))
        else:
            raise ValueError(f"keyword of a schema that isn't compiled: {word}")
    return F.concat(*out) if out else _none()


def schema_issues(rows: DataFrame, key: str, document: str, schema: dict) -> DataFrame:
    """``key severity category message location`` for each broken rule of each document that is JSON."""
    found = _bound(F.try_parse_json(document), lambda v: compiled(schema, v, F.lit("")))
    got = rows.select(key, F.explode(found).alias("__found"))
    return got.select(key, *issue("ERROR", "schema", F.col("__found.message"), F.col("__found.location")))
