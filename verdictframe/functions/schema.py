"""JSON Schema checks of VARIANT values.

A schema that the library itself states (the item record) becomes column expressions; it may use type,
enum, const, required, properties, additionalProperties (false), items, pattern, minLength, maxLength,
minimum, maximum, minItems and maxItems, and any other keyword is an error while the plan is built.

Schemas that come as data, one text in each row, are checked by one vectorised function however many there
are, so the verdict of a row never depends on other rows. It knows the validation keywords of draft 2020-12, references
by name and by ``$id`` within the text, dynamic ones and unevaluated parts as well; other words are notes. A text that is
no schema, or gives a keyword an argument of the wrong kind, fails its own rows with the message ``$: unusable schema`` and no others.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache
from urllib.parse import unquote, urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

COMPILED = frozenset(
    "type enum const required properties additionalProperties items pattern minLength maxLength minimum maximum minItems maxItems".split()
)
NOTES = frozenset("$schema $id $comment title description default examples format".split())


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_type(v: Column, kind: str) -> Column:
    if kind == "object":
        return _fields(v).isNotNull()
    if kind == "array":
        return F.try_variant_get(v, "$", "array<variant>").isNotNull()
    t = F.schema_of_variant(v)
    number = t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
    if kind == "string":
        test = t == "STRING"
    elif kind == "boolean":
        test = t == "BOOLEAN"
    elif kind == "null":
        test = t == "VOID"
    elif kind == "number":
        test = number
    elif kind == "integer":
        as_double = F.try_variant_get(v, "$", "double")
        test = (t == "BIGINT") | (number & (as_double == F.floor(as_double)))
    else:
        raise ValueError(f"unknown JSON type {kind}")
    return F.coalesce(test, F.lit(False))


def _member(v: Column, name: str) -> Column:
    """Field of an object without building its map; names that a path cannot quote use the map."""
    if re.fullmatch(r"[^\"'\\\[\]]+", name):
        return F.try_variant_get(v, f'$["{name}"]', "variant")
    return F.try_element_at(_fields(v), F.lit(name))


def _text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _collect(schema: Mapping[str, object], v: Column, path: str) -> list[tuple[Column, str]]:
    checks: list[tuple[Column, str]] = []
    unknown = schema.keys() - COMPILED - NOTES
    if unknown or isinstance(schema.get("additionalProperties"), Mapping):
        raise ValueError(f"not compiled: {sorted(unknown) or 'additionalProperties as a schema'}")

    def add(violated: Column, message: str) -> None:
        checks.append((v.isNotNull() & F.coalesce(violated, F.lit(False)), f"{path}: {message}"))

    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = F.lit(False)
        for kind in kinds:
            fits = fits | _is_type(v, kind)
        add(~fits, "type " + "|".join(kinds))
    if "enum" in schema:
        add(~F.to_json(v).isin(*[_text(e) for e in schema["enum"]]), "enum")
    if "const" in schema:
        add(F.to_json(v) != _text(schema["const"]), "const")

    if {"pattern", "minLength", "maxLength"} & schema.keys():
        text, is_text = F.try_variant_get(v, "$", "string"), _is_type(v, "string")
        if "pattern" in schema:
            add(is_text & ~text.rlike(schema["pattern"]), "pattern")
        if "minLength" in schema:
            add(is_text & (F.length(text) < schema["minLength"]), "minLength")
        if "maxLength" in schema:
            add(is_text & (F.length(text) > schema["maxLength"]), "maxLength")
    if {"minimum", "maximum"} & schema.keys():
        number, is_number = F.try_variant_get(v, "$", "double"), _is_type(v, "number")
        if "minimum" in schema:
            add(is_number & (number < schema["minimum"]), "minimum")
        if "maximum" in schema:
            add(is_number & (number > schema["maximum"]), "maximum")
    if {"items", "minItems", "maxItems"} & schema.keys():
        array, is_array = F.try_variant_get(v, "$", "array<variant>"), _is_type(v, "array")
        if "minItems" in schema:
            add(is_array & (F.size(array) < schema["minItems"]), "minItems")
        if "maxItems" in schema:
            add(is_array & (F.size(array) > schema["maxItems"]), "maxItems")
        if schema.get("items"):
            add(is_array & F.exists(array, lambda e: _any_violated(schema["items"], e)), "items")

    if {"required", "properties", "additionalProperties"} & schema.keys():
        fields = _fields(v)
        is_object = fields.isNotNull()
        for name in schema.get("required", []):
            add(is_object & _member(v, name).isNull(), f"required {name}")
        known = schema.get("properties", {})
        if schema.get("additionalProperties") is False:
            present = F.lit(0)
            for name in known:
                present = present + _member(v, name).isNotNull().cast("int")
            add(is_object & (F.size(fields) > present), "additionalProperties")
        for name in sorted(known):
            if isinstance(known[name], Mapping) and known[name]:
                checks += _collect(known[name], _member(v, name), f"{path}.{name}")
    return checks


def _any_violated(schema: Mapping[str, object], v: Column) -> Column:
    out = F.lit(False)
    for violated, _ in _collect(schema, v, "$"):
        out = out | violated
    return out


def violated(schema: Mapping[str, object], v: Column) -> Column:
    """True when the value breaks the schema. Plain boolean code, much cheaper than the messages."""
    return _any_violated(schema, v)


def _no_messages() -> Column:
    return F.array().cast("array<string>")


def violations(schema: Mapping[str, object], v: Column) -> Column:
    """Array of messages, in path order; empty when the value conforms."""
    checks = _collect(schema, v, "$")
    if not checks:
        return _no_messages()
    listed = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))
    return F.when(_any_violated(schema, v), listed).otherwise(_no_messages())


class UnusableSchema(Exception):
    """The schema itself is at fault, whatever the value."""


def _same(a: object, b: object) -> bool:
    """JSON equality: numbers by value, ``true`` is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def _is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


TYPES: dict[str, Callable[[object], bool]] = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "number": _is_number,
    "integer": lambda v: _is_number(v) and (isinstance(v, int) or v.is_integer()),
}


@lru_cache(maxsize=4096)
def _pattern(text: str) -> re.Pattern[str]:
    try:
        return re.compile(text)
    except re.error as fault:
        raise UnusableSchema(text) from fault


def _multiple(value: float, step: float) -> bool:
    if isinstance(value, int) and isinstance(step, int):
        return value % step == 0
    ratio = value / step
    return math.isfinite(ratio) and abs(ratio - round(ratio)) < 1e-9 * max(1.0, abs(ratio))


#: What the argument of each keyword has to be. Keywords that are not here are notes.
KINDS: dict[str, str] = {
    **dict.fromkeys("properties patternProperties $defs definitions dependentSchemas".split(), "schemas by name"),
    **dict.fromkeys("additionalProperties items contains propertyNames not if then else unevaluatedProperties unevaluatedItems".split(), "schema"),
    **dict.fromkeys("allOf anyOf oneOf prefixItems".split(), "schemas"),
    **dict.fromkeys("minLength maxLength minItems maxItems minProperties maxProperties minContains maxContains".split(), "count"),
    **dict.fromkeys("minimum maximum exclusiveMinimum exclusiveMaximum".split(), "number"),
    **dict.fromkeys("pattern $ref $dynamicRef $anchor $dynamicAnchor $id".split(), "text"),
    "multipleOf": "step", "uniqueItems": "flag", "required": "names", "dependentRequired": "names by name", "type": "types", "enum": "values",
}

PLACES = {word: i for i, word in enumerate(KINDS)}
#: The schemas within an argument.
PARTS: dict[str, Callable] = {"schema": lambda v: [v], "schemas": list, "schemas by name": lambda v: list(v.values())}


def _names(v: object) -> bool:
    return isinstance(v, list) and all(isinstance(x, str) for x in v)


FITS_KIND: dict[str, Callable[[object], bool]] = {
    "schema": lambda v: isinstance(v, (bool, dict)),
    "schemas": lambda v: isinstance(v, list) and bool(v),
    "schemas by name": lambda v: isinstance(v, dict),
    "count": lambda v: _is_number(v) and v >= 0 and v == int(v),
    "number": _is_number,
    "step": lambda v: _is_number(v) and v > 0,
    "text": lambda v: isinstance(v, str),
    "flag": lambda v: isinstance(v, bool),
    "names": _names,
    "names by name": lambda v: isinstance(v, dict) and all(map(_names, v.values())),
    "types": lambda v: (v in TYPES) if isinstance(v, str) else _names(v) and bool(v) and all(k in TYPES for k in v),
    "values": lambda v: isinstance(v, list),
}


def _distinct(value: object) -> object:
    """A key that is equal for equal JSON values only."""
    if isinstance(value, bool) or value is None:
        return (type(value).__name__, value)
    if isinstance(value, list):
        return ("list", *map(_distinct, value))
    if isinstance(value, dict):
        return ("dict", frozenset((k, _distinct(v)) for k, v in value.items()))
    return ("text", value) if isinstance(value, str) else ("number", value)


BESIDE = frozenset("$ref $dynamicRef allOf if dependentSchemas".split())


class _Check:
    """Violations of a value, path by path; ``root`` is the whole schema, whose parts and names are looked through once."""

    def __init__(self, root: object) -> None:
        self.resources: dict[str, object] = {}
        self.anchors: dict[tuple[str, str], object] = {}
        self.dynamic: dict[tuple[str, str], object] = {}
        self.base: dict[int, str] = {}
        self.scope: list[str] = []
        self.root = root
        self._look(root, "", True)

    def _look(self, schema: object, base: str, whole: bool = False) -> None:
        if isinstance(schema, bool):
            return
        if not isinstance(schema, Mapping):
            raise UnusableSchema(str(schema))
        words = sorted(schema.keys() & KINDS.keys(), key=PLACES.__getitem__)
        for word in words:
            if not FITS_KIND[KINDS[word]](schema[word]):
                raise UnusableSchema(word)
        if whole and "$id" not in schema:
            self.resources[base] = schema
        elif "$id" in schema:
            base = urldefrag(urljoin(base, schema.get("$id", ""))).url
            self.resources[base] = schema
            if whole:
                self.resources.setdefault("", schema)
        self.base[id(schema)] = base
        for word, names in (("$anchor", self.anchors), ("$dynamicAnchor", self.anchors), ("$dynamicAnchor", self.dynamic)):
            if word in schema:
                names[base, schema[word]] = schema
        for word in words:
            parts = PARTS.get(KINDS[word])
            for part in parts(schema[word]) if parts else ():
                self._look(part, base)

    def target(self, ref: str, schema: Mapping[str, object]) -> object:
        base = self.base.get(id(schema), "")
        url, fragment = urldefrag(urljoin(base, ref)) if not ref.startswith("#") else (base, ref[1:])
        if url not in self.resources:
            raise UnusableSchema(ref)
        if fragment and not fragment.startswith("/"):
            if (url, fragment) not in self.anchors:
                raise UnusableSchema(ref)
            return self.anchors[url, fragment]
        at = self.resources[url]
        for part in unquote(fragment).split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            try:
                at = at[int(part)] if isinstance(at, list) else at[part]
            except (KeyError, IndexError, ValueError, TypeError) as fault:
                raise UnusableSchema(ref) from fault
        return at

    def dynamic_target(self, ref: str, schema: Mapping[str, object]) -> object:
        """As a plain reference, unless it leads to a dynamic anchor: then the outermost resource in use that has one of that name."""
        found, name = self.target(ref, schema), ref.partition("#")[2]
        if isinstance(found, Mapping) and found.get("$dynamicAnchor") == name:
            return next((self.dynamic[base, name] for base in self.scope if (base, name) in self.dynamic), found)
        return found

    def fits(self, schema: object, value: object) -> bool:
        found = self.all(schema, value, "$")
        try:
            return next(found, None) is None
        finally:
            found.close()

    def all(self, schema: object, value: object, path: str) -> Iterator[str]:
        if schema is True:
            return
        if schema is False:
            yield f"{path}: false"
            return
        if not isinstance(schema, Mapping):
            raise UnusableSchema(str(schema))
        self.scope.append(self.base.get(id(schema), ""))
        try:
            for message in self.own(schema, value):
                yield f"{path}: {message}"
            if isinstance(value, dict):
                yield from self.members(schema, value, path)
            if not BESIDE.isdisjoint(schema):
                for part in self.beside(schema, value):
                    yield from self.all(part, value, path)
            if "unevaluatedProperties" in schema or "unevaluatedItems" in schema:
                yield from self.unevaluated(schema, value, path)
        finally:
            self.scope.pop()

    def beside(self, schema: Mapping[str, object], value: object) -> Iterator[object]:
        """Schemas that the value itself has to fit as well."""
        if "$ref" in schema:
            yield self.target(schema["$ref"], schema)
        if "$dynamicRef" in schema:
            yield self.dynamic_target(schema["$dynamicRef"], schema)
        yield from schema.get("allOf", [])
        if "if" in schema:
            branch = "then" if self.fits(schema["if"], value) else "else"
            if branch in schema:
                yield schema[branch]
        if isinstance(value, dict):
            yield from (part for name, part in schema.get("dependentSchemas", {}).items() if name in value)

    def unevaluated(self, schema: Mapping[str, object], value: object, path: str) -> Iterator[str]:
        for word, kind in (("unevaluatedProperties", dict), ("unevaluatedItems", list)):
            if word in schema and isinstance(value, kind):
                seen = self.seen({k: v for k, v in schema.items() if k != word}, value, schema)
                rest = [value[k] for k in (value if kind is dict else range(len(value))) if k not in seen]
                if not all(self.fits(schema[word], v) for v in rest):
                    yield f"{path}: {word}"

    def seen(self, schema: object, value: dict | list, place: Mapping[str, object] | None = None) -> set:
        """Names or numbers of the parts of ``value`` that the schema, or one that it applies with success, says something of."""
        if not isinstance(schema, Mapping):
            return set()
        self.base.setdefault(id(schema), self.base.get(id(place), ""))
        own: set = set()
        if isinstance(value, dict):
            known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
            own = {n for n in value if n in known or any(_pattern(p).search(n) for p in patterns)}
            if "additionalProperties" in schema or "unevaluatedProperties" in schema:
                own = set(value)
        else:
            own = set(range(len(schema.get("prefixItems", []))))
            if "items" in schema or "unevaluatedItems" in schema:
                own = set(range(len(value)))
            elif "contains" in schema:
                own |= {i for i, v in enumerate(value) if self.fits(schema["contains"], v)}
        parts = [*self.beside(schema, value), *(x for word in ("anyOf", "oneOf") for x in schema.get(word, []) if self.fits(x, value))]
        if "if" in schema and self.fits(schema["if"], value):
            parts.append(schema["if"])
        return own.union(*(self.seen(x, value) for x in parts if x is not False))

    def own(self, schema: Mapping[str, object], value: object) -> Iterator[str]:
        if "type" in schema:
            kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            if not any(TYPES[k](value) for k in kinds):
                yield "type " + "|".join(kinds)
        if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
            yield "enum"
        if "const" in schema and not _same(value, schema["const"]):
            yield "const"
        if isinstance(value, str):
            if "pattern" in schema and not _pattern(schema["pattern"]).search(value):
                yield "pattern"
            if len(value) < schema.get("minLength", 0):
                yield "minLength"
            if len(value) > schema.get("maxLength", len(value)):
                yield "maxLength"
        if _is_number(value):
            if value < schema.get("minimum", value):
                yield "minimum"
            if value > schema.get("maximum", value):
                yield "maximum"
            if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
                yield "exclusiveMinimum"
            if "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
                yield "exclusiveMaximum"
            if "multipleOf" in schema and not _multiple(value, schema["multipleOf"]):
                yield "multipleOf"
        if isinstance(value, list):
            yield from self.elements(schema, value)
        if "anyOf" in schema and not any(self.fits(x, value) for x in schema["anyOf"]):
            yield "anyOf"
        if "oneOf" in schema and sum(self.fits(x, value) for x in schema["oneOf"]) != 1:
            yield "oneOf"
        if "not" in schema and self.fits(schema["not"], value):
            yield "not"

    def elements(self, schema: Mapping[str, object], value: list) -> Iterator[str]:
        if len(value) < schema.get("minItems", 0):
            yield "minItems"
        if len(value) > schema.get("maxItems", len(value)):
            yield "maxItems"
        first = schema.get("prefixItems", [])
        if not all(self.fits(s, v) for s, v in zip(first, value)):
            yield "prefixItems"
        if "items" in schema and not all(self.fits(schema["items"], v) for v in value[len(first) :]):
            yield "items"
        if schema.get("uniqueItems") and len({_distinct(v) for v in value}) < len(value):
            yield "uniqueItems"
        if "contains" in schema:
            n = sum(self.fits(schema["contains"], v) for v in value)
            if not schema.get("minContains", 1) <= n <= schema.get("maxContains", n):
                yield "contains"

    def members(self, schema: Mapping[str, object], value: dict, path: str) -> Iterator[str]:
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for name in schema.get("required", []):
            if name not in value:
                yield f"{path}: required {name}"
        if len(value) < schema.get("minProperties", 0):
            yield f"{path}: minProperties"
        if len(value) > schema.get("maxProperties", len(value)):
            yield f"{path}: maxProperties"
        others = [n for n in value if n not in known and not any(_pattern(p).search(n) for p in patterns)]
        more = schema.get("additionalProperties", True)
        if others and more is False or isinstance(more, Mapping) and not all(self.fits(more, value[n]) for n in others):
            yield f"{path}: additionalProperties"
        if "propertyNames" in schema and not all(self.fits(schema["propertyNames"], n) for n in value):
            yield f"{path}: propertyNames"
        for name, needed in schema.get("dependentRequired", {}).items():
            if name in value and not set(needed) <= value.keys():
                yield f"{path}: dependentRequired {name}"
        for name in sorted(known):
            if name in value:
                yield from self.all(known[name], value[name], f"{path}.{name}")
        for pattern in sorted(patterns):
            for name in sorted(value):
                if _pattern(pattern).search(name):
                    yield from self.all(patterns[pattern], value[name], f"{path}.{name}")


UNUSABLE = ["$: unusable schema"]


FAULTS = (UnusableSchema, RecursionError, TypeError, KeyError, AttributeError, ZeroDivisionError, ValueError, OverflowError)


def python_violations(schema: object, value: object, check: _Check | None = None) -> list[str]:
    """Messages for one parsed value, in path order; a schema that cannot be used is a violation."""
    try:
        return list((check or _Check(schema)).all(schema, value, "$"))
    except FAULTS:
        return UNUSABLE


def _plain(schema: object) -> Callable[[object], bool] | None:
    """For an object of typed and bounded members, a quick test whether a value fits; None for schemas that ask for more."""
    bounds = {"type", "minimum", "maximum", "minLength", "maxLength"}
    if not isinstance(schema, dict) or schema.get("type") != "object" or schema.keys() - NOTES - {"type", "required", "properties", "additionalProperties"}:
        return None
    known, closed = schema.get("properties", {}), schema.get("additionalProperties", True)
    if not isinstance(closed, bool) or not all(isinstance(k, dict) and isinstance(k.get("type", "string"), str) and not k.keys() - bounds - NOTES for k in known.values()):
        return None
    members = [(n, TYPES[k["type"]] if "type" in k else None, k.get("minimum"), k.get("maximum"), k.get("minLength"), k.get("maxLength")) for n, k in known.items()]
    required = schema.get("required", [])

    def fits(value: object) -> bool:
        if type(value) is not dict or any(n not in value for n in required) or not closed and any(n not in known for n in value):
            return False
        for name, kind, low, high, short, long in members:
            if name in value:
                own = value[name]
                if kind and not kind(own):
                    return False
                if (low is not None or high is not None) and _is_number(own) and not (own if low is None else low) <= own <= (own if high is None else high):
                    return False
                if (short is not None or long is not None) and isinstance(own, str) and not (short or 0) <= len(own) <= (len(own) if long is None else long):
                    return False
        return True

    return fits


@lru_cache(maxsize=4096)
def _ready(text: str) -> Callable[[object], list[str]]:
    """What a schema text says of a value; the text is parsed and looked through once."""
    try:
        schema = json.loads(text)
        check = _Check(schema)
    except FAULTS:
        return lambda value: UNUSABLE
    quick = _plain(schema)
    if quick is None:
        return lambda value: python_violations(schema, value, check)
    return lambda value: [] if quick(value) else python_violations(schema, value, check)


@F.pandas_udf(ArrayType(StringType()))
def _violations_by_row(schemas: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([[] if s is None or v is None else _ready(s)(json.loads(v)) for s, v in zip(schemas, values)])


def violations_by_schema(schema: Column | str, value: Column) -> Column:
    """Violations of each row's own schema text; empty without a schema or a value."""
    text = F.col(schema) if isinstance(schema, str) else schema
    # a row without a schema sends no value to Python
    return _violations_by_row(text, F.when(text.isNotNull(), F.to_json(value)))
