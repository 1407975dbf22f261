"""Graph schemas: types with id prefixes, typed fields, languages; merging, and lookup by path."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "id": T.StringType(), "type": T.StringType(), "url": T.StringType(), "email": T.StringType(), "phone": T.StringType(), "digest": T.StringType(), "json": T.StringType(), "int": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.LongType(), "float": T.DoubleType(), "number": T.DoubleType(), "text": T.MapType(T.StringType(), T.StringType()), "geo": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])}
RELATIONS = ("parents", "children", "ancestors", "descendants")
DEFAULTS = {"id": {"type": "id"}, "type": {"type": "type"}, "aliases": {"type": "set", "items": {"type": "string"}}, "createdAt": {"type": "timestamp"}, "updatedAt": {"type": "timestamp"}} | {r: {"type": "references"} for r in RELATIONS}
_NAME = re.compile(r"^[a-zA-Z0-9][a-zA-Z0-9_-]*$")


class SchemaError(ValueError):
    """A schema, or a payload against it, isn't acceptable."""


def spark_type(spec: dict) -> T.DataType | None:
    """The column type of a field; None for references, which are rows of the edge table."""
    kind = spec["type"]
    if kind in _SIMPLE:
        return _SIMPLE[kind]
    if kind in ("reference", "references"):
        return None
    if kind == "object":
        inner = [(k, spark_type(v)) for k, v in spec.get("properties", {}).items()]
        return T.StructType([T.StructField(k, t) for k, t in inner if t is not None])
    if kind == "record":
        return T.MapType(T.StringType(), spark_type(spec["values"]) or T.ArrayType(T.StringType()))
    if kind in ("array", "set"):
        return T.ArrayType(spark_type(spec["items"]))
    raise SchemaError(f"unknown field type {kind}")


@dataclass(frozen=True)
class TypeDef:
    prefix: str
    fields: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    def all_fields(self) -> dict:
        return DEFAULTS | self.fields

    def struct(self) -> T.StructType:
        kinds = [(k, spark_type(v)) for k, v in self.all_fields().items() if k not in RELATIONS]
        return T.StructType([T.StructField(k, t) for k, t in kinds if t is not None])


@dataclass(frozen=True)
class GraphSchema:
    types: dict[str, TypeDef]
    languages: tuple[str, ...] = ()

    @classmethod
    def of(cls, spec: dict) -> GraphSchema:
        """From {"languages": [...], "types": {name: {"prefix": ..., "fields": {...}}}, "rootType": {...}}."""
        return cls({"root": TypeDef("ro", dict(spec.get("rootType", {}).get("fields", {})))}, ()).merged(spec)[0]

    @property
    def sha(self) -> str:
        told = {"languages": self.languages, "types": {k: [v.prefix, v.fields] for k, v in sorted(self.types.items())}}
        return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()

    @property
    def prefixes(self) -> dict[str, str]:
        return {v.prefix: k for k, v in self.types.items()}

    def type_of(self, node_id: str) -> str | None:
        return "root" if node_id == "root" else self.prefixes.get(node_id[:2])

    def merged(self, spec: dict, allow_mutations: bool = False) -> tuple[GraphSchema, list[dict]]:
        """The schema with spec added, and the mutations that existing data needs.

        Fields and types that spec leaves out stay. Changing or dropping a field needs allow_mutations.
        """
        types, changes = dict(self.types), []
        taken = {v.prefix: k for k, v in types.items()}
        for name, told in spec.get("types", {}).items():
            if told.get("$delete"):
                if not allow_mutations:
                    raise SchemaError(f"deleting type {name} is a mutation")
                types.pop(name, None)
                changes.append({"mutation": "delete_type", "type": name})
                continue
            old = types.get(name)
            prefix = told.get("prefix", old.prefix if old else None)
            prefix = prefix or self._new_prefix(name, taken)
            if old and old.prefix != prefix:
                raise SchemaError(f"the prefix of {name} can't change")
            if taken.get(prefix, name) != name or prefix == "ro" and name != "root":
                raise SchemaError(f"prefix {prefix} is in use")
            if len(prefix) != 2:
                raise SchemaError(f"prefix {prefix} must have two characters")
            taken[prefix] = name
            fields = dict(old.fields) if old else {}
            for key, want in told.get("fields", {}).items():
                if not _NAME.match(key):
                    raise SchemaError(f"bad field name {key}")
                if want.get("$delete"):
                    if not allow_mutations:
                        raise SchemaError(f"deleting field {name}.{key} is a mutation")
                    fields.pop(key, None)
                    changes.append({"mutation": "remove_field", "type": name, "field": key})
                    continue
                have = fields.get(key)
                if have and have["type"] != want["type"]:
                    if not allow_mutations:
                        raise SchemaError(f"changing the type of {name}.{key} is a mutation")
                    changes.append({"mutation": "change_field", "type": name, "field": key, "old": have, "new": want})
                    fields[key] = want
                elif have and have["type"] == "object":
                    fields[key] = {**have, **want, "properties": {**have.get("properties", {}), **want.get("properties", {})}}
                else:
                    fields[key] = {**(have or {}), **want}
            types[name] = TypeDef(prefix, fields, {**(old.meta if old else {}), **told.get("meta", {})})
        if told := spec.get("rootType"):
            types["root"] = TypeDef("ro", {**types["root"].fields, **told.get("fields", {})})
        languages = tuple(dict.fromkeys([*self.languages, *spec.get("languages", ())]))
        return replace(self, types=types, languages=languages), changes

    @staticmethod
    def _new_prefix(name: str, taken: dict) -> str:
        tries = [name[:2].lower(), *(name[0].lower() + c for c in name[2:].lower()), *(a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz0123456789")]
        return next(p for p in tries if len(p) == 2 and p not in taken and p != "ro")

    def lookup(self, type_name: str, path: str) -> dict | None:
        """The field spec at a dot path: array indexes are ignored, a record takes any key, text.xx is a string."""
        spec = self.types[type_name].all_fields() if type_name in self.types else DEFAULTS
        here: dict | None = {"type": "object", "properties": spec}
        for part in re.sub(r"\[-?\d*\]", "", path).split("."):
            kind = here["type"]
            if kind == "object":
                here = here.get("properties", {}).get(part)
            elif kind == "record":
                here = here["values"]
            elif kind == "text":
                here = {"type": "string"}
            elif kind in ("array", "set") and here["items"]["type"] == "object":
                here = here["items"].get("properties", {}).get(part)
            else:
                return None
            if here is None:
                return None
        return here

    def relation_kind(self, name: str) -> str | None:
        """reference or references, if a type has a field of that name and kind."""
        return next((v.fields[name]["type"] for v in self.types.values() if v.fields.get(name, {}).get("type") in ("reference", "references")), None)

    def conform(self, type_name: str, payload: dict) -> dict:
        """payload without what the schema doesn't declare."""

        def keep(spec: dict, value):
            kind = spec["type"]
            if kind == "object" and isinstance(value, dict):
                return {k: keep(spec["properties"][k], v) for k, v in value.items() if k in spec.get("properties", {})}
            if kind == "record" and isinstance(value, dict):
                return {k: keep(spec["values"], v) for k, v in value.items()}
            if kind == "text" and isinstance(value, dict):
                return {k: v for k, v in value.items() if k in self.languages}
            if kind == "array" and isinstance(value, list):
                return [keep(spec["items"], v) for v in value]
            return value

        fields = self.types[type_name].all_fields()
        return {k: v if k.startswith("$") else keep(fields[k], v) for k, v in payload.items() if k.startswith("$") or k in fields}
