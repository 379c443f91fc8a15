"""Mappings: which elements become rows, and which values become columns."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, field as default
from pathlib import Path

import yaml
from pyspark.sql import types as T

from ..errors import InvalidMapping, MappingFault, UnsupportedTransform

#: Data types of a mapping and the Spark types that hold them.
TYPES: dict[str, T.DataType] = {
    "Boolean": T.BooleanType(),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "Int8": T.ByteType(),
    "UInt8": T.ShortType(),
    "Int16": T.ShortType(),
    "UInt16": T.IntegerType(),
    "Int32": T.IntegerType(),
    "UInt32": T.LongType(),
    "Int64": T.LongType(),
    "UInt64": T.DecimalType(20, 0),
    "Utf8": T.StringType(),
}
FLOATS = ("Float32", "Float64")


def segments(path: str) -> tuple[str, ...]:
    """Steps of an absolute path; leading, trailing and double slashes mean nothing."""
    return tuple(s for s in path.split("/") if s)


@dataclass(frozen=True)
class Field:
    """One column: the element or @attribute that it comes from, and its type."""

    name: str
    xml_path: str
    data_type: str = "Utf8"
    nullable: bool = False
    scale: float | None = None
    offset: float | None = None

    def __post_init__(self):
        if self.data_type not in TYPES:
            raise MappingFault(f"Unknown data type {self.data_type!r} of field {self.name!r}", field=self.name, data_type=self.data_type)

    def check(self) -> None:
        for transform in ("scale", "offset"):
            if getattr(self, transform) is not None and self.data_type not in FLOATS:
                raise UnsupportedTransform(f"{transform} is not supported for data type {self.data_type}", transform=transform, data_type=self.data_type)


class FieldBuilder:
    """Fluent making of a field: field("t", "/a/t", "Float64").scaled(2).build()."""

    def __init__(self, name: str, xml_path: str, data_type: str = "Utf8"):
        self._made = {"name": name, "xml_path": xml_path, "data_type": data_type}

    def nullable(self, yes: bool = True) -> FieldBuilder:
        self._made["nullable"] = yes
        return self

    def scaled(self, by: float) -> FieldBuilder:
        self._made["scale"] = float(by)
        return self

    def shifted(self, by: float) -> FieldBuilder:
        self._made["offset"] = float(by)
        return self

    def build(self) -> Field:
        made = Field(**self._made)
        made.check()
        return made


@dataclass(frozen=True)
class Table:
    """Rows are the known children of the element at xml_path."""

    name: str
    xml_path: str
    levels: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "levels", tuple(self.levels))
        object.__setattr__(self, "fields", tuple(self.fields))

    def schema(self) -> T.StructType:
        """Level columns, then fields in their order."""
        levels = [T.StructField(f"<{x}>", T.LongType(), False) for x in self.levels]
        return T.StructType(levels + [T.StructField(f.name, TYPES[f.data_type], f.nullable) for f in self.fields])


@dataclass(frozen=True)
class Options:
    trim_text: bool = False
    stop_at_paths: tuple[str, ...] = ()
    validate_closing_tags: bool = True
    validate_attributes: bool = True
    strip_namespaces: bool = True

    def __post_init__(self):
        object.__setattr__(self, "stop_at_paths", tuple(self.stop_at_paths))


@dataclass(frozen=True)
class Mapping:
    tables: tuple[Table, ...] = ()
    parser_options: Options = default(default_factory=Options)

    def __post_init__(self):
        object.__setattr__(self, "tables", tuple(self.tables))

    # -- reading and writing -------------------------------------------------

    @classmethod
    def from_yaml_text(cls, text: str) -> Mapping:
        try:
            raw = yaml.load(text, _Loader)  # noqa: S506  a safe loader with fewer implicit types
        except yaml.YAMLError as e:
            raise MappingFault(f"The mapping is no valid YAML: {e}") from e
        made = _mapping(raw)
        made.check()
        return made

    @classmethod
    def from_yaml_file(cls, path: str | Path) -> Mapping:
        return cls.from_yaml_text(Path(path).read_text(encoding="utf-8"))

    def to_yaml_text(self) -> str:
        plain = dataclasses.asdict(self)
        options = plain.pop("parser_options")
        plain["tables"] = [t | {"levels": list(t["levels"]), "fields": [{k: v for k, v in f.items() if v is not None} for f in t["fields"]]} for t in plain["tables"]]
        plain["parser_options"] = options | {"stop_at_paths": list(options["stop_at_paths"])}
        return yaml.dump(plain, Dumper=_Dumper, sort_keys=False, allow_unicode=True)

    def to_yaml_file(self, path: str | Path) -> None:
        Path(path).write_text(self.to_yaml_text(), encoding="utf-8")

    # -- checks --------------------------------------------------------------

    def check(self) -> None:
        """Raise the first contradiction: tables in order, each with its fields in order."""
        names: set[str] = set()
        places: dict[tuple[str, ...], str] = {}
        for table in self.tables:
            _want(table.name, "empty table name", "A table has an empty name")
            _want(table.name not in names, "duplicate table name", f"Two tables share the name {table.name!r}", name=table.name)
            names.add(table.name)
            _want(table.xml_path, "empty table path", f"Table {table.name!r} has an empty xml_path", table=table.name)
            place = segments(table.xml_path)
            _want(place not in places, "duplicate table path", f"Tables {places.get(place)!r} and {table.name!r} share the same xml_path {table.xml_path!r}", tables=[places.get(place), table.name], xml_path=table.xml_path)
            places[place] = table.name
            seen: set[str] = {f"<{x}>" for x in table.levels}
            _want(len(seen) == len(table.levels), "duplicate level", f"Table {table.name!r} has a level twice", table=table.name)
            for f in table.fields:
                _want(f.name, "empty field name", f"A field of table {table.name!r} has an empty name", table=table.name)
                _want(f.name not in seen, "duplicate field name", f"Table {table.name!r} has two columns named {f.name!r}", table=table.name, field=f.name)
                seen.add(f.name)
                _want(f.xml_path, "empty field path", f"Field {f.name!r} of table {table.name!r} has an empty xml_path", table=table.name, field=f.name)
                _want(segments(f.xml_path)[: len(place)] == place, "field path not under table", f"Field {f.name!r} at {f.xml_path!r} is not under table {table.name!r} at {table.xml_path!r}", table=table.name, table_path=table.xml_path, field=f.name, field_path=f.xml_path)
                f.check()

    def table(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)


def _want(ok, issue: str, message: str, **facts) -> None:
    if not ok:
        raise InvalidMapping(message, issue=issue, **facts)


class _Loader(yaml.SafeLoader):
    """YAML with the scalars of version 1.2: true and false only, 1e-9 is a number, dates are text."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("tag:yaml.org,2002:int", r"^[-+]?[0-9]+$", "-+0123456789"),
    ("tag:yaml.org,2002:float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$", "-+.0123456789"),
    ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
):
    _Loader.add_implicit_resolver(_tag, re.compile(_pattern), list(_first))
_Loader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(node.value))
_Loader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: float(node.value.lower().replace(".inf", "inf").replace(".nan", "nan")))


class _Dumper(yaml.SafeDumper):
    """Quotes every text value, so that any loader reads it as text."""


_Dumper.add_representer(str, lambda dumper, s: dumper.represent_scalar("tag:yaml.org,2002:str", s, style='"'))


def _take(raw, key: str, kind, what: str, *, optional=False, fallback=None):
    if not isinstance(raw, dict):
        raise MappingFault(f"{what} must be a mapping of keys", what=what)
    value = raw.get(key)
    if value is None:
        if optional:
            return fallback
        raise MappingFault(f"{what} lacks {key}", what=what, key=key)
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if not isinstance(value, kind) or (kind is str and not isinstance(value, str)):
        raise MappingFault(f"{key} of {what} must be {kind.__name__}", what=what, key=key)
    return value


def _texts(values: list, what: str) -> list[str]:
    for v in values:
        if not isinstance(v, str):
            raise MappingFault(f"{what} must hold text, not {v!r}", what=what)
    return values


def _mapping(raw) -> Mapping:
    tables = []
    for t in _take(raw, "tables", list, "the mapping"):
        name = _take(t, "name", str, "a table")
        fields = []
        for f in _take(t, "fields", list, f"table {name!r}"):
            what = f"a field of table {name!r}"
            fields.append(Field(_take(f, "name", str, what), _take(f, "xml_path", str, what), _take(f, "data_type", str, what), _take(f, "nullable", bool, what, optional=True, fallback=False), _take(f, "scale", float, what, optional=True), _take(f, "offset", float, what, optional=True)))
        tables.append(Table(name, _take(t, "xml_path", str, f"table {name!r}"), _texts(_take(t, "levels", list, f"table {name!r}"), "levels"), fields))
    o = _take(raw, "parser_options", dict, "the mapping", optional=True, fallback={})
    flags = {k: _take(o, k, bool, "parser_options", optional=True, fallback=v) for k, v in (("trim_text", False), ("validate_closing_tags", True), ("validate_attributes", True), ("strip_namespaces", True))}
    return Mapping(tables, Options(stop_at_paths=_texts(_take(o, "stop_at_paths", list, "parser_options", optional=True, fallback=[]), "stop_at_paths"), **flags))
