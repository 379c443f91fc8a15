"""Shredding without Spark, for tests of the fold and the plain conversions."""

from arborel import Field, Mapping, Options, Table
from arborel.functions.plain import convert
from arborel.operators.fold import Fold
from arborel.plans.program import compile_mapping


def shred(xml, mapping):
    """{table: [(levels, values)]}"""
    program = compile_mapping(mapping)
    raw = {p.index: [] for p in program.plans if p.end > p.first}
    fold = Fold(program, set(raw), lambda t, pos, levels, cells: raw[t].append((tuple(levels), cells)))
    fold.run(xml.encode() if isinstance(xml, str) else xml)
    out = {}
    for t, rows in raw.items():
        table = mapping.tables[t]
        out[table.name] = [(levels, tuple(convert(f, None if c is None else c.decode()) for f, c in zip(table.fields, cells, strict=True))) for levels, cells in rows]
    return out


def one(xml, *fields, path="/d", levels=(), **options):
    """Rows' values of a mapping with one table."""
    return [v for _, v in shred(xml, Mapping([Table("t", path, levels, fields)], Options(**options)))["t"]]


def text(name="v", path="/d/r/v", nullable=True):
    return Field(name, path, "Utf8", nullable)


def number(name="v", path="/d/r/v", kind="Int32", nullable=False, **more):
    return Field(name, path, kind, nullable, **more)
