"""Raw text to typed columns, as Catalyst expressions.

A raw null means that nothing was captured, "" that an empty value was.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F, types as T

from ..errors import MARK
from ..plans.mapping import FLOATS, TYPES, Field

#: White space that numbers and booleans may have around them.
BLANK = " \t\n\f\r"
#: Spellings of booleans, in any case.
TRUE = ("true", "yes", "y", "t", "on", "1")
FALSE = ("false", "no", "n", "f", "off", "0")
#: Least and greatest value of each integer type.
BOUNDS = {f"{'U' * u}Int{b}": (0, 2**b - 1) if u else (-(2 ** (b - 1)), 2 ** (b - 1) - 1) for b in (8, 16, 32, 64) for u in (0, 1)}
_SIGNED, _UNSIGNED = r"^[+-]?[0-9]+$", r"^[+]?[0-9]+$"
_FLOAT = r"^[+-]?(?:(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def _first(t: Column) -> Column:
    """Code of the first character; 0 of an empty text."""
    return F.ascii(t)


def _last(t: Column) -> Column:
    return F.ascii(F.substring(t, -1, 1))


def trimmed(raw: Column) -> Column:
    """Without the blanks around; texts that have none are left as they are."""
    return F.when((_first(raw) > 32) & (_last(raw) > 32), raw).otherwise(F.btrim(raw, F.lit(BLANK)))


def to_boolean(t: Column) -> Column:
    """True or false for the known spellings of trimmed text, else null."""
    t = F.lower(t)
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def to_integer(t: Column, data_type: str) -> Column:
    """The whole number of trimmed text, or null where it is none or out of bounds.

    Spark's own parser takes digits with a sign and nothing inside; the
    control characters that it would trim show at either end.
    """
    low, high = BOUNDS[data_type]
    fine = _first(t).between(33, 126) & _last(t).between(48, 57)
    if not low:
        fine &= ~t.startswith("-")
    number = F.when(fine, t.try_cast("bigint"))
    if data_type == "UInt64":  # beyond 63 bits a decimal, whose parser takes more: only digits may reach it
        wide = F.when(t.rlike(_UNSIGNED), t).try_cast("decimal(38,0)")
        wide = F.when(wide.between(F.lit(0), F.lit(str(high)).cast("decimal(38,0)")), wide.try_cast(TYPES[data_type]))
        return F.when(number.isNotNull(), number.try_cast(TYPES[data_type])).otherwise(wide)
    if data_type == "Int64":
        return number
    return F.when(number.between(F.lit(low), F.lit(high)), number.try_cast(TYPES[data_type]))


def to_float(t: Column, data_type: str) -> Column:
    """The number of trimmed text parsed at its own width, or null where it is none.

    Spark's parser also takes a type's letter at the end and hexadecimal
    numbers; words and those go by the pattern.
    """
    last = _last(t)
    fine = _first(t).between(43, 57) & (last.between(48, 57) | (last == 46)) & ~t.contains("x") & ~t.contains("X")
    other = F.when(t.rlike(_FLOAT), F.regexp_replace(t, "^[+-](?i:nan)$", "NaN"))
    return F.when(fine, t.try_cast(TYPES[data_type])).otherwise(other.try_cast(TYPES[data_type]))


def scaled(value: Column, field: Field) -> Column:
    """value * scale + offset, every operand at the column's width."""
    kind = TYPES[field.data_type]
    if field.scale is not None:
        value = value * F.lit(field.scale).cast(kind)
    if field.offset is not None:
        value = value + F.lit(field.offset).cast(kind)
    return value


def _raise(error: str, message: str, field: Field, raw: Column | None, keys: list[str], **facts) -> Column:
    """An expression that raises; all that is known before is one constant."""
    told = json.dumps({"error": error, "message": message, "field": field.name, "path": field.xml_path} | facts)
    parts = [] if raw is None else [raw.alias("value")]
    parts += [F.col(f"`{k}`").cast("string").alias(f"document_{k}") for k in keys]
    if not parts:
        return F.raise_error(F.lit(message + MARK + told))
    return F.raise_error(F.concat(F.lit(message + MARK + told[:-1] + ", "), F.substring(F.to_json(F.struct(*parts)), 2, 1 << 30)))


def converted(field: Field, raw: Column, keys: list[str] | None = None, text: Column | None = None) -> Column:
    """The typed column of a field; wrong and missing values raise structured errors.

    keys: columns that name the document in errors.  text: the trimmed raw
    text as a column of an earlier projection, so that it is made once.
    """
    keys = keys or []
    text = trimmed(raw) if text is None else text
    kind = TYPES[field.data_type]
    missing = F.lit(None).cast(kind)
    if field.data_type == "Utf8":
        return raw if field.nullable else F.coalesce(raw, F.lit(""))
    if not field.nullable:
        missing = _raise("MissingValue", f"Missing value for field {field.name!r} at {field.xml_path}", field, None, keys, kind="missing").cast(kind)
    if field.data_type == "Boolean":
        value, what = to_boolean(text), ("boolean", "holds no boolean")
    elif field.data_type in FLOATS:
        value, what = to_float(text, field.data_type), ("number", f"holds no {field.data_type}")
    else:
        value, what = to_integer(text, field.data_type), ("number", f"holds no {field.data_type}, or one too large or too small")
    wrong = _raise("ValueFault", f"Field {field.name!r} at {field.xml_path} {what[1]}", field, raw, keys, kind=what[0], data_type=field.data_type).cast(kind)
    checked = F.coalesce(value, wrong)
    if field.scale is not None or field.offset is not None:
        checked = scaled(checked, field)
    out = F.when(text.isNull() | (text == ""), missing).otherwise(checked)
    if field.nullable:
        return out
    default = False if isinstance(kind, T.BooleanType) else 0
    return F.coalesce(out, F.lit(default).cast(kind))  # never null; this tells Spark so


def message_facts(message: str) -> dict:
    return json.loads(message.split(MARK, 1)[1])
