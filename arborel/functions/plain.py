"""The same conversions for single values in Python, for sources that yield typed rows."""

from __future__ import annotations

import re
from decimal import Decimal

import numpy as np

from ..errors import MissingValue, ValueFault
from ..plans.mapping import FLOATS, Field
from .convert import _FLOAT, _SIGNED, _UNSIGNED, BLANK, BOUNDS, FALSE, TRUE

_SIGNED_RE, _UNSIGNED_RE, _FLOAT_RE = (re.compile(p.replace("$", r"\Z"), re.ASCII) for p in (_SIGNED, _UNSIGNED, _FLOAT))


def convert(field: Field, raw: str | None):
    """The typed value of a raw text; the rules are those of `convert.converted`."""
    if field.data_type == "Utf8":
        return raw if raw is not None or field.nullable else ""
    text = (raw or "").strip(BLANK)
    if not text:
        if field.nullable:
            return None
        raise MissingValue(f"Missing value for field {field.name!r} at {field.xml_path}", field=field.name, path=field.xml_path, kind="missing")
    value, kind = None, "number"
    if field.data_type == "Boolean":
        kind, low = "boolean", text.lower()
        value = True if low in TRUE else False if low in FALSE else None
    elif field.data_type in FLOATS:
        if _FLOAT_RE.match(text):
            width = np.float32 if field.data_type == "Float32" else np.float64
            with np.errstate(over="ignore"):
                number = width(text)
                if field.scale is not None:
                    number = number * width(field.scale)
                if field.offset is not None:
                    number = number + width(field.offset)
            value = float(number)
    else:
        low, high = BOUNDS[field.data_type]
        if (_UNSIGNED_RE if low == 0 else _SIGNED_RE).match(text) and low <= int(text) <= high:
            value = Decimal(int(text)) if field.data_type == "UInt64" else int(text)
    if value is None:
        raise ValueFault(f"Field {field.name!r} at {field.xml_path} holds no {field.data_type}, or one too large or too small", field=field.name, path=field.xml_path, value=raw, kind=kind, data_type=field.data_type)
    return value
