"""Raw text to typed columns, a column of a batch at a time.

Usual spellings of numbers and booleans go through Arrow's parsers; the rest
is converted one by one, by the rules of `plain`, which raise the errors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..errors import ShredError
from ..plans.mapping import FLOATS, Field
from .convert import BLANK, BOUNDS, FALSE, TRUE
from .plain import convert

#: The Arrow type of each type's Spark column.
ARROW = {"Boolean": pa.bool_(), "Float32": pa.float32(), "Float64": pa.float64(), "UInt64": pa.decimal128(20, 0)}
ARROW |= {"Int8": pa.int8(), "Int16": pa.int16(), "Int32": pa.int32(), "Int64": pa.int64(), "UInt8": pa.int16(), "UInt16": pa.int32(), "UInt32": pa.int64()}
_WHOLE, _NUMBER = r"^-?[0-9]{1,18}$", r"^-?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: Bytes with which Arrow's parsers take more than the rules do.
_FOREIGN = (b"x", b"X", b"(")
_SPELLED = pa.array([*TRUE, *FALSE])


def _bytes(texts: pa.Array) -> memoryview | bytes:
    """All bytes of a string array, one value after another."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return b"" if data is None else data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()


def _parsed(texts: pa.Array, kind: pa.DataType, pattern: str) -> pa.Array:
    """Numbers, null where a text is of no usual spelling."""
    raw = _bytes(texts)
    if not any(b in raw for b in _FOREIGN):
        try:
            return pc.cast(texts, kind)
        except pa.ArrowInvalid:
            pass
    texts = pc.utf8_trim(texts, BLANK)
    texts = pc.replace_substring_regex(texts, r"^\+([0-9.])", r"\1")
    texts = pc.if_else(pc.match_substring_regex(texts, pattern), texts, pa.scalar(None, texts.type))
    try:
        return pc.cast(texts, kind)
    except pa.ArrowInvalid:
        return pa.nulls(len(texts), kind)


def _whole(texts: pa.Array, data_type: str) -> pa.Array:
    low, high = BOUNDS[data_type]
    if not low and b"-" in _bytes(texts):
        texts = pc.if_else(pc.match_substring(texts, "-"), pa.scalar(None, texts.type), texts)
    found = _parsed(texts, pa.uint64() if data_type == "UInt64" else pa.int64(), _WHOLE)
    if data_type not in ("Int64", "UInt64"):
        least, most = pc.min_max(found).as_py().values()
        if least is not None and (least < low or most > high):
            found = pc.if_else(pc.and_(pc.greater_equal(found, low), pc.less_equal(found, high)), found, pa.scalar(None, found.type))
    return pc.cast(found, ARROW[data_type])


def _real(texts: pa.Array, field: Field) -> pa.Array:
    kind = ARROW[field.data_type]
    found = _parsed(texts, kind, _NUMBER)
    if field.scale is None and field.offset is None:
        return found
    width = kind.to_pandas_dtype()
    value = found.fill_null(0).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        if field.scale is not None:
            value = value * width(field.scale)
        if field.offset is not None:
            value = value + width(field.offset)
    return pa.array(value, kind, mask=found.is_null().to_numpy(zero_copy_only=False) if found.null_count else None, from_pandas=False)


def quick(field: Field, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(values of usual spellings, raw texts where there is one without a value)."""
    if field.data_type == "Boolean":
        at = pc.index_in(pc.ascii_lower(pc.utf8_trim(texts, BLANK)), _SPELLED)
        found = pc.less(at, len(TRUE))
    elif field.data_type in FLOATS:
        found = _real(texts, field)
    else:
        found = _whole(texts, field.data_type)
    if found.null_count == texts.null_count:
        return found, pa.nulls(len(texts), pa.string())
    return found, pc.if_else(found.is_null(), texts, pa.scalar(None, pa.string()))


def typed(field: Field, texts: pa.Array) -> pa.Array:
    """The column of a field; null where that may be.  A wrong or missing value raises, with its row as fact `row`."""
    if field.data_type == "Utf8":
        return texts if field.nullable else texts.fill_null("")
    found, rest = quick(field, texts)
    if not found.null_count or field.nullable and rest.null_count == len(rest):
        return found
    values, known = found.to_pylist(), {}
    for i in np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False)).tolist():
        raw = rest[i].as_py()
        if raw not in known:
            try:
                known[raw] = convert(field, raw)
            except ShredError as e:
                e.facts["row"] = i
                raise
        values[i] = known[raw]
    return pa.array(values, found.type)
