"""Structured errors, and their way back from executors.

An error raised on an executor reaches the driver as text inside a Spark
exception.  Every message therefore ends with a marked JSON object, from which
``recovered`` makes the structured error again.
"""

from __future__ import annotations

import json

MARK = " @arborel:"


class ShredError(Exception):
    """Base of all errors of this package.  `facts` holds what the message says."""

    def __init__(self, message: str, **facts):
        super().__init__(message)
        self.message, self.facts = message, facts

    def __getattr__(self, name):
        try:
            return self.__dict__["facts"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __str__(self):
        return f"{self.message}{MARK}{json.dumps({'error': type(self).__name__, 'message': self.message} | self.facts)}"

    def __reduce__(self):
        return _again, (type(self), self.message, self.facts)


def _again(kind, message, facts):
    return kind(message, **facts)


class SyntaxFault(ShredError):
    """The document is no well-formed XML where that is checked."""


class EncodingFault(SyntaxFault):
    """A text column's bytes are no valid UTF-8."""


class MappingFault(ShredError):
    """The mapping's YAML can't be read."""


class ValueFault(ShredError):
    """A captured value does not fit its column: field, path, value, kind.

    kind: number, boolean, unresolved entity, duplicate value.
    """


class MissingValue(ValueFault):
    """A column that must not be null has no value in a row: field, path."""


class UnsupportedTransform(ShredError):
    """scale or offset on a type without it: transform, data_type."""


class InvalidMapping(ShredError):
    """The mapping contradicts itself: issue, and the names concerned."""


class LevelFault(ShredError):
    """A table has more level columns than its rows have ancestors: table."""


_KINDS = {c.__name__: c for c in (ShredError, SyntaxFault, EncodingFault, MappingFault, ValueFault, MissingValue, UnsupportedTransform, InvalidMapping, LevelFault)}


def recovered(error: BaseException) -> BaseException:
    """The structured error that a Spark exception carries, chained to it; else the exception."""
    text = str(error)
    at = text.find(MARK)
    if isinstance(error, ShredError) or at < 0:
        return error
    try:
        facts, _ = json.JSONDecoder().raw_decode(text[at + len(MARK) :].lstrip())
    except ValueError:
        return error
    found = _KINDS[facts.pop("error")](facts.pop("message"), **facts)
    found.__cause__ = error
    return found
