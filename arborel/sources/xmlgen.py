"""Writing XML from columns, with Spark's own functions: the inverse of shredding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def escaped(value: Column) -> Column:
    """Text with markup characters as entities; null is empty."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def element(name: str, *inside: Column, attributes: dict[str, Column] | None = None) -> Column:
    """<name attribute="..">inside</name>; inside is taken as markup."""
    parts: list[Column] = [F.lit(f"<{name}")]
    for key, value in (attributes or {}).items():
        parts += [F.lit(f' {key}="'), escaped(value), F.lit('"')]
    return F.concat(*parts, F.lit(">"), *inside, F.lit(f"</{name}>"))


def leaf(name: str, value: Column, *, optional: bool = False) -> Column:
    """An element with escaped text; optional: nothing at all for null."""
    made = element(name, escaped(value))
    return F.when(value.isNotNull(), made).otherwise("") if optional else made


def number(name: str, value: Column) -> Column:
    """An element with a number, which has nothing to escape; null is empty."""
    return element(name, F.coalesce(value.cast("string"), F.lit("")))


def nested(rows: DataFrame, keys: list[str], order: list[str], xml: Column, name: str) -> DataFrame:
    """One row for each key with the fragments of its rows in order, as column `name`.

    The fragments of one parent are gathered: a parent becomes one document or
    a part of one, and that is one task's work anyway.
    """
    gathered = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], xml.alias("_xml"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(gathered, lambda r: r["_xml"]), "").alias(name))
