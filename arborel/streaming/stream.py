"""Shredding streams: every arriving document is one record, and nothing is kept between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.shred import Shredder
from ..plans.mapping import Mapping


def read_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Files that arrive in a folder, whole, as column `value`."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def shred_stream(docs: DataFrame, mapping: Mapping | str | Shredder, table: str, *, content: str = "value", keys: list[str] | None = None) -> DataFrame:
    """One typed table of a streaming DataFrame of documents; keys such as an event time go along."""
    engine = mapping if isinstance(mapping, Shredder) else Shredder(mapping)
    return engine.table(docs, table, content=content, keys=keys)
