"""Declarative shredding of XML documents into linked DataFrames."""

from .operators.shred import Shredder, relinked, shred_files, shred_text
from .plans.mapping import Field, FieldBuilder, Mapping, Options, Table

__all__ = ["Field", "FieldBuilder", "Mapping", "Options", "Shredder", "Table", "relinked", "shred_files", "shred_text"]
