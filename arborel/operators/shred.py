"""The engine: documents in a DataFrame become typed, linked DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import EncodingFault, ShredError, recovered
from ..functions.quick import typed
from ..plans.mapping import TYPES, Field, Mapping
from ..plans.program import Plan, Program, compile_mapping
from ..shared import new_path
from ..shipping import ensure
from .columns import Columns, simplified
from .fold import Fold

#: Rows that one batch to the JVM holds.
BATCH = 8192


#: Bytes of documents that are shredded together.
PIECE = 1 << 20


def texts_of(raw: pa.Array, field: Field) -> pa.Array:
    """A binary column as text; bytes that are no UTF-8 are a fault in a text column only."""
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        if field.data_type == "Utf8":
            raise EncodingFault(f"Field {field.name!r} holds bytes that are no UTF-8", field=field.name) from None
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in raw.to_pylist()], pa.string())


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole documents: (number of the first, bytes, offsets from 0); nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(int(np.searchsorted(at, at[first] + PIECE, side="right")) - 1, first + 1)
        yield first, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


#: Rows of a table: its number, their documents' numbers, positions, levels and raw cells.
Found = tuple[int, np.ndarray, np.ndarray, list[np.ndarray], list[pa.Array]]


class Reader:
    """Rows of the tables of some plans, from runs of documents."""

    def __init__(self, program: Program, plans: list[Plan]):
        self.program, self.wanted = program, {p.index for p in plans}
        self.at_once = Columns(program, plans)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Found]:
        """Plain documents at once, then those that could be made plain, and one by one the fold's."""
        found, left = self.at_once.run(data, offsets)
        for table, rows in found.items():
            yield table, rows.doc, rows.position, rows.levels, rows.cells
        odd = np.flatnonzero(left).tolist()
        if not odd:
            return
        documents = {i: data[offsets[i] : offsets[i + 1]].tobytes() for i in odd}
        plain = {i: p for i, d in documents.items() if self.at_once.shape is not None and (p := simplified(d, self.at_once.trim)) is not None}
        if plain:
            which = np.array(list(plain))
            found, left = self.at_once.run(np.frombuffer(b"".join(plain.values()), np.uint8), np.cumsum([0, *map(len, plain.values())]))
            for table, rows in found.items():
                yield table, which[rows.doc], rows.position, rows.levels, rows.cells
            odd = sorted({*odd} - {*which[~left].tolist()})
        for i in odd:
            yield from self.folded(i, documents[i])

    def folded(self, i: int, document: bytes) -> Iterator[Found]:
        """One document by the fold; its rows leave once it is read: a fault gives none."""
        rows: dict[int, list[tuple]] = {}
        Fold(self.program, self.wanted, lambda table, *row: rows.setdefault(table, []).append(row)).run(document)
        for table, own in rows.items():
            for a in range(0, len(own), BATCH):
                pos, levels, cells = zip(*own[a : a + BATCH], strict=True)
                yield table, np.full(len(pos), i), np.array(pos), [np.array(x) for x in zip(*levels, strict=True)], [pa.array(c, pa.binary()) for c in zip(*cells, strict=True)]


class Shredder:
    """A checked and compiled mapping, used for any number of DataFrames.

    Documents are rows with a string or binary column; other columns chosen as
    keys go along with every row.  Parsing is one narrow pass in Python on the
    executors, plain documents many at a time and others by the fold, and
    values are converted there a column at a time.  A wrong or missing value
    of a table is an error when that table is evaluated.
    """

    def __init__(self, mapping: Mapping | str):
        self.mapping = Mapping.from_yaml_text(mapping) if isinstance(mapping, str) else mapping
        self.program: Program = compile_mapping(self.mapping)

    @property
    def warnings(self) -> list[str]:
        """What the mapping does that is probably not meant."""
        return self.program.warnings

    @property
    def names(self) -> list[str]:
        """Tables that have columns, in the mapping's order."""
        return [t.name for t in self.mapping.tables if t.fields]

    def _source(self, docs: DataFrame, content: str, keys: list[str]) -> DataFrame:
        ensure(docs.sparkSession)
        return docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{content}`").cast("binary").alias("_content"))

    def _fields(self, plan: Plan, prefix: str = "") -> list[T.StructField]:
        """Columns of rows: _l0.. (levels), _f0.. (fields); with a prefix, beside those of other tables, they can be null."""
        never = not prefix
        return [T.StructField(f"{prefix}_l{i}", T.LongType(), not never) for i in range(plan.levels)] + [T.StructField(f"{prefix}_f{i}", TYPES[f.data_type], f.nullable or not never) for i, f in enumerate(plan.table.fields)]

    def _rows(self, docs: DataFrame, plans: list[Plan], content: str, keys: list[str], together: bool) -> DataFrame:
        """keys, _pos and columns of the plans' tables; together: _table, and each table's columns under its number."""
        source = self._source(docs, content, keys)
        program, named = self.program, lambda p: f"_{p.index}" if together else ""
        own = {p.index: self._fields(p, named(p)) for p in plans}
        schema = T.StructType([*source.schema.fields[:-1], T.StructField("_pos", T.LongType(), False), *[x for fields in own.values() for x in fields], *([T.StructField("_table", T.IntegerType())] if together else [])])
        kinds = to_arrow_schema(schema)
        reader = Reader(program, plans)

        def made(batch: pa.RecordBatch, first: int, found: Found) -> pa.RecordBatch:
            table, whose, pos, levels, cells = found
            take, fields = pa.array(whose + first, pa.int32()), program.plans[table].table.fields
            columns = {"_pos": pa.array(pos, pa.int64()), "_table": pa.array(np.full(len(pos), table, np.int32))}
            try:
                values = [pa.array(x, pa.int64()) for x in levels] + [typed(f, texts_of(c, f)) for c, f in zip(cells, fields, strict=True)]
            except ShredError as e:  # the keys tell which document it is
                row = e.facts.pop("row", None)
                if row is not None:
                    e.facts |= {f"document_{k}": str(v) for i, k in enumerate(keys) if (v := batch.column(i)[int(whose[row]) + first].as_py()) is not None}
                raise
            columns |= zip((f.name for f in own[table]), values, strict=True)
            arrays = [batch.column(i).take(take) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays(arrays + [columns[f.name] if f.name in columns else pa.nulls(len(pos), f.type) for f in list(kinds)[len(keys) :]], names=kinds.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, data, offsets in _pieces(batch.column(batch.num_columns - 1)):
                    for found in reader.rows(data, offsets):
                        yield made(batch, first, found)

        return source.mapInArrow(run, schema)

    def _named(self, rows: DataFrame, plan: Plan, keys: list[str], position: bool) -> DataFrame:
        """Keys, level columns and fields under their names."""
        table = plan.table
        levels = [F.col(f"_l{i}").alias(f"<{table.levels[i]}>") for i in range(plan.levels)]
        # Levels that no row can have stay empty columns: any row is an error before this.
        levels += [F.lit(0).cast("long").alias(f"<{x}>") for x in table.levels[plan.levels :]]
        return rows.select(*[F.col(f"`{k}`") for k in keys], *([F.col("_pos")] if position else []), *levels, *[F.col(f"_f{i}").alias(f.name) for i, f in enumerate(table.fields)])

    def _plan(self, name: str) -> Plan:
        return next(p for p in self.program.plans if p.table.name == name)

    def table(self, docs: DataFrame, name: str, *, content: str = "content", keys: list[str] | None = None, position: bool = False) -> DataFrame:
        """One typed table.  keys identify documents across tables; position orders rows in one.

        Null contents give no rows, empty documents neither.  The result has
        no order of rows; sort by keys and _pos where that matters.
        """
        plan, keys = self._plan(name), list(keys or [])
        return self._named(self._rows(docs, [plan], content, keys, False), plan, keys, position)

    def tables(self, docs: DataFrame, *, content: str = "content", keys: list[str] | None = None, position: bool = False, once: bool = False) -> dict[str, DataFrame]:
        """All tables with columns, in the mapping's order.

        Each is a plan of its own, that parses what it needs when it runs.
        With once, documents are parsed now, for all tables together, and kept
        below spark.checkpoint.dir as `write_raw` keeps them.
        """
        if once:
            path = new_path(ensure(docs.sparkSession), "tables")
            schema = self._write(docs, path, content, list(keys or []))
            return self.stored(docs.sparkSession, path, keys=keys, position=position, schema=schema)
        return {n: self.table(docs, n, content=content, keys=keys, position=position) for n in self.names}

    def _write(self, docs: DataFrame, path: str, content: str, keys: list[str]) -> T.StructType:
        rows = self._rows(docs, [p for p in self.program.plans if p.end > p.first], content, keys, True)
        rows.write.partitionBy("_table").parquet(path)
        return rows.schema

    def write_raw(self, docs: DataFrame, path: str, *, content: str = "content", keys: list[str] | None = None) -> dict[str, DataFrame]:
        """All tables from one pass: rows go to Parquet below path, partitioned by table.

        Returns the typed tables over it, which `stored` gives again later.
        Documents are parsed once however many tables there are.
        """
        schema = self._write(docs, path, content, list(keys or []))
        return self.stored(docs.sparkSession, path, keys=keys, schema=schema)

    def stored(self, spark: SparkSession, path: str, *, keys: list[str] | None = None, position: bool = False, schema: T.StructType | None = None) -> dict[str, DataFrame]:
        """Typed tables of what `write_raw` wrote; each reads its own partition and columns only.

        schema, of the written rows, is needed only where no document gave any row.
        """
        raw = spark.read.schema(schema) if schema is not None else spark.read
        out = {}
        for name in self.names:
            plan = self._plan(name)
            own = raw.parquet(path).where(F.col("_table") == plan.index)
            columns = []
            for f in self._fields(plan):
                value = F.col(f"_{plan.index}{f.name}")
                # Never null in the table's own rows; this tells Spark so.
                default = {T.StringType(): F.lit(""), T.BooleanType(): F.lit(False)}.get(f.dataType, F.lit(0).cast(f.dataType))
                columns.append((value if f.nullable else F.coalesce(value, default)).alias(f.name))
            out[name] = self._named(own.select(*[F.col(f"`{k}`") for k in keys or []], "_pos", *columns), plan, list(keys or []), position)
        return out

    def check(self, docs: DataFrame, *, content: str = "content", keys: list[str] | None = None) -> None:
        """Parse and convert everything; raise the first error found, in structured form."""
        for frame in self.tables(docs, content=content, keys=keys).values():
            try:
                frame.write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001
                raise recovered(e) from e


def shred_files(spark: SparkSession, path: str | list[str], mapping: Mapping | str | Shredder, *, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the XML files below a path; key column `path` unless others are named."""
    engine = mapping if isinstance(mapping, Shredder) else Shredder(mapping)
    return engine.tables(spark.read.format("binaryFile").load(path), keys=["path"] if keys is None else keys)


def shred_text(spark: SparkSession, xml: str | bytes, mapping: Mapping | str | Shredder) -> dict[str, DataFrame]:
    """Tables of one document in memory."""
    engine = mapping if isinstance(mapping, Shredder) else Shredder(mapping)
    data = xml.encode() if isinstance(xml, str) else bytes(xml)
    return engine.tables(spark.createDataFrame([(bytearray(data),)], "content binary"))


def relinked(child: DataFrame, parent: DataFrame, levels: list[str], keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Join child rows to their parents on document keys and shared level columns."""
    return child.join(parent, [*(keys or []), *[f"<{x}>" for x in levels]], how)
