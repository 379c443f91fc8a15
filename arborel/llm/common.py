"""Shared parts: the shared folder, written tables, text buffers, hashing."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import new_path, remove

#: Rows of one Arrow record batch are worked on in pieces of about this many bytes.
PIECE_BYTES = 1 << 20

_scratch: list[list[str]] = []


def written(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder, read it back.

    Within `scratch`, the table goes at the end of it unless it is to be kept.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting by which shuffle files go when the execution that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Within it, shuffle files go with each execution; at its end, what `written` wrote."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    _scratch.append([])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
        for path in _scratch.pop():
            remove(spark, path)


def shards_for(df: DataFrame, each: int = 256 << 20) -> int:
    """Shards to write a table in: as many as shuffles have, more where its files hold more than `each` bytes a shard."""
    spark = df.sparkSession
    hadoop, size = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for file in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(hadoop).getFileStatus(path).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


#: A key is cut if it has more than this part of a table's rows, and at least so many.
HOT_SHARE, HOT_ROWS = 10_000, 100


def salted_join(left: DataFrame, right: DataFrame, key: str, sums: DataFrame, total: int, by: str) -> DataFrame:
    """Inner join with a table of one row a key, where some keys have very many of left's rows.

    sums has for each key the number n of left's rows, total is their number
    in all.  Keys of more than a ten-thousandth of them, fewer than 10,000,
    are cut: left's rows go to parts by a hash of column `by`, and right's row
    is copied to each.  What is broadcast is a key and a number for each.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(sums.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).alias("_parts")))
    cut = left.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), "_parts"), F.lit(0).cast("long"))).drop("_parts")
    copied = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1))).drop("_parts")
    return cut.join(copied, [key, "_part"]).drop("_part")


#: Stretches of ids of which rows are counted before a table is dealt to shards.
STRETCHES = 1 << 16


def ranged(df: DataFrame, key: str, shards: int) -> DataFrame:
    """The table with rows of ascending keys in partitions 0 to shards - 1, each dealt by counts of all keys.

    The bounds follow from the keys alone, so that every run cuts alike.  Keys
    are counted by stretches of equal width, of which at most 65,538 arrive at
    the driver; a stretch is not cut, nor are rows with one key.  Null keys
    are in the first partition.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.repartitionById(shards, F.lit(0))
    stretch = F.floor(F.col(key) / F.lit(float(max(1, (high - low) // STRETCHES)))).alias("_stretch")
    counts = sorted(map(tuple, df.where(F.col(key).isNotNull()).groupBy(stretch).agg(F.count("*")).collect()))
    total, before, to = sum(n for _, n in counts), 0, []
    for k, n in counts:
        to.append((k, before * shards // total))
        before += n
    places = df.sparkSession.createDataFrame(to, "_stretch long, _shard int")
    dealt = df.select("*", stretch).join(F.broadcast(places), "_stretch", "left").withColumn("_shard", F.coalesce("_shard", F.lit(0)))
    return dealt.repartitionById(shards, "_shard").drop("_stretch", "_shard")


def whole_row(df: DataFrame, text: str) -> Column:
    """All columns of df but the text as one struct, to go along through a pass in Python."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("whole")


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, without a copy.

    Row i is data[offsets[i]:offsets[i + 1]]; a null is an empty row.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8), offsets


def pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES):
    """Split a batch's rows into runs of about `limit` bytes of one column.

    Yields (first row, last row + 1, bytes of the run, offsets from 0).  Every
    row is whole; a row longer than the limit is a run of its own.
    """
    data, offs = buffer_of(batch.column(column))
    n = len(offs) - 1
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES = Powers(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a run, and the word offsets of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


#: Bytes that one prefix sum of span_hashes covers, but for a longer span.
SUMMED = 1 << 22


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums over stretches of the run; starts ascend."""
    n = len(starts)
    out = np.empty(n, np.uint64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SUMMED)))
        base, top = int(starts[i]), int(ends[i:j].max())
        up, down = _BYTES.upto(top - base + 1)
        total = np.empty(top - base + 1, np.uint64)
        total[0] = 0
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * up[: top - base], out=total[1:])
        h = (total[ends[i:j] - base] - total[starts[i:j] - base]) * down[starts[i:j] - base]
        out[i:j] = mix64(h + (ends[i:j] - starts[i:j]).astype(np.uint64) * _M2)
        i = j
    return out
