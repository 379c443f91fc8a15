"""Benchmark decontamination with one Aho-Corasick automaton over words.

Benchmark texts are normalised to words; each run of ``window`` consecutive
words is a pattern of the automaton, and an item with fewer words is one
pattern.  Every document is normalised the same way and scanned once; a match
marks word positions, and positions map back to byte offsets of the original.

The automaton is broadcast.  Its size is bounded: items are dealt to blocks of
at most ``block_words`` pattern words, and each block is one automaton and one
scan, so a benchmark of any size is covered by more passes, not more memory.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import pieces, whole_row, written

#: Byte map of the normal form: ASCII letters are lowered, bytes that are
#: neither ASCII letters, digits nor part of a non-ASCII character are spaces.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.IntegerType())),
        T.StructField("offsets", T.ArrayType(T.IntegerType())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Patterns:
    """The automaton of one block of items, built on first use in each process."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.items, self.window, self._built = items, window, None

    def __getstate__(self):
        return {"items": self.items, "window": self.window, "_built": None}

    def built(self):
        if self._built is None:
            ids: dict[bytes, int] = {}
            owners: dict[tuple[int, ...], set[str]] = {}
            for item, words in self.items:
                seq = [ids.setdefault(w, len(ids) + 1) for w in words]
                n = min(self.window, len(seq))
                for i in range(len(seq) - n + 1):
                    owners.setdefault(tuple(seq[i : i + n]), set()).add(item)
            auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, who in owners.items():
                auto.add_word(key, (len(key), tuple(who)))
            auto.make_automaton()
            self._built = ids, auto
        return self._built

    def scan(self, text: str | None) -> tuple[int, np.ndarray | None, set[str]]:
        """(number of words, mask of hit words or None, items that occur)."""
        ids, auto = self.built()
        words = words_of(text)
        if not words or not ids:
            return len(words), None, set()
        get = ids.get
        seq = tuple([get(w, 0) for w in words])
        hit, items = None, set()
        for end, (n, who) in auto.iter(seq):
            if hit is None:
                hit = np.zeros(len(words), bool)
            hit[end - n + 1 : end + 1] = True
            items.update(who)
        return len(words), hit, items


def _runs(hit: np.ndarray) -> list[int]:
    """Hit words as a flat list first, end, first, end ..."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edge.tolist()


def original_spans(text: str, runs: list[int]) -> list[int]:
    """Character offsets in the original text of runs of normalised words, flat as they are: first, end, first, end ..."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(NORMAL), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flat.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    at = np.array(runs).reshape(-1, 2)
    return np.column_stack([chars[starts[at[:, 0]]], chars[ends[at[:, 1] - 1]]]).ravel().tolist()


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks whose patterns have at most block_words words (one item at least)."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        n = min(window, len(words))
        cost = n * (len(words) - n + 1)
        if block and size + cost > block_words:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += cost
    if block:
        yield block


def _scan(source: DataFrame, patterns) -> DataFrame:
    """One scan of (doc_id, text, row) with one broadcast automaton; text and whole, if there, go along."""
    carry = "whole" in source.columns
    schema = T.StructType([*HITS.fields, T.StructField("row", T.LongType()), *([source.schema["text"], source.schema["whole"]] if carry else [])])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in pieces(batch, 1):
                part = batch.slice(a, b - a)
                out: list[list] = [[] for _ in kinds]
                for key, text, row in zip(*(c.to_pylist() for c in part.columns[:3]), strict=True):
                    n, hit, items = patterns.value.scan(text)
                    runs = [] if hit is None else _runs(hit)
                    found = (key, n, 0 if hit is None else int(hit.sum()), sorted(items), runs, original_spans(text, runs) if runs else [], row)
                    for o, v in zip(out, found, strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(o, t) for o, t in zip(out, kinds, strict=True)), *([part.column(1), part.column(3)] if carry else [])], names=schema.names)

    return source.mapInArrow(scan, schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the runs and items that several automata found in a document."""
    for batch in batches:
        out: list[list] = [[] for _ in HITS.names]
        for key, n, items, spans, offsets in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
            runs: list[int] = []
            places: list[int] = []
            for first, end, start, stop in sorted(zip(spans[::2], spans[1::2], offsets[::2], offsets[1::2], strict=True)):
                if runs and first <= runs[-1]:
                    runs[-1], places[-1] = max(runs[-1], end), max(places[-1], stop)
                else:
                    runs += [first, end]
                    places += [start, stop]
            for o, v in zip(out, (key, n, sum(runs[1::2]) - sum(runs[::2]), sorted(set(items)), runs, places), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)] + batch.columns[5:], names=HITS.names + batch.schema.names[5:])


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 4_000_000, carry: bool = False) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items, spans, offsets; with carry also text, and the row's other columns as a struct.

    spans lists first, end, first, end ... of runs of hit words, offsets the
    same runs as places of characters in the original text.  Null and
    empty texts have no words; items without words or with a null id are
    patterns of nothing; with no items nothing is hit.  Repeated rows are
    judged each by itself.  Other columns of the inputs are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("row"), *([whole_row(docs, text)] if carry else []))
    parts = blocks(benchmark, item_id, item_text, window, block_words)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return _scan(source, spark.sparkContext.broadcast(Patterns(first, window))).drop("row")
    found = []
    for block in itertools.chain([first, second], parts):
        sent = spark.sparkContext.broadcast(Patterns(block, window))
        result = _scan(source if not found else source.select("doc_id", "text", "row"), sent)
        found.append(written(result if not found else result.where("n_hit > 0").dropDuplicates(["doc_id", "row"]), "hits"))
        sent.destroy()
    more = functools.reduce(DataFrame.unionAll, found[1:]).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("items")).alias("more"), F.flatten(F.collect_list("spans")).alias("further"), F.flatten(F.collect_list("offsets")).alias("beyond"))
    one = found[0].alias("a").join(more.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.row").eqNullSafe(F.col("b.row")), "left")
    none = F.array()
    both = one.select("a.doc_id", "n_words", F.concat("items", F.coalesce("more", none.cast("array<string>"))).alias("items"), F.concat("spans", F.coalesce("further", none.cast("array<int>"))).alias("spans"), F.concat("offsets", F.coalesce("beyond", none.cast("array<int>"))).alias("offsets"), *(["a.text", "a.whole"] if carry else []))
    return both.mapInArrow(_joined, T.StructType([*HITS.fields, *both.schema.fields[5:]]))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """The contract's rule: at least one hit word, and a twentieth of all words."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def items_digest(items: Column) -> Column:
    """sha256 of the sorted item ids, joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)
