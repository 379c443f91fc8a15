"""Substring dedup over a compacted De Bruijn graph of token k-mers.

The graph's edges are the windows: k-mers of ``window`` words, each from the
k-mer without its last word to the one without its first.  Edges are held as
pieces: consecutive windows of a text that share their least inner k-mer of
``k`` words by hash (their anchor) are one row with the anchor, a digest of the
piece's words, its coordinates, and the pieces before and after it.

1. Anchors of a single document are dropped: no window through them repeats.
2. Equal digests are one piece; its source is its first occurrence by document
   and place.  A piece joins the one after it where neither branches: all
   occurrences of the one are followed by the other, which follows nothing
   else.  A Spark join on these links, and a running mark along the source's
   coordinates, compact chains of pieces to paths of any length.
3. A path's words are read again at its source coordinates and digested to
   128 bits.  Its occurrences in later documents are spans to remove, and each
   goes only if its own words give that digest.
4. At an anchor with several pieces, windows can repeat without their piece.
   There the windows of the pieces' sources become single edges, equal if
   128-bit digests of their words are.
5. Spans meet the texts once more and the words in them are removed.

Every step joins or sums by key with partial aggregation before the shuffle,
so copies of any number cost one row each, and no group is ever in one task's
memory.  A piece that all copies share is compared through its source alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import Powers, mix64, pieces, salted_join, scratch, span_hashes, whole_row, word_spans, written

_NODES, _PATHS = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)
_ODD = np.uint64(0xE7037ED1A0B428DB)
#: Places within a stretch of k-mers ride in the low bits of their hashes.
_BITS = 24


class _Run:
    """Words of a run of documents with prefix sums for span digests."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.rows = word_spans(data, offsets)
        self.n = len(starts)
        words = span_hashes(data, starts, ends)
        self.sums = []
        for powers in (_NODES, _PATHS):
            up, down = powers.upto(self.n + 1)
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(words * up[:-1], out=total[1:])
            self.sums.append((total, down))

    def digest(self, which: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        total, down = self.sums[which]
        return (total[end] - total[begin]) * down[begin]

    def anchors(self, window: int, k: int, bits: int = _BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Valid windows' first words, the place of each one's anchor, and all k-mer hashes.

        Stretches of k-mers overlap, so that every window lies whole in one and
        ties go to the leftmost in each, wherever it begins.
        """
        begin = np.arange(max(0, self.n - k + 1))
        kmers = mix64(self.digest(0, begin, begin + k))
        width = window - k + 1
        total = self.n - window + 1
        if total <= 0:
            return begin[:0], begin[:0], kmers
        low = np.uint64((1 << bits) - 1)
        place = np.empty(total, np.int64)
        step = max(1, (1 << bits) - width)
        for a in range(0, total, step):
            b = min(a + step, total)
            v = kmers[a : b + width - 1]
            v = (v & ~low) | np.arange(len(v), dtype=np.uint64)
            have = 1
            while 2 * have <= width:
                v = np.minimum(v[: len(v) - have], v[have:])
                have *= 2
            if have < width:
                v = np.minimum(v[: len(v) - (width - have)], v[width - have :])
            place[a:b] = a + (v & low).astype(np.int64)
        ends = np.repeat(self.rows[1:], np.diff(self.rows))[:total]
        valid = np.flatnonzero(np.arange(total) + window <= ends)
        return valid, place[valid], kmers

    def pieces(self, window: int, k: int):
        """Per piece: row, anchor's hash, digest, first word in the row, windows, digests before and after (0: none)."""
        valid, place, kmers = self.anchors(window, k)
        if not len(valid):
            return None
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(valid) != 1)) + 1
        at = np.concatenate([[0], cut])
        n = np.diff(np.concatenate([at, [len(valid)]]))
        first, where = valid[at], place[at]
        row = np.searchsorted(self.rows, first, side="right") - 1
        shape = (n.astype(np.uint64) << np.uint64(32)) | (where - first).astype(np.uint64)
        piece = mix64(self.digest(1, first, first + n + window - 1) ^ mix64(shape * _ODD))
        on = row[1:] == row[:-1]
        before, after = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
        before[1:][on], after[:-1][on] = piece[:-1][on], piece[1:][on]
        return row, kmers[where], piece, first - self.rows[row], n, before, after


PIECES = "doc_id long, row long, anchor long, piece long, first int, windows int, before long, after long"


def _pieces(window: int, k: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in pieces(batch, 2, limit):
                found = _Run(data, offsets).pieces(window, k)
                if found is None:
                    continue
                row, anchor, piece, first, n, before, after = found
                take = pa.array(row + a)
                longs = [pa.array(x.view(np.int64)) for x in (anchor, piece, before, after)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *longs[:2], pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), *longs[2:]], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


#: Digests of words at given places: of a span for a path, of each window of a span for edges.
PROOFS = "doc_id long, row long, first int, windows int, path boolean, proof binary"


class _Words:
    """A text's words, joined by one space, with digests of spans."""

    def __init__(self, text: str):
        words = text.encode().split()
        self.joined = memoryview(b" ".join(words))
        self.at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()

    def proof(self, first: int, end: int) -> bytes:
        return hashlib.blake2b(self.joined[self.at[first] : self.at[end] - 1], digest_size=16).digest()


def _proofs(window: int):
    """What is asked for of each text: flat lists of first words, windows, and whether as one path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, row, text, firsts, sizes, paths = (c[i].as_py() for c in batch.columns)
                words, first, size, path, proof = _Words(text), [], [], [], []
                for f, n, whole in sorted(set(zip(firsts, sizes, paths, strict=True))):
                    at = [f] if whole else range(f, f + n)
                    span = (n if whole else 1) + window - 1
                    first += at
                    size += [n if whole else 1] * len(at)
                    path += [whole] * len(at)
                    proof += [words.proof(x, x + span) for x in at]
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, row)), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(path, pa.bool_()), pa.array(proof, pa.binary())], names=[x.split()[0] for x in PROOFS.split(", ")])

    return run


def compacted(known: DataFrame) -> DataFrame:
    """Paths of pieces that never part: head (the first piece), doc_id, row, first (of the source), windows, pieces.

    known has, per piece: piece, at (doc_id, row, first of its source),
    windows, and before and after, null where occurrences differ in them.
    """
    links = known.select(F.col("piece").alias("before"), F.col("after").alias("follower")).where("follower IS NOT NULL")
    # All of a piece's occurrences follow `before`, and all of that one's come before it.
    glued = written(known.join(links, "before", "left").select("piece", "at.*", "windows", F.coalesce(F.col("follower") == F.col("piece"), F.lit(False)).alias("glued")), "glued")
    along = Window.partitionBy("doc_id", "row").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    chained = glued.withColumn("start", F.last(F.when(~F.col("glued"), F.col("first")), ignorenulls=True).over(along))
    return chained.groupBy("doc_id", "row", "start").agg(F.max(F.when(~F.col("glued"), F.col("piece"))).alias("head"), F.sum("windows").cast("int").alias("windows"), F.count("*").alias("pieces")).withColumnRenamed("start", "first")


def repeated_spans(docs: DataFrame, *, window: int = 50, k: int = 16, limit: int = 1 << 20) -> DataFrame:
    """Spans of (doc_id, row, text) rows that earlier documents hold.

    Returns doc_id, row, first (word), windows, source, source_row,
    source_first, proof: every window of the span also starts in document
    `source`, whose id is smaller, from that word on; proof is the digest of
    the source's words, null for spans of single windows, which were compared
    by such digests before.
    """
    seen = written(docs.where(F.col("doc_id").isNotNull()).mapInArrow(_pieces(window, k, limit), PIECES), "pieces")
    # Sums are written before they are joined: then both sides are plain shuffles, and hot keys are split.
    anchors = written(seen.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "anchors")
    shared = written(seen.join(anchors, "anchor", "left_semi"), "shared")
    single = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c)).alias(c)
    known = shared.groupBy("piece").agg(F.min(F.struct("doc_id", "row", "first")).alias("at"), F.max("doc_id").alias("last"), F.min("anchor").alias("anchor"), F.min("windows").alias("windows"), F.count("*").alias("n"), single("before"), single("after"))
    known = written(known, "known")
    branching = written(known.groupBy("anchor").agg(F.count("*").alias("ways")).where("ways > 1").select("anchor"), "branching")
    # Pieces of one document only lie in no path: all pieces of a path are of the same documents.
    paths = written(compacted(known.where(F.col("at.doc_id") < F.col("last"))), "paths")
    parted = written(known.join(branching, "anchor", "left_semi").select("piece", "at.doc_id"), "parted")
    asked = shared.select("piece", "doc_id", "row", "first", "windows").join(parted, ["piece", "doc_id"]).select("doc_id", "row", "first", "windows", F.lit(False).alias("path"))
    asked = asked.unionByName(paths.select("doc_id", "row", "first", "windows", F.lit(True).alias("path")))
    lists = written(asked.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "windows", "path")).alias("x")), "asked")
    read = docs.join(lists.hint("merge"), ["doc_id", "row"]).select("doc_id", "row", "text", "x.first", "x.windows", "x.path")
    proofs = written(read.mapInArrow(_proofs(window), PROOFS), "proofs")

    proven = proofs.where("path").groupBy("doc_id", "row", "first").agg(F.min("proof").alias("proof"))
    proven = written(paths.join(proven, ["doc_id", "row", "first"]).select(F.col("head").alias("piece"), F.col("windows").alias("length"), F.struct("doc_id", "row", "first").alias("at"), "proof"), "proven")
    whole = salted_join(shared.select("piece", "doc_id", "row", "first"), proven, "piece", known, shared.count(), "doc_id").where(F.col("doc_id") > F.col("at.doc_id"))
    whole = whole.select("doc_id", "row", "first", F.col("length").alias("windows"), F.col("at.doc_id").alias("source"), F.col("at.row").alias("source_row"), F.col("at.first").alias("source_first"), "proof")

    edges = proofs.where("NOT path").select("doc_id", "row", "first", "proof")
    sums = written(edges.groupBy("proof").agg(F.min(F.struct("doc_id", "row", "first")).alias("at"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("n > 1"), "edges")
    part = salted_join(edges, sums.where("at.doc_id < last").select("proof", "at"), "proof", sums, proofs.count(), "doc_id").where(F.col("doc_id") > F.col("at.doc_id"))
    part = part.select("doc_id", "row", "first", F.col("at.doc_id").alias("source"), F.col("at.row").alias("source_row"), F.col("at.first").alias("source_first")).distinct()
    # Windows one after the other in both texts are one span.
    diagonal = ["doc_id", "row", "source", "source_row", (F.col("first") - F.col("source_first")).alias("shift")]
    part = part.select("*", diagonal[-1]).withColumn("island", F.col("first") - F.row_number().over(Window.partitionBy("doc_id", "row", "source", "source_row", "shift").orderBy("first")))
    part = part.groupBy("doc_id", "row", "source", "source_row", "shift", "island").agg(F.min("first").alias("first"), F.count("*").cast("int").alias("windows"), F.min("source_first").alias("source_first"))
    return whole.unionByName(part.select("doc_id", "row", "first", "windows", "source", "source_row", "source_first", F.lit(None).cast("binary").alias("proof")))


def _kept(window: int, texts: bool, schema: T.StructType):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    kinds = pa.schema(fields + [("kept", pa.string()), ("original", pa.string())] * texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, _, _ in pieces(batch, 1):
                part = batch.slice(start, end - start)
                out: list[list] = [[] for _ in kinds]
                for key, text, firsts, runs, proofs in zip(*(c.to_pylist() for c in part.columns[:5]), strict=True):
                    words = [] if text is None else text.encode().split()
                    n = len(words)
                    if firsts:
                        own = _Words(text)
                        change = np.zeros(n + 1, np.int32)
                        for first, run_, proof in zip(firsts, runs, proofs, strict=True):
                            stop = first + run_ + window - 1
                            if proof is None or own.proof(first, stop) == proof:
                                change[first] += 1
                                change[stop] -= 1
                        keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                        words = [words[i] for i in keep.tolist()]
                    kept = b" ".join(words)
                    for o, v in zip(out, (key, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else "", text), strict=False):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(o, f.type) for o, f in zip(out, kinds, strict=True)), *part.columns[5:]], names=schema.names)

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 50, k: int = 16, texts: bool = True, carry: bool = False, limit: int = 1 << 20) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept_sha256; with texts also kept, original; with carry the row's other columns as a struct.

    A word goes if a window of `window` words over it also starts in a
    document with a smaller id; windows are judged on the input.  Null and
    empty texts have no words and keep an empty text; texts shorter than a
    window keep all.  Rows with equal ids do not act on each other; rows with
    a null id neither remove nor lose words.  Texts of any number of words
    are read whole, one text at a time in memory.  Other columns are not read.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and window")
    body = F.col(text).cast("string")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("row"), body.alias("text"))
    with scratch(docs.sparkSession):
        found = repeated_spans(source, window=window, k=k, limit=limit).groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "windows", "proof")).alias("spans"))
        spans = written(found, "spans", keep=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("row"), body.alias("text"), whole_row(docs, text)) if carry else source
    joined = rows.join(spans.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", F.col("spans.first").alias("firsts"), F.col("spans.windows").alias("runs"), F.col("spans.proof").alias("proofs"), *(["whole"] if carry else []))
    schema = T.StructType([*T._parse_datatype_string(KEPT + ", kept string, original string" * texts).fields, *joined.schema.fields[5:]])
    return joined.mapInArrow(_kept(window, texts, schema), schema)
