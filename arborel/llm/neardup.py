"""Near-duplicate documents by SetSketch registers, bands and exact checks.

A document's set of word shingles becomes m registers.  Register i is the
minimum over the set of an exponential variable, cut to exponentially spaced
levels: floor(1 - log_b(minimum)), between 0 and q + 1.  Registers of a union
are the element-wise maxima, and equal registers are about as frequent as the
Jaccard similarity of the sets.

Documents with equal sets form a class, kept as one node.  Bands of registers
key the buckets in which nodes meet; candidates pass a joint likelihood
estimate from their registers and then an exact comparison of the full sets.

Buckets are not expanded into all pairs.  The node of a bucket that meets most
others is its hub.  All members are compared with their hubs, which closes
most groups.  Members of a hub that are then outside its largest component are
compared with all its members, in blocks of bounded size that give links only.
So every pair that shares a bucket is compared or within one component.
A pair at the threshold shares no bucket with probability (1 - 0.8**r)**bands,
6e-7 for the defaults.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import HOT_ROWS, LOWER, mix64, pieces, salted_join, scratch, span_hashes, word_spans, written
from .components import components

#: Rate and base of the registers, and their largest value.
RATE, BASE, TOP = 20.0, 1.001, 65535
#: Elements of a set that count as one set's place in a block.
BLOCK_SET = 2000
_A, _B, _C = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)


def _keys(m: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, m + 1, dtype=np.uint64)
    return mix64(i * _A) | np.uint64(1), mix64(i * _B)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 2) -> list[np.ndarray]:
    """Sorted distinct hashes of the lower-cased word shingles of each row."""
    starts, ends, rows = word_spans(data, offsets)
    words = span_hashes(LOWER[data], starts, ends)
    h = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h[: len(words) - j] += mix64(words[j:] + np.uint64(j + 1) * _C) if j < len(words) else np.uint64(0)
    h = mix64(h)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
        elif b > a:  # fewer words than a shingle: the whole sequence is one
            whole = words[a:b] + np.arange(1, b - a + 1, dtype=np.uint64) * _B
            out.append(mix64(np.array([mix64(whole).sum(dtype=np.uint64) ^ np.uint64(b - a)])))
        else:
            out.append(words[:0])
    return out


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Registers (len(sets), m) as unsigned 16-bit integers; sets are not empty."""
    factor, salt = _keys(m)
    values = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((m, len(sets)), np.uint64)
    for i in range(m):
        least[i] = np.minimum.reduceat((values ^ salt[i]) * factor[i], at)
    u = (least.T.astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers with known set sizes."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-x * c) / np.log(BASE)
    slope = lambda x: c / (1 - x * c) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave: halve by its slope
        j = (low + high) / 2
        xu, xv = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        pu, pv = np.maximum(p(xu), 1e-12), np.maximum(p(xv), 1e-12)
        p0 = np.maximum(1 - pu - pv, 1e-12)
        du, dv = -v * slope(xu), -u * slope(xv)
        rising = up * du / pu + down * dv / pv - same * (du + dv) / p0 > 0
        low, high = np.where(rising, j, low), np.where(rising, high, j)
    return (low + high) / 2


def _intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of incidence matrices."""
    values, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in [*a, *b]])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    total = np.zeros((len(a), len(b)), np.float64)
    for begin in range(0, len(values), width):
        x, y = np.searchsorted(place, [begin, begin + width])
        part = np.zeros((len(a) + len(b), width), np.float32)
        part[row[x:y], place[x:y] - begin] = 1
        total += part[: len(a)] @ part[len(a) :].T
    return total


def _compare(percent: int):
    """Links between two blocks of (node, component, shingles): one for each pair of components at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (batch.column(c).slice(k, 1).flatten() for c in (0, 1))
                node, part, sets = zip(*((s.field(0).to_numpy(), s.field(1).to_numpy(), np.split(s.field(2).flatten().to_numpy(), np.cumsum(s.field(2).value_lengths().to_numpy())[:-1])) for s in (x, y)), strict=True)
                common = _intersections(*sets)
                size = [np.array([len(s) for s in each], float) for each in sets]
                linked = 100 * common >= percent * (size[0][:, None] + size[1][None] - common)
                i, j = np.nonzero(linked & (part[0][:, None] != part[1][None]))
                pairs = np.column_stack([part[0][i], part[1][j]])
                _, once = np.unique(np.sort(pairs, axis=1), axis=0, return_index=True)
                a, b = node[0][i[once]], node[1][j[once]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


SKETCH = "doc_id long, n long, key binary, registers binary"


def _sketch(size: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch, 1):
                sets = shingles(data, offsets, size)
                full = [s for s in sets if len(s)]
                n = np.array([len(s) for s in sets])
                key, regs = [None] * len(sets), [None] * len(sets)
                if full:
                    at = np.cumsum([0] + [len(s) for s in full[:-1]])
                    values = np.concatenate(full)
                    sums = np.stack([np.add.reduceat(mix64(values ^ x), at) for x in (_A, _B)], 1)
                    for i, k, r in zip(np.flatnonzero(n).tolist(), sums, registers(full, m), strict=True):
                        key[i], regs[i] = k.tobytes(), r.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "key", "registers"])

    return run


def _bands(m: int, r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, m // r, r).astype(np.uint64)
            h = np.zeros(regs.shape[:2], np.uint64)
            for j in range(r):
                h = mix64(h * _B + regs[:, :, j] + _C)
            h = mix64(h ^ (np.arange(m // r, dtype=np.uint64) * _A))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), m // r))], names=["band", "node"])

    return run


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (3, 5))
            j = estimate(a, b, batch.column(2).to_numpy().astype(float), batch.column(4).to_numpy().astype(float))
            keep = pa.array(j >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch, 1):
                sets = shingles(data, offsets, size)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["node", "shingles"])

    return run


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, r: int = 5, bands: int = 36, margin: float = 0.17, block: int = 128) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * intersection >= percent * union of their sets of
    lower-cased word shingles; links are confirmed on the full sets.
    component_id is the least doc_id that links lead to, itself included.
    Null and empty texts have an empty set and are alone.  Rows that share a
    doc_id count as one document for links; rows with a null id are alone,
    with a null component, and kept.  Other columns are not read.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with scratch(docs.sparkSession):
        return written(_near_duplicates(source, shingle, percent, r, bands, margin, block), "near", keep=True)


def _near_duplicates(source: DataFrame, shingle: int, percent: int, r: int, bands: int, margin: float, block: int) -> DataFrame:
    m = r * bands
    sketches = written(source.mapInArrow(_sketch(shingle, m), SKETCH), "sketches")
    known = sketches.where("doc_id IS NOT NULL AND n > 0")
    nodes = written(known.groupBy("key").agg(F.min("doc_id").alias("node"), F.any_value(F.struct("n", "registers")).alias("s")).select("node", "key", "s.n", "s.registers"), "nodes")
    met = nodes.select("node", "registers").mapInArrow(_bands(m, r), "band long, node long")
    met = written(met, "bands")
    # Sums are written before they are joined: then both sides are plain shuffles, and hot keys are split.
    crowds = written(met.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", "n"), "crowds")
    total = met.count()
    meetings = written(salted_join(met, crowds.withColumn("crowd", F.col("n")).drop("n"), "band", crowds, total, "node"), "meetings")
    scores = meetings.groupBy("node").agg(F.sum("crowd").alias("score"))
    members = written(meetings.join(scores, "node").select("band", "node", "score"), "members")
    # Texts and sets are shuffled at any size: a small run then moves what a large one does, in proportion.
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = written(source.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(shingle), "node long, shingles array<long>"), "sets")
    figures = written(nodes.join(wanted.withColumnRenamed("doc_id", "node"), "node", "left_semi").select("node", "n", "registers"), "figures")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs, one of each a hub, that link; hubs have many pairs, which are cut and meet copies of the hub."""
        pairs = written(pairs, "pairs")
        n_pairs, often = pairs.count(), {x: written(pairs.groupBy(x).agg(F.count("*").alias("n")).where(f"n > {HOT_ROWS}"), "often") for x in "ab"}
        met = lambda left, right, x: salted_join(left, right, x, often[x], n_pairs, "ba"["ab".index(x)])
        a, b = (figures.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}")) for x in "ab")
        sized = met(met(pairs, b, "b"), a, "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "ra", "nb", "rb")
        likely = written(sized.mapInArrow(_likely(percent / 100 - margin), "a long, b long"), "likely")
        sa, sb = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        both = met(met(likely.hint("merge"), sb, "b"), sa.hint("merge"), "a").select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("common"))
        return written(both.where(f"100 * common >= {percent} * (total - common)").select("a", "b").distinct(), "links")

    hubs = written(members.groupBy("band").agg(F.max(F.struct("score", "node")).alias("hub")).select("band", F.col("hub.node").alias("hub")), "hubs")
    meet = written(salted_join(members, hubs, "band", crowds, total, "node").select("hub", "node").distinct(), "meet")
    first = verified(meet.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    labels = components(first)

    # Where hub and members are of several components: those outside the largest, against all, in blocks.
    groups = written(meet.join(labels, "node", "left").join(figures.select("node", "n"), "node").select("hub", "node", F.coalesce("component", "node").alias("component"), "n"), "groups")
    parts = groups.groupBy("hub", "component").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    crowded = parts.groupBy("hub").agg(F.sum("k").alias("n"), F.sum("size").alias("size"), F.max(F.struct("k", "component", "size")).alias("most"), F.count("*").alias("kinds"))
    crowded = written(crowded, "crowded")
    # A block holds so many sets, and so many of their elements, on average at most.
    cut = lambda k, size: F.ceil(F.greatest(k / block, size / (block * BLOCK_SET)))
    mixed = crowded.where("kinds > 1").select("hub", F.col("most.component").alias("main"), cut(F.col("n") - F.col("most.k"), F.col("size") - F.col("most.size")).alias("rows"), cut(F.col("n"), F.col("size")).alias("columns"))
    entry = F.struct("node", "component", "shingles").alias("entry")
    apart = salted_join(groups.drop("n"), mixed, "hub", crowded, groups.count(), "node")
    rest = apart.join(sets, "node").select("hub", F.xxhash64("node").alias("h"), (F.col("component") != F.col("main")).alias("outside"), "rows", "columns", entry)
    left = rest.where("outside").groupBy("hub", F.expr("pmod(h, rows)").alias("i")).agg(F.collect_list("entry").alias("x"))
    right = rest.groupBy("hub", F.expr("pmod(h, columns)").alias("j")).agg(F.collect_list("entry").alias("y"))
    index = mixed.select("hub", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), "columns").select("hub", "i", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    blocks = index.join(left, ["hub", "i"]).join(right, ["hub", "j"]).select("x", "y")
    second = blocks.mapInArrow(_compare(percent), "a long, b long")
    labels = components(written(second.distinct(), "links"), labels)
    classes = nodes.select("key", "node")
    classes = classes.join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    done = sketches.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(classes, "key", "left")
    component = F.coalesce("component", "doc_id")
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
