"""Token ids in a fixed-width packed binary format.

Every id takes the least number of bits that hold the vocabulary.  A shard
file holds blocks of packed ids, a table of documents and a table of block
offsets, so that any span of ids is read by unpacking its blocks only.
Shards hold ascending ranges of document ids; a manifest, written last, lists
them and gives each its place in the whole sequence of ids.

Shard layout, little-endian; a file is written in one go, so its figures end it::

    blocks: block i begins at its offset; ids are packed from the low bit up
    documents: i64 doc_id, u64 first id within the shard
    null ids: a bit for each document, from the low bit up
    block offsets: u64 each, and the end of the last block
    head: magic "TKPK", u32 bits, u32 ids in a block, u64 ids, u64 documents
    footer: u64 place of documents, u64 place of block offsets
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.columns import name_hashes
from .common import LOWER, SPACE, new_path, pieces, ranged, shards_for

MAGIC = b"TKPK"
HEAD = struct.Struct("<4sIIQQ")
FOOT = struct.Struct("<QQ")
#: Chunks of text that one worker keeps encoded; beyond it those that did not recur go.
MEMO = 400_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Pack unsigned ids, bits each, from the low bit up."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The n ids packed in raw (uint8), as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return raw[: n * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    planes = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard under a temporary name and renames it when it is whole."""

    def __init__(self, uri: str, bits: int, block: int):
        self.fs, self.path = store(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.bits, self.block = self.fs.open_output_stream(self.temporary), bits, block
        self.rest, self.held = [], 0
        self.docs: list[int | None] = []
        self.firsts, self.offsets, self.n, self.at = [0], [0], 0, 0

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs += doc_ids
        self.firsts += (self.n + np.cumsum(lengths)).tolist()
        self.n += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, whole, self.block):
            raw = pack(ids[a : min(a + self.block, whole)], self.bits)
            self.out.write(raw)
            self.at += len(raw)
            self.offsets.append(self.at)
        self.rest, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> dict:
        self.flush(True)
        docs = np.empty((len(self.docs), 2), "<i8")
        docs[:, 0] = [0 if d is None else d for d in self.docs]
        docs[:, 1] = self.firsts[:-1]
        nulls = np.packbits(np.array([d is None for d in self.docs], bool), bitorder="little")
        self.out.write(docs.tobytes() + nulls.tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(HEAD.pack(MAGIC, self.bits, self.block, self.n, len(self.docs)))
        self.out.write(FOOT.pack(self.at, self.at + docs.nbytes + nulls.nbytes))
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return {"path": self.path, "docs": len(self.docs), "ids": self.n}


class ShardReader:
    """Random access to one shard."""

    def __init__(self, uri: str):
        filesystem, path = store(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(HEAD.size + FOOT.size, size - HEAD.size - FOOT.size)
        magic, self.bits, self.block, self.n, n_docs = HEAD.unpack_from(tail)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        at, blocks = FOOT.unpack_from(tail, HEAD.size)
        listed = self.file.read_at(blocks - at, at)
        docs = np.frombuffer(listed, "<i8", 2 * n_docs).reshape(n_docs, 2)
        #: Which ids are null; theirs reads as 0
        self.null = np.unpackbits(np.frombuffer(listed, np.uint8, offset=docs.nbytes), count=n_docs, bitorder="little").astype(bool)
        self.doc_ids, self.firsts = docs[:, 0], np.append(docs[:, 1], self.n)
        self.offsets = np.frombuffer(self.file.read_at(size - HEAD.size - FOOT.size - blocks, blocks), "<u8").astype(np.int64)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids first to end of the shard, from their blocks only."""
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (end - 1) // self.block + 1
        raw = np.frombuffer(self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a])), np.uint8)
        got = []
        for k in range(a, b):
            n = min(self.block, self.n - k * self.block)
            got.append(unpack(raw[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]], self.bits, n))
        return np.concatenate(got)[first - a * self.block : end - a * self.block]

    def close(self) -> None:
        self.file.close()


_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
#: ASCII signs but the apostrophe, which begins pre-tokens of its own.
_SIGNS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27)
_SIGN = np.zeros(256, bool)
_SIGN[list(_SIGNS)] = True
#: Pre-tokens of lower-case ASCII text, as the tokenizer cuts it.
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class Encoder:
    """Encodes texts with a lower-casing tokenizer of words that end in a suffix.

    Such a tokenizer drops white space and never joins across it, so a text has
    the ids of its chunks, one after another.  Each distinct chunk goes through
    the library once and is kept while it recurs.  A run of signs between an
    ASCII letter and white space is a chunk of its own, as it is for the
    tokenizer.
    Texts that may hold a special token's string are encoded as a whole.
    """

    def __init__(self, path: str, suffix: str = "</w>"):
        self.path, self.suffix, self.tokenizer = path, suffix, None

    def __getstate__(self):
        return {"path": self.path, "suffix": self.suffix, "tokenizer": None}

    def load(self) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(self.suffix)]] = True
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, chunks: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        k, n = len(self.known), len(chunks)
        while k + n > len(self.begin):
            self.begin, self.length, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.hits))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[k : k + n], self.length[k : k + n], self.hits[k : k + n] = self.used + np.cumsum(lengths) - lengths, lengths, 0
        self.known.update(zip(chunks, range(k, k + n), strict=True))
        self.used += len(ids)

    @staticmethod
    def pre_tokens(chunk: bytes) -> int:
        """Pre-tokens of a chunk, or 0 where only the library can say."""
        if chunk.isalpha():
            return 1
        if chunk.isascii():
            return len(_ASCII.findall(chunk))
        core = chunk.rstrip(_SIGNS)
        return (1 + (len(core) < len(chunk))) * core.decode().isalpha()

    def learn(self, chunks: list[bytes]) -> None:
        """Chunks with a known number of pre-tokens go in groups, cut by the suffix that ends each."""
        counts = list(map(self.pre_tokens, chunks))
        rest = [c for c, n in zip(chunks, counts, strict=True) if not n]
        plain = [(c, n) for c, n in zip(chunks, counts, strict=True) if n]
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for at in range(0, len(groups), 25):  # the library's results are large; few live at a time
            part = groups[at : at + 25]
            for group, ids in zip(part, self.ids([b" ".join(c for c, _ in g).decode() for g in part]), strict=True):
                words, n = zip(*group, strict=True)
                flat = np.array(ids, np.uint32)
                ends = np.flatnonzero(self.closes[flat]) + 1
                last = np.cumsum(n) - 1
                if len(ends) == last[-1] + 1:
                    self.keep(words, flat, np.diff(ends[last], prepend=0))
                else:
                    rest += words
        for i in range(0, len(rest), 1000):
            part = rest[i : i + 1000]
            ids = self.ids([c.decode() for c in part])
            self.keep(part, np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def forget(self) -> None:
        """Keep what was met at least twice since the last time."""
        n = len(self.known)
        stay = np.flatnonzero(self.hits[:n] > 1)
        words = list(self.known)
        begin, length, flat = self.begin[stay], self.length[stay], self.flat
        at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        self.known, self.used = {}, 0
        self.keep([words[i] for i in stay.tolist()], flat[at], length)

    @staticmethod
    def distinct(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct chunk, and for each chunk which of those it equals.

        Chunks are told apart by a hash; lengths and the first 16 bytes are
        compared besides.
        """
        size = stops - starts
        _, first, inverse = np.unique(name_hashes(data, starts, size), return_index=True, return_inverse=True)
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        mask = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
        for part in (size, words[starts] & mask[np.minimum(size, 8)], words[starts + 8] & mask[np.clip(size - 8, 0, 8)]):
            if (part != part[first][inverse]).any():
                return np.arange(len(starts)), np.arange(len(starts))
        return first, inverse

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text with the end id, all ids one after another)."""
        if self.tokenizer is None:
            self.load()
        if len(self.known) > MEMO:
            self.forget()
        odd = {i: t for i, t in enumerate(texts) if b"<|" in t}
        raw = b"\n".join(b"" if i in odd else t for i, t in enumerate(texts)) + b"\n"
        data = LOWER[np.frombuffer(raw, np.uint8)]
        sign = _SIGN[data]
        begin, end = np.flatnonzero(sign[1:] & ~sign[:-1]) + 1, np.flatnonzero(sign[:-1] & ~sign[1:]) + 1
        end = end[len(end) - len(begin) :]  # the text may begin with a run; it never ends with one
        cut = begin[_LETTER[data[begin - 1]] & SPACE[data[end]]]
        heads = np.cumsum([0] + [0 if i in odd else len(t) for i, t in enumerate(texts)]) + np.arange(len(texts) + 1)
        heads += np.searchsorted(cut, heads)
        data = np.concatenate([np.insert(data, cut, 0x20), np.zeros(48, np.uint8)])
        blank = SPACE[data]
        blank[-48:] = True
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        stops = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        counts = np.diff(np.searchsorted(starts, heads))
        first, inverse = self.distinct(data, starts, stops)
        flat = data.tobytes()
        chunks = [flat[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        known = np.fromiter(map(self.known.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(known < 0).tolist()
        if new:
            missing = [chunks[i] for i in new]
            self.learn(list(dict.fromkeys(missing)))
            known[new] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(new))
        which = known[inverse]
        self.hits[: len(self.known)] += np.bincount(which, minlength=len(self.known))
        lengths = self.length[which]
        place = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.begin[which] - place[:-1], lengths) + np.arange(place[-1])]
        ends = place[np.cumsum(counts)]
        sizes = np.diff(ends, prepend=0) + 1
        ids = np.insert(ids, ends, end_id)
        if odd:
            split = np.split(ids, np.cumsum(sizes)[:-1])
            for i, found in zip(odd, self.ids([t.decode() for t in odd.values()]), strict=True):
                split[i], sizes[i] = np.array([*found, end_id], np.uint32), len(found) + 1
            ids = np.concatenate(split)
        return sizes, ids


MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("shard", T.IntegerType()), ("uri", T.StringType()), ("docs", T.LongType()), ("ids", T.LongType()))])
READ = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, vocabulary: int | None = None, block: int = 1 << 16, shards: int | None = None) -> dict:
    """Encode and write all documents, ids ascending; return the manifest.

    Null and empty texts give the end id alone; rows with equal ids follow in
    the order of their texts and null ids come first; an empty table gives a
    manifest without shards.  Other columns are not read.  Shards are cut by
    counts of all ids, alike in every run; rows with one id are in one.  A
    lost task is done again: it writes under a new temporary name and renames
    over the same shard name with the same bytes.  Texts of any length are
    encoded whole, one batch of about 2 MB or one text at a time.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = vocabulary or Tokenizer.from_file(tokenizer).get_vocab_size()
    bits, encoder = bits_for(max(vocabulary, end_id + 1)), Encoder(tokenizer)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    ordered = ranged(rows, "doc_id", shards or shards_for(docs)).sortWithinPartitions("doc_id", "text")
    make_folder(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for a, b, _, _ in pieces(batch, 1, 1 << 21):
                part = batch.slice(a, b - a)
                writer = writer or ShardWriter(f"{path}/shard-{shard:06d}.tkpk", bits, block)
                writer.add(part.column(0).to_pylist(), *encoder.encode(part.column(1).to_pylist(), end_id))
        if writer:
            done = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": f"{path}/shard-{shard:06d}.tkpk", "docs": done["docs"], "ids": done["ids"]}], pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = sorted(ordered.mapInArrow(write, MANIFEST).collect())  # one row a shard
    starts = [0, *itertools.accumulate(r["ids"] for r in rows)]
    manifest = {"bits": bits, "block": block, "end_id": end_id, "ids": starts[-1], "shards": [r.asDict() | {"start": s} for r, s in zip(rows, starts, strict=False)]}
    filesystem, place = store(path)
    with filesystem.open_output_stream(f"{place}/manifest.json.tmp") as out:
        out.write(json.dumps(manifest).encode())
    filesystem.move(f"{place}/manifest.json.tmp", f"{place}/manifest.json")
    return manifest


def make_folder(uri: str) -> None:
    filesystem, place = store(uri)
    filesystem.create_dir(place, recursive=True)


def read_manifest(path: str) -> dict:
    filesystem, place = store(path)
    with filesystem.open_input_stream(f"{place}/manifest.json") as file:
        return json.loads(file.read())


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens and the checksum of its ids, from the files."""
    shards = read_manifest(path)["shards"]
    listed = spark.createDataFrame([(s["uri"], s["start"]) for s in shards], "uri string, start long").repartition(max(1, len(shards)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = ShardReader(uri)
                a = 0
                while a < len(shard.doc_ids):  # documents of some 500,000 ids, or one
                    b = max(a + 1, min(a + 5000, int(np.searchsorted(shard.firsts, shard.firsts[a] + 500_000, side="right")) - 1))
                    keys, null, firsts = shard.doc_ids[a:b], shard.null[a:b], shard.firsts[a : b + 1]
                    a = b
                    ids = memoryview(shard.ids(int(firsts[0]), int(firsts[-1])).astype("<u4").tobytes())
                    at = ((firsts - firsts[0]) * 4).tolist()
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=null), pa.array(firsts[:-1] + start), pa.array(np.diff(firsts)), pa.array(crc, pa.int64())], names=READ.names)
                shard.close()

    return listed.mapInArrow(read, READ)


def token_file(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents to a new folder of the shared store and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(docs.sparkSession, path)
