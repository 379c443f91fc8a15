"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Merges go by score, the best candidate of a segment first, the leftmost of
equals.  A candidate (two neighbours, where they begin) is skipped if a keyed
hash of it falls below the dropout rate; a new candidate arises when a
neighbour changes.  The key is the seed, a hash of the whole text and the
segment's place in it, so a text's segmentation is reproducible, and other
seeds, other texts and repeats within a text vary.  With rate 0 the result is
the library's own.

White space only ever begins a piece, so texts are cut before each run of
spaces and around line ends.  What a segment becomes depends on which of its
merges are skipped alone, so courses are kept: the merges of a segment without
skips, and from each merge the course that is taken if that one is skipped.
Every occurrence draws for its own merges and follows the courses to the one
of which it skips nothing.  New courses of a batch, and segments too long to
recur, are worked out in numpy rounds, a merge of each segment at a time; those
of which that would be too many go through an agenda, a heap of candidates.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix64, pieces, span_hashes
from .langid import Table

MARK = "▁"
NONE = np.int64(1) << 30
#: Courses that a worker keeps; beyond it the memory starts anew.
MEMO = 400_000
#: Segments of more bytes are worked out at each occurrence.
LONG = 40
#: Segments of more bytes, such as text without spaces, go through a heap.
AGENDA = 1000
#: Occurrences that are drawn for at a time.
DRAWN = 200_000
_P, _Q = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


class Pieces:
    """The vocabulary of a BPE model with byte fallback, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte0 = next(i for i in range(n) if model.is_byte(i))
        usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in usual}
        scores = np.full(n, -np.inf)
        scores[usual] = [model.get_score(i) for i in usual]
        _, rank = np.unique(-scores, return_inverse=True)
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("pieces of this model join words")
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[0x20], self.char[ord(MARK)] = self.char[ord(MARK)], -1  # the mark itself, in a text, goes by bytes
        pairs = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        keys = mix64(np.array([a * n + b for a, b in pairs], np.uint64))
        order = np.argsort(keys)
        self.n, self.table = n, Table(keys[order], np.array(list(pairs.values()), np.int64)[order])
        self.rank = rank.astype(np.int64)
        #: Bytes of each piece, for decoding
        self.raw = [bytes([i - self.byte0]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode() if scores[i] > -np.inf else b"" for i in range(n)]

    def segments(self, segments: list[bytes], key: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each segment), keyed by the segments' own bytes."""
        data = np.frombuffer(b"".join(segments), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
        salt = span_hashes(data, np.concatenate([[0], ends[:-1]]), ends) ^ mix64(np.array([key], np.uint64))
        return self.merged(segments, salt, rate)[:2]

    def merged(self, segments: list[bytes], salt: np.ndarray, rate: float, gone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, number of ids of each segment, then of all merges in order: segment, and the candidate's two numbers).

        Candidates are skipped by their `skips` under the segment's salt, or,
        if `gone` is given, where that hash is among its sorted values.
        """
        raw = b"".join(segments)
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
        chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[np.concatenate([[0], ends])]
        size = np.diff(heads)
        word = np.repeat(np.arange(len(segments)), size)
        place = np.arange(len(chars)) - np.repeat(heads[:-1], size)
        known = self.char[chars]
        sym = np.where(known >= 0, known, -chars - 1)
        limit = np.uint64(int(rate * 2.0**32))
        # One cell a symbol; pair i joins symbols i and i + 1.
        into = np.full(len(sym), -1, np.int64)
        rank = np.full(len(sym), NONE, np.int64)

        def weigh(at: np.ndarray) -> None:
            at = at[at + 1 < len(sym)]
            at = at[(word[at] == word[at + 1]) & (sym[at] >= 0) & (sym[at + 1] >= 0)]
            pair = (sym[at] * self.n + sym[at + 1]).astype(np.uint64)
            found = self.table.find(mix64(pair))
            ok = found >= 0
            if rate or gone is not None:
                h = mix64(salt[word[at]] + pair * _P ^ mix64(place[at].astype(np.uint64) * _Q))
                if gone is None:
                    ok &= (h >> np.uint64(32)) >= limit
                elif len(gone):
                    ok &= gone[np.minimum(np.searchsorted(gone, h), len(gone) - 1)] != h
            at, found = at[ok], found[ok]
            into[at] = self.table.values[found]
            rank[at] = self.rank[into[at]]

        weigh(np.arange(len(sym)))
        done_word, done_place, done_sym = [], [], []
        merges: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), first)
            live = best < NONE << 32
            if not live.all():
                over = ~np.repeat(live, np.diff(np.append(first, len(sym))))
                done_word.append(word[over]), done_place.append(place[over]), done_sym.append(sym[over])
                stay = ~over
                shift = np.cumsum(stay) - 1
                sym, word, place, into, rank = sym[stay], word[stay], place[stay], into[stay], rank[stay]
                best = best[live]
                at = shift[best & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            if not len(sym):
                break
            for m, v in zip(merges, (word[at], (sym[at] * self.n + sym[at + 1]).astype(np.uint64), place[at]), strict=True):
                m.append(v)
            sym[at] = into[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word, place, into, rank = sym[stay], word[stay], place[stay], into[stay], rank[stay]
            at = at - np.arange(len(at))
            touched = np.zeros(len(sym), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            again = np.flatnonzero(touched)
            into[again], rank[again] = -1, NONE
            weigh(again)
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(segments), np.int64), *(m[0] for m in merges)
        word, place, sym = np.concatenate(done_word), np.concatenate(done_place), np.concatenate(done_sym)
        order = np.lexsort((place, word))
        word, sym = word[order], sym[order]
        odd = np.flatnonzero(sym < 0)
        if len(odd):  # characters without a piece: their bytes
            encoded = [chr(-v - 1).encode() for v in sym[odd].tolist()]
            copies = np.ones(len(sym), np.int64)
            copies[odd] = list(map(len, encoded))
            word, sym = np.repeat(word, copies), np.repeat(sym, copies)
            sym[sym < 0] = np.frombuffer(b"".join(encoded), np.uint8).astype(np.int64) + self.byte0
        of, pair, where = map(np.concatenate, merges)
        order = np.argsort(of, kind="stable")
        return sym, np.bincount(word, minlength=len(segments)), of[order], pair[order] * _P, mix64(where[order].astype(np.uint64) * _Q)


    def agenda(self, segment: bytes, salt: int, rate: float) -> list[int]:
        """Ids of one segment, as `merged` has them, in time that grows with n log n."""
        chars = np.frombuffer(segment.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        known = self.char[chars]
        sym = np.where(known >= 0, known, -chars - 1).tolist()
        limit, last = int(rate * 2.0**32), len(sym)
        before, after = list(range(-1, last - 1)), [*range(1, last), -1]
        into: dict[int, tuple[int, int]] = {}  # pair -> its piece and rank; rank NONE if there is none

        def learn(pairs: np.ndarray) -> None:
            pairs = np.unique(pairs)
            at = self.table.find(mix64(pairs.astype(np.uint64)))
            piece = self.table.values[at]
            into.update(zip(pairs.tolist(), zip(piece.tolist(), np.where(at >= 0, self.rank[piece], NONE).tolist(), strict=True), strict=True))

        def candidate(i: int) -> tuple[int, int, int] | None:
            """(rank, place, pair) of a symbol and the next, unless they never merge or are skipped."""
            a, b = sym[i], sym[after[i]]
            if a < 0 or b < 0:
                return None
            pair = a * self.n + b
            if pair not in into:
                learn(np.array([pair]))
            skipped = limit and _mixed((salt + pair * int(_P) & _ALL) ^ _mixed(i * int(_Q) & _ALL)) >> 32 < limit
            return None if into[pair][1] >= NONE or skipped else (into[pair][1], i, pair)

        first = np.array(sym)
        learn((first[:-1] * self.n + first[1:])[(first[:-1] >= 0) & (first[1:] >= 0)])
        heap = [c for i in range(last - 1) if (c := candidate(i))]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j < 0 or sym[i] < 0 or sym[j] < 0 or sym[i] * self.n + sym[j] != pair:
                continue  # one of the two has gone into another piece
            sym[i], sym[j], after[i] = into[pair][0], None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and after[k] >= 0 and (c := candidate(k)):
                    heapq.heappush(heap, c)
        out: list[int] = []
        for v in sym:
            if v is not None:
                out += [v] if v >= 0 else [b + self.byte0 for b in chr(-v - 1).encode()]
        return out

    def alone(self, segments: list[bytes], salt: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each segment) of segments that do not recur."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        short, parts = np.flatnonzero(size <= AGENDA), [np.zeros(0, np.int32)] * len(segments)
        if len(short):
            ids, sizes = self.merged([segments[i] for i in short.tolist()], salt[short], rate)[:2]
            for i, own in zip(short.tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                parts[i] = own
        for i in np.flatnonzero(size > AGENDA).tolist():
            parts[i] = np.array(self.agenda(segments[i], int(salt[i]), rate))
        return np.concatenate(parts).astype(np.int32), np.fromiter(map(len, parts), np.int64, len(parts))


_ALL = (1 << 64) - 1


def _mixed(x: int) -> int:
    """common.mix64 of one number."""
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & _ALL
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & _ALL
    return x ^ x >> 33


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(self.size + 2 * len(values), self.data.dtype)])
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)


def _spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one after the other."""
    heads = np.cumsum(sizes) - sizes
    return np.repeat(begin - heads, sizes) + np.arange(int(sizes.sum()))


class Courses:
    """What segments become, by the merges that they skip."""

    def __init__(self, pieces: Pieces, rate: float):
        self.pieces, self.rate, self.limit = pieces, rate, np.uint64(int(rate * 2.0**32))
        self.roots: dict[bytes, int] = {}
        #: Of each course: its segment, and the numbers of the candidates it skips.
        self.segment: list[bytes] = []
        self.skipped: list[tuple[tuple[int, int], ...]] = []
        #: How many merges it shares with its parent
        self.depth = np.zeros(0, np.int64)
        self.begin, self.length, self.ids = Grown(np.int64), Grown(np.int64), Grown(np.int32)
        #: Merges of a course beyond those of its parent, the two numbers of each, and the course if it is skipped.
        self.first, self.merges = Grown(np.int64), Grown(np.int64)
        self.a, self.b, self.child = Grown(np.uint64), Grown(np.uint64), Grown(np.int64)

    def add(self, segments: list[bytes], skipped: list[tuple[tuple[int, int], ...]], known: np.ndarray) -> None:
        """Work out courses; of the merges of each, the first `known` ones are shared with its parent."""
        own = mix64(np.arange(1, len(segments) + 1).astype(np.uint64))
        n_gone = list(map(len, skipped))
        pairs = np.array([p for s in skipped for p in s], np.uint64).reshape(-1, 2)
        gone = np.sort(mix64(np.repeat(own, n_gone) + pairs[:, 0] ^ pairs[:, 1]))
        ids, sizes, of, a, b = self.pieces.merged(segments, own, 0.0, gone)
        self.begin.add(self.ids.size + np.cumsum(sizes) - sizes), self.length.add(sizes), self.ids.add(ids)
        n = np.bincount(of, minlength=len(segments))
        new = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) >= np.repeat(known, n)
        n = n - known
        self.first.add(self.a.size + np.cumsum(n) - n), self.merges.add(n)
        self.a.add(a[new]), self.b.add(b[new]), self.child.add(np.full(int(new.sum()), -1))
        self.segment += segments
        self.skipped += skipped
        self.depth = np.concatenate([self.depth, known])

    def of(self, segments: list[bytes], salt: np.ndarray) -> np.ndarray:
        """The course of each occurrence."""
        course = np.fromiter(map(self.roots.get, segments, itertools.repeat(-1)), np.int64, len(segments))
        if (course < 0).any():
            fresh = list(dict.fromkeys(segments[i] for i in np.flatnonzero(course < 0).tolist()))
            self.roots.update(zip(fresh, range(len(self.segment), len(self.segment) + len(fresh)), strict=True))
            self.add(fresh, [()] * len(fresh), np.zeros(len(fresh), np.int64))
            course = np.fromiter(map(self.roots.__getitem__, segments), np.int64, len(segments))
        left = np.arange(len(course)) if self.rate else np.zeros(0, np.int64)
        while len(left):
            left = left[self.merges.data[course[left]] > 0]
            n = self.merges.data[course[left]]
            at = _spread(self.first.data[course[left]], n)
            h = mix64(np.repeat(salt[left], n) + self.a.data[at] ^ self.b.data[at])
            hit = np.flatnonzero((h >> np.uint64(32)) < self.limit)
            which, first = np.unique(np.repeat(np.arange(len(left)), n)[hit], return_index=True)
            left, at = left[which], at[hit[first]]
            open_ = self.child.data[at] < 0
            if open_.any():
                new, where = np.unique(at[open_], return_index=True)
                parent = course[left[open_][where]]
                known = self.depth[parent] + new - self.first.data[parent]
                self.child.data[new] = np.arange(len(self.segment), len(self.segment) + len(new))
                numbers = zip(self.a.data[new].tolist(), self.b.data[new].tolist(), strict=True)
                self.add([self.segment[p] for p in parent.tolist()], [(*self.skipped[p], x) for p, x in zip(parent.tolist(), numbers, strict=True)], known)
            course[left] = self.child.data[at]
        return course


class MergeDropout:
    """Encoder and decoder; loads its model once in each process."""

    def __init__(self, path: str, rate: float = 0.1, seed: int = 0):
        self.path, self.rate, self.seed = path, rate, seed
        self.pieces: Pieces | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("path", "rate", "seed")} | {"pieces": None}

    def load(self) -> None:
        self.pieces = Pieces(self.path)
        self.raw = self.pieces.raw
        self.courses = Courses(self.pieces, self.rate)

    def salts(self, texts: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Of each segment: seed, hash of its text, and its place there."""
        key = str(self.seed).encode()
        of_text = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=8, key=key).digest() for t in texts), "<u8")
        place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return mix64(np.repeat(of_text, counts) + place.astype(np.uint64) * _Q)

    def _cut(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Segments of all texts, each with its leading space, and their number in each text."""
        rows = []
        for t in texts:
            if b"\0" in t:
                return [s for u in texts for s in self._slow(u)], np.array([len(self._slow(u)) for u in texts])
            rows.append(b" " + t)
        heads = np.cumsum([0] + [len(r) for r in rows])
        data = np.frombuffer(b"".join(rows), np.uint8)
        space, line = data == 0x20, data == 0x0A
        begin = line.copy()
        begin[1:] |= line[:-1] | space[1:] & ~space[:-1]
        begin[heads[:-1]] = True
        cut = np.flatnonzero(begin)
        segments = np.insert(data, cut, 0).tobytes().split(b"\0")[1:]
        return segments, np.diff(np.searchsorted(cut, heads))

    @staticmethod
    def _slow(text: bytes) -> list[bytes]:
        out, now = [], b""
        for i, c in enumerate(b" " + text):
            c = bytes([c])
            if now and (c == b"\n" or now == b"\n" or c == b" " and now[-1:] != b" "):
                out.append(now)
                now = b""
            now += c
        return [*out, now]

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        segments, counts = self._cut(texts)
        salt = self.salts(texts, counts)
        out = []
        for a in range(0, len(segments), DRAWN):
            out.append(self._drawn(segments[a : a + DRAWN], salt[a : a + DRAWN]))
        sizes = np.concatenate([n for _, n in out])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return np.split(np.concatenate([i for i, _ in out]), ends[:-1])

    def _drawn(self, segments: list[bytes], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each segment)."""
        if len(self.courses.segment) > MEMO:
            self.courses = Courses(self.pieces, self.rate)
        long = np.fromiter(map(len, segments), np.int64, len(segments)) > LONG
        if not long.any():
            course = self.courses.of(segments, salt)
            sizes = self.courses.length.data[course]
            return self.courses.ids.data[_spread(self.courses.begin.data[course], sizes)], sizes
        parts = []
        for some, ids_of in ((~long, self._drawn), (long, lambda s, k: self.pieces.alone(s, k, self.rate))):
            at = np.flatnonzero(some)
            parts.append((at, *(ids_of([segments[i] for i in at.tolist()], salt[at]) if len(at) else (np.zeros(0, np.int32), np.zeros(0, np.int64)))))
        sizes = np.zeros(len(segments), np.int64)
        for at, _, n in parts:
            sizes[at] = n
        begin = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), np.int32)
        for at, found, n in parts:
            ids[_spread(begin[at], n)] = found
        return ids, sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        if self.pieces is None:
            self.load()
        raw = [(t or "").encode() for t in texts]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        some = [i for i, t in enumerate(raw) if t]
        if some:
            for i, ids in zip(some, self._ids([raw[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, without the first space."""
        if self.pieces is None:
            self.load()
        return b"".join(map(self.raw.__getitem__, ids.tolist())).removeprefix(b" ").decode()


ENCODED = "doc_id long, ids array<int>"


def encode(docs: DataFrame, coder: MergeDropout, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, ids.

    Null and empty texts have no ids.  Equal texts have equal ids, whatever
    the row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in pieces(batch, 1):
                part = batch.slice(a, b - a)
                ids = coder.encode(part.column(1).to_pylist())
                offsets = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, coder: MergeDropout) -> DataFrame:
    """Per row of encode's result: doc_id, ids, text; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [coder.decode(np.array(i if i is not None else [], np.int64)) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, ENCODED + ", text string")


DIGEST = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean"


def round_trip(docs: DataFrame, coder: MergeDropout, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_tokens, ids_crc32, decoded_sha256, lossless.

    ids_crc32 is of the ids as little-endian unsigned 32-bit integers; lossless
    says whether decoding gave the text back (null counts as empty).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in pieces(batch, 1):
                part = batch.slice(a, b - a)
                texts = part.column(1).to_pylist()
                out: list[list] = [[], [], [], []]
                for t, ids in zip(texts, coder.encode(texts), strict=True):
                    back = coder.decode(ids)
                    for o, v in zip(out, (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, DIGEST)
