"""Language identification by interpolated Kneser-Ney character models.

Each language has one n-gram model over folded characters: letters in lower
case, everything else one space, repeated spaces one.  Models of all languages
share sorted hash arrays: for each order, the sorted hashes of all n-grams
that any language has seen, and beside each hash the log probability of its
last character in every language; likewise the back-off weights of contexts.
A text gets the language of the lowest cross-entropy per character.  What is
rejected is calibrated on held-out texts: models of two parts of the training
texts each judge the third, and the limit is what a stated share of those held
out exceeds.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import mix64, pieces, whole_row

UNKNOWN = "und"
_K = np.uint64(0x9E3779B97F4A7C15)


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or a space for what is no letter."""
    table = np.full(sys.maxunicode + 1, 0x20, np.int32)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: list[np.ndarray] = []


def folded(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts of a run, and the offsets of each text.

    Every text begins with one space; a text without letters is that space.
    """
    if not _table:
        _table.append(_fold_table())
    raw = np.frombuffer(data, np.uint8)
    chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    rows = heads[offsets]
    n = len(rows) - 1
    out = np.full(len(chars) + n, 0x20, np.int32)
    where = np.arange(len(chars)) + np.repeat(np.arange(1, n + 1), np.diff(rows))
    out[where] = _table[0][chars]
    begins = rows[:-1] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0x20) | (out[:-1] != 0x20)
    keep[begins] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[np.append(begins, len(out))]


def grams(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, for n = 1 to order.

    Hashes of n-grams that reach over a text's beginning are made too; callers
    look at those within a text only.
    """
    c = mix64(chars.astype(np.uint64) + np.uint64(1))
    out = [c]
    for n in range(2, order + 1):
        h = np.zeros(len(c), np.uint64)
        h[n - 1 :] = mix64(out[-1][n - 2 : -1] * _K + c[n - 1 :]) if len(c) >= n else 0
        out.append(h)
    return out


@dataclass
class Table:
    """A sorted hash array with a row of values beside each hash."""

    hashes: np.ndarray
    values: np.ndarray

    def __post_init__(self):
        self.bits = np.uint64(64 - max(1, int(np.log2(max(2, len(self.hashes)))) + 1))
        top = np.arange(1 << int(np.uint64(64) - self.bits), dtype=np.uint64) << self.bits
        self.begin = np.searchsorted(self.hashes, top).astype(np.int32)
        ends = np.append(self.begin[1:], len(self.hashes))
        self.most = int((ends - self.begin).max()) if len(self.hashes) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1: its leading bits give where to begin."""
        at = np.full(len(h), -1, np.int32)
        if not self.most:
            return at
        place = self.begin[(h >> self.bits).astype(np.int64)]
        last = len(self.hashes) - 1
        left = np.arange(len(h))
        for _ in range(self.most + 1):
            p = np.minimum(place, last)
            got = self.hashes[p]
            hit = got == h[left]
            at[left[hit]] = p[hit]
            on = (got < h[left]) & (place < last)
            left, place = left[on], place[on] + 1
            if not len(left):
                break
        return at


def _counts(h: np.ndarray, context: np.ndarray, lower: np.ndarray):
    """Distinct n-grams with count, context and suffix."""
    u, first, n = np.unique(h, return_index=True, return_counts=True)
    return u, n, context[first], lower[first]


@dataclass
class Model:
    languages: list[str]
    order: int
    probs: list[Table]
    weights: list[Table]
    floor: np.ndarray
    #: The largest cross-entropy that is not rejected, by LENGTHS
    limit: np.ndarray | None = None
    spread: float = 1.0

    def surprise(self, chars: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character of each text in each language, characters)."""
        n_chars = np.diff(rows) - 1
        hashes = grams(chars, self.order)
        place = np.arange(len(chars)) - np.repeat(rows[:-1], np.diff(rows))
        use = np.flatnonzero(place > 0)
        total = np.zeros((len(use), len(self.languages)), np.float32)
        level = np.minimum(place[use] + 1, self.order)
        open_ = np.arange(len(use))
        for n in range(self.order, 0, -1):
            now = open_[level[open_] >= n]
            if not len(now):
                continue
            at = self.probs[n - 1].find(hashes[n - 1][use[now]])
            hit = at >= 0
            total[now[hit]] += self.probs[n - 1].values[at[hit]]
            miss = now[~hit]
            if n > 1 and len(miss):
                w = self.weights[n - 2].find(hashes[n - 2][use[miss] - 1])
                known = w >= 0
                total[miss[known]] += self.weights[n - 2].values[w[known]]
            elif len(miss):
                total[miss] += self.floor
            done = np.zeros(len(use), bool)
            done[now[hit]] = True
            if n == 1:
                done[miss] = True
            open_ = open_[~done[open_]]
        sums = np.zeros((len(rows) - 1, len(self.languages)))
        full = n_chars > 0
        if full.any():
            begin = np.concatenate([[0], np.cumsum(n_chars)])[:-1][full]
            sums[full] = np.add.reduceat(total, begin, axis=0, dtype=np.float64)
        return -sums / np.maximum(n_chars, 1)[:, None], n_chars

    def predict(self, data: bytes, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text of a run."""
        chars, rows = folded(data, offsets)
        bits, n = self.surprise(chars, rows)
        letters = np.add.reduceat(chars != 0x20, rows[:-1]) if len(rows) > 1 else np.zeros(0)
        best = bits.argmin(1)
        least = bits[np.arange(len(best)), best]
        # How far the others are behind, over the text, gives the score; a long text is no surer than 200 characters.
        odds = np.exp(-(bits - least[:, None]) * np.minimum(n, 200)[:, None] * self.spread).sum(1)
        und = letters == 0
        score = np.where(und, 0.0, 1 / odds)
        names = [UNKNOWN if u else self.languages[k] for u, k in zip(und, best, strict=True)]
        beyond = np.zeros(len(least), bool) if self.limit is None else least > np.append(self.limit, np.inf)[np.searchsorted(LENGTHS, n, side="right") - 1]
        return names, score, np.where(und, np.nan, least), und | beyond


#: Characters from which a text's cross-entropy is held against the limit for texts of its length or more.
LENGTHS = (1, 5, 10, 20, 40, 80, 160, 320)


def calibrated(texts: list[tuple[str, str]], order: int, rejects: float, folds: int = 3) -> np.ndarray:
    """For each of LENGTHS, the cross-entropy that at most a share `rejects` of held-out texts of that length exceeds.

    A text belongs to the part that a hash of it names; those left out are
    judged by models of the others, whole and by their first characters, as
    many as LENGTHS has.  Of n texts the limit is beyond all where n * rejects
    is below one: then the excess of the largest over the median is added once
    more.  Without held-out texts nothing is rejected.
    """
    part = [zlib.crc32(t.encode()) % folds for _, t in texts]
    found: list[list[float]] = [[] for _ in LENGTHS]
    for k in range(folds):
        own, held = [x for x, p in zip(texts, part, strict=True) if p != k], [t for (_, t), p in zip(texts, part, strict=True) if p == k]
        if not own or not held:
            continue
        model = fitted(own, order)
        for a in range(0, len(held), 200):
            raw = [t.encode() for t in held[a : a + 200]]
            chars, rows = folded(b"".join(raw), np.cumsum([0] + [len(t) for t in raw]))
            for j, length in enumerate(LENGTHS):
                size = np.diff(rows) - 1
                take = np.flatnonzero(size >= length)
                if not len(take):
                    continue
                # The first `length` characters of each, and for the last of LENGTHS the whole.
                stop = rows[take] + 1 + (size[take] if j == len(LENGTHS) - 1 else length)
                at = np.concatenate([np.arange(x, y) for x, y in zip(rows[take], stop, strict=True)])
                bits, n = model.surprise(chars[at], np.concatenate([[0], np.cumsum(stop - rows[take])]))
                found[j] += bits.min(1).tolist()
    limit = np.full(len(LENGTHS), np.inf)
    for j, seen in enumerate(found):
        if seen:
            x = np.sort(seen)
            gone = int(len(x) * rejects)
            limit[j] = x[-1 - gone] if gone else 2 * x[-1] - np.median(x)
    return limit


def train(texts: list[tuple[str, str]], order: int = 4, rejects: float = 0.0001) -> Model:
    """Interpolated Kneser-Ney models of (language, text) rows, with limits that reject a share of held-out texts."""
    model = fitted(texts, order)
    model.limit = calibrated(texts, order, rejects)
    return model


def fitted(texts: list[tuple[str, str]], order: int = 4) -> Model:
    """Fit interpolated Kneser-Ney models to (language, text) rows."""
    languages = sorted({lang for lang, _ in texts})
    per: list[list[tuple]] = []
    for lang in languages:
        own = [t.encode() for x, t in texts if x == lang]
        chars, rows = folded(b"".join(own), np.cumsum([0] + [len(t) for t in own]))
        hashes = grams(chars, order)
        place = np.arange(len(chars)) - np.repeat(rows[:-1], np.diff(rows))
        found = []
        for n in range(1, order + 1):
            use = np.flatnonzero((place >= n - 1) & (place > 0))
            context = hashes[n - 2][use - 1] if n > 1 else np.zeros(len(use), np.uint64)
            lower = hashes[n - 2][use] if n > 1 else np.zeros(len(use), np.uint64)
            found.append(_counts(hashes[n - 1][use], context, lower))
        per.append(found)

    # Continuation counts: below the highest order an n-gram counts its different left extensions.
    probs, weights = [], []
    letters = 1 + len(np.unique(np.concatenate([f[0][0] for f in per])))
    lower_p: list[np.ndarray] = []
    for n in range(1, order + 1):
        union = np.unique(np.concatenate([f[n - 1][0] for f in per]))
        contexts = np.unique(np.concatenate([f[n - 1][2] for f in per]))
        value = np.zeros((len(union), len(per)), np.float64)
        back = np.zeros((len(contexts), len(per)), np.float64)
        order_of = np.searchsorted(union, union)
        context_of, lower_of = np.zeros(len(union), np.uint64), np.zeros(len(union), np.uint64)
        for f in per:
            at = np.searchsorted(union, f[n - 1][0])
            context_of[at], lower_of[at] = f[n - 1][2], f[n - 1][3]
        for k, f in enumerate(per):
            u, count, context, _ = f[n - 1]
            c = count.astype(np.float64)
            if n < order:
                up, more = np.unique(f[n][3], return_counts=True)
                at = np.minimum(np.searchsorted(up, u), len(up) - 1) if len(up) else np.zeros(len(u), int)
                c = np.where(up[at] == u, more[at], 1.0) if len(up) else np.ones(len(u))
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = float(ones / (ones + 2 * twos)) if ones and twos else 0.5
            ctx, inverse = np.unique(context, return_inverse=True)
            sums, kinds = np.bincount(inverse, c, len(ctx)), np.bincount(inverse, minlength=len(ctx))
            lam_at = np.searchsorted(contexts, ctx)
            lam = np.ones(len(contexts))
            lam[lam_at] = d * kinds / sums
            back[:, k] = np.log(lam)
            own = np.zeros(len(union))
            own[np.searchsorted(union, u)] = np.maximum(c - d, 0) / sums[inverse]
            if n == 1:
                base = np.full(len(union), 1 / letters)
            else:
                base = lower_p[k][np.searchsorted(unions, lower_of)]
            value[:, k] = own + lam[np.searchsorted(contexts, context_of)] * base
        unions, lower_p = union[order_of], [value[:, k] for k in range(len(per))]
        probs.append(Table(union, np.log(value).astype(np.float32)))
        if n > 1:
            weights.append(Table(contexts, back.astype(np.float32)))
        else:
            floor = (back[0] - np.log(letters)).astype(np.float32)
    return Model(languages, order, probs, weights, floor)


def sample(docs: DataFrame, most: int, most_bytes: int, most_all: int, languages: int) -> list[tuple[str, str]]:
    """The `most` distinct texts of least hash of each language, fewer where `most_all` in all would be passed.

    Every language is learned.  A model holds a number for each n-gram and
    language, so beyond `languages` of them the texts in all are lowered in
    proportion, to one a language at least.  Of a text over `most_bytes` a
    window of a quarter as many characters counts, at a place that its hash
    gives.
    """
    hashed, wide = F.xxhash64("text", F.lit(7)), most_bytes // 4
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("h", hashed)
    # A text of more than 4 * wide bytes has more than wide characters.
    window = F.substring("text", (F.pmod("h", F.length("text") - wide) + 1).cast("int"), F.lit(wide))
    rows = rows.withColumn("text", F.when(F.octet_length("text") > most_bytes, window).otherwise(F.col("text")))
    n = dict(map(tuple, rows.groupBy("lang").agg(F.approx_count_distinct("h")).collect()))
    if not n:
        return []
    most = max(1, min(most, min(most_all, most_all * languages // len(n)) // len(n) + (len(n) <= languages)))
    # More than enough, as counts and hashes are estimates; the least hashes of those are the least of all.
    enough = 1.2 * (most + 6 * most**0.5)
    share = docs.sparkSession.createDataFrame([(x, int(min(1.0, enough / max(1, k)) * 1_000_000) + 1) for x, k in n.items()], "lang string, share long")
    rank = F.pmod("h", F.lit(1_000_000))
    chosen = rows.join(F.broadcast(share), "lang").where(rank < F.col("share"))
    taken: dict[str, list] = {}
    for lang, text, h in chosen.select("lang", "text", rank.alias("rank")).distinct().collect():
        taken.setdefault(lang, []).append((h, text))
    return sorted((lang, text) for lang, of in taken.items() for _, text in sorted(of)[:most])


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", order: int = 4, most: int = 500, most_bytes: int = 20_000, most_all: int = 10_000, languages: int = 100) -> Model | None:
    """A model from a bounded sample of labelled rows, or None without any."""
    texts = sample(docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")), most, most_bytes, most_all, languages)
    return train(texts, order) if texts else None


FOUND = "doc_id long, lang_pred string, score double, bits_per_char double, rejected boolean"


def identify(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Per document row: doc_id, lang_pred, score, bits_per_char, rejected; with carry also text, and the row's other columns as a struct.

    Null texts and texts without letters are `und`, with score 0, and are
    rejected; so is everything without a model.  Whole texts count, of any
    length.  Other columns are not read, nor is the id used.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for a, b, data, offsets in pieces(batch, 1, 1 << 19):
                if m is None:
                    names, score, bits, gone = [UNKNOWN] * (b - a), np.zeros(b - a), np.full(b - a, np.nan), np.ones(b - a, bool)
                else:
                    names, score, bits, gone = m.predict(data.tobytes(), offsets)
                columns = [batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(bits / np.log(2), pa.float64(), mask=np.isnan(bits)), pa.array(gone), *(c.slice(a, b - a) for c in batch.columns[1:] if carry)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([whole_row(docs, text)] if carry else []))
    schema = T.StructType([*T._parse_datatype_string(FOUND).fields, *(source.schema.fields[1:] if carry else [])])
    return source.mapInArrow(run, schema)
