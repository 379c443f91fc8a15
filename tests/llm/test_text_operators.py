"""Operators on documents against brute force, on small fixtures with the hard cases."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborel.llm import common, components, decontam, langid, mediats, mergedrop, neardup, quality, queries, substring, tokenbin

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, row long, node long, spans string"


def frame(spark, rows):
    """Rows of (doc_id, text) with other columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def cases(rng):
    """Copies, near copies, a passage that many share, repeats inside a text, edges."""
    base = prose(rng, 300)
    passage = prose(rng, 60)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "two words"), (5, " ".join(base)), (6, " ".join(base)), (7, "\n".join(base[:49])), (8, " ".join(base[:50])), (9, "é  " + "\t".join(base[100:250]) + "\x0b"), (9, "é  " + "\t".join(base[100:250]) + "\x0b")]
    for i in range(10, 40):
        own = prose(rng, rng.randrange(0, 90))
        near = list(base)
        for _ in range(rng.randrange(0, 25)):
            near[rng.randrange(len(near))] = rng.choice(WORDS)
        rows.append((i, " ".join(rng.choice([own + passage + prose(rng, 30), near, own, near[:150] + passage, passage + own + passage]))))
    rows += [(40, " ".join(prose(rng, 5000))), (41, "A B a b " * 40), (42, "A B a b " * 60), (None, " ".join(base)), (43, "x\xa0y z")]
    return rows


def brute_repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize(("window", "k"), [(50, 16), (8, 3), (3, 3), (2, 1)])
def test_repeats_against_brute_force(spark, window, k):
    rows = cases(random.Random(window))
    got = substring.remove_repeats(frame(spark, rows), window=window, k=k, texts=False, limit=4000).collect()
    assert key(got) == key(brute_repeats(rows, window))


def test_repeats_carry_and_empty(spark):
    docs = frame(spark, cases(random.Random(1)))
    got = substring.remove_repeats(docs, carry=True).select("whole.*", "kept", "n_removed")
    assert got.where("n_removed = 0").count() > 5 and "source" in got.columns
    assert substring.remove_repeats(docs.where("false")).count() == 0


def test_stretches_do_not_show():
    """Prefix sums and anchors worked out in stretches, as for very long texts, are those of the whole."""
    from arborel.llm import common

    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(32, 40, 150_000), np.resize([97, 32], 50_000)]).astype(np.uint8)
    offsets = np.array([0, 1000, 1000, 120_000, 200_000])
    starts, ends, _ = common.word_spans(data, offsets)
    whole, words = common.span_hashes(data, starts, ends), substring._Run(data, offsets)
    summed, common.SUMMED = common.SUMMED, 777
    try:
        assert (common.span_hashes(data, starts, ends) == whole).all()
    finally:
        common.SUMMED = summed
    for bits in (6, 8, 13):
        assert all((x == y).all() for x, y in zip(words.anchors(50, 16), words.anchors(50, 16, bits), strict=True))


def test_long_repeats_are_one_path(spark):
    """Pieces that never part compact to one path, and a span goes only if the source's words are its own."""
    rng = random.Random(9)
    passage = prose(rng, 900)
    rows = [(i, " ".join(prose(rng, 70) + passage + prose(rng, 70))) for i in range(5)]
    source = frame(spark, rows).select("doc_id", F.xxhash64("text").alias("row"), "text")
    spans = substring.repeated_spans(source).collect()
    # Pieces at the passage's ends differ between documents; their windows are compared one by one.
    assert sorted({r.doc_id for r in spans}) == [1, 2, 3, 4] and len(spans) <= 12 and {r.source for r in spans} == {0}
    for i in range(1, 5):
        assert sum(r.windows for r in spans if r.doc_id == i) == 900 - 49
        assert max(r.windows for r in spans if r.doc_id == i and r.proof is not None) > 750
    words = substring._Words(rows[0][1])
    assert all(words.proof(r.source_first, r.source_first + r.windows + 49) == r.proof for r in spans if r.proof is not None)


def brute_links(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = [i for i in sets if i is not None]
    least = {i: i for i in ids}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                least[max(p, q)] = min(p, q)
    return [(i, len(sets[i][0]) if i is not None else None, find(i) if i is not None else None) for i, _ in rows]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(spark, size):
    rng = random.Random(size)
    rows = [r for r in cases(rng) if r[0] is None or r[0] != 9]
    group = prose(rng, 120)
    for i in range(100, 190):  # a group in which many are near one another but not all
        near = list(group)
        for _ in range(rng.randrange(0, 14)):
            near[rng.randrange(len(near))] = rng.choice(WORDS)
        rows.append((i, " ".join(near).upper() if i % 2 else " ".join(near)))
    got = neardup.near_duplicates(frame(spark, rows), shingle=size, block=8).collect()
    want = brute_links(rows, size, 80)
    assert key((r.doc_id, r.component_id) for r in got) == key((i, c) for i, _, c in want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: n for i, n, _ in want if i is not None}


def test_near_duplicates_without_links(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "d e f g")]
    assert sorted(map(tuple, neardup.near_duplicates(frame(spark, rows), shingle=2).collect())) == [(1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 3, 4, True)]
    assert neardup.near_duplicates(frame(spark, rows).where("false")).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    for share in (0.0, 0.5, 0.8, 1.0):
        b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.integers(0, 2**63, int(len(a) * (1 - share)) + 1).astype(np.uint64)]))
        ra, rb, both = neardup.registers([a, b, np.union1d(a, b)], 2000)
        assert (neardup.merge(ra, rb) == both).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(neardup.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.05


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (12, 11), (5, 5), (2, 1)] + [(100 + i, 101 + i) for i in range(60)] + [(200, 200 + i) for i in range(1, 50)]
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    got = dict(map(tuple, found.collect()))
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(61)} | {200 + i: 200 for i in range(50)}
    more = dict(map(tuple, components.components(spark.createDataFrame([(3, 10), (300, 301), (301, 249)], "a long, b long"), found).collect()))
    assert more[12] == 1 and more[301] == more[210] == 200 and more[150] == 100 and len(more) == len(got) + 2
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block_words", [4_000_000, 60])
def test_contamination_against_brute_force(spark, block_words):
    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate([1, 2, 12, 13, 14, 40, 40])] + [(7, None), (8, " ?! "), (9, "É-ß 12ab")]
    docs = [(0, None), (1, ""), (2, "...")]
    for i in range(3, 60):
        parts = prose(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            said = (rng.choice(items)[1] or "x").split()
            parts += said[rng.randrange(3) :] + prose(rng, rng.randrange(0, 30))
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(p.upper() if rng.random() < 0.2 else p for p in parts)))
    docs.append((60, "x É-ß\xa012AB y"))
    docs.append((60, "x É-ß 12AB y"))

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    want = []
    for i, t in docs:
        w, hit, who = words(t), set(), set()
        for item, said in items:
            p = words(said)
            n = min(13, len(p))
            for k in range(len(p) - n + 1) if p else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == p[k : k + n]:
                        hit.update(range(j, j + n))
                        who.add(str(item))
        want.append((i, len(w), len(hit), ",".join(sorted(who))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(frame(spark, docs), bench, block_words=block_words)
    got = [(r.doc_id, r.n_words, r.n_hit, ",".join(sorted(r["items"]))) for r in found.collect()]
    assert key(got) == key(want)
    said = {t for _, t in docs}
    for r in found.where("n_hit > 0").collect():  # offsets cut the hit words out of the original text
        (text,) = [t for i, t in docs if i == r.doc_id and len(words(t)) == r.n_words][:1]
        cut = [words(text[a:b]) for a, b in zip(r.offsets[::2], r.offsets[1::2], strict=True)]
        assert text in said and cut == [words(text)[a:b] for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)]
    carried = decontam.contamination(frame(spark, docs), bench, block_words=block_words, carry=True)
    assert carried.select("whole.*", "text", "n_hit").count() == len(docs)
    assert decontam.contamination(frame(spark, docs), bench.where("false")).where("n_hit > 0").count() == 0


def test_hits_map_to_the_original():
    p = decontam.Patterns([("1", ["é".encode(), b"b"])], 13)
    text = "«A» É... é,  B! c"
    _, hit, items = p.scan(text)
    span = decontam.original_spans(text, decontam._runs(hit))
    assert items == {"1"} and text[slice(*span)] == "é,  B"


def test_language(spark):
    letters = {"aa": "abcde ", "bb": "defgh ", "zz": "ñéüx "}
    rng = random.Random(5)
    made = [(i, "".join(rng.choice(letters[lang]) for _ in range(400)), lang) for i, lang in enumerate(list(letters) * 40)]
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in made] + [(900, None, "aa"), (901, "", None), (902, "123 !?", "bb"), (903, "АБВГД" * 40, None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 90 AND lang IS NOT NULL"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [i for i, _, _ in made if i >= 90]
    assert all(got[i].lang_pred == made[i][2] and not got[i].rejected for i in held)
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].rejected and got[903].lang_pred in letters
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs, langid.fit(docs.where("false"))).where("rejected").count() == docs.count()


def test_all_languages_are_sampled(spark):
    """Neither many languages nor copies nor long texts keep a language from being learned."""
    rows = [(f"own {i} text {k}", f"l{i}") for i in range(130) for k in range(3)]
    rows += [("much copied", "copied")] * 3000 + [(f"other {i}", "copied") for i in range(200)] + [("few", "few")] * 2000 + [("long " * 5000, "long")]
    got = langid.sample(spark.createDataFrame(rows, "text string, lang string"), 500, 20_000, 10_000, 100)
    assert {lang for lang, _ in got} == {lang for _, lang in rows} and len(got) == len(set(got))
    got = langid.sample(spark.createDataFrame(rows[390:], "text string, lang string"), 500, 20_000, 10_000, 100)
    assert sum(lang == "copied" for lang, _ in got) == 201 and ("few", "few") in [(t, x) for x, t in got]
    wide = langid.sample(spark.createDataFrame([(f"t{i}", "x") for i in range(5000)], "text string, lang string"), 500, 20_000, 10_000, 100)
    assert len(wide) == 500
    # Long texts are as likely as others, and give a window.
    long = langid.sample(spark.createDataFrame([("x" * 100 + str(i) + "é" * 30_000 + "y" * 9000, "x") for i in range(20)] + [(f"t{i}", "x") for i in range(20)], "text string, lang string"), 500, 20_000, 10_000, 100)
    assert sorted(len(t) for _, t in long)[20:] == [5000] * (len(long) - 20) and len(long) > 20 and langid.train(long).languages == ["x"]


def plain_kneser_ney(texts, order, letters):
    """log P of the last character of a string after the others, by dictionaries of one language's texts."""
    count = [{} for _ in range(order + 1)]
    for t in texts:
        for end in range(1, len(t)):
            for n in range(1, order + 1):
                if end - n + 1 >= 0:
                    gram = t[end - n + 1 : end + 1]
                    count[n][gram] = count[n].get(gram, 0) + 1
    for n in range(1, order):  # different left extensions, one for what only begins a text
        count[n] = {g: max(1, sum(h[1:] == g for h in count[n + 1])) for g in count[n]}
    discount = []
    for n in range(1, order + 1):
        ones, twos = (sum(c == k for c in count[n].values()) for k in (1, 2))
        discount.append(ones / (ones + 2 * twos) if ones and twos else 0.5)

    def p(gram):
        n = len(gram)
        lower = p(gram[1:]) if n > 1 else 1 / letters
        after = {g: c for g, c in count[n].items() if g[:-1] == gram[:-1]}
        if not after:
            return lower
        d, total = discount[n - 1], sum(after.values())
        return max(after.get(gram, 0) - d, 0) / total + d * len(after) / total * lower

    return lambda text: sum(np.log(p(text[max(0, k - order + 1) : k + 1])) for k in range(1, len(text)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_models_against_plain_dictionaries(order):
    """Cross-entropies are those of interpolated Kneser-Ney, and probabilities of all next characters add up to one."""
    made = {"x": ["abracadabra abba cab", "a cab abba"], "y": ["the quick brown fox", "the lazy dog the fox", "q"]}
    model = langid.train([(x, t) for x, own in made.items() for t in own], order=order)
    seen = sorted({c for own in made.values() for t in own for c in " " + t})
    plain = [plain_kneser_ney([" " + t for t in made[x]], order, len(seen) + 1) for x in model.languages]

    def total(text):  # log P of a text, which begins with a space, in each language
        data = text[1:].encode()
        chars, rows = langid.folded(data, np.array([0, len(data)]))
        bits, n = model.surprise(chars, rows)
        return -bits[0] * n[0]

    for text in ("abba", "the cab", "quux dog", "ζ a", "zzz", "b"):
        assert np.allclose(total(" " + text), [p(" " + text) for p in plain], atol=1e-5)
    for context in ("a", "ab", "th", "zz", "the q", "ζ"):
        after = np.array([total(" " + context + c) - total(" " + context) for c in [*seen[1:], "ω"]])
        space = np.array([p(" " + context + " ") - p(" " + context) for p in plain])
        assert np.allclose(np.exp(after).sum(0) + np.exp(space), 1, atol=1e-4)


def test_rejection_is_calibrated_on_held_out_texts():
    """Of texts like the training texts about the stated share is rejected, and other languages are."""
    rng = random.Random(6)
    sampled = lambda seed, n: " ".join("".join(random.Random(f"{seed}{rng.randrange(300)}").choices("abcdefghijklm" if seed == "x" else "hijklmnopqrst", k=5)) for _ in range(n))
    model = langid.train([(x, sampled(x, rng.randrange(2, 80))) for x in "xy" for _ in range(400)], rejects=0.02)
    rejected = lambda texts: model.predict("".join(texts).encode(), np.cumsum([0] + [len(t.encode()) for t in texts]))[3].mean()
    for n in (2, 5, 20, 70):
        assert rejected([sampled("x" if k % 2 else "y", n) for k in range(1000)]) < 0.06
    assert rejected(["".join(rng.choices("nopqrstuvwxyz абвг", k=100)) for _ in range(200)]) > 0.95
    assert langid.train([("x", "alone")]).limit.tolist() == [np.inf] * len(langid.LENGTHS)


TEXTS = ["", None, "a", "Hello, world. It's", "...,. a. b.. c.,d.", "É. é日本語。 ok", "x<|endoftext|>y", "123a4,5.", "w " * 3000, "İstanbul ΑΣ. ΑΣ", "\x1c\x85 q", "same", "same"]


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = [7, 3, 3, 12, 100, -5, 9, 10, 11, 50, 51, 52, 52]
    docs = spark.createDataFrame(list(zip(ids, TEXTS, strict=True)), "doc_id long, text string")
    got = sorted(tokenbin.token_file(docs, path, block=16, shards=3).collect())
    rows = sorted(zip(ids, [t or "" for t in TEXTS], strict=True), key=lambda r: (r[0], r[1].encode()))
    at = 0
    for r, (i, t) in zip(got, rows, strict=True):
        want = [*library.encode(t, add_special_tokens=False).ids, 1]
        if rows.count((i, t)) == 1 and [x for x, _ in rows].count(i) == 1:
            assert tuple(r) == (i, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert tokenbin.token_file(docs.where("false"), path).count() == 0
    # The least id there is is no null; null ids come first, wherever the table is cut.
    odd = spark.createDataFrame([(-(1 << 63), "a b"), (None, "c"), ((1 << 63) - 1, "d"), (None, None)], "doc_id long, text string").repartition(3)
    got = sorted(tokenbin.token_file(odd, path, shards=2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -(1 << 63), (1 << 63) - 1]


def test_ranges_follow_from_the_keys(spark):
    rng = random.Random(4)
    keys = [rng.choice([rng.randrange(100), rng.randrange(10**12)]) for _ in range(3000)] + [None] * 5
    made = []
    for parts in (1, 7):
        frame = spark.createDataFrame([(k,) for k in keys], "k long").repartition(parts)
        made.append([sorted((-1 if r.k is None else r.k) for r in part) for part in common.ranged(frame, "k", 6).rdd.glom().collect()])
    assert made[0] == made[1] and sum(made[0], []) == sorted(-1 if k is None else k for k in keys) and len(made[0]) == 6


def test_salted_joins_are_joins(spark, monkeypatch):
    """Keys that are cut into parts give the rows of a plain join; keys without a row of right give none."""
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, rng.randrange(50)]), i) for i in range(500)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 50, 2)] + [(1, "r1")], "k long, w string")
    sums = left.groupBy("k").agg(F.count("*").alias("n"))
    got = common.salted_join(left, right, "k", sums, 500, "v")
    assert got.columns == ["k", "v", "w"] and sorted(got.collect()) == sorted(left.join(right, "k").collect())


def test_long_and_short_texts_in_token_files(spark):
    """Batches are cut by bytes, so a text of any length is encoded whole."""
    path = queries.vocabulary_file("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b"] * 50 + ["word " * 600_000, "x" * 50_000, ""])], "doc_id long, text string").coalesce(1)
    got = sorted(tokenbin.token_file(docs, path).collect())
    assert [r.n_tokens for r in got[:50]] == [3] * 50 and got[50].n_tokens == 600_001 and got[52].n_tokens == 1


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 20, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    assert (tokenbin.unpack(np.frombuffer(tokenbin.pack(ids, bits), np.uint8), bits, 1001) == ids).all()


def test_random_access(tmp_path):
    ids = np.random.default_rng(0).integers(0, 8000, 1000).astype(np.uint32)
    writer = tokenbin.ShardWriter(f"file://{tmp_path}/s.tkpk", 13, 64)
    writer.add([1, None], np.array([400, 600]), ids)
    writer.close()
    reader = tokenbin.ShardReader(f"file://{tmp_path}/s.tkpk")
    for a, b in ((0, 1000), (63, 65), (64, 64), (999, 1000), (100, 700)):
        assert (reader.ids(a, b) == ids[a:b]).all()
    assert reader.doc_ids.tolist() == [1, 0] and reader.null.tolist() == [False, True] and [p.name for p in tmp_path.iterdir()] == ["s.tkpk"]


def test_media(spark):
    docs = frame(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(50, "long é " * 20_000), (None, "x")])
    got = {(r.doc_id, r.n_bytes): r for r in mediats.media_features(mediats.to_media(docs)).collect()}
    for i, t in [*enumerate(TEXTS), (50, "long é " * 20_000), (None, "x")]:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        r = got[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes % 188 == 0 and "lost=0;repeated=0;faulty=0" in r.feature and len(r.pts) == len(r.points) == -(-len(payload) // mediats.UNIT)
    assert mediats.media_features(mediats.to_media(docs.where("false"))).count() == 0


def test_streams_show_what_is_lost():
    payload = bytes(range(256)) * 200
    media = mediats.write_stream(payload)
    assert mediats.read_stream(media).payload == payload
    cut = mediats.read_stream(media[: 188 * 30] + media[188 * 31 :])
    assert cut.lost == 1 and cut.faulty == 1
    assert mediats.read_stream(b"").faulty == 1 and mediats.read_stream(b"x" * 1000).payload == b""
    whole = mediats.read_stream(media)
    assert mediats.from_point(media, whole.points, whole.stamps[2] + 5) == payload[2 * mediats.UNIT :]
    stamp, packet, offset = whole.points[2]
    # Nothing between the tables and the point is read.
    blank = media[: 188 * 3] + bytes(188 * (packet - 3)) + media[188 * packet :]
    assert mediats.from_point(blank, whole.points, stamp) == payload[offset:]
    broken = bytearray(media)
    broken[8] ^= 1
    assert mediats.read_stream(bytes(broken)).faulty == 1  # the table's checksum


def test_repeated_packets_are_dropped():
    payload = bytes(range(256)) * 200
    media = mediats.write_stream(payload)
    packets = [media[a : a + 188] for a in range(0, len(media), 188)]
    for k in (0, 2, 3, 40, len(packets) - 1):
        found = mediats.read_stream(b"".join([*packets[: k + 1], packets[k], *packets[k + 1 :]]))
        assert found.payload == payload and (found.lost, found.faulty, found.repeated) == (0, 0, int(k > 1))
    idle = bytes([0x47, 1, 0, 0x20 | packets[4][3] & 15, 183, 0]) + b"\xff" * 182  # no payload: the counter stays
    assert mediats.read_stream(b"".join([*packets[:5], idle, *packets[5:]])).payload == payload


def test_damaged_streams_are_no_errors():
    """Of 3,000 streams with bytes changed, cut out or repeated, none is an error, and intact units are right."""
    rng = random.Random(11)
    payload = bytes(rng.randrange(256) for _ in range(4 * mediats.UNIT))
    units = {payload[a : a + mediats.UNIT] for a in range(0, len(payload), mediats.UNIT)}
    media = mediats.write_stream(payload)
    exact = 0
    for _ in range(3000):
        raw = bytearray(media)
        for _ in range(rng.randrange(1, 6)):
            kind, at = rng.randrange(4), rng.choice([rng.randrange(188 * 3), rng.randrange(len(raw)), rng.randrange(len(raw)) // 188 * 188 + rng.randrange(12)]) % len(raw)
            if kind == 0:
                raw[at] = rng.randrange(256)
            elif kind == 1:
                del raw[at // 188 * 188 : at // 188 * 188 + 188 * rng.randrange(1, 4)]
            elif kind == 2:
                del raw[at : at + rng.randrange(1, 400)]
            else:
                raw[at:at] = raw[at : at + rng.randrange(1, 400)]
            raw = raw or bytearray(media)
        found = mediats.read_stream(bytes(raw))
        exact += found.payload == payload
        assert len(found.payload) <= len(raw) and found.faulty >= 0
    lost = mediats.read_stream(media[: 188 * 30] + media[188 * 32 :])
    assert lost.payload in {b"".join(payload[a : a + mediats.UNIT] for a in range(0, len(payload), mediats.UNIT) if a != skip * mediats.UNIT) for skip in range(4)} and len(units) == 4
    assert exact > 0


def test_quality(spark):
    rng = random.Random(2)
    rows = [(i, ("JUNK!! " * rng.randrange(5, 50)) if i % 3 == 0 else " ".join(prose(rng, rng.randrange(30, 200))) + ".", int(i % 3 != 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y if i % 7 else None) for i, _, y in rows] + [(1, 1), (None, 0), (5000, 1)], "doc_id long, quality int")
    forest = quality.fit(docs, labels.where("doc_id < 200 OR doc_id IS NULL"))
    got = {r.doc_id: r for r in quality.score(docs, forest).collect()}
    assert all(got[i].predicted == y for i, _, y in rows) and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 302
    assert quality.score(docs, quality.fit(docs, labels.where("false"))).where("score = 0.5").count() == 302


def test_repeated_ids_keep_the_bound_of_the_fit(spark, monkeypatch):
    """One label on an id of many rows teaches no more rows than the bound."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(2, "JUNK!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "boost", lambda x, y, **_: seen.append(len(y)))
    quality.fit(docs, labels, most=500)
    quality.fit(docs, labels)
    assert seen == [500, 3001]


def test_statistics_are_per_text():
    texts = [b"", b"One two.", "É é é".encode(), b"a\n\nb\nb\n", b"x " * 2000]
    alone = np.vstack([quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    assert np.allclose(alone, quality.statistics(data, np.cumsum([0] + [len(t) for t in texts])))


def test_merge_dropout(spark):
    import sentencepiece

    path = queries.vocabulary_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in TEXTS if t] + [" a  b\nc\td ", "▁x ▁", "\0z\n\n", "<0x0A> <s>", "aaaaaaaaaa bbbbb", "  "]
    for t, ids in zip(texts, mergedrop.MergeDropout(path, rate=0.0).encode(texts), strict=True):
        if "▁" not in t and "\0" not in t:
            assert ids.tolist() == library.encode(t)
    coder = mergedrop.MergeDropout(path, rate=0.3, seed=1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in mergedrop.decode(mergedrop.encode(docs, coder), coder).collect()}
    assert [got[i].text for i in range(len(texts) + 2)] == [*texts, "", ""]
    assert mergedrop.round_trip(docs, coder).where("NOT lossless").count() == 0
    said = "The quick brown foxes jumped unbelievably over lazily sleeping dogs"
    seen = {tuple(mergedrop.MergeDropout(path, rate=0.3, seed=s).encode([said])[0].tolist()) for s in range(8)}
    assert len(seen) > 4 and all(mergedrop.MergeDropout(path).decode(np.array(s)) == said for s in seen)
    once = mergedrop.MergeDropout(path, rate=0.3, seed=4)
    assert once.encode([said])[0].tolist() == once.encode(["x", said])[1].tolist()


def test_dropout_against_a_plain_agenda():
    """One segment at a time, with the same keyed skips, by a list of symbols."""
    from arborel.llm.common import mix64, span_hashes

    pieces = mergedrop.Pieces(queries.vocabulary_file("piece_bpe_32k.model"))
    pairs = {}
    table = pieces.table
    rng = random.Random(3)
    segments = [(" " + "".join(rng.choice("abcdethion") for _ in range(rng.randrange(1, 14)))).encode() for _ in range(200)]
    ids, sizes = pieces.segments(segments, 99, 0.25)
    got = np.split(ids, np.cumsum(sizes)[:-1])
    limit = int(0.25 * 2**32)
    for s, want in zip(segments, got, strict=True):
        data = np.frombuffer(s, np.uint8)
        salt = int((span_hashes(data, np.array([0]), np.array([len(s)])) ^ mix64(np.array([99], np.uint64)))[0])
        symbols = [(int(pieces.char[ord(c)]), k) for k, c in enumerate(s.decode())]
        while True:
            best = None
            for k in range(len(symbols) - 1):
                pair = symbols[k][0] * pieces.n + symbols[k + 1][0]
                if pair not in pairs:
                    at = int(table.find(mix64(np.array([pair], np.uint64)))[0])
                    pairs[pair] = int(table.values[at]) if at >= 0 else -1
                if pairs[pair] < 0:
                    continue
                mask = (1 << 64) - 1
                place = int(mix64(np.array([symbols[k][1] * int(mergedrop._Q) & mask], np.uint64))[0])
                h = int(mix64(np.array([(salt + pair * int(mergedrop._P) & mask) ^ place], np.uint64))[0]) >> 32
                if h < limit:
                    continue
                rank = int(pieces.rank[pairs[pair]])
                if best is None or rank < best[0]:
                    best = (rank, k, pairs[pair])
            if best is None:
                break
            symbols[best[1] : best[1] + 2] = [(best[2], symbols[best[1]][1])]
        assert [i for i, _ in symbols] == want.tolist()


@pytest.mark.parametrize("rate", [0.0, 0.25])
def test_agenda_and_rounds_agree(rate):
    pieces = mergedrop.Pieces(queries.vocabulary_file("piece_bpe_32k.model"))
    rng = random.Random(13)
    segments = [(rng.choice(["", " ", "   "]) + "".join(rng.choice("abcdethionéx日本▁") for _ in range(rng.randrange(1, 80)))).encode() for _ in range(150)]
    salt = np.random.default_rng(1).integers(0, 2**63, len(segments)).astype(np.uint64)
    ids, sizes = pieces.merged(segments, salt, rate)[:2]
    assert [pieces.agenda(s, int(k), rate) for s, k in zip(segments, salt, strict=True)] == [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_long_texts_without_spaces_are_encoded_in_seconds():
    coder = mergedrop.MergeDropout(queries.vocabulary_file("piece_bpe_32k.model"), rate=0.1, seed=1)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdethionrs") for _ in range(150_000)), "日本語" * 20_000, "word " * 100_000, "a" * 100_000]
    began = time.time()
    assert [coder.decode(ids) for ids in coder.encode(texts)] == texts and time.time() - began < 60


def test_every_occurrence_is_drawn_for():
    """Repeats within a text vary, no two texts share their choices, and kept courses give what each draw alone gives."""
    path = queries.vocabulary_file("piece_bpe_32k.model")
    coder = mergedrop.MergeDropout(path, rate=0.2, seed=3)
    rng = random.Random(8)
    texts = ["unbelievably " * 400, *(f"{i} unbelievably said" for i in range(200)), " ".join("".join(rng.choice("abcdethion") for _ in range(rng.randrange(1, 60))) for _ in range(600)), "a\0b unbelievably"]
    for _ in range(2):
        got = coder.encode(texts)
        assert all(coder.decode(ids) == t for ids, t in zip(got, texts, strict=True))
        for t, ids in zip(texts, got, strict=True):
            segments, counts = coder._cut([t.encode()])
            assert coder.pieces.merged(segments, coder.salts([t.encode()], counts), 0.2)[0].tolist() == ids.tolist()
    words = [tuple(i) for i in np.split(got[0], np.flatnonzero([coder.raw[k].startswith(b" ") for k in got[0]]))[1:]]
    assert len(words) == 401 and len(set(words)) > 12
    assert len({tuple(i.tolist()[-8:]) for i in got[1:201]}) > 12


def test_fold_of_a_null_id(spark):
    one = spark.createDataFrame([(None,), (7,)], "doc_id long").select(F.coalesce(queries.fold("doc_id", 4) == 2, F.lit(False)).alias("x"))
    assert [r.x for r in one.collect()] == [False, zlib.crc32(b"7") % 4 == 2]
