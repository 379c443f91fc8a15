"""The pipeline: each stage on its own input, and its results against brute force."""

import pytest

import corpus_pipeline
from arborel.llm import queries


def documents(spark, tmp_path, rows):
    path = tmp_path / "sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, tmp_path):
    words = lambda seed, n: " ".join(f"w{'abcdefghij'[(seed * 7 + i * i) % 10]}{chr(97 + (seed + i) % 26)}{chr(97 + i // 26 % 26)}{chr(97 + seed % 26)}" for i in range(n))
    shared = words(3, 60)
    rows = [(i, words(i + 30, 120), "en", "s", 5) for i in range(20)]
    rows += [(100, words(30, 120), "en", "s", 5), (101, words(30, 119) + " other", "en", "s", 5)]  # of the first
    rows += [(200, shared + " " + words(15, 90), None, "s", 5), (201, words(16, 90) + "\n" + shared, "en", None, None)]
    rows += [(300, "so: " + " ".join(f"BENCH{i}" for i in range(4, 18)) + " end", "en", "s", 5), (400, None, "en", "s", 0), (401, "", None, None, 0), (402, "12 34", "en", "s", 5)]
    path = documents(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    everyone = {r[0] for r in rows}
    assert set(seen["language"]) == everyone - {400, 401, 402}
    assert set(seen["near_duplicates"]) == set(seen["language"]) - {100, 101}
    assert set(seen["repeats"]) == set(seen["near_duplicates"])
    assert seen["repeats"][201].text == words(16, 90) and seen["repeats"][201].n_chars == len(words(16, 90))
    assert seen["repeats"][200].text == shared + " " + words(15, 90) and seen["repeats"][200].n_chars == 5
    assert set(seen["decontamination"]) == set(seen["repeats"]) - {300}
    assert set(seen["tokens"]) == set(seen["decontamination"]) and all(r.lossless for r in seen["tokens"].values())
    whole = {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, path).collect()}
    assert whole == {i: tuple(r) for i, r in seen["tokens"].items()}


def test_empty(spark, tmp_path):
    path = documents(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, path).count() == 0


CONTRACT = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_token_file": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op10_merge_dropout": "doc_id bigint",
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_have_their_columns(spark, tmp_path, name):
    """Each query over small tables: the columns of its contract first, and a row for each row."""
    path = documents(spark, tmp_path, [(i, f"some words of text number {i}" if i else None, "en", "s", 5) for i in range(30)])
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, f"http://h.example/{i}", f"<p>page {i % 3}</p>" * 100) for i in range(30)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    made = queries.QUERIES[name](spark, path)
    want = CONTRACT[name].split(", ")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in made.schema][: len(want)] == want
    assert made.count() == 30 and set(queries.SQL) <= set(queries.QUERIES)
