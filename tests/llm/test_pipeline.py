"""Every stage takes effect on what the one before it kept, and none loses clean documents."""

from __future__ import annotations

from collections import defaultdict

import public_tokenizers

import corpus_pipeline
from lakemart.llm import packing, quality, secrets, simhash, substrings


def test_stages_on_the_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], small_dir).cache())
        assert kept[-1].columns == columns
        assert [f.dataType for f in kept[-1].schema] == [f.dataType for f in docs.schema]
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    good = {r["doc_id"] for r in quality.score(docs).where("quality.kept").select("doc_id").collect()}
    assert ids[1] == good
    groups = simhash.near_duplicates(kept[1]).collect()
    assert ids[2] == {r["component_id"] for r in groups}
    assert ids[3] == ids[2] and ids[4] == ids[3]
    cut = substrings.remove_repeats(kept[2]).select("doc_id", "repeats.kept").collect()
    assert {r["doc_id"]: r["kept"] for r in cut} == {r["doc_id"]: r["text"] for r in kept[3].collect()}
    masked = secrets.mask_secrets(kept[3]).collect()
    assert {r["doc_id"]: r["text"] for r in masked} == {r["doc_id"]: r["text"] for r in kept[4].collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept[4].collect())


def test_run_packs_what_is_left(spark, small_dir):
    found = corpus_pipeline.run(spark, small_dir).collect()
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_odd_rows_and_empty_tables(spark, small_dir):
    schema = spark.read.parquet(f"{small_dir}/documents.parquet").schema
    prose = " ".join(f"the word{i} of a thing{i * 7} was in place{i * i} and" for i in range(30))
    rows = [(1, prose, "en", "s", len(prose)), (1, prose, "en", "s", len(prose)), (None, None, None, None, None), (2, "", "", "", 0), (None, prose, None, None, None)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small_dir)
        assert docs.count() == (1 if given else 0)


def test_run_returns_the_ids_of_the_cleaned_texts(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small_dir)
    docs = docs.cache()
    tokenizer = packing.WordTokenizer(public_tokenizers.path(packing.VOCABULARY))
    end = packing.END_ID.to_bytes(4, "little")
    wanted = {r["doc_id"]: tokenizer.ids(r["text"]) + end for r in docs.collect()}
    found = defaultdict(bytes)
    for r in corpus_pipeline.best_fit_packing(spark, docs, small_dir).orderBy("doc_id", "piece").collect():
        found[r["doc_id"]] += bytes(r["ids"])
    assert wanted and found == wanted


def test_substring_stage_deals_documents_once(spark, small_dir):
    """Its two passes and the removal share one shuffle of the documents."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    cut = corpus_pipeline.substring_dedup(spark, docs, small_dir)
    assert cut.columns == docs.columns
    cut.collect()
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("== Initial Plan ==")].count("ReusedExchange") >= 2
