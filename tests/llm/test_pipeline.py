"""The pipeline's stages, each on what the one before kept."""

import hashlib

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = cp.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    lines = cp.line_stage(spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    near = cp.near_stage(spark, docs, SF)
    ids = [r[0] for r in near.select("doc_id").collect()]
    assert near.columns == docs.columns and len(ids) == len(set(ids)) < docs.count()
    clean = cp.decontamination_stage(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()


def test_edges_pass_every_stage(spark, docs):
    for _, stage in cp.STAGES:
        stage(spark, docs, SF).collect()
        stage(spark, docs.limit(0), SF).collect()


def test_run_is_the_stages_in_order(spark):
    got = {r["doc_id"]: r for r in cp.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(cp.tokenizer_file())
    for i, text in texts.items():
        ids = reference.encode(text, add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()


def test_line_stage_takes_passages_in_few_pages_but_not_copies(spark):
    long, short = "a passage that stands in a few pages of the source and in no other place of it", "Yes indeed."
    texts = [f"start {i}\n" + (f"{long}\n" if i % 50 == 0 else "") + (f"{short}\n" if i % 100 == 1 else "") + f"end {i}" for i in range(400)]
    texts += ["one page\nwhose text was copied whole, so that each of its lines is in several pages\nits end"] * 8
    docs = spark.createDataFrame([(i, t, "h", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in cp.line_stage(spark, docs, SF).collect()}
    assert all(got[i] == t.replace(f"{long}\n", "") for i, t in enumerate(texts))


def test_near_stage_tells_repeated_ids_apart_by_text(spark):
    page = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, page("a")), (2, page("a") + " end"), (2, page("b")), (2, page("c")), (2, page("c") + " end"), (2, page("c")), (3, page("b")), (None, page("a")), (None, page("d"))]
    got = cp.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert got.columns == ["doc_id", "text"]
    kept = [(r.doc_id, r.text[:2]) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, "a0"), (2, "b0"), (2, "c0"), (None, "a0"), (None, "d0")], key=str)
