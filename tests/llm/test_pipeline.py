"""Each stage of the pipeline against SQL or another library on what its predecessor kept."""

import hashlib
from collections import Counter

import duckdb
import pytest
import tiktoken

import corpus_pipeline
from heatsheet.llm import bpe, mixing, sql
from heatsheet.scratch import settle

SMALL = "/root/testdata/sf0.001"


def tokenizer():
    ranks, pattern = bpe.public_ranks()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def digests(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage kept, by its name."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SMALL))
        kept[name] = docs
    return kept


def in_sql(frame, name):
    db = duckdb.connect()
    table = frame.toArrow()
    db.register("documents", table)
    return db.execute(sql.oracle_sql()[name]).to_arrow_table().to_pylist()


def test_quality_rules_keep_what_the_sql_keeps(stages):
    want = {r["doc_id"] for r in in_sql(stages["documents"], "op8_quality") if r["kept"]}
    made = stages["quality_rules"].collect()
    assert {r["doc_id"] for r in made} == want and 0 < len(made) < stages["documents"].count()
    rows = {tuple(r) for r in stages["documents"].collect()}
    assert {tuple(r) for r in made} <= rows


def test_line_dedup_leaves_what_the_sql_leaves(stages):
    want = {r["doc_id"]: (r["kept_sha256"], r["n_chars"]) for r in in_sql(stages["quality_rules"], "op5_line_templates")}
    made = {r["doc_id"]: (hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["n_chars"]) for r in stages["line_dedup"].collect()}
    assert made == want


def test_one_document_of_each_group_stays(stages):
    groups = in_sql(stages["line_dedup"], "op3_ngram_jaccard")
    want = {r["component_id"] if r["n_shingles"] else r["doc_id"] for r in groups}
    made = stages["ngram_jaccard"].collect()
    assert Counter(r["doc_id"] for r in made) == Counter(want)
    assert {tuple(r) for r in made} <= {tuple(r) for r in stages["line_dedup"].collect()}


def test_mix_repeats_documents_as_the_plan_says(stages):
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(stages["ngram_jaccard"]).collect()}
    made = stages["mix_sources"].collect()
    assert Counter(r["doc_id"] for r in made) == Counter({i: n for i, n in plan.items() if n})
    assert {tuple(r) for r in made} <= {tuple(r) for r in stages["ngram_jaccard"].collect()}


def test_tokens_are_those_of_another_library(spark, stages):
    encoding = tokenizer()
    want = Counter((r["doc_id"], *digests(encoding, r["text"])) for r in stages["mix_sources"].collect())
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(tuple(r) for r in stages["byte_bpe"].select(*columns).collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SMALL).select(*columns).collect()) == want


def test_every_text_of_a_table_is_encoded_as_by_another_library(spark):
    encoding = tokenizer()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ranks, pattern = bpe.public_ranks()
    made = {r["doc_id"]: tuple(r)[1:4] for r in bpe.encode(docs, ranks, pattern).collect()}
    assert made == {r["doc_id"]: digests(encoding, r["text"]) for r in docs.collect()}


def test_long_texts_and_pieces_beyond_the_memory(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    ranks, pattern = bpe.public_ranks()
    codec, encoding = bpe.Codec(ranks, pattern, bpe.serialise(ranks)), tokenizer()
    texts = [" ".join(f"w{i % 977}x{i % 13}" for i in range(20_000)), "q" * 100_000, "", "naïve ☃ " * 300]
    for part in (texts, texts[::-1], texts[1:3]):
        for text, (ids, raw) in zip(part, codec.codes(part), strict=True):
            assert [int(i) for i in ids.split(",") if i] == encoding.encode_ordinary(text) and raw.decode() == text
        assert len(codec.recent[0]) < 50 and not any(len(piece) > bpe.REMEMBERED_LETTERS for piece in codec.recent[0])


def test_stages_on_empty_tables_nulls_and_repeats(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, " \\n\\t", None, "a", 3), (3, "word " * 20_000, "en", "b", 100_000)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns, name
            stage(spark, docs, "").collect()
        out = corpus_pipeline.byte_bpe(spark, docs, "").collect()
        assert len(out) == len(rows)
