import corpus_pipeline
import tiktoken
from conftest import ODD

import public_tokenizers
from llm import op1_ngram_jaccard, op5_decontamination, op7_byte_bpe

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, docs, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keep = {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    got = corpus_pipeline.language(spark, docs, SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == keep
    groups = op1_ngram_jaccard.brute_force([(i, texts[i]) for i in keep], 5, 80, 100)
    got = corpus_pipeline.near_duplicates(spark, got, SF)
    keep = {i for i, _, c in groups if i == c}
    assert {r.doc_id for r in got.select("doc_id").collect()} == keep
    leaked = {d for d, _ in op5_decontamination.brute_force([(i, texts[i]) for i in keep], items)}
    got = corpus_pipeline.decontaminate(spark, got, SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == keep - leaked
    assert got.columns == docs.columns


def test_run(spark, docs):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op7_byte_bpe.read_ranks(public_tokenizers.path(op7_byte_bpe.RANKS)), special_tokens={})
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    for r in rows[:40]:
        assert library.encode_ordinary(r.text) == list(memoryview(bytes(r.ids)).cast("I")) and len(r.ids) == 4 * r.n_tokens
    assert not [r for r in rows if "@mail" in r.text]


def test_odd_rows(spark, odd, empty):
    left = odd
    for name, stage in corpus_pipeline.STAGES:
        before = left.columns
        left = stage(spark, left, SF)
        assert stage(spark, empty, SF).count() == 0, name
        if name != "tokens":
            assert left.columns == before
    # the language stage learns from these few rows alone, so it rejects those unlike them (4, 7, 8, 12)
    kept = {r.doc_id for r in left.collect()}
    assert {5, 9, 10} <= kept and not {1, 2, 3, 6, 11} & kept and len(ODD) > len(kept)
