"""Empty tables and extra columns with clashing names, where other tests don't have them."""

import hashlib

import pytest

from tests.llm.data import DOCS, awkward
from textgate.llm import bpe, chat, ngram_join, sharding, spotsigs, toxicity
from textgate.llm.common import scratch, stored


def test_bpe_on_an_empty_table_and_clashing_columns(spark):
    pytest.importorskip("public_tokenizers")
    ranks, pattern = bpe.default_vocabulary()
    docs = spark.createDataFrame([(*r, 5, "x") for r in awkward()], DOCS + ", n_tokens int, ids string")
    got = bpe.round_trip(docs, ranks, pattern)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in awkward())
    assert sorted(r.decoded_sha256 for r in got.collect()) == want
    assert bpe.round_trip(docs.limit(0), ranks, pattern).count() == 0
    assert bpe.decode(bpe.encode(docs.limit(0), ranks, pattern), ranks).count() == 0


def test_chats_ignore_clashing_columns(spark):
    rows = [(1, k, role, "t", "x", 3) for k, role in enumerate(["user", "assistant"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, segments int")
    out = chat.format_chats(turns).collect()
    assert [r.formatted for r in out] == ["<|im_start|>user\nt<|im_end|>\n<|im_start|>assistant\nt<|im_end|>\n"]


def test_long_conversations(spark):
    turns = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "cast(id as string) as text")
    out = chat.format_chats(turns).select(chat.read_back(chat.F.col("formatted")).alias("t")).first()
    assert [t.text for t in out.t] == [str(i) for i in range(20_000)]


def test_sharding_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "same", 0, 0)] * 5 + [(2, "other", 1, 1)]
    got = sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string, size int, slot int"), 3).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 1, 1, 2]
    assert len({r.shard for r in got if r.doc_id == 1}) == 1 and sorted(r.slot for r in got if r.doc_id == 1) == list(range(5))


def test_fingerprints_of_repeated_rows(spark, tmp_path):
    rows = [(1, "a rose of the name", "c")] * 3 + [(None, None, "d")]
    spark.createDataFrame(rows, "doc_id long, text string, sigs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = spotsigs.op10_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert sorted(r.near_next for r in got if r.doc_id == 1)[1:] == [1.0, 1.0]


def test_one_of_each_keeps_the_same_row_however_they_are_dealt(spark):
    rows = [(1, "one two three four five six", v) for v in "dbca"] + [(2, "one two three four five six", "e")]
    kept = {ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, v string").repartition(n)).collect()[0].v for n in (1, 3)}
    assert len(kept) == 1


def test_toxicity_model_is_the_same_for_rows_in_any_order(spark):
    rows = [(i, f"you {'idiot' if i % 2 else 'poet'} number {i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    a, b = (toxicity.train(docs.repartition(n), labels) for n in (1, 3))
    assert (a.words, a.prefixes) == (b.words, b.prefixes)


def test_scratch_deletes_all_but_what_is_kept(spark):
    from pathlib import Path

    def there(df):
        return Path(df._stored_at.removeprefix("file://").removeprefix("file:")).exists()

    with scratch(spark) as keep:
        gone, kept = stored(spark.range(3), "test-gone"), keep(stored(spark.range(4), "test-kept"))
        assert there(gone)
    assert not there(gone) and kept.count() == 4
