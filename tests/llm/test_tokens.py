import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, token_counts

TEXTS = [
    None, "", " \n\t", "Hello hello, it's 12½ ²³ é", "<|startoftext|>Hi <|endoftext|>there's\x1c", "ΑΣ Σ İ 中文字 ﬁ 🎉🎉 ٣٤",
    "ab" * 3000, "x" * 50_000, "</w> a</w>b <|x|>", "don't we'll 'S 'RE", "same", "same",
]


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.vocabulary_text()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, i, i) for i, x in enumerate(TEXTS)] + [(None, "same", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, key long")


def test_counts_match_the_library(docs, vocabulary):
    lib = Tokenizer.from_str(vocabulary)
    for small in (2, 1000):  # with a tiny first tier and cache, the same counts
        got = token_counts.token_counts(docs, vocabulary, table_size=small, cache_bytes=small, limit=2048).collect()
        assert len(got) == len(TEXTS) + 1
        for r in got:
            x = r["text"] or ""
            assert r["n_tokens"] == len(lib.encode(x, add_special_tokens=False).ids)
            assert r["n_bytes"] == len(x.encode()) and r["over_limit"] == (r["n_tokens"] > 2048)


def test_encoding_round_trip_matches_the_library(docs, vocabulary):
    lib = Tokenizer.from_str(vocabulary)
    digests = {r["doc_id"]: r for r in bpe.bpe_digests(docs, vocabulary, cache_bytes=3).collect()}
    for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False)
        if r["text"] != "same":
            d = digests[r["doc_id"]]
            assert d["n_tokens"] == len(ids) and d["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert d["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_empty_table(docs, vocabulary):
    none = docs.filter(F.lit(False))
    assert token_counts.token_counts(none, vocabulary).count() == 0
    assert bpe.bpe_digests(none, vocabulary).count() == 0
