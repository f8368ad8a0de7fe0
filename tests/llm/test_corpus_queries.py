"""The queries over the smallest tables, against SQL, the libraries, or brute force."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import queries
from tessella.llm.token_counts import vocabulary_text

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    df = queries.queries()[name](spark, DIR)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)


def test_tokens(spark, texts):
    lib = Tokenizer.from_str(vocabulary_text())
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in queries.queries()["op2_token_counts"](spark, DIR).collect():
        assert (r["n_tokens"], r["n_bytes"]) == (len(ids[r["doc_id"]]), len(texts[r["doc_id"]].encode()))
    for r in queries.queries()["op4_bpe"](spark, DIR).collect():
        own = ids[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(own, skip_special_tokens=False).encode()).hexdigest()


def test_recall(spark):
    v = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    ids = np.array(sorted(v))
    x = np.stack([v[i] / np.linalg.norm(v[i]) for i in ids])
    want = {(int(i), int(ids[k])) for i in ids[ids % 50 == 0] for k in [k for k in np.lexsort((ids, -(x @ (v[i] / np.linalg.norm(v[i]))))) if ids[k] != i][:5]}
    got = {(r["query_id"], r["vec_id"]) for r in queries.queries()["op3_neighbours"](spark, DIR).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_substrings(spark, texts):
    seen = Counter(b[k : k + 200] for b in (t.encode() for t in texts.values()) for k in range(len(b) - 199))
    for r in queries.queries()["op6_substring_dedup"](spark, DIR).collect():
        b = texts[r["doc_id"]].encode()
        mask = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                mask[k : k + 200] = b"\1" * 200
        assert r["n_removed"] == sum(mask) and r["kept_sha256"] == hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest()


def test_whole_tables(spark, texts):
    for name in ("op1_toxicity", "op5_near_duplicates"):
        assert sorted(r["doc_id"] for r in queries.queries()[name](spark, DIR).collect()) == sorted(texts)
    pages = spark.read.parquet(f"{DIR}/pages.parquet").count()
    assert queries.queries()["op8_html_text"](spark, DIR).filter("n_chars > 0").count() == pages
