"""Operator 11 against brute force: the kernel on random repetitive texts, the query on the smallest table."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessella.llm.periodic_runs import Grammar, op11_periodic_runs, periodic_runs, runs_of

DIR = "/root/testdata/sf0.001"


def brute(w, least=6, times=4):
    """start, end, period: every period from 1 on, every stretch; multiples of a period found before go."""
    found = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, times * p) and not any(a <= s and i + p <= b for a, b, _ in found):
                found.append((s, i + p, p))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def together(docs):
    sizes = np.array([len(x) for x in docs])
    return np.array(sum(docs, []), np.int32), np.repeat(np.arange(len(docs), dtype=np.int32), sizes), np.cumsum(sizes)


@pytest.mark.parametrize("seed", range(4))
def test_kernel(seed):
    rng = random.Random(seed)
    for _ in range(250):
        docs = []
        for _ in range(rng.randint(1, 4)):
            kinds = rng.choice([1, 2, 3, 5, 30])
            x = [rng.randrange(kinds) for _ in range(rng.randint(0, rng.choice([0, 1, 5, 8, 20, 60, 200])))]
            for _ in range(rng.randint(0, 3)):
                u = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 7, 9, 12, 20, 33]))]
                at, m = rng.randint(0, len(x)), rng.randint(2, 9)
                x = x[:at] + (u * m)[: len(u) * m - rng.randint(0, len(u) - 1)] + x[at:]
            docs.append(x + x[: rng.randint(1, len(x))] if x and rng.random() < 0.3 else x)
        word, doc, ends = together(docs)
        start, end, period = runs_of(word, doc, ends)
        want = [(s + ends[d] - len(x), e + ends[d] - len(x), p) for d, x in enumerate(docs) for s, e, p in brute(x)]
        assert sorted(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == sorted(want)


def test_grammar_compresses():
    """A passage that stands in many documents is asked once: nodes are far fewer than words."""
    rng = random.Random(5)
    passage = [rng.randrange(500) for _ in range(400)]
    word, doc, ends = together([passage + [1000 + d] for d in range(50)])
    assert len(Grammar(word, doc).nodes(ends)[0]) < len(word) / 10


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a a a a a a", "x"), (3, "b \t\x0b" + "a b " * 4 + "c", "x"), (3, "b \t\x0b" + "a b " * 4 + "c", "x"), (4, "é é " * 6, "x"), (5, "w " * 30000, "x")]
    made = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in made), key=str)
    want = [(1, 0, [], ""), (2, 0, [], ""), (None, 6, [(0, 6, 1)], "a"), (3, 10, [(0, 9, 2)], "b a c"), (3, 10, [(0, 9, 2)], "b a c"), (4, 6, [(0, 6, 1)], "é é"), (5, 30000, [(0, 30000, 1)], "w")]
    assert got == sorted(want, key=str)
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    made = {r["doc_id"]: r for r in op11_periodic_runs(spark, DIR).collect()}
    assert made.keys() == rows.keys()
    planted = 0
    for i, text in rows.items():
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = brute(words) if n < 2500 else None
        if runs is None:
            continue
        planted += bool(runs)
        gone = {k for s, e, p in runs for k in range(s + p, e)}
        best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
        r = made[i]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == ((best[0], best[1] - best[0], best[2]) if best else (None,) * 3)
        assert r["exponent_milli"] == (1000 * (best[1] - best[0]) // best[2] if best else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{e - s},{p}\n" for s, e, p in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for k, w in enumerate(words) if k not in gone))
    assert planted > 5
