"""Operator 13 against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

from tessella.llm.spelling import op13_spelling_variants, spelling_variants, words_of

DIR = "/root/testdata/sf0.001"


def expected(counts, length=5, times=3, ratio=2):
    """Near words by deletion and replacement in a set of all words."""
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= times}
    gaps = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            gaps[w[:k] + "\0" + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for own in gaps.values():
        for w in own:
            near[w] |= own - {w}
    for w in words:
        for k in range(len(w)):
            if (v := w[:k] + w[k + 1 :]) in words:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_random_words(spark):
    """Short words over few letters, chains, doubled letters, letters beyond ASCII, one letter's and very long words."""
    rng = random.Random(3)
    counts = Counter({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 3, 5, 8, 16, 40]) for _ in range(700)})
    counts |= Counter({"a" * k: 3 * k for k in range(1, 30)})
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    counts |= Counter({long: 9, long[:1500] + long[1501:]: 4, long[:20] + "z" + long[21:]: 3, long + "a": 3, "x" + long: 20})
    counts |= Counter({"".join(rng.choice("nmrstuaeiou") for _ in range(6)): rng.randint(1, 9) for _ in range(1500)})
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string")
    assert got(spelling_variants(df, length=1, times=1)) == expected(counts, 1, 1)
    assert got(spelling_variants(df)) == expected(counts)


def test_edges(spark):
    rows = [("hello", 2), ("hello", 2), (None, 5), ("hallo", None), ("hallo", 2), ("hullo", 8), ("jullo", 8), ("hell", 99)]
    df = spark.createDataFrame(rows, "word string, n long")
    assert got(spelling_variants(df)) == expected(Counter({"hello": 4, "hullo": 8, "jullo": 8, "hell": 99}))
    assert spelling_variants(df.limit(0)).count() == 0
    texts = [(1, None), (2, ""), (None, "Wörter ÄB"), (3, "Hello HELLO-hello h3llo ×÷")]
    made = {r["word"]: r["n"] for r in words_of(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert made == {"wörter": 1, "Äb": 1, "hello": 3, "h": 1, "llo": 1, "×÷": 1}


def test_query(spark):
    counts, fold = Counter(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", (r["text"] or "").translate(fold)):
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    rows = got(op13_spelling_variants(spark, DIR))
    assert rows == expected(counts)
    assert sum(r[1] is not None for r in rows) > 20
