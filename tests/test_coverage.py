"""Coverage of topics against searching every text for every token."""

import random

from tessella import sources as S
from tessella.operators import quality as Q


def test_against_search(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abn") for _ in range(n))
    docs = [(k, rng.choice("xyz"), rng.choice([" ".join(word(rng.randint(1, 8)) for _ in range(rng.randint(0, 12))), "", None])) for k in range(60)]
    topics = [(100 + k, rng.choice("xyw"), [word(rng.randint(3, 4)) for _ in range(rng.randint(0, 5))]) for k in range(30)] + [(200, "x", ["abn", "abn", "bbbb"])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc int, g string, norm string, token int")
    t = spark.createDataFrame(topics, "item int, g string, tokens array<string>")
    got = sorted((r["doc"], r["item"], r["told"]["found"], r["told"]["covered"]) for r in Q.coverage(d, t, "g", "doc", "item", S.stored).collect())
    want = []
    for k, g, norm in docs:
        for item, h, tokens in topics:
            if g == h:
                found = sum(x in (norm or "") for x in tokens)
                want.append((k, item, found, not tokens or found >= max(1, (len(tokens) + 1) // 2)))
    assert got == sorted(want)
    assert Q.coverage(d.limit(0), t, "g", "doc", "item", S.stored).count() == 0


def test_contents_stay_where_they_are(spark, monkeypatch):
    """Contents are not shuffled; sets of few topics, short tokens and topics that are not broadcast give the same."""
    d = spark.createDataFrame([(1, "x", "abc de ñandú"), (2, "x", None), (3, "y", "xabcx")], "doc int, g string, norm string")
    t = spark.createDataFrame([(10, "x", ["abc", "c", "abc"]), (11, "x", []), (12, "x", ["and", "zzz", "ñandú"]), (13, "y", ["abc", "bcd", "ab", "x"])], "item int, g string, tokens array<string>")
    want = [(1, 10, 3, True), (1, 11, 0, True), (1, 12, 2, True), (2, 10, 0, False), (2, 11, 0, True), (2, 12, 0, False), (3, 13, 3, True)]
    rows = lambda made: sorted((r["doc"], r["item"], r["told"]["found"], r["told"]["covered"]) for r in made.collect())
    made = Q.coverage(d, t, "g", "doc", "item", S.stored)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and rows(made) == want
    assert rows(Q.coverage(d, t, "g", "doc", "item", S.stored, together=1)) == want
    monkeypatch.setattr(Q, "size_hint", lambda *_: "shuffle_merge")
    assert rows(Q.coverage(d, t, "g", "doc", "item", S.stored, parts=3)) == want
