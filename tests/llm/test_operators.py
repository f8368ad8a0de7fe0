"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, and no rows at all,
against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontamination, html_text, line_dedup, lyndon, near_dedup, neighbours, revisits, substring_dedup, toxicity
from tessella.llm.shingles import text_shingles

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghé"), rng.integers(2, 8))) for _ in range(n))


def table(spark, rows):
    """doc_id and text with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, i, "x", i, 0.5) for i, t in rows], "doc_id long, text string, row long, key string, rank long, score double")


# 1


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(400):
        text = prose(i, int(rng.integers(5, 80)))
        if bad := i % 4 == 0:
            text += " " + " ".join(rng.choice(["vileness", "vilest", "scoundrel"], int(rng.integers(2, 5))))
        rows.append((i, text))
        labels.append((i, int(bad), 1))
    rows += [(1000, None), (1001, ""), (1002, "x " * 50_000), (None, "vilest scoundrel vileness"), (3, rows[3][1])]
    docs = table(spark, rows)
    known = spark.createDataFrame([*labels[:300], (5, None, 1), (None, 1, 1), (0, 1, 0)], "doc_id long, toxic int, quality int")
    scored = toxicity.score_toxicity(docs, toxicity.toxicity_model(docs, known)).collect()
    assert len(scored) == len(rows)
    held = [r for r in scored if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    assert sum(r["toxic"] == (r["doc_id"] % 4 == 0) for r in held) >= 97
    assert {r["doc_id"]: r["toxic"] for r in scored}[None] and not any(r["toxic"] for r in scored if (r["doc_id"] or 0) >= 1000)
    assert all(0 <= r["severity"] <= 2 and r["grade"] in (0, 1, 2) for r in scored)


def test_toxicity_without_grades(spark):
    docs, labels = table(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.toxicity_model(docs, labels)
    assert [r["severity"] for r in toxicity.score_toxicity(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.score_toxicity(docs.filter("false"), model).count() == 0


def test_thresholds_share_weights():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        f = [k for k in range(4) if rng.random() < 0.4]
        z = sum((3, 1.5, 0, -1)[k] for k in f)
        rows.append((f, int(z > 1) + int(z > 3.5)))
    model = toxicity.fit(rows, ["aaaa", "bbbb", "cccc", "dddd"], penalty=1e-5)
    w = model.weights
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    assert w["aaaa"] > w["bbbb"] > abs(w.get("cccc", 0)) and w["dddd"] < 0


def test_likelihood_and_optimum():
    """The gradient against differences, the likelihood against its definition, the optimum against its conditions."""
    rng = np.random.default_rng(1)
    rows = [(sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist()), int(rng.integers(0, 3))) for _ in range(80)]
    r, c, y = np.repeat(np.arange(80), [len(f) for f, _ in rows]), np.concatenate([np.array(f, dtype=int) for f, _ in rows]), np.array([g for _, g in rows])
    p = np.concatenate([rng.normal(size=6), [-0.4, -0.2]])
    value, slope = toxicity.likelihood(p, r, c, y, 6)
    first, second = p[6], p[6] + math.exp(p[7])
    logs = []
    for f, g in rows:
        z = sum(p[k] for k in f)
        above = [1, 1 / (1 + math.exp(first - z)), 1 / (1 + math.exp(second - z)), 0]
        logs.append(-math.log(above[g] - above[g + 1]))
    assert math.isclose(value, sum(logs) / 80, rel_tol=1e-9)
    for k in range(8):
        step = np.eye(8)[k] * 1e-6
        near = (toxicity.likelihood(p + step, r, c, y, 6)[0] - toxicity.likelihood(p - step, r, c, y, 6)[0]) / 2e-6
        assert abs(near - slope[k]) < 1e-6
    model = toxicity.fit(rows, list("abcdef"), penalty=0.02, steps=4000)
    w = np.array([model.weights.get(x, 0.0) for x in "abcdef"])
    best = np.concatenate([w, [model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])]])
    slope = toxicity.likelihood(best, r, c, y, 6)[1]
    assert np.all(np.abs(slope[6:]) < 1e-4)
    assert all(abs(s + 0.02 * np.sign(x)) < 1e-4 if x else abs(s) <= 0.02 + 1e-4 for x, s in zip(w, slope[:6], strict=True))


# 3


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[300:400] = v[7]  # a large group of equal vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, [float("inf")] + [1.0] * 15), (None, v[0].tolist()), (905, []), (906, [1.0, 2.0]), (5, v[5].tolist())]
    t = spark.createDataFrame([(i, x, 1) for i, x in rows + odd], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.neighbours(t, t.filter("vec_id % 50 = 0 or vec_id in (906, 310)")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in [*range(0, 600, 50), 310]:
        s = x @ x[q]
        best = sorted((j for j in range(600) if j != q), key=lambda j: (-round(s[j], 12), j))[:5]
        hits += len({*best} & {j for j, _ in got[q]})
        total += 5
        assert all(math.isclose(c, s[j], rel_tol=1e-9) for j, c in got[q]) and len(got[q]) == 5
    assert hits / total >= 0.9
    assert [j for j, _ in got[310]] == [7, 300, 301, 302, 303]  # ties go to the smaller id
    assert 906 not in got and not set(got) & set(range(900, 906))
    assert neighbours.neighbours(t.filter("false"), t).count() == 0


# 5


def probability_jaccard(a, b):
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def test_near_duplicates_against_brute_force(spark):
    base = prose(1, 120).split()
    rows = [(10 + k, " ".join(w if j != 7 * k else "changed" for j, w in enumerate(base))) for k in range(12)]
    rows += [(30 + k, prose(100 + k, 60)) for k in range(5)] + [(40, rows[0][1]), (41, None), (42, None), (43, ""), (44, "!!!"), (45, "!!!"), (46, "one two"), (47, "One, two"), (48, prose(9, 20_000)), (10, rows[0][1])]
    got = {r["doc_id"]: r for r in near_dedup.near_classes(table(spark, rows)).collect()}
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else Counter() for i, t in rows}
    parent = {i: i for i, _ in rows}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, t in rows:
        for j, u in rows:
            if i < j and (t and t == u or probability_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: r["class_id"] for i, r in got.items()} == {i: root(i) for i in parent}
    assert got[10]["n_copies"] == 3 and got[30]["n_copies"] == 1
    assert near_dedup.near_classes(table(spark, rows).filter("false")).count() == 0


def test_pairs_within_a_crowd_are_found(spark):
    base, rows = prose(1, 200).split(), []
    for k in range(60):
        own = prose(1000 + k, 28).split()
        rows.append((2 * k, " ".join(base + own)))
        rows.append((2 * k + 1, " ".join(base + own[:5] + prose(3000 + k, 23).split())))
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in rows for w in [words(t)]}
    similar = [(i, j) for i in sets for j in sets if i < j and len(sets[i].keys() & sets[j].keys()) / len(sets[i].keys() | sets[j].keys()) >= 0.8]
    assert similar == [(2 * k, 2 * k + 1) for k in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(table(spark, rows), small=2).collect()}
    assert got == {i: i - i % 2 for i in sets}


def test_a_class_and_its_neighbours(spark):
    """Texts with little of their own, all in one class, and texts with more, each similar to some of the former only."""
    base, rows = prose(1, 300).split(), []
    for k in range(25):
        rows.append((k, " ".join(base + prose(1000 + k, 10).split())))
        rows.append((100 + k, " ".join(base[: 290 - k] + prose(3000 + k, 40 + k).split())))
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in rows for w in [words(t)]}
    assert all(n == 1 for c in sets.values() for n in c.values())  # so that the similarity is that of sets
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i].keys() & sets[j].keys()) >= 0.8 * len(sets[i].keys() | sets[j].keys()):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(table(spark, rows), small=2).collect()}
    assert got == group and 1 < len(set(group.values())) < 26


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    a, b = np.arange(1, 200, dtype=np.uint64), np.arange(60, 260, dtype=np.uint64)
    x, y = rng.integers(1, 6, len(a)), rng.integers(1, 6, len(b))
    exact = near_dedup.probability_jaccard((a, x), (b, y))
    assert math.isclose(exact, probability_jaccard(dict(zip(a.tolist(), x.tolist())), dict(zip(b.tolist(), y.tolist()))), rel_tol=1e-9)
    h = near_dedup.mix
    order_a, order_b = np.argsort(h(a)), np.argsort(h(b))
    same = near_dedup.probminhash(h(a)[order_a], x[order_a], 4096) == near_dedup.probminhash(h(b)[order_b], y[order_b], 4096)
    assert abs(same.mean() - exact) < 0.04


def test_texts_signed_together_are_signed_as_alone():
    texts = list(text_shingles([prose(k, 1 + 3 * k) for k in range(40)] + ["a b a b " * 90, "x"]))
    together = near_dedup.probminhashes(texts, 120)
    assert all((row == near_dedup.probminhash(*t, 120)).all() for row, t in zip(together, texts, strict=True))
    assert near_dedup.probminhashes([], 120).shape == (0, 120)


@pytest.mark.parametrize("block", [4, 1000])
def test_a_crowd_leaves_tasks_as_links_only(spark, block):
    """Texts that are alike, but below the limit, in one bucket: all pairs are compared, and no more than the links come out."""
    base, rows = prose(1, 200).split(), []
    for k in range(30):
        own = prose(1000 + k, 28).split()
        rows.append((f"{2 * k}", " ".join(base + own)))
        rows.append((f"{2 * k + 1}", " ".join(base + own[:5] + prose(3000 + k, 23).split())))
    twice = " ".join(base[:50] * 4)  # weights beyond 1
    rows += [("60", twice), ("61", " ".join(base[:50] * 3))]
    mixed = spark.createDataFrame([(7, k, "m" if k in ("0", "2", "4") else k) for k, _ in rows], "band long, key string, class string")
    got = near_dedup.block_links(mixed, spark.createDataFrame(rows, "key string, text string"), block=block).collect()
    sets = {k: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for k, t in rows for w in [words(t)]}
    assert probability_jaccard(sets["60"], sets["61"]) >= 0.8  # of the others all weights are 1
    want = {("60", "61")} | {(a, b) for a in sets for b in sets if a < b and not {a, b} & {"60", "61"} and len(sets[a].keys() & sets[b].keys()) >= 0.8 * len(sets[a].keys() | sets[b].keys())}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) and len(want) == 31


def test_shingles_of_batches_are_those_of_texts():
    texts = ["A b C d e f", None, "", "a b c d e", "a  b\nc d-e", "x y", "é" * 3]
    alone = [next(iter(text_shingles([t]))) for t in texts]
    for (a, n), (b, m) in zip(text_shingles(texts), alone, strict=True):
        assert a.tolist() == b.tolist() and n.tolist() == m.tolist()
    assert alone[3][0].tolist() == alone[4][0].tolist() and len(alone[0][0]) == 2


# 6


def removed(rows, n):
    seen = Counter(b[k : k + n] for _, b in rows for k in range(len(b) - n + 1))
    out = []
    for i, b in rows:
        mask = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                mask[k : k + n] = b"\1" * n
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((i, len(b), sum(mask), sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("kinds", [64, 2])
def test_substrings_against_brute_force(spark, kinds):
    passage = prose(2, 60)
    rows = [(i, prose(50 + i, 30) + passage + prose(80 + i, 30)) for i in range(10)]
    rows += [(20, passage[:199]), (21, passage[:200]), (22, None), (23, ""), (24, "ab" * 300), (25, "a" * 250), (26, "é" * 120), (27, rows[0][1][7:260]), (28, prose(7, 30_000)), (28, "short"), (None, passage + "ñ")]
    got = substring_dedup.dedup_substrings(table(spark, rows), kinds=kinds).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == removed([(i, (t or "").encode()) for i, t in rows], 200)
    assert substring_dedup.dedup_substrings(table(spark, rows).filter("false")).count() == 0


def test_windows_of_a_common_passage_are_not_joined(spark, monkeypatch):
    """A passage in many surroundings: its windows are counted where they are, not joined with their counts."""
    plans, real = [], substring_dedup.stored
    monkeypatch.setattr(substring_dedup, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    rows = [(i, prose(50 + i, 30) + prose(2, 60) + prose(80 + i, 30)) for i in range(6)]
    got = substring_dedup.dedup_substrings(table(spark, rows), kinds=2).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == removed([(i, t.encode()) for i, t in rows], 200)
    assert min(r["n_removed"] for r in got) >= 200
    assert not [line for plan in plans for line in plan.splitlines() if "Join" in line and "two#" in line]


def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(4)
    for _ in range(60):
        strings = [[*rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)).tolist(), 0] for _ in range(int(rng.integers(1, 9)))]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        got = lyndon.suffix_arrays(np.array([x for s in strings for x in s]), bounds)
        for k, s in enumerate(strings):
            assert (got[bounds[k] : bounds[k + 1]] - bounds[k]).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


# 7


def test_lines_against_brute_force(spark):
    rng, short = np.random.default_rng(8), "\n".join(prose(70 + k, 6)[:38] for k in range(10))
    a, b, c = ("alpha " * 9).strip(), ("beta " * 9).strip(), "long line " * 25
    rows = [(1, f"{a}\n{b}\nend one"), (2, f"x\n{a}\n{b}\ny"), (3, f"{a}\nz"), (4, None), (5, ""), (6, f"{c}\nq"), (7, f"p\n{c}"), (8, f"{a}\n{b}"), (9, "\n".join([a] * 5)), (10, "s\nt"), (11, "s\nt"), (12, "\n".join(prose(k, 6) for k in range(3000)))]
    rows += [(20 + k, "\n".join(rng.choice(["", "", "ab", "c" * 30, "d" * 41, "e" * 90, "f" * 210], rng.integers(1, 14)))) for k in range(60)]
    rows += [(100, f"own\n{short}\nend"), (101, f"other\n{short}\nlast"), (104, "\n" * 400 + "g" * 80), (105, "\n" * 300 + "g" * 80), (106, "\n".join(["h" * 7] * 40))]
    seen, gone = set(), {}
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        for k in range(len(lines)):
            size = 0
            for e in range(k + 1, min(len(lines), k + 500) + 1):
                size += len(lines[e - 1])
                if size >= (200 if e == k + 1 else 80):
                    run = hash(tuple(lines[k:e]))
                    gone.setdefault(i, set()).update(range(k, e)) if run in seen else seen.add(run)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone.get(i, ()))
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_removed"]) == (t if t is None else kept, len(lines), len(gone.get(i, ())))
    assert got[8]["text"] == "" and got[2]["n_runs"] == 1 and got[1]["rank"] == 1 and got[101]["text"] == "other\nlast"
    assert line_dedup.dedup_lines(table(spark, rows).filter("false")).count() == 0


def test_pipeline_drops_runs_of_short_lines(spark):
    import corpus_pipeline

    short = "\n".join(prose(70 + k, 12)[:38] for k in range(10))
    docs = table(spark, [(100, f"own\n{short}\nend"), (101, f"other\n{short}\nlast")]).withColumn("n_chars", F.lit(1).cast("long"))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {100: f"own\n{short}\nend", 101: "other\nlast"}


# 8


PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li>Menu<li>More</ul></nav>
<div class="cookie-notice">We use cookies</div>{box}<main>{body}</main><aside>Side</aside><section id="comments"><p>Reader says</p></section><form>Name <input></form><footer>&copy; F</footer></body></html>"""


def test_main_text(spark):
    box = "<div class='q7'><p>Join our club of {} friends</p></div>"
    rows = [(k, f"http://a.example/{k}", f"<body>{box.format('many')}<div><h1>Title {k}</h1><p>{prose(k, 5)}&nbsp;&amp; <b>x</b>y<p>two{'<br>'}lines</div></body>") for k in range(8)]
    rows += [(20, None, PAGE.format(box="", body="<h1>Head</h1>\n<p>One  &lt;\ntwo<!-- no --><div class=ad>Buy</div><p>three")), (21, "http://b", None), (22, "http://b", ""), (23, "http://b", "plain & simple"), (24, "http://b", "<p>cut <"), (25, "x", "<body><p>" + "long " * 50_000)]
    pages = spark.createDataFrame([(i, u, h, 1, 2) for i, u, h in rows], "page_id long, url string, html string, key int, host int")
    for limit in (500_000, 0):  # template keys broadcast, or joined
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(pages, broadcast_rows=limit).collect()}
        assert got[3][0] == f"Title 3 {prose(3, 5)} & xy two lines"
        assert got[20][0] == "Head One < two three" and got[21] == got[22] == ("", 0) and got[23][0] == "plain & simple" and got[24][0] == "cut <"
        assert got[25][1] == len("long " * 50_000) - 1 and all(n == len(t) for t, n in got.values())
    assert html_text.extract_text(pages.filter("false")).count() == 0


def test_mirrored_pages_are_no_template(spark):
    rows = [(k, f"http://m.example/{k}", "<article><div><p>The same story everywhere</p></div></article>") for k in range(20)]
    # One story in two sections, published again and again, each time with another advert.
    rows += [(100 + k, f"http://n.example/{k}", f"<body><div><p>{prose(1, 60)}</p></div><div><p>{prose(2, 60)}</p></div><div class=q><p>{prose(k, 4)}</p></div></body>") for k in range(20)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got if r["page_id"] < 100} == {"The same story everywhere"}
    assert all(r["text"].startswith(f"{prose(1, 60)} {prose(2, 60)}") for r in got if r["page_id"] >= 100)


def test_templates_of_a_large_host(spark):
    """Unnamed blocks that rotate: each stands on few pages of many, and each page has another article."""
    def page(k):
        return f"<body><div class=x1><p>Advert {k % 40} {prose(k % 40, 6)}</p></div><div class=y2><h1>Title {k}</h1><p>{prose(5000 + k, 50)}</p></div><div class=z3><p>Notice {k % 30} {prose(900 + k % 30, 9)}</p></div></body>"

    rows = [(k, f"http://big.example/{k}", page(k)) for k in range(400)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k} {prose(5000 + k, 50)}" for k in range(400)}
    # Brute force: in how many different surroundings does each container stand?
    seen = {}
    for _, url, html in rows:
        for key, rank, sig in html_text.surroundings(html, url):
            seen.setdefault((key, rank), set()).add(sig)
    want = {key for (key, _), sigs in seen.items() if len(sigs) >= 5}
    keys = html_text.template_keys(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["key"] for r in keys.collect()} == want and len(want) == 70


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><p>Main story</p></article><article class="comment"><p>nice</p></article>', "Main story"),
        ('<main><p>Long main text of the page</p><article class="teaser"><p>Tease</p></article></main>', "Long main text of the page"),
        ("<main><p>Long main text of the page that goes on</p><article><p>Tease</p></article></main>", "Long main text of the page that goes on Tease"),
        ("<header>Site</header><article><header><h1>Title</h1></header><p>Text</p></article>", "Title Text"),
        ('<div class="post-header"><h1>Title</h1></div><p>Text</p>', "Title Text"),
        ('<p class="notice-of-meeting">Meeting</p><p class="cookie-notice">no</p><div class="ad-slot-2">x</div><div id="adBox">y</div>', "Meeting"),
        ("<p title=don't>text's <b>end</b>", "text's end"),
        ("a < b <p>cut <", "a < b cut <"),
        ("<div>" * 5000 + "deep", "deep"),
        ("<p>x" + "<a " * 200_000, "x"),
        ("<b><div>" + "<i>" * 50_000 + "</b>" * 50_000 + "y", "y"),
    ],
)
def test_main_text_of_odd_pages(html, text):
    assert html_text.main_text(html) == text
    assert list(html_text.surroundings(html, None)) is not None


# 9


def test_revisits(spark):
    def record(i, kind, url, at, tag=None, modified=None, headers=None):
        return (i, kind, url, at, tag, modified, headers or {}, "clash")

    rows = [
        record(1, "response", "http://www.A.example:80/p/?ref=1#f", 100, '"a"', 5, {"content-type": "text/html", "date": "1", "content-length": "9"}),
        record(2, "response", "https://a.example/p", 7300, '"b"', 6, {"date": "2"}),
        record(3, "response", "https://a.example/p", 7300, '"c"', 6, {"date": "3"}),
        record(10, "revisit", "http://a.example/p", 200, 'W/"a"', None, {"date": "9", "content-length": "0"}),
        record(11, "revisit", "http://a.example/p", 9000, '"c"'),
        record(12, "revisit", "http://a.example/p", 7300, '"x"'),
        record(13, "revisit", "http://a.example/p", 90_000, None, 7),
        record(14, "revisit", "http://a.example/p", 90_000),
        record(15, "revisit", "http://a.example/p", 100, '"a"'),
        record(16, "revisit", None, 100, '"a"'),
        record(17, "revisit", "http://a.example/p", None, '"a"'),
        record(18, "request", "http://a.example/p", 120),
    ]
    t = spark.createDataFrame(rows, "record_id long, kind string, url string, at long, etag string, last_modified long, headers map<string,string>, canonical string")
    got = {r["record_id"]: r for r in revisits.resolve_revisits(t).collect()}
    assert {i: (r["status"], r["response_id"]) for i, r in got.items()} == {10: ("resolved", 1), 11: ("resolved", 3), 12: ("mismatch", 1), 13: ("mismatch", 3), 14: ("unchecked", 3), 15: ("no_response", None), 16: ("no_response", None), 17: ("no_response", None)}
    assert got[10]["headers"] == {"content-type": "text/html", "date": "9", "content-length": "9"} and got[12]["headers"] is None
    assert revisits.resolve_revisits(t.filter("false")).count() == 0


# 10


def test_decontamination_against_brute_force(spark):
    item, short = prose(1, 40), "Tiny item"
    bench = [(1, item), (2, item), (3, short), (4, None), (5, "..."), (6, prose(2, 13)), (7, prose(3, 14)), (10, "the the the the the the the the the the the the the the the")]
    rows = [(1, prose(20, 50) + " " + " ".join(item.split()[3:25]).upper() + ". " + prose(21, 50)), (2, " ".join(item.split()[:12])), (3, "a TINY-item b"), (4, None), (5, ""), (6, prose(2, 13)), (7, "x " + prose(3, 14) + " y " + prose(3, 14)), (8, "the " * 5000), (9, prose(30, 3000) + " tiny item"), (9, "tiny item"), (None, item)]
    got = decontamination.decontaminate(table(spark, rows), spark.createDataFrame([(i, t, "z") for i, t in bench], "item_id long, text string, doc_id string")).collect()
    want = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for j, u in bench:
            v = words(u)
            n = min(13, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    items.add(str(j))
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(table(spark, rows), empty).filter("contaminated or n_hit > 0").count() == 0
    assert decontamination.decontaminate(table(spark, rows).filter("false"), empty).count() == 0


# the pipeline


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    item = prose(900, 40)
    rows = [(i, prose(i, 60) + "\n" + prose(500 + i, 60), "en", "s", 1, "extra") for i in range(40)]
    toxic = [(100 + i, prose(300 + i, 40) + " vilest scoundrel vileness", "en", "s", 1, "e") for i in range(20)]
    odd = [(200, None, "en", None, None, None), (201, "", "en", "s", 0, "e"), (202, rows[0][1], "en", "s", 1, "e"), (203, rows[1][1].replace(" ", " the ", 1), "en", "s", 1, "e"), (204, item, "en", "s", 1, "e")]
    spark.createDataFrame(rows + toxic + odd, "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 1) for i in range(40)] + [(100 + i, 1, 1) for i in range(20)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept == {*range(40), 200, 201, 203}  # 202 is a copy, 204 a benchmark item; what line dedup leaves of 203 is like no other text
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
    assert out.filter(F.lit(False)).count() == 0


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    import corpus_pipeline

    item = prose(900, 40)
    rows = [(None, item, 1), (1, item, 2), (1, prose(1, 60), 3), (2, prose(2, 60), 4), (2, prose(2, 60), 5), (None, prose(2, 60), 6), (None, prose(3, 60), 7), (None, prose(3, 60), 8), (5, prose(2, 60), 9), (5, prose(4, 60), 10), (None, None, 11), (None, None, 12)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r["n_chars"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()} == {2, 3, 4, 7, 10, 11, 12}
    assert {r["n_chars"] for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()} == {*range(3, 13)}


def test_pipeline_stages_take_clashing_names(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, prose(1, 60), "a", 7, "x", 1), (2, prose(1, 60), "b", 8, "y", 2), (3, None, "c", 9, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, n_removed long, `n.lines` string, row long")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for (_, stage), left in zip(corpus_pipeline.STAGES[:-1], (3, 2, 2, 3), strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = {tuple(r) for r in out.collect()}
        assert len(got) == left and got <= set(rows)


def test_spans_are_merged_for_many_texts_at_once():
    import random

    import numpy as np

    from tessella.llm.anchors import picks, prefix_sums, substring_hashes
    from tessella.llm.substring_dedup import merged

    rng = random.Random(3)
    texts = [[(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 9)))] for _ in range(200)]
    flat = [p for t in texts for p in t]
    low, upto, at = merged(np.array([len(t) for t in texts]), np.array([a for a, _ in flat]), np.array([b for _, b in flat]))
    for k, spans in enumerate(texts):
        runs = []
        for a, b in sorted(spans):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        assert runs == [[int(a), int(b)] for a, b in zip(low[at[k] : at[k + 1]], upto[at[k] : at[k + 1]], strict=True)]
    none = np.zeros(0, np.int64)
    assert merged(np.zeros(3, np.int64), none, none)[2].tolist() == [0, 0, 0, 0]
    raw = np.frombuffer(rng.randbytes(500), dtype=np.uint8)
    sums = prefix_sums(raw)
    place, hashes, _, _ = picks(sums, len(raw), 200, 64)
    assert (hashes == substring_hashes(sums, place, place + 64)).all()
