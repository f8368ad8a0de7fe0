"""Operator 12 against brute force over all pairs of a label."""

import math

import numpy as np

from tessella.llm.lattice_links import SHORTEST, linked_vectors, nearest_e8, op12_lattice_links

DIR = "/root/testdata/sf0.001"


def brute(rows, cosine=0.98):
    fine = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    for i in fine:
        for j in fine:
            a, b = rows[i][1], rows[j][1]
            if i < j and rows[i][2] == rows[j][2] and len(a) == len(b) and np.dot(a, b) / (math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b))) >= cosine:
                near[i].add(j)
                near[j].add(i)
    out = []
    for k, (vec_id, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo.extend(new)
        least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((vec_id, len(near[k]), least, vec_id is not None and vec_id == least))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def near_copies(rng, centre, n, cosine):
    noise = rng.standard_normal((n, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * centre + math.sqrt(1 - cosine**2) * noise


def test_decoder():
    """No lattice point beside the decoded one is nearer; decoded points are fixed points."""
    x = np.random.default_rng(1).uniform(-4, 4, (500, 8))
    home = nearest_e8(x)
    away = ((x[:, None, :] - home[:, None, :] - SHORTEST) ** 2).sum(axis=2)
    assert len(SHORTEST) == 240 and (((x - home) ** 2).sum(axis=1) <= away.min(axis=1) + 1e-9).all() and (nearest_e8(home) == home).all()


def test_groups(spark):
    """A large group of near copies, exact copies, chains, scaled vectors, several labels; the same with blocks of a few vectors."""
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v)
    rows = []
    for label, size in ((0, 150), (1, 40), (2, 3)):
        c = unit(rng.standard_normal(16))
        rows += [(None, list(map(float, v * rng.uniform(0.1, 9))), label) for v in near_copies(rng, c, size, 0.991)]
        rows += [(None, list(map(float, unit(rng.standard_normal(16)))), label) for _ in range(60)]
    rows += [rows[3]] * 7 + [rows[160]] * 3
    step = unit(rng.standard_normal(16)), unit(rng.standard_normal(16))
    rows += [(None, list(map(float, math.cos(0.15 * k) * step[0] + math.sin(0.15 * k) * step[1])), 1) for k in range(9)]
    rows = [(1000 - k, v, label) for k, (_, v, label) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    assert got(linked_vectors(df)) == want
    assert got(linked_vectors(df, block=16)) == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, nan], 0), (5, [1.0, inf], 0), (6, [1.0, None], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (9, [2.0, 0.0], 0), (None, [3.0, 0.01], 0), (None, None, None), (10, [1.0, 0.0, 0.0], 0), (11, [-1.0, 0.0], 0), (12, [-0.0, 1.0], 1), (13, [0.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, cell string, n int")
    assert got(linked_vectors(df)) == brute(rows)
    assert linked_vectors(df.limit(0)).count() == 0


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    assert got(op12_lattice_links(spark, DIR)) == brute(rows)
