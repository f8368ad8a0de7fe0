"""Files to blocks, against taking the pairs one after the other."""

import random

from tessella import sources as S
from tessella.operators import guides as G
from tessella.operators import matching as M


def follow(blocks, files):
    words = lambda s: {t for t in s.split() if len(t) >= 3 and not t.isdigit()}
    pairs = [(-len(words(n) & words(s)) / max(1, min(len(words(n)), len(words(s)))), b, f) for b, n in blocks for f, s in files if words(n) & words(s)]
    out, used = {}, set()
    for _, b, f in sorted(pairs):
        if b not in out and f not in used:
            out[b] = (f, "overlap")
            used.add(f)
    free = [f for f, _ in files if f not in used]
    for k, (b, _) in enumerate(blocks):
        if b not in out:
            out[b] = (free.pop(0), "free") if free else ((files[k] if k < len(files) else files[0])[0], "place") if files else (None, None)
    return out


def test_against_sequence(spark):
    rng = random.Random(11)
    name = lambda: " ".join(rng.choice(["ejes", "soldadura", "arco", "uniones", "12", "de", "lisos", "frenos"]) for _ in range(rng.randint(0, 3)))
    groups = {f"g{k}": ([(b, name()) for b in range(rng.randint(0, 7))], [(100 + f, name()) for f in range(rng.randint(0, 6))]) for k in range(25)}
    blocks = spark.createDataFrame([(g, *b, 1.0) for g, (own, _) in groups.items() for b in own], "g string, block long, name string, score double")
    files = spark.createDataFrame([(g, *f) for g, (_, own) in groups.items() for f in own], "g string, file long, stem string")
    got = {(r["g"], r["block"]): (r["file"], r["how"]) for r in M.assign_files(blocks, files, "g", S.stored).collect()}
    assert got == {(g, b): x for g, (own, given) in groups.items() for b, x in follow(own, given).items()}
    assert {how for _, how in got.values()} >= {"overlap", "free", "place"}


def test_guide_first(spark):
    blocks = spark.createDataFrame([("g", 1, "Ejes"), ("g", 2, "Frenos"), ("g", 3, "Nada"), ("h", 1, "Solo")], "g string, block int, name string")
    topics = spark.createDataFrame([("g", 1, 1, "Ejes lisos")], "g string, block int, ord int, name string")
    files = spark.createDataFrame([("g", 10, "ejes"), ("g", 11, "frenos de disco")], "g string, file int, stem string")
    found = spark.createDataFrame([("g", 10, 1, "Chavetas", "Sección 1.1"), ("g", 11, 1, "Discos", "Sección 2.1"), ("g", 11, 2, "Zapatas", None)], "g string, file int, ord int, name string, evidence string")
    got = sorted((r["block"], r["ord"], r["name"], r["origin"]) for r in G.guide_first_topics(blocks, topics, files, found, "g", S.stored).collect())
    assert got == [(1, 1, "Ejes lisos", "Guía docente"), (2, 1, "Discos", "Detectado"), (2, 2, "Zapatas", "Detectado"), (3, 1, "Chavetas", "Detectado")]
