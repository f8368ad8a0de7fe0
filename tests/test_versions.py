"""Versioned outputs, and items checked by type."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tessella.operators import quality as Q
from tessella.sources import versions as V


def blocks(spark, text):
    rows = [("d", "Bloque 12", text, 1), ("d", "Anexo é", text, 1), ("d", None, text, 1), ("d", "BLOQUE 007", " ", 1), ("e", "Bloque 1", None, 1)]
    return spark.createDataFrame(rows, "doc string, label string, markdown string, version int")


def test_next_version(spark, tmp_path):
    where = str(tmp_path / "out")
    assert V.versions(spark, where) == {}
    assert V.write_version(blocks(spark, " one\n"), where) == 1 and V.write_version(blocks(spark, "two"), where) == 2
    assert {r["markdown"] for r in V.read_version(spark, where, 1).collect()} == {"one"}
    last = V.read_version(spark, where).collect()
    assert {(r["file"], r["markdown"], r["version"]) for r in last} == {("bloque-12.md", "two", 2), ("bloque-anexo-e.md", "two", 2), ("bloque-sin-numero.md", "two", 2)}
    with pytest.raises(ValueError):
        V.read_version(spark, where, 3)


def test_retries_and_crashes(spark, tmp_path):
    where, token = str(tmp_path / "out"), "a" * 32
    # A write that stopped before it was published, and a number that was claimed by a writer that then died.
    blocks(spark, "half").write.parquet(f"{where}/data/{token}")
    (tmp_path / "out" / "versions").mkdir()
    (tmp_path / "out" / "versions" / "v1").touch()
    assert V.versions(spark, where) == {}
    assert V.write_version(blocks(spark, "whole"), where, token=token) == 2
    assert V.write_version(blocks(spark, "again"), where, token=token) == 2
    assert {r["markdown"] for r in V.read_version(spark, where).collect()} == {"whole"}
    with pytest.raises(ValueError):
        V.write_version(blocks(spark, "x"), where, token="../short")


def test_writers_at_once(spark, tmp_path):
    where = str(tmp_path / "out")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: (V.write_version(blocks(spark, f"text {k}"), where), k), range(4)))
    assert sorted(n for n, _ in numbers) == [1, 2, 3, 4]
    for n, k in numbers:
        assert {r["markdown"] for r in V.read_version(spark, where, n).collect()} == {f"text {k}"}


def test_items(spark):
    good = '{"tipo": "teoria", "titulo_detectado": null, "contenido_markdown": "engranajes helicoidales"}'
    items = [("a", 1, good), ("a", 2, good), ("b", 1, '{"tipo": 1}'), ("b", 2, '{"tipo": 1, "titulo_detectado": {"x": 1}, "contenido_markdown": null}'), ("c", 1, None), ("c", 2, '"text"'), ("c", 3, '{"a": '), ("e", 1, good)]
    chunks = [("a", 1, "Engranajes helicoidales"), ("a", 3, "sin elemento"), ("e", 1, "Cojinetes deslizantes"), ("b", 2, None)]
    i, c = spark.createDataFrame(items, "doc string, idx int, item string"), spark.createDataFrame(chunks, "doc string, idx int, chunk string")
    reports, fidelities = Q.validate_items(i, c, "doc")
    got = {r["doc"]: (r["n_items"], r["errors"], r["n_failed"], r["ok"]) for r in reports.collect()}
    assert got == {
        "a": (2, [], 0, True),
        "b": (2, ["Bloque 1: faltan claves ['contenido_markdown', 'titulo_detectado']", "Bloque 2: contenido_markdown no es string", "Bloque 2: titulo_detectado no es string/null"], 0, False),
        "c": (3, ["Bloque 1: no es un objeto", "Bloque 2: no es un objeto", "Bloque 3: no es un objeto"], 0, False),
        "e": (1, [], 1, False),
    }
    assert {(r["doc"], r["idx"]): r["score"] for r in fidelities.collect()} == {("a", 1): 1.0, ("e", 1): 0.0}
