"""S4, dense: a row's line is written from its own cells; no row per empty cell is made, joined or shuffled."""

import contextlib
import io
import json
import random

import pyarrow as pa
import pytest

from helixframe.sources import readers, sinks
from helixframe.sources.number_lists import number_lists


def test_f2_dense_lines(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,)], "r int")
    cells = spark.createDataFrame([(2, 0, 1.5), (0, 3, 2.0), (0, 1, 1e-9), (2, 2, None)], "r int, c int, abundance double")
    out = sinks.dense_lines(rows, cells, 4)
    assert {(r.r, r.c): r.t for r in out.collect()} == {
        (0, 0): "0.0,1.0E-9,0.0,2.0", (1, 0): "0.0,0.0,0.0,0.0", (2, 0): "1.5,0.0,0.0,0.0"}
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain()
    assert "Generate" not in text.getvalue()


def test_f1_long_text_is_written_in_parts_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "_PART_NUMBERS", 40)
    monkeypatch.setattr(sinks, "_PART_LINES", 16)
    cells = [(f"o{r:02}", f"s{c}", float(r * c % 5) + 0.5) for r in range(50) for c in range(9) if (r + c) % 4 == 0]
    t = spark.createDataFrame(cells, "otu_id string, sample_id string, abundance double")
    otus = spark.createDataFrame([(f"o{r:02}",) for r in range(53)], "otu_id string")
    samples = spark.createDataFrame([(f"s{c}",) for c in range(9)], "sample_id string")
    matrix = sinks.biom_matrix(t, otus, samples)
    for dense in (False, True):
        plain, packed = str(tmp_path / f"plain{dense}"), str(tmp_path / f"packed{dense}")
        sinks.write_biom_json(t, otus, samples, plain, dense=dense, matrix=matrix)
        sinks.write_biom_json(t, otus, samples, packed, dense=dense, compression="gzip")
        parts = sorted(p for p in (tmp_path / f"plain{dense}").iterdir() if p.name.startswith("part-"))
        assert len(parts) > 8
        doc = json.loads("".join(p.read_text() for p in parts))
        assert doc["shape"] == [53, 9] and len(doc["data"]) == (53 if dense else len(cells))
        if dense:
            assert all(len(line) == 9 for line in doc["data"])
            assert {(f"o{r:02}", f"s{c}", x) for r, line in enumerate(doc["data"]) for c, x in enumerate(line) if x} == set(cells)
        for path in (plain, packed):
            back, o, s = readers.read_biom_json(spark, path)
            assert sorted(map(tuple, back.collect())) == sorted(cells)
            assert o.count() == 53 and s.count() == 9


def test_f1_reader_makes_no_row_of_a_zero(spark, tmp_path):
    doc = {"matrix_type": "dense", "rows": [{"id": "a"}, {"id": "b"}], "columns": [{"id": str(c)} for c in range(4000)],
           "data": [[0.0] * 3999 + [2.5], [7] + [0] * 3999]}
    (tmp_path / "t.biom").write_text(json.dumps(doc))
    triples, _, _ = readers.read_biom_json(spark, str(tmp_path / "t.biom"))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        triples.explain()
    assert "posexplode" not in text.getvalue()
    assert {tuple(r) for r in triples.collect()} == {("a", "3999", 2.5), ("b", "0", 7.0)}


def lists(records, file=None, block=None):
    n = len(records)
    batch = pa.RecordBatch.from_arrays([pa.array(records), pa.array(file or ["f"] * n), pa.array(block or [0] * n, pa.int64()),
                                        pa.array(range(n), pa.int64())], names=["value", "file", "block", "line"])
    return [r for b in number_lists([batch]) for r in b.to_pylist()]


def test_f1_records_to_lists():
    got = lists(['{"data": [[0,0,5.0', ",[0.0,-1.5E-3, 20 ", "\n ,\n [ 0 ,1e2,0e9", "", '], "x": ["a[1', " ,[0,0,0", "[[1", "a[1", "1,[2"])
    runs = [(r["line"], r["sub"], r["n"], r["least"], r["counts"], r["places"], r["numbers"]) for r in got if r["n"]]
    assert runs == [(0, 1, 1, 3, [1], [2], [5.0]), (1, 1, 2, 3, [2, 1], [1, 2, 1], [-1.5e-3, 20.0, 100.0]),
                    (5, 1, 1, 3, [0], [], [])]
    assert [(r["line"], r["sub"], r["value"]) for r in got if r["value"] is not None] == [
        (0, 0, '{"data": ['), (4, 0, '], "x": ["a[1'), (6, 0, "[[1"), (7, 0, "a[1"), (8, 0, "1,[2")]
    assert lists(["", "\n"]) == [] and lists([""]) == []
    assert [(r["file"], r["block"], r["line"], r["n"]) for r in lists(["[1"] * 5, list("ffggg"), [0, 0, 0, 9, 9])] == [
        ("f", 0, 0, 2), ("g", 0, 2, 1), ("g", 9, 3, 2)]
    with pytest.raises(ValueError):
        lists(["[1,,2"])


def test_f1_lists_of_any_numbers():
    rng = random.Random(5)
    spell = [lambda x: str(x), lambda x: f"{x:.3e}", lambda x: f" {x}", lambda x: "0", lambda x: "-0.00", lambda x: "0.0"]
    rows = [[rng.choice(spell)(rng.choice([0, 7, -12.25, 100, 1e-30])) for _ in range(rng.randint(1, 300))] for _ in range(200)]
    got = lists([",[" + ",".join(r) for r in rows])
    (run,) = got
    at = 0
    for row, n in zip(rows, run["counts"], strict=True):
        want = [(c, float(x)) for c, x in enumerate(row) if float(x)]
        assert list(zip(run["places"][at:at + n], run["numbers"][at:at + n], strict=True)) == want
        at += n
    assert run["least"] == min(map(len, rows)) and at == len(run["numbers"])


def test_f1_dense_line_of_edges(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,)], "r int")
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 3, 4.0), (1, 2, 3.0), (1, 2, 3.0), (1, 1, 2.0)], "r int, c int, abundance double")
    got = {r.r: r.t for r in sinks.dense_lines(rows, cells, 4, "0").collect()}
    assert got == {0: "1.0,0,0,4.0", 1: "0,2.0,3.0,0", 2: "0,0,0,0"}
    assert {r.t for r in sinks.dense_lines(rows, cells.limit(0), 1).collect()} == {"0.0"}
    assert {r.t for r in sinks.dense_lines(rows, cells.limit(0), 0).collect()} == {""}
