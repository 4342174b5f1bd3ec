"""Readers, writers and the streaming scorer on small files in a fresh temporary folder."""

import json
import os
import subprocess
import sys
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from helixframe.operators.scoring import rule_weights
from helixframe.sources import readers as R
from helixframe.sources import sinks as W


def tmp():
    return tempfile.mkdtemp(prefix="helix-test-")


def test_s1_sequences_csv(spark):
    d = tmp()
    for split, rows in {"train": [("ACGT", "0", "x"), ("NA", "1", "y")], "test": [("GG", "1", "y")]}.items():
        with open(os.path.join(d, f"{split}.csv"), "w") as f:
            f.write("DNA Sequence,label,Drug Class\n" + "\n".join(",".join(r) for r in rows) + "\n")
    df = R.read_sequences(spark, {s: os.path.join(d, f"{s}.csv") for s in ("train", "test")},
                          ["DNA Sequence", "label", "Drug Class"])
    rows = sorted(df.collect(), key=lambda r: r["row_id"])
    assert [r["split"] for r in rows] == ["train", "train", "test"]
    assert rows[1]["DNA Sequence"] is None and R.target_column("dc") == "Drug Class"


def test_s2_metadata_tsv(spark):
    d = tmp()
    p = os.path.join(d, "meta.tsv")
    with open(p, "w") as f:
        f.write("co_occur\tph\tenv\nnot applicable\t7.1\tsoil\nNA\tNA\t\n0.3\t6\tAir\n")
    df = R.read_metadata(spark, p, numeric=["ph"])
    rows = df.collect()
    assert rows[0]["co_occur"] == "not applicable" and rows[1]["co_occur"] is None
    assert rows[1]["ph"] is None and rows[2]["ph"] == 6.0


def test_s3_wide_embeddings_and_s6_roundtrip(spark):
    d = tmp()
    p = os.path.join(d, "emb.csv")
    with open(p, "w") as f:
        f.write("sample_name,abundance,emb_0,emb_1,emb_2\nS1,2,0.5,1,2\nS2,0,3,4,5\n")
    df = R.read_wide_embeddings(spark, p, dim=3)
    assert df.first()["emb"] == [0.5, 1.0, 2.0]
    out = os.path.join(d, "out")
    W.write_table(df, out, fmt="csv", vec="emb", dim=3)
    back = spark.read.option("header", True).csv(out)
    assert set(back.columns) == {"sample_name", "abundance", "emb_0", "emb_1", "emb_2"}


def test_s4_biom_json(spark):
    d = tmp()
    p = os.path.join(d, "t.biom")
    doc = {"rows": [{"id": "o1"}, {"id": "o2"}, {"id": "o3"}], "columns": [{"id": "s1"}, {"id": "s2"}],
           "data": [[0, 0, 5.0], [2, 1, 1.0]]}
    with open(p, "w") as f:
        json.dump(doc, f)
    triples, otus, samples = R.read_biom_json(spark, p)
    assert sorted(map(tuple, triples.collect())) == [("o1", "s1", 5.0), ("o3", "s2", 1.0)]
    assert otus.count() == 3 and samples.count() == 2


BIOM_ROWS = ["o1", "o[2", 'q"uote', "o,4", "é5"]


@pytest.mark.parametrize("dense", [False, True])
@pytest.mark.parametrize("data_first", [False, True])
@pytest.mark.parametrize("indent", [None, 1])
def test_s4_forms_orders_and_metadata(spark, dense, data_first, indent):
    cells = {(0, 0): 5.0, (2, 1): 1.5, (4, 2): -2e-3, (3, 0): 7.0}
    rows = [{"id": r, "metadata": {"taxonomy": ["k__[B]", "p]__", "x"], "n": [1, 2, 3]}} for r in BIOM_ROWS]
    columns = [{"id": f"s{c}", "metadata": None} for c in range(3)]
    data = ([[cells.get((r, c), 0.0) for c in range(3)] for r in range(5)] if dense
            else [[r, c, v] for (r, c), v in cells.items()] + [[1, 1, 0]])
    head = {"id": "table", "matrix_type": "dense" if dense else "sparse", "shape": [5, 3]}
    parts = [("data", data), ("rows", rows), ("columns", columns)]
    doc = head | dict(parts if data_first else parts[::-1]) | {"comment": "[1,2,3] ]"}
    p = os.path.join(tmp(), "t.biom")
    with open(p, "w") as f:
        json.dump(doc, f, indent=indent)
    triples, otus, samples = R.read_biom_json(spark, p)
    assert {tuple(r) for r in triples.collect()} == {(BIOM_ROWS[r], f"s{c}", v) for (r, c), v in cells.items()}
    assert sorted(r[0] for r in otus.collect()) == sorted(BIOM_ROWS) and samples.count() == 3


def test_s4_one_file_is_read_by_many_tasks_and_round_trips(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = [(f"o{r}", f"s{c}", float(r * c % 7) + 0.25) for r in range(300) for c in range(9) if (r + c) % 3]
        t = spark.createDataFrame(rows, "otu_id string, sample_id string, abundance double")
        otus = spark.range(310).select(F.concat(F.lit("o"), "id").alias("otu_id"))
        samples = spark.range(9).select(F.concat(F.lit("s"), "id").alias("sample_id"))
        for dense in (False, True):
            path = os.path.join(tmp(), "b")
            W.write_biom_json(t, otus, samples, path, dense=dense)
            assert R._biom_records(spark, path).select(F.spark_partition_id()).distinct().count() > 3
            back, o, s = R.read_biom_json(spark, path)
            assert sorted(map(tuple, back.collect())) == sorted(rows)
            assert o.count() == 310 and s.count() == 9
            part = next(x for x in os.listdir(path) if x.startswith("part-"))
            with open(os.path.join(path, part)) as f:
                assert json.load(f)["shape"] == [310, 9]  # a valid JSON text
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_s4_refuses_what_it_cannot_read(spark):
    for doc in ({"rows": [], "columns": []}, {"matrix_type": "other", "rows": [], "columns": [], "data": []},
                {"rows": [{"id": "a]b"}], "columns": [{"id": "s"}], "data": []},
                {"shape": [2, 1], "rows": [{"id": "a"}], "columns": [{"id": "s"}], "data": []}):
        p = os.path.join(tmp(), "t.biom")
        with open(p, "w") as f:
            json.dump(doc, f)
        with pytest.raises(ValueError):
            R.read_biom_json(spark, p)
    p = os.path.join(tmp(), "t.biom")
    with open(p, "w") as f:
        json.dump({"rows": [{"id": "a"}], "columns": [{"id": "s"}], "data": []}, f)
    triples, otus, samples = R.read_biom_json(spark, p)
    assert triples.count() == 0 and otus.count() == samples.count() == 1


def test_k6_batches_and_padding(spark):
    from helixframe.operators.batching import pad_batches

    df = spark.createDataFrame([(0, [5]), (31, [6, 7, 8]), (32, [9, 9]), (70, [])], "row_id bigint, ids array<int>")
    got = {r["row_id"]: (r["batch"], r["longest"], r["ids"], r["attention_mask"]) for r in pad_batches(df).collect()}
    assert got == {0: (0, 3, [5, 0, 0], [1, 0, 0]), 31: (0, 3, [6, 7, 8], [1, 1, 1]), 32: (1, 2, [9, 9], [1, 1]),
                   70: (2, 0, [], [])}


def test_s7_snapshots_partitioned(spark):
    d = tmp()
    df = spark.createDataFrame([(1, 10, 0.1, "A"), (2, 20, 0.1, "C")], "row_id bigint, iteration int, rate double, seq string")
    W.write_snapshots(df, os.path.join(d, "snap"))
    back = spark.read.parquet(os.path.join(d, "snap")).where(F.col("iteration") == 20)
    assert [r["row_id"] for r in back.collect()] == [2]


def test_streaming_scorer(spark):
    from helixframe.streaming.scoring import score_stream

    d = tmp()
    src = os.path.join(d, "in")
    df = spark.createDataFrame([(1, "ACGTACGT"), (2, "GG")], "row_id bigint, dna string")
    df.write.parquet(src)
    q = score_stream(spark, src, df.schema, rule_weights(spark, 4, 3), 4, os.path.join(d, "out"),
                     os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(d, "out"))
    assert sorted(r["row_id"] for r in out.collect()) == [1, 2]


def test_s1_reordered_header_extra_columns_and_unique_ids(spark):
    d = tmp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("label,DNA Sequence,note\n1,ACGT,x\n0,GG,NA\n")
    os.mkdir(os.path.join(d, "b"))
    rows = [(str(i), "ACGT") for i in range(400)]
    spark.createDataFrame(rows, ["label", "DNA Sequence"]).repartition(200).write.option("header", True).csv(
        os.path.join(d, "b"), mode="overwrite")
    df = R.read_sequences(spark, {"train": os.path.join(d, "a.csv"), "test": os.path.join(d, "b")},
                          ["DNA Sequence", "label"])
    got = df.collect()
    assert {r["DNA Sequence"] for r in got} == {"ACGT", "GG"} and len({r["row_id"] for r in got}) == 402
    import pytest

    with pytest.raises(ValueError, match="missing columns"):
        R.read_sequences(spark, {"train": os.path.join(d, "a.csv")}, ["Gene Family"])


def test_s3_missing_cells_and_extra_columns(spark):
    d = tmp()
    p = os.path.join(d, "emb.csv")
    with open(p, "w") as f:
        f.write("idx,emb_1,sample_name,abundance,emb_0\n0,2.5,S1,NA,1\n1,NA,S2,3,4\n")
    rows = R.read_wide_embeddings(spark, p, dim=2).collect()
    assert [(r.sample_name, r.abundance, r.emb) for r in rows] == [("S1", None, [1.0, 2.5]), ("S2", 3.0, [4.0, None])]


def test_s6_csv_needs_a_width(spark):
    import pytest

    df = spark.createDataFrame([("S1", [1.0])], "sample_name string, emb array<double>")
    with pytest.raises(ValueError, match="width"):
        W.write_table(df, os.path.join(tmp(), "x"), fmt="csv", vec="emb")


def test_intermediates_go_when_the_application_ends(tmp_path):
    code = f"""
import glob
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "{tmp_path}").getOrCreate())
from helixframe.session import materialize
assert materialize(spark.range(5)).count() == 5
assert glob.glob("{tmp_path}/**/*.parquet", recursive=True)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)), timeout=300)
    for _ in range(100):  # the JVM ends a moment after Python
        if not list(tmp_path.rglob("*.parquet")):
            break
        time.sleep(0.2)
    assert not list(tmp_path.rglob("helix-*")) and not list(tmp_path.rglob("*.parquet"))
