"""K1 with bounded groups; M3-M6, M11 training rows: counted once, written, dealt out by key."""

import contextlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.operators import tokens as T
from helixframe.plans import ml, q_ml

SF001 = "/root/testdata/sf0.001"


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.mark.parametrize("k", [1, 3, 16])
def test_f13_counts_without_a_table_of_groups(spark, k):
    rows = [(1, "ACGTACGTTTNACGTACGTACGTACG"), (2, "AC"), (1, "ACGTACGTTTGACGTACGTACGTACG"), (None, "ACGNNN" * 9),
            (None, "ACGNNN" * 5), (3, ""), (4, None), (5, "ACGT" * 50)]
    df = spark.createDataFrame(rows, "row_id bigint, dna string").repartition(3)
    want = Counter((i, s[p:p + k]) for i, s in rows if s for p in range(len(s) - k + 1))
    counts = T.kmer_counts(df, "dna", "row_id", k)
    got = [((r.row_id, r.kmer), r.n) for r in counts.collect()]
    assert len(got) == len(want) and dict(got) == dict(want)
    assert "Aggregate" not in plan(counts)


def test_f5_kmer_counts_by_number(spark, monkeypatch):
    monkeypatch.setattr(ml, "RUN", 8)
    texts = ["ACGTACG", "", None, "NNACGTA", "AC", "TTT", "ACGTNTTT"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, dna string").repartition(1)
    for r in df.select("dna", ml.kmer_counts(F.col("dna"), 3).alias("c")).collect():
        t = r.dna or ""
        want = Counter()
        for p in range(len(t) - 2):
            w = t[p:p + 3]
            want[64 if set(w) - set("ACGT") else sum("ACGT".index(x) * 4 ** (2 - j) for j, x in enumerate(w))] += 1
        assert len(r.c) == 65 and {i: int(v) for i, v in enumerate(r.c) if v} == dict(want)


def test_f7_training_and_scoring_read_written_counts(spark):
    """No pass of the fit or of the scorings goes back to the texts."""
    text = plan(q_ml._seq_training(spark, SF001))
    assert "documents" not in text and "regexp" not in text and "dna" not in text


@pytest.mark.parametrize(("kind", "target", "maker"), [("forest", "presence", "random_forest"),
                                                       ("boosting", "threshold", "gradient_boosting")])
def test_f11_f12_training_rows_are_dealt_out(spark, monkeypatch, kind, target, maker):
    class Seen(Exception):
        pass

    class Model:
        def fit(self, df):
            raise Seen(df.rdd.getNumPartitions())

    monkeypatch.setattr(ml, maker, lambda features: Model())
    with pytest.raises(Seen) as seen:
        q_ml._predictions(spark, SF001, target, kind)
    assert seen.value.args[0] >= int(spark.conf.get("spark.sql.shuffle.partitions"))
