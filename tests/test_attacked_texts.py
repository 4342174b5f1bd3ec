"""Attacked texts built run by run (F10-F14, W2-W4): equal to the column functions, and bounded in what a task holds."""

import contextlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.functions import mutation as M
from helixframe.operators import attack as A
from helixframe.operators import tries as R
from helixframe.operators.scoring import rule_weights
from helixframe.plans import q_attack, q_sequence
from helixframe.session import materialize

SF001 = "/root/testdata/sf0.001"

ROWS = [(1, "ACGTACGTTTAGGAC"), (2, "ACGTNNNUACG"), (3, ""), (4, None), (None, "ACGTAC"), (2, "GGGCATéCATTA"), (5, "AC"),
        (7, "ACGTTGCA" * 400), (-3, "TTAGGCA")]


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.mark.parametrize("attack", M.ATTACKS)
@pytest.mark.parametrize("n", [1, 3])
def test_equal_to_the_columns(spark, attack, n, monkeypatch):
    monkeypatch.setattr(R, "RUN", 40)
    df = spark.createDataFrame(ROWS, "row_id bigint, dna string").repartition(1)
    tries = [(attack, 0.4, range(1, n + 1)), ("nucl", 0.2, (2,))]
    got = R.attacked_texts(df, "dna", "row_id", tries).select(
        F.col("t")[0].alias("got"), F.col("t")[1].alias("other"),
        M.repeated_attack(attack, "dna", F.col("row_id"), n, 0.4).alias("want"),
        M.mutate("nucl", "dna", F.col("row_id"), 2, 0.2).alias("want_other")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.got, r.other) == (r.want, r.want_other)


@pytest.mark.parametrize("name", ["f12_repeated_attack_codons", "f12_repeated_attack", "f13_attack_dispatch"])
def test_f12_f13_texts_are_built_in_batches(spark, name):
    """One pass over the texts, without an interpreted function per character."""
    text = plan(getattr(q_sequence, name)(spark, SF001))
    assert text.count("MapInArrow") == 1 and "lambda" not in text and text.count("FileScan") == 1


def test_f8_one_text_a_row_for_all_snapshots(spark, monkeypatch):
    """Rows go through the text builder once, not once a snapshot."""
    seen = []
    build = A.attacked_texts
    monkeypatch.setattr(A, "attacked_texts", lambda df, *a, **k: seen.append(df) or build(df, *a, **k))
    out = q_attack.w03_snapshots(spark, SF001)
    n = spark.read.parquet(f"{SF001}/documents.parquet").count()
    assert [d.count() for d in seen] == [n] and out.count() == n * len(q_attack.SNAPSHOTS)


def test_f9_a_task_hands_texts_on_run_by_run(monkeypatch):
    monkeypatch.setattr(R, "RUN", 64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(32)), pa.array(["ACGTACGT"] * 32)], names=["row_id", "dna"])

    class Rows:
        schema = type("S", (), {"fields": []})

        def mapInArrow(self, build, schema):
            return list(build(iter([batch])))

    made = R.attacked_texts(Rows(), "dna", "row_id", [("nucl", r, (1,)) for r in (0.1, 0.5)])
    assert [b.num_rows for b in made] == [8] * 4
    assert all(len(t) == 8 for b in made for ts in b.column("t").to_pylist() for t in ts)


def test_f14_back_translations_are_scored_without_texts(spark, monkeypatch):
    """Same successes as with built texts; no row of one try's text or of one k-mer."""
    df = materialize(spark.createDataFrame([(i, i % 4, "ACGTNACGTTTAGGACCA" * (1 + i % 7) + "A" * (i % 3)) for i in range(60)],
                                           "row_id bigint, y int, dna string"))
    model = {"weights": rule_weights(spark, 4, 3), "n_classes": 4, "k": 3}
    args = dict(max_iter=6, schedule=(1, 5), attack="bt", bt_batches=True)
    scored = sorted(map(tuple, A.first_success(df, "dna", "row_id", "y", **model, **args).collect()))
    monkeypatch.setattr(A, "MAX_K", 0)  # the path of longer k-mers
    built = sorted(map(tuple, A.first_success(df, "dna", "row_id", "y", **model, **args).collect()))
    assert scored == built and scored
    monkeypatch.undo()
    monkeypatch.setattr(A, "kmer_logits", None)
    assert A.first_success(df, "dna", "row_id", "y", **model, **args).count() == len(scored)


def test_f15_one_draw_a_codon(monkeypatch):
    drawn = []
    draw = R.draw_of_sum
    monkeypatch.setattr(R, "draw_of_sum", lambda x: drawn.append(len(x)) or draw(x))
    import numpy as np

    weights = np.arange(65 * 4, dtype=np.int64).reshape(65, 4)
    R._tries(pa.array([1]), pa.array([0]), pa.array(["ACG" * 100]), [(1, 0.1), (2, 0.1)], weights, 3, 0, R.PIECE, False, "codon")
    assert drawn == [100, 100]
