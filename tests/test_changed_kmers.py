"""tries count only the k-mers over replaced letters anew; a round's rows are turned into bases after the found ones leave."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.operators import attack as A
from helixframe.operators import tries as R
from helixframe.operators.scoring import rule_weights
from helixframe.session import materialize
from helixframe.sources import standins as S


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_f15_changed_kmers_against_a_loop(k):
    rng, draws = random.Random(k), np.random.default_rng(k)
    weights = draws.integers(-500, 500, (4 ** k + 1, 3))
    weights[-1] = 0
    for letters in ("ACGT", "ACGTN\0é"):
        texts = ["".join(rng.choices(letters, k=n)) for n in (0, 1, 2, 3, 700, 0, 4000, 5)]
        chars, offsets = R.characters(pa.array(texts))
        clean = R.Clean(chars, offsets, weights, k)
        for rate in (0.0, 0.1, 1.0):
            fire = np.flatnonzero(draws.random(len(chars)) < rate)
            new = chars.copy()
            new[fire] = np.array([ord(b) for b in "ACTG"], dtype=np.uint32)[draws.integers(0, 4, len(fire))]
            want = np.zeros((len(texts), 3), dtype=np.int64)
            for i, t in enumerate(R.split_text(new, offsets)):
                for p in range(len(t) - k + 1):
                    if not set(t[p:p + k]) - set("ACGT"):
                        want[i] += weights[sum("ACGT".index(x) * 4 ** (k - 1 - j) for j, x in enumerate(t[p:p + k]))]
            assert (clean.sums_of(new) == want).all()


@pytest.mark.parametrize("attack", ["codon", "nucl"])
def test_f15_a_try_does_not_look_all_kmers_up_again(monkeypatch, attack):
    seen = []
    numbers = R._numbers
    monkeypatch.setattr(R, "_numbers", lambda c, *a: seen.append(len(c)) or numbers(c, *a))
    weights = np.arange(65 * 4, dtype=np.int64).reshape(65, 4)
    R._tries(pa.array([1]), pa.array([0]), pa.array(["ACG" * 100]), [(i, 0.1) for i in range(1, 9)], weights, 3, 0, R.PIECE,
             False, attack)
    assert seen == [300]  # once for the clean text, whatever the number of tries


def test_f15_only_the_rows_of_a_round_are_prepared(spark):
    """Same successes; the rows found leave before the rest is turned into bases."""
    df = materialize(spark.createDataFrame([(i, i % 4, "Hello, world! " * (1 + i % 9) + "x" * (i % 3)) for i in range(60)],
                                           "row_id bigint, y int, dna string"))
    model = {"weights": rule_weights(spark, 4, 3), "n_classes": 4, "k": 3}
    args = dict(max_iter=6, schedule=(1, 5), attack="codon")
    ready = df.withColumn("dna", S.text_to_dna(F.col("dna")))
    want = sorted(map(tuple, A.first_success(ready, "dna", "row_id", "y", **model, **args).collect()))
    got = A.first_success(df, "dna", "row_id", "y", **model, **args, prepare=S.text_to_dna)
    assert sorted(map(tuple, got.collect())) == want and want
