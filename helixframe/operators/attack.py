"""Adversarial attacks as table operators (W1-W4, J6, A16, M10, F14 scoring).

State that the reference keeps in driver dictionaries becomes keys:

* W4 (first success over up to ``max_iter`` tries): a failed try leaves the
  sequence unchanged, so tries are independent functions of ``(row_id,
  iteration)`` and run in parallel, point mutations in numpy over Arrow batches
  (``tries``). Tries go in growing rounds; rows that succeeded leave by
  ``left_anti`` join, and each round's (small) result is written to the shared
  checkpoint folder, so later rounds never recompute earlier scoring and a lost
  executor only re-runs its own tasks.
* W1 (sticky first success over snapshots): a window per ``row_id`` whose
  frame runs from the first snapshot to the current one. A row id owns one row
  per snapshot, so no window partition can grow with the data.
* W2 (cascade across mutation rates keyed by text): texts travel as digests; only
  digests that occur more than once are looked at, since a text that occurs once
  keeps its label, and the few changed labels are joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mutation import ATTACKS, mutate, point_mutation_batch
from ..session import materialize
from .frames import keep_correct
from .scoring import MAX_K, attack_logits, kmer_logits, predict
from .tries import attacked_texts, mutated_texts, try_logits, weight_matrix


def score(df: DataFrame, seq: str, key: str, weights: DataFrame, n_classes: int, k: int = 3,
          out: str = "y_hat") -> DataFrame:
    """M8 predictions ``(key, out)`` for the sequences in ``df``."""
    lg = try_logits(df, seq, key, [], [(0, 0.0)], weight_matrix(weights, n_classes, k), k)
    return lg.select(key, predict("logits").alias(out))


def attempts(df: DataFrame, seq: str, row_id: str, iterations: list[int], weights: DataFrame,
             n_classes: int, k: int = 3, rate: float = 0.1, seed: int = 0,
             with_text: bool = True) -> DataFrame:
    """One independent point-mutation try per listed iteration: ``(row_id, iteration, y_atk[, seq])``."""
    its = F.array(*[F.lit(i) for i in iterations])
    lg = attack_logits(df, seq, row_id, its, weights, n_classes, k, rate, seed)
    out = lg.select(row_id, "iteration", predict("logits").alias("y_atk"))
    if with_text:
        texts = df.select(row_id, seq)
        out = out.join(texts, row_id).withColumn(
            seq, point_mutation_batch(seq, F.col(row_id), F.col("iteration"), rate, seed))
    return out


def round_bounds(max_iter: int, schedule: tuple[int, ...] = (1, 4, 10, 35), start: int = 1) -> list[tuple[int, int]]:
    """Iteration ranges of the rounds: sizes from ``schedule`` (the last one repeats) up to ``max_iter``."""
    out, i = [], 0
    while start <= max_iter:
        size = schedule[min(i, len(schedule) - 1)]
        end = min(start + size - 1, max_iter)
        out.append((start, end))
        start, i = end + 1, i + 1
    return out


def first_success(df: DataFrame, seq: str, row_id: str, y: str, weights: DataFrame, n_classes: int,
                  k: int = 3, rate: float = 0.1, max_iter: int = 50,
                  schedule: tuple[int, ...] = (1, 9, 40), seed: int = 0, attack: str = "nucl",
                  require_correct: bool = False, y_orig: str | None = None, known: DataFrame | None = None,
                  start: int = 1, bt_batches: bool = False, prepare: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per row, the first try ``1..max_iter`` whose prediction differs from ``y``.

    Returns ``(row_id, success_iteration, y_atk)`` for the rows that were broken
    (rows never broken are absent: join back with ``left`` to keep them).
    Rounds grow (``schedule``) because most rows break early: the first round
    tries every row once, later rounds try only the rows still standing.
    ``attack`` is ``nucl`` or ``codon`` (scored batch by batch, no text leaves its task) or ``bt``
    (with ``bt_batches`` likewise, for k-mers of up to ``MAX_K`` letters; else texts built per try, then scored). With ``require_correct`` only rows whose
    clean prediction ``y_orig`` is right are attacked. With ``known`` the successes
    of the tries before ``start`` are given (``clean_and_first``). ``prepare`` turns the column ``seq`` into the
    sequences, in each round only for the rows it tries.
    """
    if attack not in ATTACKS:
        raise ValueError(f"unknown attack {attack!r}")
    base = keep_correct(df, y, y_orig) if require_correct else df
    # Every round scans the source again, less the rows found so far: nothing of the corpus is cached or written.
    pending = base.select(row_id, y, seq)
    found = known
    if known is not None:
        pending = pending.join(known.select(row_id), row_id, "left_anti")
    bounds = round_bounds(max_iter, schedule, start)
    matrix = weight_matrix(weights, n_classes, k) if attack != "bt" or bt_batches and k <= MAX_K else None
    for n, (start, end) in enumerate(bounds):
        its = F.sequence(F.lit(start), F.lit(end))
        rows = pending if prepare is None else pending.withColumn(seq, prepare(F.col(seq)))
        if matrix is not None:
            tries = [(i, rate) for i in range(start, end + 1)]
            lg = try_logits(rows, seq, row_id, [y], tries, matrix, k, seed, attack=attack).withColumn(
                "iteration", F.col("try") + F.lit(start))
        else:
            tries = rows.select(row_id, y, F.explode(its).alias("iteration"), seq)
            tries = tries.withColumn(seq, mutate(attack, seq, F.col(row_id), F.col("iteration"), rate, seed))
            lg = kmer_logits(tries, seq, [row_id, "iteration", y], weights, n_classes, k)
        hits = lg.select(row_id, "iteration", predict("logits").alias("y_atk"), y).where(
            F.col("y_atk") != F.col(y))
        hits = hits.groupBy(row_id).agg(
            F.min("iteration").alias("success_iteration"),
            F.min_by("y_atk", "iteration").alias("y_atk"))
        hits = materialize(hits, f"round{n}")  # written table: cuts lineage, survives executor loss
        found = hits if found is None else found.unionByName(hits)
        if n + 1 < len(bounds):
            pending = pending.join(hits.select(row_id), row_id, "left_anti")  # J6: skip finished rows
    return found


def clean_and_first(df: DataFrame, seq: str, row_id: str, y: str, weights: DataFrame, n_classes: int, k: int = 3,
                    rate: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The clean predictions ``(row_id, y, y_orig)`` and the successes of the first try, from one pass over the texts."""
    lg = try_logits(df, seq, row_id, [y], [(0, 0.0), (1, rate)], weight_matrix(weights, n_classes, k), k, seed)
    both = materialize(lg.select(row_id, y, "try", predict("logits").alias("_p")), "clean")
    hits = both.where((F.col("try") == 1) & (F.col("_p") != F.col(y)))
    return (both.where("try = 0").select(row_id, y, F.col("_p").alias("y_orig")),
            hits.select(row_id, F.lit(1).alias("success_iteration"), F.col("_p").alias("y_atk")))


def attack_outcome(df: DataFrame, seq: str, row_id: str, y: str, found: DataFrame,
                   rate: float = 0.1, seed: int = 0, attack: str = "nucl") -> DataFrame:
    """Every row with its final text: the mutated text of its first success, else the original."""
    j = df.select(row_id, y, seq).join(found, row_id, "left")
    j = attacked_texts(j, seq, row_id, [(attack, rate, ())], "_t", seed, iteration="success_iteration")
    final = F.when(F.col("success_iteration").isNull(), F.col(seq)).otherwise(F.col("_t")[0])
    return j.select(row_id, y, "success_iteration", "y_atk", final.alias(seq))


def states(clean: DataFrame, found: DataFrame, row_id: str = "row_id", y: str = "y", y_orig: str = "y_orig",
           intervals: tuple[int, ...] = (10, 20, 30, 40, 50)) -> DataFrame:
    """Prediction state as of each saved iteration: ``(row_id, iteration, y, y_orig, y_atk, success)``.

    ``clean`` has the truth and the clean prediction, ``found`` W4's first successes (over *all* tries): up to its
    first success a row still has its original text, hence its clean prediction; from then on the successful one's.
    """
    j = clean.select(row_id, y, y_orig).join(found.select(row_id, "success_iteration", F.col("y_atk").alias("_ya")),
                                             row_id, "left")
    j = j.select("*", F.explode(F.array(*[F.lit(t) for t in intervals])).alias("iteration"))
    ok = F.coalesce(F.col("success_iteration") <= F.col("iteration"), F.lit(False))
    return j.select(row_id, "iteration", y, y_orig, F.when(ok, F.col("_ya")).otherwise(F.col(y_orig)).alias("y_atk"),
                    ok.alias("success"))


def snapshots(state: DataFrame, found: DataFrame, original: DataFrame, seq: str, row_id: str = "row_id",
              rate: float = 0.1, seed: int = 0, attack: str = "nucl") -> DataFrame:
    """The saved tables: ``(row_id, iteration, rate, y, y_hat, success, seq)``; ``y_hat`` is the state's prediction."""
    # the text of a success is the same at every snapshot: it is built once a row, which the snapshots wait beside
    states = state.groupBy(row_id).agg(F.collect_list(F.struct("iteration", "y", "y_atk", "success")).alias("_s"))
    j = original.select(row_id, seq).join(states, row_id).join(found.select(row_id, "success_iteration"), row_id, "left")
    j = attacked_texts(j, seq, row_id, [(attack, rate, ())], "_t", seed, iteration="success_iteration")
    j = j.select(row_id, seq, "_t", F.explode("_s").alias("_s"))
    mutated = F.when(F.col("_s.success"), F.col("_t")[0])
    return j.select(row_id, "_s.iteration", F.lit(float(rate)).alias("rate"), "_s.y", F.col("_s.y_atk").alias("y_hat"),
                    "_s.success", F.coalesce(mutated, F.col(seq)).alias(seq))


def sticky_success(att: DataFrame, row_id: str = "row_id", iteration: str = "iteration",
                   y: str = "y", y_orig: str = "y_orig", y_atk: str = "y_atk",
                   carry: list[str] | None = None) -> DataFrame:
    """Once a row's attack works (originally right, now wrong), later snapshots keep that row.

    Adds ``pinned_iteration`` (null while no success) and replaces ``y_atk`` and
    the ``carry`` columns by the pinned snapshot's values.
    """
    carry = carry or []
    ok = (F.col(y) == F.col(y_orig)) & (F.col(y) != F.col(y_atk))
    pin = F.when(ok, F.struct(F.col(iteration).alias("it"), F.col(y_atk).alias("ya"),
                              *[F.col(c).alias(f"c_{c}") for c in carry]))
    w = Window.partitionBy(row_id).orderBy(iteration).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = att.withColumn("_pin", F.first(pin, ignorenulls=True).over(w))
    out = p.select(*[c for c in att.columns if c not in carry and c != y_atk],
                   F.coalesce(F.col("_pin.ya"), F.col(y_atk)).alias(y_atk),
                   *[F.when(F.col("_pin").isNotNull(), F.col(f"_pin.c_{c}")).otherwise(F.col(c)).alias(c)
                     for c in carry],
                   F.col("_pin.it").alias("pinned_iteration"))
    return out


def rate_sweep_steps(df: DataFrame, seq: str, row_id: str, rates: tuple[float, ...], weights: DataFrame,
                     n_classes: int, k: int = 3, seed: int = 0, iteration: int = 1) -> DataFrame:
    """F14 + scoring: one attacked copy per rate, ``(row_id, step, rate, y_atk, digest)``.

    Each sequence is drawn once, mutated once per rate, scored and digested in one pass; the attacked text leaves its
    task only as a 128-bit digest, so no copy of the corpus is written or shuffled. ``sweep_texts`` gives the texts.
    """
    tries = [(iteration, r) for r in rates]
    lg = try_logits(df, seq, row_id, [], tries, weight_matrix(weights, n_classes, k), k, seed, digest=True)
    rate = F.element_at(F.array(*[F.lit(float(r)) for r in rates]), F.col("try") + 1)
    return lg.select(row_id, F.col("try").alias("step"), rate.alias("rate"), predict("logits").alias("y_atk"), "digest")


def sweep_texts(seq: str, row_id: str, rates: tuple[float, ...], seed: int = 0, iteration: int = 1) -> Column:
    """The attacked texts of all steps of the sweep, in order (``tries.attacked_texts`` for whole tables)."""
    return mutated_texts(F.col(seq), F.col(row_id), iteration, list(rates), seed)


def cascade(steps: DataFrame, text: str = "seq", row_id: str = "row_id", step: str = "step",
            label: str = "y", y_orig: str = "y_orig", y_atk: str = "y_atk") -> DataFrame:
    """Cascade successes across attack steps (rates), keyed by text.

    Step 0 records ``text -> label`` for rows originally right whose attacked
    prediction is wrong (a repeated text: the last row wins). Later steps
    record, for a text not yet recorded, the first row (in ``(step, row_id)``
    order) whose prediction differs from its label. A row of a later step whose
    text is already recorded at that point takes the recorded label.

    A text that occurs once keeps its label, so one aggregate counts the texts
    and only rows of repeated ones take part; the changed labels are joined back
    by ``(row_id, step)``. ``steps`` is read several times: pass a materialised
    table, not a plan that scores sequences.
    """
    repeated = steps.groupBy(text).agg(F.count("*").alias("_n")).where("_n > 1").select(text)
    some = materialize(steps.join(repeated, text, "left_semi"), "repeated")
    s0 = some.where((F.col(step) == 0) & (F.col(label) == F.col(y_orig)) & (F.col(label) != F.col(y_atk)))
    first = s0.groupBy(text).agg(F.max_by(label, row_id).alias("_lab0"))
    later = some.where((F.col(step) > 0) & (F.col(label) != F.col(y_atk)))
    later = later.groupBy(text).agg(F.min_by(F.struct(F.col(step).alias("s"), F.col(row_id).alias("r"),
                                                      F.col(label).alias("l")),
                                             F.struct(F.col(step), F.col(row_id))).alias("_e"))
    j = some.join(first.join(later, text, "full"), text)
    earlier = F.struct(F.col("_e.s"), F.col("_e.r")) < F.struct(F.col(step), F.col(row_id))
    new_label = F.when(F.col("_lab0").isNotNull(), F.col("_lab0")).when(earlier, F.col("_e.l"))
    changed = j.where(F.col(step) > 0).select(row_id, step, new_label.alias("_new")).where(
        F.col("_new").isNotNull())
    out = steps.join(materialize(changed, "changed"), [row_id, step], "left")
    return out.select(*[F.coalesce("_new", label).alias(label) if c == label else F.col(c) for c in steps.columns])


def success_rate_by(df: DataFrame, group: list[str], y: str = "y", y_orig: str = "y_orig",
                    y_atk: str = "y_atk") -> DataFrame:
    """A16 per group."""
    from .metrics import attack_success_rate

    return attack_success_rate(df, y, y_orig, y_atk, group)


def before_after(df: DataFrame, clean: DataFrame, group: str = "iteration", y: str = "y", y_orig: str = "y_orig",
                 y_atk: str = "y_atk") -> DataFrame:
    """Metrics on clean and attacked predictions per snapshot (or rate), plus A16.

    ``clean`` has the truth and the clean prediction of every row; it does not
    change between snapshots, so it is evaluated once and joined to each.
    """
    from .metrics import attack_success_rate, summary

    atk = summary(df, y, y_atk, group=[group]).withColumn("variant", F.lit("attacked"))
    clean = summary(clean, y, y_orig)
    groups = df.select(group).distinct()
    clean = groups.join(F.broadcast(clean), how="cross").withColumn("variant", F.lit("clean"))
    rate = attack_success_rate(df, y, y_orig, y_atk, [group])
    return atk.unionByName(clean.select(*atk.columns)).join(rate, group, "left")
