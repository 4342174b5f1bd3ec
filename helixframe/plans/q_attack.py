"""Scoring and attack queries over ``seqs``: M8, J3-J6, J8, W1-W4, A16, M10.

The victim model is the md5-weighted 3-mer scorer (M8) over the four
document languages; labels are the train-split first-appearance ids (L1).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import threshold
from ..operators import attack as A
from ..operators import frames as FR
from ..operators import labels as L
from ..operators.scoring import predict, rule_weights
from ..operators.tries import attacked_texts, try_logits, weight_matrix
from ..session import materialize, shared_path
from ..sources import standins as S
from ..sources.sinks import write_snapshots
from .q_labels import train_dictionary
from .registry import register
from .sqlgen import dbl, draws_nested_sql, point_mutation_sql, r6, rule_weights_sql
from .views import with_views

K = 3
RATE = 0.1
SEED = 0
N_CLASSES = 4          # label columns of the oracle texts; the Spark side counts the dictionary
# Saved iterations, number of tries, mutation rates of the sweep.
SNAPSHOTS = (10, 20, 30, 40, 50)
MAX_ITER = 50
SWEEP = (0.1, 0.2, 0.3, 0.4, 0.5)
# Tries of the rounds: tries scored in batches cost little beside a round's scan, built texts cost more.
ROUNDS = {"nucl": (1, 9, 40), "codon": (1, 9, 40), "bt": (1, 4, 10, 35)}


def dictionary(spark, sf_dir):
    """The label dictionary, written once a query: a handful of rows whose size the planner knows."""
    return materialize(train_dictionary(spark, sf_dir), "dictionary")


def labelled_seqs(spark, sf_dir, d=None, raw: bool = False):
    """``(row_id, dna, y, split)`` with the strict label encoding (J1); with ``raw`` the texts as ``dna``."""
    s = S.seqs(spark, sf_dir, raw=raw)
    return L.encode_strict(s, dictionary(spark, sf_dir) if d is None else d, "label_name").drop("label_name")


def scorer(spark, d) -> dict:
    """Weights of the victim model for the labels of the dictionary."""
    n = d.count()
    return {"weights": rule_weights(spark, n, K, SEED), "n_classes": n, "k": K}


def victim(spark, sf_dir):
    """Labelled sequences and the victim model."""
    d = dictionary(spark, sf_dir)
    return labelled_seqs(spark, sf_dir, d), scorer(spark, d)


def clean_scores(s, model):
    """``(row_id, y, y_orig)``: truth and clean prediction, written once; the texts stay where they are."""
    matrix = weight_matrix(**model)
    lg = try_logits(s, "dna", "row_id", ["y"], [(0, 0.0)], matrix, model["k"])
    return materialize(lg.select("row_id", "y", predict("logits").alias("y_orig")), "clean")


def attacked(spark, sf_dir):
    """The attack over all tries: sequences, clean scores, first successes, and the state at each snapshot."""
    d = dictionary(spark, sf_dir)
    s, model = labelled_seqs(spark, sf_dir, d), scorer(spark, d)
    clean, first = A.clean_and_first(s, "dna", "row_id", "y", **model, rate=RATE, seed=SEED)
    found = A.first_success(labelled_seqs(spark, sf_dir, d, raw=True), "dna", "row_id", "y", **model, rate=RATE,
                            max_iter=MAX_ITER, seed=SEED, schedule=ROUNDS["nucl"][1:], known=first, start=2,
                            prepare=S.text_to_dna)
    return s, clean, found, A.states(clean, found, intervals=SNAPSHOTS)


# ---- DuckDB text ---------------------------------------------------------------------------

def _codes_sql(src: str, keep: list[str], mutate: bool, it: str = "it", rate: float = RATE) -> str:
    """k-mer index rows over ``src`` (which has ``row_id, dna, p`` and ``it`` when mutating)."""
    if not mutate:
        cs = [f"codes[p + {j}] AS c{j}" for j in range(K)]
        inner = f"SELECT {', '.join(keep)}, {', '.join(cs)} FROM {src}"
    else:
        d = draws_nested_sql(src, keep + ["codes", "p"], "row_id", it, {str(j): f"p + {j}" for j in range(K)}, SEED)
        thr = threshold(rate)
        cs = [f"CASE WHEN d_{j} < {thr} THEN [0, 3, 1, 2][CAST((d_{j} // 1000) % 4 + 1 AS INTEGER)] "
              f"ELSE codes[p + {j}] END AS c{j}" for j in range(K)]
        inner = f"SELECT {', '.join(keep)}, {', '.join(cs)} FROM ({d})"
    valid = " AND ".join(f"c{j} >= 0" for j in range(K))
    idx = " + ".join(f"c{j} * {4 ** (K - 1 - j)}" for j in range(K))
    return f"SELECT {', '.join(keep)}, CASE WHEN {valid} THEN {idx} END AS idx FROM ({inner})"


def _logit_cols(prefix: str = "") -> str:
    return ", ".join(f"CAST(coalesce(sum({prefix}w{c}), 0) AS BIGINT) AS l{c}" for c in range(N_CLASSES))


def _argmax(prefix: str = "") -> str:
    ls = ", ".join(f"{prefix}l{c}" for c in range(N_CLASSES))
    return f"CAST(list_position([{ls}], greatest({ls})) - 1 AS INTEGER)"


BASE_CTES = f"""dict AS (SELECT label_name, CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS INTEGER) AS id
          FROM seqs WHERE split = 'train' GROUP BY label_name),
base AS (SELECT s.row_id, s.dna, d.id AS y, s.split FROM seqs s JOIN dict d ON s.label_name = d.label_name),
w AS ({rule_weights_sql(N_CLASSES, K, SEED)}),
cd AS (SELECT row_id, list_transform(string_split(dna, ''), lambda ch: instr('ACGT', ch) - 1) AS codes FROM base),
kp AS (SELECT row_id, codes, unnest(range(1, len(codes) - {K - 2})) AS p FROM cd),
ki AS ({_codes_sql('kp', ['row_id'], False)}),
lg AS (SELECT b.row_id, {_logit_cols()} FROM base b LEFT JOIN ki ON b.row_id = ki.row_id
       LEFT JOIN w ON ki.idx = w.idx GROUP BY b.row_id),
orig AS (SELECT b.row_id, b.dna, b.y, b.split, {_argmax('lg.')} AS y_orig FROM base b JOIN lg USING (row_id))"""


def _attack_ctes(iters_sql: str, rate: float = RATE, name: str = "atk", rows: str | None = None) -> str:
    """``{name}(row_id, it, y_atk)`` for the iterations listed by ``iters_sql`` (a one-column query),
    over all rows or only the row ids returned by ``rows``."""
    only = f" WHERE kp.row_id IN ({rows})" if rows else ""
    only_b = f" WHERE b.row_id IN ({rows})" if rows else ""
    return f"""{name}_it AS ({iters_sql}),
{name}_kp AS (SELECT kp.row_id, kp.codes, kp.p, t.it FROM kp, {name}_it t{only}),
{name}_ki AS ({_codes_sql(name + '_kp', ['row_id', 'it'], True, 'it', rate)}),
{name}_lg AS (SELECT b.row_id, t.it, {_logit_cols()}
   FROM (SELECT * FROM base b{only_b}) b CROSS JOIN {name}_it t
   LEFT JOIN {name}_ki ki ON b.row_id = ki.row_id AND t.it = ki.it
   LEFT JOIN w ON ki.idx = w.idx GROUP BY b.row_id, t.it),
{name} AS (SELECT row_id, it, {_argmax()} AS y_atk FROM {name}_lg)"""


def _q(body: str, *extra: str) -> str:
    ctes = ",\n".join((BASE_CTES,) + extra)
    return with_views("seqs", f"WITH {ctes}\n{body}")


def _snap_iters() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({t})" for t in SNAPSHOTS) + ") v(it)"


# ---- queries -------------------------------------------------------------------------------

@register("m08_kmer_score", _q(f"SELECT o.row_id, o.y, o.y_orig AS y_hat, "
                                 f"{', '.join(f'lg.l{c}' for c in range(N_CLASSES))} "
                                 "FROM orig o JOIN lg USING (row_id)"))
def m08_kmer_score(spark, sf_dir):
    s, model = victim(spark, sf_dir)
    lg = try_logits(s, "dna", "row_id", ["y"], [(0, 0.0)], weight_matrix(**model), model["k"])
    return lg.select("row_id", "y", predict("logits").alias("y_hat"),
                     *[F.col("logits")[c].alias(f"l{c}") for c in range(model["n_classes"])])


@register("j03_decode_labels", _q("""SELECT o.row_id, a.label_name AS y_name, b.label_name AS y_hat_name
FROM orig o LEFT JOIN dict a ON o.y = a.id LEFT JOIN dict b ON o.y_orig = b.id"""))
def j03_decode_labels(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    p = clean_scores(labelled_seqs(spark, sf_dir, d), scorer(spark, d))
    d = L.decode(p.select("row_id", "y", F.col("y_orig").alias("y_hat")), d, "label_name")
    return d.select("row_id", "y_name", "y_hat_name")


# ---- the state at the snapshots -------------------------------------------------------------

# The oracle tries iteration 1 on every row and iterations 2..50 only on rows
# still standing: the first success is the same, the work ~10x smaller.
W04_CTES = (_attack_ctes("SELECT 1 AS it", name="first"),
            """standing AS (SELECT f.row_id FROM first f JOIN base b ON f.row_id = b.row_id WHERE f.y_atk = b.y)""",
            _attack_ctes(f"SELECT CAST(unnest(range(2, {MAX_ITER} + 1)) AS INTEGER) AS it", name="rest",
                         rows="SELECT row_id FROM standing"),
            """atk AS (SELECT * FROM first UNION ALL SELECT * FROM rest)""",
            """hits AS (SELECT a.row_id, min(a.it) AS success_iteration, arg_min(a.y_atk, a.it) AS y_atk
        FROM atk a JOIN base b ON a.row_id = b.row_id WHERE a.y_atk <> b.y GROUP BY a.row_id)""")
SNAP_CTES = (*W04_CTES, f"""snap AS (SELECT o.row_id, CAST(t.it AS INTEGER) AS iteration, o.y, o.y_orig,
          coalesce(h.success_iteration <= t.it, false) AS success,
          CASE WHEN h.success_iteration <= t.it THEN h.y_atk ELSE o.y_orig END AS y_atk
        FROM orig o CROSS JOIN ({_snap_iters()}) t LEFT JOIN hits h ON o.row_id = h.row_id)""")


@register("j05_align_predictions", _q("SELECT row_id, y, y_orig, y_atk FROM snap WHERE iteration = 10", *SNAP_CTES))
def j05_align_predictions(spark, sf_dir):
    _, clean, _, state = attacked(spark, sf_dir)
    att = state.where("iteration = 10").select("row_id", "y_atk")
    return FR.align(clean.select("row_id", "y"), clean.select("row_id", "y_orig"), att)


@register("j04_copy_label", _q("SELECT row_id, iteration, y_atk, y FROM snap", *SNAP_CTES))
def j04_copy_label(spark, sf_dir):
    _, clean, _, state = attacked(spark, sf_dir)
    att = state.select("row_id", "iteration", "y_atk", F.lit(None).cast("int").alias("y"))
    return FR.copy_column(att, clean, "y")


W01_CTE = """w1 AS (SELECT row_id, iteration, y, y_orig, coalesce(pin.ya, y_atk) AS y_atk, pin.it AS pinned_iteration
FROM (SELECT row_id, iteration, y, y_orig, y_atk,
        first_value(CASE WHEN y = y_orig AND y <> y_atk THEN {'it': iteration, 'ya': y_atk} END
                    IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY iteration
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pin
      FROM snap))"""
W01_SQL = _q("SELECT * FROM w1", *SNAP_CTES, W01_CTE)


@register("w01_sticky_success", W01_SQL)
def w01_sticky_success(spark, sf_dir):
    return A.sticky_success(attacked(spark, sf_dir)[3].drop("success"))


A16_SQL = _q(f"""SELECT iteration, {r6("coalesce(CAST(count(*) FILTER (WHERE y = y_orig AND y <> y_atk) AS DOUBLE) "
                                  "/ nullif(count(*) FILTER (WHERE y = y_orig), 0), 0.0)")} AS success_rate
FROM w1 GROUP BY iteration""", *SNAP_CTES, W01_CTE)


@register("a16_attack_success_rate", A16_SQL)
def a16_attack_success_rate(spark, sf_dir):
    r = A.success_rate_by(w01_sticky_success(spark, sf_dir), ["iteration"])
    return r.select("iteration", (F.round("success_rate", 6) + F.lit(0.0)).alias("success_rate"))


# ---- W4 / W3: first success over 50 tries, snapshots --------------------------------------




def first_successes(spark, sf_dir, attack: str = "nucl"):
    d = dictionary(spark, sf_dir)
    found = A.first_success(labelled_seqs(spark, sf_dir, d, raw=True), "dna", "row_id", "y", **scorer(spark, d), rate=RATE,
                            max_iter=MAX_ITER, seed=SEED, attack=attack, schedule=ROUNDS[attack], bt_batches=True,
                            prepare=S.text_to_dna)
    return labelled_seqs(spark, sf_dir, d), found


@register("w04_attack_50", _q(f"""SELECT b.row_id, b.y, CAST(h.success_iteration AS INTEGER) AS success_iteration, h.y_atk,
  CASE WHEN h.success_iteration IS NULL THEN b.dna
       ELSE {point_mutation_sql('b.dna', 'b.row_id', 'h.success_iteration', RATE)} END AS dna
FROM base b LEFT JOIN hits h ON b.row_id = h.row_id""", *W04_CTES))
def w04_attack_50(spark, sf_dir):
    s, found = first_successes(spark, sf_dir)
    out = A.attack_outcome(s, "dna", "row_id", "y", found, RATE, SEED)
    return out.select("row_id", "y", F.col("success_iteration").cast("int").alias("success_iteration"),
                      "y_atk", "dna")


W03_SQL = _q(f"""SELECT s.row_id, s.iteration, {dbl(RATE)} AS rate, s.y, s.y_atk AS y_hat, s.success,
  CASE WHEN s.success THEN {point_mutation_sql('b.dna', 'b.row_id', 'h.success_iteration', RATE)}
       ELSE b.dna END AS dna
FROM snap s JOIN base b ON b.row_id = s.row_id LEFT JOIN hits h ON b.row_id = h.row_id""", *SNAP_CTES)


@register("w03_snapshots", W03_SQL)
def w03_snapshots(spark, sf_dir):
    s, _, found, state = attacked(spark, sf_dir)
    return A.snapshots(state, found, s, "dna", rate=RATE, seed=SEED)


@register("s07_snapshots", W03_SQL)
def s07_snapshots(spark, sf_dir):
    """The snapshots written as tables by iteration and rate, and read back."""
    path = shared_path(spark, "snapshots")
    write_snapshots(w03_snapshots(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.select("row_id", F.col("iteration").cast("int").alias("iteration"),
                       F.col("rate").cast("double").alias("rate"), "y", "y_hat", "success", "dna")


@register("j06_unbroken_rows", _q("""SELECT b.row_id, b.y FROM base b
WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.row_id = b.row_id)""", *W04_CTES))
def j06_unbroken_rows(spark, sf_dir):
    s, found = first_successes(spark, sf_dir)
    return s.join(found, "row_id", "left_anti").select("row_id", "y")


# ---- J8: pin rows from an earlier snapshot ---------------------------------------------------

@register("j08_overwrite_rows", _q("""SELECT a.row_id, coalesce(p.y_atk, a.y_atk) AS y_atk,
  coalesce(p.iteration, a.iteration) AS iteration
FROM snap a LEFT JOIN (SELECT * FROM snap WHERE iteration = 10 AND y = y_orig AND y <> y_atk) p ON a.row_id = p.row_id
WHERE a.iteration = 50""", *SNAP_CTES))
def j08_overwrite_rows(spark, sf_dir):
    state = attacked(spark, sf_dir)[3]
    last = state.where("iteration = 50").select("row_id", "y_atk", "iteration")
    patch = state.where("iteration = 10 and y = y_orig and y <> y_atk").select("row_id", "y_atk", "iteration")
    return FR.overwrite(last, patch, "row_id")


# ---- M10: before / after per snapshot ------------------------------------------------------

M10_METRICS = ("accuracy", "balanced_accuracy", "f1_macro", "precision_macro", "recall_macro")


def _m10_sql(rows: str, group: str, clean: str = "orig") -> str:
    """Five metrics of clean and attacked predictions, and the success rate, per ``group`` of ``rows``."""
    both = (f"SELECT 'attacked' AS variant, {group}, y, y_atk AS p FROM {rows} UNION ALL "
            f"SELECT 'clean', g.{group}, o.y, o.y_orig FROM {clean} o, (SELECT DISTINCT {group} FROM {rows}) g")
    return f"""SELECT m.variant, m.{group}, {', '.join(f'{r6(c)} AS {c}' for c in M10_METRICS)},
  {r6('success_rate')} AS success_rate
FROM (SELECT variant, {group}, sum(tp) / sum(t) AS accuracy, avg(CASE WHEN t > 0 THEN tp / t END) AS balanced_accuracy,
    avg(2.0::DOUBLE * tp / (t + n)) AS f1_macro, avg(CASE WHEN n > 0 THEN tp / n ELSE 0 END) AS precision_macro,
    avg(CASE WHEN t > 0 THEN tp / t ELSE 0 END) AS recall_macro
  FROM (SELECT variant, {group}, label, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(t) AS DOUBLE) AS t,
          CAST(sum(n) AS DOUBLE) AS n
        FROM (SELECT variant, {group}, y AS label, CAST(y = p AS INT) AS tp, 1 AS t, 0 AS n FROM ({both})
              UNION ALL SELECT variant, {group}, p, 0, 0, 1 FROM ({both})) GROUP BY ALL) GROUP BY ALL) m
JOIN (SELECT {group}, coalesce(CAST(count(*) FILTER (WHERE y = y_orig AND y <> y_atk) AS DOUBLE)
         / nullif(count(*) FILTER (WHERE y = y_orig), 0), 0.0) AS success_rate FROM {rows} GROUP BY ALL) r
  ON r.{group} = m.{group}"""


def _rounded(r, group: str):
    return r.select("variant", group, *[(F.round(c, 6) + F.lit(0.0)).alias(c)
                                        for c in (*M10_METRICS, "success_rate")])


@register("m10_before_after", _q(_m10_sql("w1", "iteration"), *SNAP_CTES, W01_CTE))
def m10_before_after(spark, sf_dir):
    """The chain joined up: all tries -> states at the snapshots -> sticky success -> metrics and success rate."""
    _, clean, _, state = attacked(spark, sf_dir)
    pinned = A.sticky_success(state.drop("success"))
    return _rounded(A.before_after(pinned, clean, "iteration"), "iteration")


@register("m10_confusion", _q("""SELECT 'attacked' AS variant, iteration, y, y_atk AS y_hat, count(*) AS n FROM w1
GROUP BY ALL UNION ALL SELECT 'clean', NULL, y, y_orig, count(*) FROM orig GROUP BY ALL""", *SNAP_CTES, W01_CTE))
def m10_confusion(spark, sf_dir):
    """Non-empty cells of the confusion matrix: attacked per snapshot, clean once."""
    _, clean, _, state = attacked(spark, sf_dir)
    pinned = A.sticky_success(state.drop("success"))
    cells = pinned.groupBy(F.lit("attacked").alias("variant"), "iteration", "y", F.col("y_atk").alias("y_hat")).agg(
        F.count("*").alias("n"))
    return cells.unionByName(clean.groupBy(F.lit("clean").alias("variant"), F.lit(None).cast("int").alias("iteration"),
                                           "y", F.col("y_orig").alias("y_hat")).agg(F.count("*").alias("n")))


# ---- W2: cascade across mutation rates -------------------------------------------------------

def _w02_sql() -> str:
    steps = []
    for i, r in enumerate(SWEEP):
        steps.append(_attack_ctes("SELECT 1 AS it", rate=r, name=f"r{i}"))
    union = "\nUNION ALL ".join(
        f"SELECT {i} AS step, o.row_id, o.y, o.y_orig, a.y_atk, "
        f"{point_mutation_sql('o.dna', 'o.row_id', '1', r)} AS seq "
        f"FROM orig o JOIN r{i} a ON o.row_id = a.row_id" for i, r in enumerate(SWEEP))
    body = f"""st AS ({union}),
first0 AS (SELECT seq, arg_max(y, row_id) AS lab0 FROM st
           WHERE step = 0 AND y = y_orig AND y <> y_atk GROUP BY seq),
later AS (SELECT seq, arg_min({{'s': step, 'r': row_id, 'l': y}}, {{'s': step, 'r': row_id}}) AS e FROM st
          WHERE step > 0 AND y <> y_atk GROUP BY seq)
SELECT st.step, st.row_id, st.seq, st.y_orig, st.y_atk,
  CASE WHEN st.step = 0 THEN st.y
       WHEN f.lab0 IS NOT NULL THEN f.lab0
       WHEN l.e IS NOT NULL AND (l.e.s < st.step OR (l.e.s = st.step AND l.e.r < st.row_id)) THEN l.e.l
       ELSE st.y END AS y
FROM st LEFT JOIN first0 f ON st.seq = f.seq LEFT JOIN later l ON st.seq = l.seq"""
    head, tail = body.split("\nSELECT st.step", 1)
    ctes = (*steps, head, "cas AS (SELECT st.step" + tail + ")")
    rates = " ".join(f"WHEN {i} THEN {dbl(r)}" for i, r in enumerate(SWEEP))
    rated = f"rated AS (SELECT CASE step {rates} END AS rate, row_id, y, y_orig, y_atk FROM cas)"
    return _q("SELECT step, row_id, seq, y FROM cas", *ctes), _q(_m10_sql("rated", "rate"), *ctes, rated)


W02_SQL, M10_SWEEP_SQL = _w02_sql()


def cascaded(spark, sf_dir):
    """The sweep's rows (no texts) with cascaded labels, and the sequences and clean scores behind them."""
    s, model = victim(spark, sf_dir)
    clean = clean_scores(s, model)
    st = A.rate_sweep_steps(s, "dna", "row_id", SWEEP, **model, seed=SEED)
    st = materialize(st.join(clean, "row_id"), "steps")  # ids, labels and digests; the cascade reads it several times
    return clean, A.cascade(st, text="digest")


@register("m10_rate_sweep", M10_SWEEP_SQL)
def m10_rate_sweep(spark, sf_dir):
    """Metrics and success rate per mutation rate, on the cascade's labels."""
    clean, c = cascaded(spark, sf_dir)
    return _rounded(A.before_after(c, clean, "rate"), "rate")


@register("w02_cascade", W02_SQL)
def w02_cascade(spark, sf_dir):
    _, c = cascaded(spark, sf_dir)
    labels = c.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("step", "y"))).alias("ys"))  # one row a step
    rows = S.seqs(spark, sf_dir).select("row_id", F.coalesce("dna", F.lit("")).alias("dna")).join(labels, "row_id")
    texts = attacked_texts(rows, "dna", "row_id", [("nucl", r, (1,)) for r in SWEEP], seed=SEED)
    each = texts.select("row_id", F.explode(F.arrays_zip("ys", "t")).alias("e"))
    return each.select("e.ys.step", "row_id", F.col("e.t").alias("seq"), "e.ys.y")


# ---- W4 with the codon attack (texts built per try, then scored) ----------------------------

def _text_score_ctes(name: str, texts_sql: str) -> str:
    """``{name}(row_id, it, y_atk)`` scoring the texts of ``texts_sql`` (columns row_id, it, txt)."""
    valid = " AND ".join(f"codes[p + {j}] >= 0" for j in range(K))
    idx = " + ".join(f"codes[p + {j}] * {4 ** (K - 1 - j)}" for j in range(K))
    return f"""{name}_tx AS ({texts_sql}),
{name}_cd AS (SELECT row_id, it, list_transform(string_split(txt, ''), lambda ch: instr('ACGT', ch) - 1) AS codes
              FROM {name}_tx),
{name}_kp AS (SELECT row_id, it, codes, unnest(range(1, len(codes) - {K - 2})) AS p FROM {name}_cd),
{name}_ki AS (SELECT row_id, it, CASE WHEN {valid} THEN {idx} END AS idx FROM {name}_kp),
{name}_lg AS (SELECT t.row_id, t.it, {_logit_cols()} FROM {name}_tx t
   LEFT JOIN {name}_ki ki ON t.row_id = ki.row_id AND t.it = ki.it
   LEFT JOIN w ON ki.idx = w.idx GROUP BY t.row_id, t.it),
{name} AS (SELECT row_id, it, {_argmax()} AS y_atk FROM {name}_lg)"""


def _text_attack_sql(kind: str, seq: str, row: str, it: str) -> str:
    from .sqlgen import aa_to_dna_sql, codon_mutation_sql, dna_to_aa_sql

    if kind == "codon":
        return codon_mutation_sql(seq, row, it, RATE)
    return aa_to_dna_sql(dna_to_aa_sql(seq), row, it)


def _w04_text_sql(kind: str) -> str:
    first = _text_score_ctes("cfirst", f"SELECT row_id, 1 AS it, {_text_attack_sql(kind, 'dna', 'row_id', '1')} AS txt FROM base")
    standing = "cstanding AS (SELECT f.row_id FROM cfirst f JOIN base b ON f.row_id = b.row_id WHERE f.y_atk = b.y)"
    rest = _text_score_ctes("crest", f"""SELECT b.row_id, t.it, {_text_attack_sql(kind, 'b.dna', 'b.row_id', 't.it')} AS txt
        FROM base b, (SELECT CAST(unnest(range(2, {MAX_ITER} + 1)) AS INTEGER) AS it) t
        WHERE b.row_id IN (SELECT row_id FROM cstanding)""")
    hits = """chits AS (SELECT a.row_id, min(a.it) AS success_iteration, arg_min(a.y_atk, a.it) AS y_atk
        FROM (SELECT * FROM cfirst UNION ALL SELECT * FROM crest) a JOIN base b ON a.row_id = b.row_id
        WHERE a.y_atk <> b.y GROUP BY a.row_id)"""
    body = f"""SELECT b.row_id, b.y, CAST(h.success_iteration AS INTEGER) AS success_iteration, h.y_atk,
  CASE WHEN h.success_iteration IS NULL THEN b.dna
       ELSE {_text_attack_sql(kind, 'b.dna', 'b.row_id', 'h.success_iteration')} END AS dna
FROM base b LEFT JOIN chits h ON b.row_id = h.row_id"""
    return _q(body, first, standing, rest, hits)


def _w04_text(spark, sf_dir, kind: str):
    s, found = first_successes(spark, sf_dir, kind)
    out = A.attack_outcome(s, "dna", "row_id", "y", found, RATE, SEED, attack=kind)
    return out.select("row_id", "y", F.col("success_iteration").cast("int").alias("success_iteration"),
                      "y_atk", "dna")


@register("w04_codon_attack_50", _w04_text_sql("codon"))
def w04_codon_attack_50(spark, sf_dir):
    return _w04_text(spark, sf_dir, "codon")


@register("w04_bt_attack_50", _w04_text_sql("bt"))
def w04_bt_attack_50(spark, sf_dir):
    return _w04_text(spark, sf_dir, "bt")
