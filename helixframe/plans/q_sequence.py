"""Sequence queries over ``seqs`` (documents): F1-F14, J7, A24, S1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mutation as M
from ..functions import sequence as Q
from ..functions.codons import CODON_TABLE
from ..functions.draws import K_ITER, draw_sql
from ..sources import standins as S
from ..functions.codons import ambiguous_codons
from ..operators.tries import attacked_texts
from ..session import shared_path
from ..sources import readers, sinks
from ..sources.tables import spread, table
from .registry import register
from .sqlgen import (aa_to_dna_sql, base_sql, codon_mutation_sql, dna_to_aa_sql, fires_sql,
                     lookup_sql, point_mutation_sql)
from .views import with_views

RATE = 0.1
RATES = (0.1, 0.2, 0.3, 0.4, 0.5)
MODEL_MAX_LEN = 510  # the DNA models' input length (510 + 2 special tokens)


@register("s01_read_sequences", with_views("seqs", "SELECT row_id, dna, label_name, split FROM seqs"))
def s01_read_sequences(spark, sf_dir):
    """Sequences written as one CSV folder per split, in the source's format, and read back by header name."""
    rows = S.seqs(spark, sf_dir, parallel=False).select(
        F.col("label_name").alias("Drug Class"), F.col("row_id").alias("id"), F.col("dna").alias("DNA Sequence"), "split")
    paths = {name: shared_path(spark, name) for name in ("train", "valid", "test")}
    for name, path in paths.items():
        rows.where(F.col("split") == name).drop("split").write.option("header", True).option("emptyValue", '""').csv(path)
    back = readers.read_sequences(spark, paths, ["DNA Sequence", readers.target_column("dc")], key="id")
    return back.select("row_id", F.coalesce("DNA Sequence", F.lit("")).alias("dna"),
                       F.col(readers.target_column("dc")).alias("label_name"), "split")


@register("s02_read_metadata", with_views("meta", "SELECT row_id, co_occur, ph, depth, env_biome, geo_loc_name FROM meta"))
def s02_read_metadata(spark, sf_dir):
    """Metadata written as a tab-separated folder with missing spellings, and read back."""
    path = shared_path(spark, "meta")
    rows = S.meta(spark, sf_dir).select("row_id", "co_occur", "ph", "depth", "env_biome", "geo_loc_name")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in rows.columns]
    rows.select(*text).write.option("header", True).option("sep", "\t").csv(path)
    back = readers.read_metadata(spark, path, numeric=["ph", "depth"])
    return back.withColumn("row_id", F.col("row_id").cast("bigint"))


@register("s03_wide_embeddings", """SELECT CAST(vec_id AS VARCHAR) AS sample_name, CAST(label AS DOUBLE) AS abundance,
  CAST(unnest(range(0, len(embedding))) AS INTEGER) AS pos, unnest(embedding) AS v FROM embeddings""")
def s03_wide_embeddings(spark, sf_dir):
    """Vectors written as wide CSV columns (S6) beside an index column, and read back by name."""
    path = shared_path(spark, "wide")
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit(0).alias("index"), F.col("vec_id").cast("string").alias("sample_name"),
        F.col("label").cast("double").alias("abundance"), F.col("embedding").alias("emb"))
    sinks.write_table(rows, path, fmt="csv", vec="emb", dim=64)
    back = readers.read_wide_embeddings(spark, path, dim=64)
    return back.select("sample_name", "abundance", F.posexplode("emb").alias("pos", "v"))


F01_SQL = """SELECT doc_id AS row_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq
FROM documents"""


@register("f01_upper", F01_SQL)
def f01_upper(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"),
                    Q.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


@register("f02_prefix_cut", with_views("seqs", f"""
SELECT row_id, substr(dna, 1, {MODEL_MAX_LEN}) AS seq FROM seqs"""))
def f02_prefix_cut(spark, sf_dir):
    return S.seqs(spark, sf_dir).select("row_id", Q.clean("dna", MODEL_MAX_LEN).alias("seq"))


@register("f03_rna_to_dna", with_views("seqs", """
SELECT row_id, translate(upper(lower(translate(dna, 'T', 'U'))), 'U', 'T') AS seq FROM seqs"""))
def f03_rna_to_dna(spark, sf_dir):
    rna = F.lower(F.translate("dna", "T", "U"))
    return S.seqs(spark, sf_dir).select("row_id", Q.rna_to_dna(rna).alias("seq"))


F04_BODY = f"""split_part(array_to_string(list_transform(regexp_extract_all(dna, '.{{3}}'),
  lambda c: {lookup_sql('c')}), ''), '_', 1)"""


@register("f04_translate_to_stop", with_views("seqs", f"SELECT row_id, {F04_BODY} AS protein FROM seqs"))
def f04_translate_to_stop(spark, sf_dir):
    return S.seqs(spark, sf_dir).select("row_id", Q.translate_to_stop("dna").alias("protein"))


# one base in five becomes an ambiguity letter, T becomes U: sequences as a laboratory reports them
_UNSURE = "translate(regexp_replace(dna, '(....)[ACGT]', '\\1N', 'g'), 'T', 'U')"


def _f04_ambiguous_sql() -> str:
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ambiguous_codons().items()) + "}"
    return with_views("seqs", f"""
WITH p AS (SELECT row_id, array_to_string(list_transform(regexp_extract_all({_UNSURE}, '.{{3}}'),
  lambda c: coalesce(({table})[c], 'X')), '') AS p FROM seqs)
SELECT row_id, CASE WHEN contains(p, '_') THEN split_part(p, '_', 1) ELSE p END AS protein FROM p""")


@register("f04_ambiguous", _f04_ambiguous_sql())
def f04_ambiguous(spark, sf_dir):
    unsure = F.translate(F.regexp_replace("dna", "(....)[ACGT]", "$1N"), "T", "U")
    return S.seqs(spark, sf_dir).select("row_id", unsure.alias("dna")).select(
        "row_id", Q.translate_to_stop("dna").alias("protein"))


F05_SQL = """SELECT doc_id AS row_id,
  array_to_string(string_split(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')),
                                         'UZOB', 'XXXX'), ''), ' ') AS protein
FROM documents"""


@register("f05_mask_rare_residues", F05_SQL)
def f05_mask_rare_residues(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return d.select(F.col("doc_id").alias("row_id"), Q.spaced(Q.mask_rare(letters)).alias("protein"))


@register("f06_codons", with_views("seqs", """
SELECT row_id, array_to_string(regexp_extract_all(dna, '.{1,3}'), ' ') AS codons,
       CAST(len(regexp_extract_all(dna, '.{1,3}')) AS BIGINT) AS n_codons FROM seqs"""))
def f06_codons(spark, sf_dir):
    c = Q.codons("dna")
    return S.seqs(spark, sf_dir).select(
        "row_id", F.array_join(c, " ").alias("codons"), F.size(c).cast("bigint").alias("n_codons"))


@register("f07_dna_to_aa", with_views("seqs", f"SELECT row_id, {dna_to_aa_sql('dna')} AS protein FROM seqs"))
def f07_dna_to_aa(spark, sf_dir):
    return S.seqs(spark, sf_dir).select("row_id", Q.dna_to_aa("dna").alias("protein"))


@register("f08_aa_to_dna", with_views("seqs", f"""
SELECT row_id, {aa_to_dna_sql('p', 'row_id', '1')} AS seq
FROM (SELECT row_id, {dna_to_aa_sql('dna')} AS p FROM seqs)"""))
def f08_aa_to_dna(spark, sf_dir):
    s = S.seqs(spark, sf_dir).select("row_id", Q.dna_to_aa("dna").alias("p"))
    return s.select("row_id", Q.aa_to_dna("p", F.col("row_id"), 1).alias("seq"))


@register("f09_point_mutation", with_views("seqs", f"""
SELECT row_id, {point_mutation_sql('dna', 'row_id', '1', RATE)} AS seq FROM seqs"""))
def f09_point_mutation(spark, sf_dir):
    return S.seqs(spark, sf_dir).select(
        "row_id", M.point_mutation_batch("dna", F.col("row_id"), 1, RATE).alias("seq"))


@register("f10_codon_mutation", with_views("seqs", f"""
SELECT row_id, {codon_mutation_sql('dna', 'row_id', '1', RATE)} AS seq FROM seqs"""))
def f10_codon_mutation(spark, sf_dir):
    return S.seqs(spark, sf_dir).select(
        "row_id", M.codon_mutation("dna", F.col("row_id"), 1, RATE).alias("seq"))


@register("f11_back_translation", with_views("seqs", f"""
SELECT row_id, {aa_to_dna_sql(dna_to_aa_sql('dna'), 'row_id', '1')} AS seq FROM seqs"""))
def f11_back_translation(spark, sf_dir):
    return S.seqs(spark, sf_dir).select(
        "row_id", M.back_translation("dna", F.col("row_id"), 1).alias("seq"))


F12_ITERS = 5


def _f12_sql() -> str:
    # Compounding point mutations keep the length; position p ends with the base
    # of the last iteration whose draw fired there, or its own base.
    last = (f"list_max(list_filter(range(1, {F12_ITERS} + 1), lambda i: "
            f"{fires_sql(draw_sql('row_id', 'i', 'z[2]'), RATE)}))")
    body = (f"CASE WHEN length(dna) = 0 THEN dna ELSE array_to_string(list_transform("
            f"list_transform(list_zip(string_split(dna, ''), range(1, length(dna) + 1)), "
            f"lambda z: {{'ch': z[1], 'p': z[2], 'i': {last}}}), "
            f"lambda t: CASE WHEN t.i IS NULL THEN t.ch ELSE "
            f"{base_sql(draw_sql('row_id', 't.i', 't.p'))} END), '') END")
    return with_views("seqs", f"SELECT row_id, {body} AS seq FROM seqs")


@register("f12_repeated_attack", _f12_sql())
def f12_repeated_attack(spark, sf_dir):
    s = S.seqs(spark, sf_dir).select("row_id", "dna")
    return attacked_texts(s, "dna", "row_id", [("nucl", RATE, range(1, F12_ITERS + 1))]).select(
        "row_id", F.col("t")[0].alias("seq"))


def _f12_rounds_sql(attack: str) -> str:
    """One nested query a round: these attacks read whole codons, so a round needs the one before."""
    rows = "SELECT row_id, dna FROM seqs"
    for i in range(1, F12_ITERS + 1):
        seq = (codon_mutation_sql("dna", "row_id", str(i), RATE) if attack == "codon" else
               aa_to_dna_sql(dna_to_aa_sql("dna"), "row_id", str(i)))
        rows = f"SELECT row_id, {seq} AS dna FROM ({rows})"
    return f"SELECT row_id, {attack!r} AS attack, dna AS seq FROM ({rows})"


@register("f12_repeated_attack_codons", with_views("seqs", f"""
{_f12_rounds_sql('codon')} UNION ALL {_f12_rounds_sql('bt')}"""))
def f12_repeated_attack_codons(spark, sf_dir):
    """F12 by codons and by back-translation."""
    return _by_attack(S.seqs(spark, sf_dir), ("codon", "bt"), range(1, F12_ITERS + 1))


def _by_attack(s, attacks, iterations):
    """``(row_id, attack, seq)``: one pass over the texts, one row an attack."""
    t = attacked_texts(s.select("row_id", "dna"), "dna", "row_id", [(a, RATE, iterations) for a in attacks])
    names = F.array(*[F.lit(a) for a in attacks])
    each = t.select("row_id", F.explode(F.arrays_zip(names.alias("attack"), F.col("t").alias("seq"))).alias("e"))
    return each.select("row_id", "e.attack", "e.seq")


@register("f13_attack_dispatch", with_views("seqs", f"""
SELECT row_id, attack,
  CASE attack WHEN 'nucl' THEN {point_mutation_sql('dna', 'row_id', '1', RATE)}
              WHEN 'codon' THEN {codon_mutation_sql('dna', 'row_id', '1', RATE)}
              ELSE {aa_to_dna_sql(dna_to_aa_sql('dna'), 'row_id', '1')} END AS seq
FROM seqs, (VALUES ('nucl'), ('codon'), ('bt')) a(attack)"""))
def f13_attack_dispatch(spark, sf_dir):
    return _by_attack(S.seqs(spark, sf_dir), M.ATTACKS, (1,))


def _f14_sql() -> str:
    arms = "\n".join(
        f"UNION ALL SELECT row_id, {r!r}::DOUBLE AS rate, {point_mutation_sql('dna', 'row_id', '1', r)} AS seq FROM seqs"
        for r in RATES)
    return with_views("seqs", arms[len("UNION ALL "):])


@register("f14_rate_sweep", _f14_sql())
def f14_rate_sweep(spark, sf_dir):
    s = S.seqs(spark, sf_dir)
    s = s.select("row_id", F.coalesce("dna", F.lit("")).alias("dna"))
    texts = attacked_texts(s, "dna", "row_id", [("nucl", r, (1,)) for r in RATES])
    rates = F.array(*[F.lit(r) for r in RATES])
    each = texts.select("row_id", F.explode(F.arrays_zip(rates.alias("rate"), F.col("t").alias("seq"))).alias("e"))
    return each.select("row_id", "e.rate", "e.seq")


@register("a24_codons_by_residue", with_views("seqs", f"""
SELECT residue, array_to_string(list_sort(list(DISTINCT codon)), ' ') AS codons,
       count(*) AS n_seen
FROM (SELECT unnest(regexp_extract_all(dna, '.{{3}}')) AS codon FROM seqs) c,
     LATERAL (SELECT {lookup_sql('c.codon')} AS residue) r
WHERE residue <> 'X' GROUP BY residue"""))
def a24_codons_by_residue(spark, sf_dir):
    c = S.seqs(spark, sf_dir).select(F.explode(Q.full_codons("dna")).alias("codon"))
    c = c.withColumn("residue", Q.lookup_residue(F.col("codon"))).where(F.col("residue") != "X")
    # collect_set holds at most 64 codons per residue: bounded partial state.
    return c.groupBy("residue").agg(
        F.array_join(F.sort_array(F.collect_set("codon")), " ").alias("codons"),
        F.count(F.lit(1)).alias("n_seen"))


@register("j07_codon_lookup", with_views("seqs", f"""
SELECT c.codon, coalesce(t.residue, 'X') AS residue, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(dna, '.{{1,3}}')) AS codon FROM seqs) c
LEFT JOIN (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in CODON_TABLE.items())})
           t(codon, residue)) t ON c.codon = t.codon
GROUP BY c.codon, t.residue"""))
def j07_codon_lookup(spark, sf_dir):
    """J7 as a join: every chunk's residue from the 64-row code table (broadcast: fixed size)."""
    code = spark.createDataFrame(list(CODON_TABLE.items()), "codon string, residue string")
    c = S.seqs(spark, sf_dir).select(F.explode(Q.codons("dna")).alias("codon"))
    j = c.join(F.broadcast(code), "codon", "left")
    return j.groupBy("codon", F.coalesce("residue", F.lit("X")).alias("residue")).agg(
        F.count(F.lit(1)).alias("n"))
