"""texts are turned into bases in Arrow batches."""

from pyspark.sql import functions as F

from helixframe.sources import standins as S


def test_f7_bases_of_texts_are_made_in_batches(spark):
    texts = [None, "", "Hello, Wörld İı ſ K é\x00 zZ", "ABCxyz\n\t12", "日本", "Å", "aZ" * 5000, "[`{@^_"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    letters = F.lower(F.regexp_replace("t", "[^A-Za-z]", ""))
    both = df.select(S.text_to_dna(F.col("t")).alias("got"), F.translate(letters, S.ALPHABET_FROM, S.ALPHABET_TO).alias("want"))
    assert all(r.got == r.want for r in both.collect())
    plan = df.select(S.text_to_dna(F.col("t")).alias("d"))._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan and "translate" not in plan
