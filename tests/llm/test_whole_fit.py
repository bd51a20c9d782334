from pyspark.sql import functions as F

from vitsord.llm import sentences, splitting

N = 13_000


def _texts(spark):
    numbered = spark.range(N, numPartitions=4).select(F.lit("chunks").alias("unit_table"), F.col("id").cast("string").alias("record_id"), F.concat(F.lit("Case "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" is open")).alias("text"))
    return [numbered.unionByName(numbered), numbered.limit(0)]


def test_model_counts_every_distinct_text_once(spark):
    model = sentences.fit([x.select("text") for x in _texts(spark)])
    assert model.n["BR", "Case"] == N
    assert model.n["INSIDE", "is"] == model.n["INSIDE", "open"] == N


def test_splitting_takes_the_model_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(sentences, "corpus_texts", lambda *_: _texts(spark))
    assert splitting._model(spark, "").n["BR", "Case"] == N
