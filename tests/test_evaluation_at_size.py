from pyspark.sql import functions as F

from vitsord.operators import answer
from vitsord.plans import catalog


def test_equal_evaluation_questions_are_asked_once(spark, small, monkeypatch):
    read, ask, seen = catalog.table, answer.ask, []

    def twice(spark, sf_dir, name):
        df = read(spark, sf_dir, name)
        return df.where("id < 'q0000006'").unionByName(df.where("id < 'q0000006'").withColumn("id", F.concat("id", F.lit("-again")))) if name == "eval_dataset" else df

    monkeypatch.setattr(catalog, "table", twice)
    monkeypatch.setattr(answer, "ask", lambda questions, *x: seen.append((questions.count(), questions.select("question").distinct().count())) or ask(questions, *x))
    got = catalog.evaluation_summary(spark, small).collect()[0]
    items = twice(spark, small, "eval_dataset").select("id", "answerable").dropDuplicates(["id"])
    assert seen[0][0] == seen[0][1] < items.count()
    assert got["answerable"] == items.where("answerable").count()
