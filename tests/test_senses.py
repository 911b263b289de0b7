"""The choice between a word's senses."""

from pyspark.sql import functions as F

from draftmetrics.operators import metrics as m


def test_written_out_senses_equal_the_function_over_the_array(spark):
    """Nulls, ties, one sense, none, and similarities around the threshold."""
    sims = [[0.45], [0.1], [0.4, 0.4499999], [0.45, 0.45], [0.2, 0.9, 0.9], [None, 0.5], [None, None], [0.46, None, 0.45], [], None]
    rows = [(i, None if s is None else [(k, float(10 * i + k), v) for k, v in enumerate(s)]) for i, s in enumerate(sims)]
    df = spark.createDataFrame(rows, "id int, senses array<struct<sense_ord: int, grade: double, gloss: double>>")
    one, other = (m.chosen_grade(F.col("senses"), lambda g: g, 0.45, most) for most in (3, 99))
    got = df.select("id", one.alias("a"), other.alias("b")).orderBy("id").collect()
    assert [r.a for r in got] == [r.b for r in got] == [0.0, 10.0, 20.0, 30.0, 41.0, 51.0, 60.0, 70.0, None, None]


def test_a_similarity_is_evaluated_once_and_by_generated_code(spark):
    df = spark.createDataFrame([([1], [(0, 1.0, [1]), (1, 2.0, [2])])], "s array<long>, senses array<struct<sense_ord: int, grade: double, gloss: array<long>>>")
    plan = df.select(m.chosen_grade(F.col("senses"), lambda g: F.size(F.array_intersect("s", g)) / 1.0, 0.2, 2).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 2 and "lambda" not in plan
