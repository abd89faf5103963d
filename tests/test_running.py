import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundplan.operators.running import carry_forward, running_totals


def _rows(spark):
    rng = random.Random(5)
    # one key holds most rows; one key is null
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), i, float(rng.randrange(100))) for i in range(2000)]
    return spark.createDataFrame(rows, "key string, pos int, x double")


def test_running_totals_equal_a_plain_window(spark):
    df = _rows(spark)
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("key", "pos", F.sum("x").over(w).alias("total"), F.count("x").over(w).alias("n"))
    ours = running_totals(df, ["key"], F.floor(F.col("pos") / 37), [F.col("pos")], {"total": F.col("x")}, rank="n")
    assert sorted(map(repr, ours.select("key", "pos", "total", "n").collect())) == sorted(map(repr, plain.collect()))


def test_carry_forward_equals_a_plain_window(spark):
    df = _rows(spark)
    value = F.when(F.col("x") < 10, F.col("pos"))
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("key", "pos", F.last(value, ignorenulls=True).over(w).alias("seen"))
    ours = carry_forward(df, ["key"], F.floor(F.col("pos") / 41), F.col("pos"), {"seen": value})
    assert sorted(map(repr, ours.select("key", "pos", "seen").collect())) == sorted(map(repr, plain.collect()))


def test_result_does_not_depend_on_the_number_of_partitions(spark):
    df = _rows(spark)
    results = []
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        ours = running_totals(df.repartition(int(partitions)), ["key"], F.floor(F.col("pos") / 50), [F.col("pos")], {"total": F.col("x")})
        results.append(sorted(map(repr, ours.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
