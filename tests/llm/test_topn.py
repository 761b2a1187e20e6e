import random

from pyspark.sql import functions as F

from basalt.llm.topn import top_n_per_group


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice(["x", "y", None]), r.choice([None, 1, 2, 3]), i, "extra") for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, t string, score int, id long, rn string").repartition(7)
    order = [F.col("score").desc_nulls_last(), F.col("id").desc()]
    got = {(x.g, x.t, x.id) for x in top_n_per_group(df, ["g", "t"], order, 5).collect()}
    want = set()
    for g in {x[0] for x in rows}:
        for t in {x[1] for x in rows}:
            mine = sorted((x for x in rows if x[0] == g and x[1] == t), key=lambda x: (x[2] is None, -(x[2] or 0), -x[3]))
            want |= {(g, t, x[3]) for x in mine[:5]}
    assert got == want


def test_small_cases(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "g string, id long")
    assert top_n_per_group(df, ["g"], [F.desc("id")], 1).count() == 2
    assert top_n_per_group(df, ["g"], [F.desc("id")], 9).count() == 3
    assert top_n_per_group(df, ["g"], [F.desc("id")], 0).count() == 0
    assert top_n_per_group(df.limit(0), ["g"], [F.desc("id")], 3).count() == 0
