import random

from basalt.llm import mixing as X

DOCS = "doc_id long, source string, n_tokens long, weight double"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def setup(spark, n=600):
    r = random.Random(1)
    docs = [(k, r.choice(["a", "a", "a", "b", "c", None]), r.choice([0, *range(1, 60)]), r.choice([None, 0.2, 1.0, -1.0])) for k in range(n)]
    return docs, spark.createDataFrame(docs, DOCS)


def test_shares_and_caps(spark):
    docs, df = setup(spark)
    targets = spark.createDataFrame([("m", "a", 0.2, 1), ("m", "b", 0.4, 3), ("m", "c", 0.3, 4), ("m", "none", 0.1, 2), ("n", "a", 1.0, 2), ("n", "b", None, 2), ("n", None, 0.5, 2), ("n", "c", 0.5, 0)], TARGETS)
    rows = X.mix(df, targets).collect()
    caps = {("m", "a"): 1, ("m", "b"): 3, ("m", "c"): 4, ("n", "a"): 2}
    tokens = {}
    for r in rows:
        assert 1 <= r.uses <= caps[r.mix_name, r.source] and r.n_tokens > 0
        tokens[r.mix_name, r.source] = tokens.get((r.mix_name, r.source), 0) + r.uses * r.n_tokens
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    total = sum(v for (m, _), v in tokens.items() if m == "m")
    for s, share in (("a", 0.2), ("b", 0.4), ("c", 0.3)):
        assert abs(tokens["m", s] / total - share / 0.9) < 0.01
    assert tokens["n", "a"] == 2 * sum(d[2] for d in docs if d[1] == "a")
    got = {(s.mix_name, s.source): s.actual_share for s in X.shares(X.mix(df, targets), targets).collect()}
    assert len(got) == 8 and got["m", "none"] == 0 and abs(got["n", "a"] - 1) < 1e-12


def test_epochs_are_complete(spark):
    _, df = setup(spark)
    targets = spark.createDataFrame([("m", "b", 1.0, 9)], TARGETS)
    size = df.filter("source = 'b'").groupBy().sum("n_tokens").first()[0]
    uses = [r.uses for r in X.mix(df, targets, total_tokens=2.5 * size).collect()]
    assert set(uses) == {2, 3} and len(uses) == df.filter("source = 'b' and n_tokens > 0").count()
    short = X.mix(df, targets, total_tokens=100.0 * size).collect()
    assert {r.uses for r in short} == {9}


def test_runs_repeat_and_weights_count(spark):
    df = spark.createDataFrame([(k, "s", 10, 1.0 if k % 2 else 0.1) for k in range(2000)], DOCS)
    targets = spark.createDataFrame([("m", "s", 1.0, 1)], TARGETS)
    one = {r.doc_id for r in X.mix(df, targets, total_tokens=5000.0).collect()}
    assert one == {r.doc_id for r in X.mix(df.repartition(7), targets, total_tokens=5000.0).collect()}
    assert len(one) == 500 and sum(k % 2 for k in one) > 400


def test_empty(spark):
    _, df = setup(spark, 20)
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    assert X.mix(df.limit(0), targets).count() == 0
    assert X.mix(df, targets.limit(0)).count() == 0
    assert X.shares(X.mix(df.limit(0), targets), targets).first().actual_share == 0


def test_ranges_of_the_key_are_narrow_for_any_weight(spark):
    from pyspark.sql import functions as F

    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("n_tokens"), F.element_at(F.array(*map(F.lit, (0.05, 0.1, 1.0))), (F.col("id") % 3 + 1).cast("int")).alias("weight"))
    key = -F.log((F.shiftrightunsigned(F.xxhash64(F.lit("m"), "doc_id", F.lit(1)), 11).cast("double") + 0.5) / float(1 << 53)) / F.col("weight")
    most = df.groupBy(F.floor(F.log2(key) * X.BINS)).count().agg(F.max("count")).first()[0]
    assert most < 60  # 0.1 % of the rows
    rows = X.mix(df, spark.createDataFrame([("m", "s", 1.0, 1)], TARGETS), total_tokens=200_000.0).collect()
    assert len(rows) == 20_000 and sum(r.doc_id % 3 == 2 for r in rows) > 15_000


def test_quality_tells_poor_text_in_any_script(spark):
    from pyspark.sql import functions as F

    good = ["The cache reads every table once. " * 1 + f"Step {k} is done by the reader and checked by hand, then it is stored where others find it, with its date and owner, and with a note on why it was done at all." for k in range(1)]
    good += ["def f(x):\n    return x + 1\n\n\ndef g(y):\n    return f(y) * 2\n" + "\n".join(f"    value_{k} = {k}" for k in range(20)), "".join(chr(0x4E00 + k) for k in range(250))]
    poor = ["same line\n" * 40, "x" * 400, "ab�" * 100, "short", "", None]
    df = spark.createDataFrame([(t,) for t in good + poor], "text string").select(X.quality_weight(F.col("text")).alias("w"))
    w = [r.w for r in df.collect()]
    assert min(w[: len(good)]) > 0.9 and max(w[len(good) :]) < 0.6 and min(w) == 0.05
