import datetime as dt
import random

from pyspark.sql import functions as F

from basalt.operators.orphans import dense_numbers, integer_key, orphan_references, parent_runs

T = [dt.datetime(2026, 1, d) for d in range(1, 29)]


def test_keys_in_texts(spark):
    df = spark.createDataFrame([(x,) for x in [" 12 ", "0012", "\t7", "x7", "", None, "7-draft", "99999999999999999999", "0", "1 2", "-3", "1.0"]], "t string")
    assert [r[0] for r in df.select(integer_key(F.col("t"))).collect()] == [12, 12, 7, None, None, None, None, None, 0, None, -3, None]


def test_runs_break_at_gaps_and_states(spark):
    p = spark.createDataFrame([(k, None, k == 5, T[0]) for k in (1, 2, 3, 5, 6, 7, 1023, 1024)], "key long, name string, gone boolean, since timestamp_ntz")
    runs = sorted((x["first"], x["last"]) for r in parent_runs(p, 10).collect() for x in r["runs"])
    assert runs == [(1, 3), (5, 5), (6, 7), (1023, 1023), (1024, 1024)]


def test_against_brute_force(spark):
    r = random.Random(4)
    parents = [(k, None, r.random() < 0.2, r.choice(T), 1) for k in r.sample(range(-50, 3000), 900)] + [(7, None, False, T[3], 2), (7, None, True, T[1], 3), (None, None, False, T[0], 4)]
    refs = [(i, r.choice([7, 7, 7, None, *range(-60, 3050)]), None, r.choice([*T, None])) for i in range(3000)]
    got = orphan_references(spark.createDataFrame(refs, "ref long, key long, name string, at timestamp_ntz"), spark.createDataFrame(parents, "key long, name string, gone boolean, since timestamp_ntz, at int").drop("at"))
    state = {}
    for k, _, gone, since, _ in parents:
        g, s = state.get(k, (True, since))
        state[k] = (g and gone, min(s, since))
    want = set()
    for ref, key, _, at in refs:
        if key is None or key not in state:
            want.add((ref, "missing"))
        elif state[key][0]:
            want.add((ref, "deleted"))
        elif at is not None and state[key][1] > at:
            want.add((ref, "late"))
    assert {tuple(x) for x in got.collect()} == want


def test_names_tell_equal_hashes_apart(spark):
    p = spark.createDataFrame([(5, "a", False, T[0]), (5, "b", False, T[9]), (9, "c", False, T[0])], "key long, name string, gone boolean, since timestamp_ntz")
    refs = spark.createDataFrame([(1, 5, "a", T[2]), (2, 5, "b", T[2]), (3, 5, "c", T[2]), (4, 9, "c", None)], "ref long, key long, name string, at timestamp_ntz")
    assert {tuple(x) for x in orphan_references(refs, p).collect()} == {(2, "late"), (3, "missing")}


def test_empty_tables(spark):
    p = spark.createDataFrame([], "key long, name string, gone boolean, since timestamp_ntz")
    refs = spark.createDataFrame([(1, 5, None, T[2])], "ref long, key long, name string, at timestamp_ntz")
    assert [tuple(x) for x in orphan_references(refs, p).collect()] == [(1, "missing")]
    assert orphan_references(refs.limit(0), p).count() == 0


def test_ids_are_numbered_in_their_order(spark):
    df = spark.createDataFrame([(f"{k:04x}",) for k in range(500)] * 2 + [(None,)], "id string")
    got = sorted((r.id, r.key) for r in dense_numbers(df, "id").collect())
    assert len(got) == 500 and [k for _, k in got] == sorted(k for _, k in got)
    parents = dense_numbers(df, "id").filter("id <> '00ff'").select("key", F.lit(None).cast("string").alias("name"), F.lit(False).alias("gone"), F.lit(T[0]).cast("timestamp_ntz").alias("since"))
    assert sum(len(r["runs"]) for r in parent_runs(parents, 40).collect()) <= 2 + spark.sparkContext.defaultParallelism * 4
