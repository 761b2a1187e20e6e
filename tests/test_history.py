import datetime as dt
import random

from basalt.operators.history import StoredHistory, apply_state_snapshot, at_depth, differing_leaves, history_of_edits, history_of_snapshots, merkle_leaves, tree_depth, versions_of_edits

EDITS = "id long, memory_id long, field string, old_value string, new_value string, created_at timestamp_ntz, field2 string"
T0 = dt.datetime(2026, 1, 1)
ARGS = (["memory_id", "field"], "old_value", "new_value", "created_at", "id")


def brute(rows):
    by = {}
    for i, m, f, old, new, at, _ in rows:
        if at is not None:
            by.setdefault((m, f), []).append((at, i, old or "", new or ""))
    out = set()
    for key, es in by.items():
        es.sort()
        value, opened = es[0][2], []
        for k, (at, _, _, new) in enumerate(es):
            if k + 1 < len(es) and es[k + 1][0] == at:
                continue
            if new != value:
                opened.append((at, new))
                value = new
        for k, (at, new) in enumerate(opened):
            out.add((*key, new, at, opened[k + 1][0] if k + 1 < len(opened) else None))
    return out


def edits(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = None if r.random() < 0.03 else T0 + dt.timedelta(seconds=r.choice([0, 1, 2, 3600, 86399, 86400, 90000, 400000]) * r.randint(0, 4))
        rows.append((i, r.choice([1, 1, 1, 2, 3, None]), r.choice(["title", "type", None]), r.choice(["a", "b", "", None]), r.choice(["a", "b", "c", "", None]), at, "extra"))
    return rows


def result(df):
    return {tuple(r) for r in df.select("memory_id", "field", "value", "valid_from", "valid_to").collect()}


def test_versions_against_brute_force(spark):
    for seed in range(3):
        rows = edits(150, seed)
        assert result(versions_of_edits(spark.createDataFrame(rows, EDITS), *ARGS)) == brute(rows)


def test_history_by_snapshots_is_the_same(spark):
    rows = edits(120, 9)
    df = spark.createDataFrame(rows, EDITS)
    cuts = [T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=3)]
    assert result(history_of_edits(df, *ARGS, cuts)) == brute(rows)
    assert result(history_of_edits(df, *ARGS, [])) == brute(rows)


def test_empty_log(spark):
    df = spark.createDataFrame([], EDITS)
    assert result(history_of_edits(df, *ARGS, [T0])) == set()


def test_only_buckets_that_differ_are_found(spark):
    a = spark.range(5000).selectExpr("id as k", "id % 7 as v")
    b = a.selectExpr("k", "case when k = 4711 then 99 else v end as v")
    one, two = merkle_leaves(a, ["k"], ["v"]), merkle_leaves(b, ["k"], ["v"])
    assert differing_leaves(one, two).count() == 1
    assert differing_leaves(one, one).count() == 0


def test_snapshots_with_nulls_and_returning_keys(spark):
    s = "k long, v string, more int"
    shots = [("2026-01-01", [(1, "a", 0), (2, None, 0), (None, "n", 0)]), ("2026-02-01", [(1, "b", 5), (None, "n", 0)]), ("2026-03-01", [(1, "b", 5), (2, None, 1), (2, None, 1)])]
    h = history_of_snapshots([(w, spark.createDataFrame(r, s)) for w, r in shots], ["k"], ["v"])
    got = {(r.k, r.v, str(r.valid_from)[:7], str(r.valid_to)[:7]) for r in h.collect()}
    assert got == {(1, "a", "2026-01", "2026-02"), (1, "b", "2026-02", "None"), (2, None, "2026-01", "2026-02"), (2, None, "2026-03", "None"), (None, "n", "2026-01", "2026-03")}


def test_empty_snapshot_ends_all(spark):
    s = "k long, v string"
    full = spark.createDataFrame([(1, "a")], s)
    h = history_of_snapshots([("2026-01-01", full), ("2026-02-01", spark.createDataFrame([], s))], ["k"], ["v"])
    assert [str(r.valid_to)[:10] for r in h.collect()] == ["2026-02-01"]
    assert apply_state_snapshot  # part of the public operators


def test_depth_follows_the_keys_and_trees_of_two_depths_compare(spark):
    a = spark.range(40_000).selectExpr("id as k", "id % 7 as v")
    assert [tree_depth(a.limit(n), ["k"]) for n in (0, 1000, 40_000)] == [2, 2, 3]
    deep, shallow = merkle_leaves(a, ["k"], ["v"], depth=5), merkle_leaves(a.filter("k <> 4711"), ["k"], ["v"], depth=2)
    assert differing_leaves(shallow, at_depth(deep, 2), depth=2).count() == 1
    b = a.selectExpr("k", "case when k = 4711 then 99 else v end as v")
    assert differing_leaves(deep, merkle_leaves(b, ["k"], ["v"], depth=5), depth=5).count() == 1


def test_history_is_kept_between_runs(spark, tmp_path):
    rows = edits(120, 3)
    df = spark.createDataFrame(rows, EDITS)
    store = StoredHistory(spark, f"file://{tmp_path}/kept")
    assert store.read() is None
    for k, at in enumerate((1, 3, 3, 1000)):
        cut = T0 + dt.timedelta(days=at)
        log = df.filter(df["created_at"].isNull() | (df["created_at"] <= cut))
        history, report = store.update(log, *ARGS)
        assert result(history) == result(store.read()) == brute([r for r in rows if r[5] is None or r[5] <= cut])
        assert (report is None) == (k == 0)
        if k == 2:
            assert report.first().skipped == 1.0 and report.first().differing == 0
    (tmp_path / "kept" / "000000009-2" / "history").mkdir(parents=True)  # a run that failed
    assert result(store.read()) == brute(rows)
