import datetime as dt
import random

from basalt.operators import memory as M

T0 = dt.datetime(2026, 1, 1)
ROWS = "id long, project string, created_at timestamp_ntz, title string, content string"


def greedy(rows, budget):
    out = set()
    for p in {r[1] for r in rows if r[1] is not None}:
        left, first = budget, True
        for r in sorted((r for r in rows if r[1] == p), key=lambda r: (r[2] is not None, r[2] or T0, r[0]), reverse=True):
            t, c = len(r[3] or ""), len(r[4] or "")
            for mode, n in (("full", t + c), ("cut", t + min(c, 100)), ("head", t)):
                n = -(-n * 2 // 7)
                if n <= left or first and mode == "full":
                    out.add((p, r[0], mode, n))
                    left, first = max(0, left - n), False
                    break
    return out


def test_packing_goes_through_all_rows(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["a", "a", "a", "b", "c", None]), r.choice([None, *(T0 + dt.timedelta(hours=h) for h in range(9))]), r.choice([None, "x" * r.randint(0, 60)]), r.choice([None, "y" * r.randint(0, 300)])) for k in range(300)]
    df = spark.createDataFrame(rows, ROWS)
    for batch in (7, 500):
        got = M.pack_newest(df, "project", 700, batch).collect()
        assert {(x.project, x.id, x.mode, x.tokens) for x in got} == greedy(rows, 700)
        assert len({(x.project, x.pos) for x in got}) == len(got)
    assert M.pack_newest(df.limit(0), "project", 700).count() == 0


def test_titles_without_trigrams_compare_whole(spark):
    df = spark.createDataFrame([(1, "p", T0, "日本", ""), (2, "p", T0, " 日本 ", ""), (3, "p", T0, "中国", ""), (4, "p", T0, None, ""), (5, "p", T0, "abcd", "")], ROWS).selectExpr("*", "'t' as type", "cast(null as timestamp_ntz) as deleted_at")
    assert {tuple(x) for x in M.duplicate_titles(df).collect()} == {(2, 1, 1.0)}


def test_unknown_orders_are_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        M.context_order(spark.range(1), "other")


def test_a_clean_up_goes_phase_by_phase(spark):
    new, old = T0, T0 - dt.timedelta(days=30)
    auto = "**What**: Auto-detected x"
    rows = [
        (1, "p", "decision", None, new, None, None, "t", "c"), (2, "p", "decision", None, old, None, T0 - dt.timedelta(days=1), "t", "c"), (3, "p", "decision", None, old, old, None, "t", "c"), (4, "p", "config", None, old, None, None, "t", "c"),
        (5, "p", "progress", None, old, None, None, "t", "c"), (6, "p", "progress", None, old, None, None, "t", "c"), (7, "p", "bugfix", None, old, None, None, "t", auto), (8, "p", "bugfix", None, old, None, None, "t", auto),
        (9, "p", "note", None, old, None, None, "CORRECTION: y", None), (10, "p", "decision", None, new, None, None, "Architecture choice: OK", "c"), (11, "p", "pattern", "k", new, None, None, "t", "c"), (12, "p", "pattern", "k", new, None, None, None, "c"),
        (13, "p", "bugfix", "k", old, None, None, "t", "c"), (14, "q", "bugfix", "k", old, None, None, "t", "c"), (15, "p", "session_summary", "k", old, None, None, "t", "c"), (16, "p", "session_summary", None, new, None, None, "t", "c"), (17, "p", "progress", None, new, None, None, "t", "c"),
    ]
    obs = spark.createDataFrame(rows, "id long, project string, type string, topic_key string, created_at timestamp_ntz, deleted_at timestamp_ntz, expires_at timestamp_ntz, title string, content string")
    rel = spark.createDataFrame([(1, 4, 0.6), (1, 13, 0.5), (3, 14, 0.9)], "source_id long, target_id long, confidence double")
    links = spark.createDataFrame([(7, 0.1), (8, 0.9)], "memory_id long, trust_score double")
    recalls = spark.createDataFrame([(6, 1), (5, 0)], "memory_id long, was_useful int")
    got = {r.id: (r.phase, r.kept_id) for r in M.cleaned(obs, rel, links, recalls).collect()}
    want = {2: "expired", 3: "deleted", 4: "superseded", 5: "stale", 7: "auto-detected", 9: "correction", 10: "noise", 15: "summary"}
    assert got == {k: (want.get(k), None) for k in range(1, 18) if k not in (11, 12, 13)} | {11: ("merged", 11), 12: ("consolidated", 11), 13: ("consolidated", 11)}
    assert M.cleaned(obs.limit(0), rel, links, recalls).count() == 0
