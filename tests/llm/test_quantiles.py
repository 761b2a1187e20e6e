import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from basalt.llm import quantiles as Q

PS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def off(values, p, value):
    v = np.sort(values)
    want = max(1, math.ceil(p * len(v)))
    return max(np.searchsorted(v, value, "left") + 1 - want, want - np.searchsorted(v, value, "right"), 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-1e6, 1e6), max_size=300), min_size=1, max_size=12))
def test_error_stays_within_its_bound(parts):
    every = np.array([x for p in parts for x in p])
    total = Q.Sketch(8)
    for p in parts:
        s = Q.Sketch(8)
        s.add(np.array(p, float))
        total.merge(Q.Sketch.of_row(dict(zip(("n", "error", "collapses", "lowest", "highest", "rest", "levels", "buffers"), s.row(), strict=True)), 8))
    assert total.n == len(every)
    for p, v in zip(PS, total.percentiles(PS), strict=True):
        assert v is None if not len(every) else off(every, p, v) <= total.error


def test_sorted_input_and_bound():
    s = Q.Sketch(64)
    for k in range(0, 100_000, 1000):
        s.add(np.arange(k, k + 1000, dtype=float))
    assert s.error <= 100_000 * math.log2(100_000 / 64) / 128
    assert all(off(np.arange(100_000.0), p, v) <= s.error for p, v in zip(PS, s.percentiles(PS), strict=True))
    assert s.held() < 64 * 14


def test_tables(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice(["d1", "d2", None]), r.choice([r.random(), None, float("nan"), 5.0]), r.choice([r.randint(-9, 9), None]), 1) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, day string, x double, n long, metric int")
    days = Q.sketches(df.drop("metric"), ["g", "day"], ["x", "n"], k=16)
    got = {(o.g, o.metric, o.percentile): o for o in Q.percentiles(Q.merge_sketches(days, ["g", "metric"], 16), ["g", "metric"], PS, 16).collect()}
    for g in ("a", "b", None):
        for i, m in ((2, "x"), (3, "n")):
            v = np.array([row[i] for row in rows if row[0] == g and row[i] is not None and row[i] == row[i]], float)
            for p in PS:
                o = got[g, m, p]
                assert o.n == len(v) and off(v, p, o.value) <= o.rank_error * o.n + 1e-9
    assert len(got) == 3 * 2 * len(PS)


def test_empty(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    assert Q.sketches(df, ["g"], ["x"]).count() == 0
    assert Q.percentiles(Q.sketches(df.limit(0), ["g"], ["x"]), ["g", "metric"], PS).count() == 0
