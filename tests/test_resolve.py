import pytest
from pyspark.sql import functions as F

from basalt.operators import graph as G
from basalt.operators import memory as M
from basalt.operators import patterns as P
from basalt.operators.resolve import resolve_calls

CALLS = "call long, repo int, file string, callee string, receiver string, owner string, line int"
SYMBOLS = "id long, repo int, file string, name string, kind string, owner string, qualified string"


def inputs(spark, calls):
    symbols = [
        (1, 1, "a", "run", "method", "A", "A.run"),
        (2, 1, "b", "run", "method", "B", "B.run"),
        (3, 1, "b", "B", "class", None, "B"),
        (4, 1, "b", "make", "function", None, "make"),
        (5, 1, "c", "make", "function", None, "make"),
        (6, 1, "c", "twice", "method", "T", "T.twice"),
        (7, 1, "d", "twice", "method", "T", "T.twice"),
        (8, 1, "e", "lone", "function", None, "lone"),
        (9, 2, "z", "lone", "function", None, "lone"),
        (10, 1, "c", "start", "method", "A", "A.start"),
    ]
    return {
        "calls": spark.createDataFrame(calls, CALLS),
        "symbols": spark.createDataFrame(symbols, SYMBOLS),
        "bindings": spark.createDataFrame([(1, "a", "build", "make", "b", False), (2, "a", "ns", "*", "b", False), (3, "a", "Klass", "B", "b", False), (4, "a", "again", "make", "b", True), (5, "a", "build", "make", "c", False)], "id long, file string, local string, original string, target string, reexport boolean"),
        "imports": spark.createDataFrame([("f", "c", 2), ("f", "b", 1)], "file string, target string, place int"),
        "parents": spark.createDataFrame([(1, "K", "B")], "repo int, name string, parent string"),
        "scopes": spark.createDataFrame([("a", "near", 1, 50, 1, 8, 0.98), ("a", "near", 10, 20, 2, 4, 0.9)], "file string, name string, first_line int, last_line int, depth int, symbol long, confidence double"),
    }


def test_every_rule(spark):
    calls = [
        (0, 1, "a", "near", None, None, 15), (1, 1, "a", "build", None, None, 1), (2, 1, "x", "start", "this", "A", 1), (3, 1, "d", "twice", "this", "T", 1), (4, 1, "x", "run", "super", "K", 1), (5, 1, "a", "make", "ns", None, 1),
        (6, 1, "a", "run", "Klass", None, 1), (7, 1, "x", "run", "B", None, 1), (8, 1, "f", "make", None, None, 1), (9, 1, "c", "make", None, None, 1), (10, 1, "x", "lone", None, None, 1), (11, 1, "x", "run", None, None, 1), (12, 1, "a", "again", None, None, 1), (13, 1, "a", "near", None, None, 40),
    ]
    got = {r.call: (r.rule, r.symbol, r.confidence) for r in resolve_calls(**inputs(spark, calls)).collect()}
    want = {0: (0, 4, 0.9), 1: (1, 4, 1.0), 2: (2, 10, 0.95), 3: (3, 7, 0.9), 4: (4, 2, 0.9), 5: (5, 4, 0.95), 6: (6, 2, 0.9), 7: (7, 2, 0.85), 8: (8, 4, 0.8), 9: (9, 5, 0.9), 10: (10, 8, 0.7), 11: (None, None, 0.5), 12: (None, None, 0.5), 13: (0, 8, 0.98)}
    assert got == want
    assert resolve_calls(**inputs(spark, calls[:0])).count() == 0


def test_patterns(spark):
    deep = "f(a, b = 1) {" + "{" * 5 + "}" * 6 + " a = 2; x = '{{{{{{'"
    rows = [(1, deep), (2, "try { x() } catch (e) { }\neval (y)"), (3, "  \n"), (4, "  for x\n  for y\n  while z"), (5, "key = 'my-API_KEY-1' // todo later 4 5 6 7 8"), (6, None), (7, "'" + "x\\'" * 50_000)]
    df = spark.createDataFrame(rows, "id long, body string").select("id", "body", F.col("body").alias("signature"), F.lit(1).alias("first_line"), F.when(F.col("id") == 6, 100).otherwise(1).alias("last_line"))
    got = {(r.id, r.rule): r.size for r in P.preset_hits(df).collect()}
    assert got == {(1, "deeply_nested"): 6, (1, "reassigned_param"): 2, (2, "empty_catch"): 1, (2, "eval_exec"): 1, (3, "empty_function"): 1, (4, "nested_loops"): 3, (5, "hardcoded_secret"): 1, (5, "todo_fixme"): 1, (5, "magic_number"): 5, (6, "god_function"): 100}
    assert {(r.id, r.pattern, r["size"]) for r in P.custom_hits(df, ["call:eval", "nesting:6", "string:for [xy]"]).collect()} == {(2, "call:eval", 1), (1, "nesting:6", 6), (4, "string:for [xy]", 2)}
    with pytest.raises(ValueError):
        P.custom_hits(df, ["depth:3"])


def test_needles_and_suggestions(spark):
    assert M.topic_needles(" The cache-reader. ./a/b. why ") == ["the cache-reader. ./a/b. why", "cache-reader", "a/b"]
    assert M.topic_needles("") == M.topic_needles(None) == [] and M.topic_needles("a " * 100) == [("a " * 100).strip()[:120]]
    df = spark.createDataFrame([(1, '{"edges": [{"entity_a": "x", "entity_b": "y"}, {"entity_a": "x"}]}'), (2, "none"), (3, None)], "id long, body string")
    assert [tuple(r) for r in G.suggested_edges(df, "body").collect()] == [(1, "y", "x", "APIContract", "", 0.5, False)]
