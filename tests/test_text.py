import json

from pyspark.sql import functions as F

from basalt.operators import memory as M
from basalt.operators import text as T


def test_name_status(spark):
    df = spark.createDataFrame([("M\0a.js\0R100\0old.js\0new.js\0C75\0src.js\0copy.js\0D\0gone.js\0",), (None,), ("",)], "t string")
    assert [tuple(r) for r in T.name_status(df, "t").collect()] == [("a.js", "M"), ("old.js", "R"), ("new.js", "R"), ("copy.js", "C"), ("gone.js", "D")]


def test_coverage(spark):
    doc = {"/a.js": {"fnMap": {"0": {"name": "f", "line": 3}, "1": {"name": "g", "line": 9}}, "f": {"0": 12}}}
    got = T.coverage_hits(spark.createDataFrame([(json.dumps(doc),), ("no json",), (None,)], "t string"), "t").collect()
    assert {tuple(r) for r in got} == {("/a.js", "f", 3, 12), ("/a.js", "g", 9, 0)}


def test_compact_round_trip(spark):
    rows = [("a/b|c/x\\y|.js", "n|1", None), ("plain.js", "", "\\p\\0"), ("a/", "p", "q|"), ("a/b|c/z", "\\", "\\\\p")]
    df = spark.createDataFrame(rows, "path string, a string, b string")
    assert {tuple(r) for r in T.expand(*T.compact(df, "path", ["a", "b"]), "path", ["a", "b"]).collect()} == set(rows)


def test_sections_skip_code(spark):
    df = spark.createDataFrame([(1, "intro\n# A\ntext\n```sh\n# no heading\n```\n## B\r\nx\n### C\n# D"), (2, None), (3, "")], "id long, t string")
    s = T.section_parents(T.sections(df, "id", "t"), "id")
    got = {(r.id, r.section): (r.level, r.title, r.parent) for r in s.collect()}
    assert got == {(1, 0): (0, None, None), (1, 1): (1, "A", None), (1, 2): (2, "B", 1), (1, 3): (3, "C", 2), (1, 4): (1, "D", None), (3, 0): (0, None, None)}


def test_query_terms():
    assert M.query_terms("Where is the Snapshot-cleaner of a snapshot in file_x?") == ["snapshot", "cleaner"]
    assert M.query_terms("the of and") == []


def test_ttl(spark):
    df = spark.createDataFrame([(x,) for x in ["12h", "7d", " 2W ", "1m", "0d", "x", None, "5y"]], "t string").withColumn("now", F.lit("2026-01-01").cast("timestamp_ntz"))
    assert [str(r[0])[:13] for r in df.select(M.ttl_until(F.col("t"), F.col("now"))).collect()] == ["2026-01-01 12", "2026-01-08 00", "2026-01-15 00", "2026-01-31 00", "None", "None", "None", "None"]


def test_packing_falls_back(spark):
    rows = [("p", 1, 1, "t" * 7, "c" * 693), ("p", 2, 2, "t" * 35, "c" * 700), ("p", 3, 3, "t" * 7, "c" * 1000), ("q", 1, 4, None, "c" * 9999)]
    df = spark.createDataFrame(rows, "g string, pos int, id long, title string, content string")
    got = {r.id: (r["mode"], r.tokens) for r in M.pack_budget(df, "g", 245).collect()}
    assert got[1] == ("full", 200) and got[2] == ("cut", 39) and got[3] == ("head", 2) and got[4][0] == "full"


def test_unanswerable_query(spark):
    o = spark.createDataFrame([], "id long, title string, content string, type string, project string, scope string, created_at timestamp_ntz, expires_at timestamp_ntz, deleted_at timestamp_ntz")
    l = spark.createDataFrame([], "memory_id long, trust_score double")
    r = spark.createDataFrame([], "memory_id long, was_useful int")
    assert M.ranked_search(o, l, r, "the", "p").count() == 0
    assert M.ranked_search(o, l, r, "snapshot cleaner", "p").count() == 0
