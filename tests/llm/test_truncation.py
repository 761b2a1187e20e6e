import random

import pytest

from basalt.llm import truncation as T

WHOLE = [
    "All is well.", "Is it?", "終わりました。", "Done. :)", "Done. 🎉", "Done.\n\n#score", "Done.\n(end of note)", "Done.\n\n-- memory bot", "Done.\n\nSee hooks/recall/session-file.py",
    "Title\n\n```sh\nmake x\n```", "A text.\n\n| a | b |\n|---|---|\n| 1 | 2 |", '{"a": 1}\n{"b": [1, 2]}', "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-  return a;\n+  return b;", "2026-01-01 10:00:00 INFO x done\n", 'He said "no."',
]
CUT = [
    "All is well. Then the", "Well. A commit pa�", "Well. Because ranking/share…[+520 chars]", "Well. It ignores the[…]", "Well. It was spli (cut)", "Title\n\n```sh\nmake x", "Text.\n\n| a | b |\n|---|---|\n| 1 | 2", '{"a": 1}\n{"b": [1,', "Text.\n\n## Sta", "Text.\n\n1. Do it.\n2.",
    "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-  return a;\n+  return b", "Text. After upgrading to 3.", "Text. It reads src/lib/tim.",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert T.ending(text)[0] == "whole"


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert T.ending(text)[0] == "cut"


def test_tables(spark):
    r = random.Random(1)
    words = "the cache reader polls every stale table once and then it stops".split()
    body = lambda: " ".join(r.choice(words) for _ in range(80)).capitalize()
    rows, k = [], 0
    for _ in range(40):
        rows.append((k := k + 1, (body() + ".")[: r.randint(60, 180)].rstrip(" .") + ".", "capped", "x"))
    dots = []
    for _ in range(12):
        dots.append(k := k + 1)
        rows.append((k, "Fine. " + body()[:191] + "...", "capped", "x"))
    rows.append((k := k + 1, "We will see. More later...", "capped", "x"))
    items = [f"- reads the table\n- reads store {n} of {words[n]}\n- polls the table" for n in range(5)] + ["- reads the table\n- same text\n- polls the table"] * 9
    rows += [(k := k + 1, "Head\n" + t, "lists", "x") for t in items]
    rows.append((cut := (k := k + 1), "Head\n- reads the store\n- reads the ta", None, "x"))
    rows += [(k := k + 1, t, "capped", "x") for t in (None, "", " \n\t", " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, state string")
    assert sorted(x.doc_id for x in T.truncated(df).collect()) == sorted([*dots, cut])
    assert T.truncated(df.limit(0)).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 200_000 + "end.", "s"), (2, "Word is. " * 100_000 + "and then", "s")], "doc_id long, text string, source string")
    assert [x.doc_id for x in T.truncated(df).collect()] == [2]


def test_limits_are_told_for_every_cut_text(spark):
    r = random.Random(2)
    body = lambda n: " ".join(r.choice("the cache reader polls every stale table once".split()) for _ in range(n)).capitalize()
    rows = [(k, f"In {k} " + body(9 + k) + ".", "s") for k in range(30)]
    rows += [(100 + k, f"Note {k}. " + body(60)[:150] + "[…]", "s") for k in range(9)] + [(200, "Well. Then the", "s"), (201, "Well. Then the", None)]
    rows += [(300 + k, f"Few {k}. " + body(60)[:150], "few") for k in range(4)]  # a source of few texts has a limit too
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x.at_limit for x in T.truncated(df).collect()}
    assert got == {**{100 + k: True for k in range(9)}, 200: False, 201: False, **{300 + k: True for k in range(4)}}


def test_a_mark_may_be_long():
    assert T.ending("Well. " + "[+ 52 chars " + "x" * 500 + "]")[0] == "cut"
