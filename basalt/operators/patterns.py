"""Source bodies held against rules: presets and patterns of the form kind:value."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names, severities and least sizes of the presets.
PRESETS = {
    "empty_catch": "warning",
    "empty_function": "warning",
    "deeply_nested": "warning",
    "nested_loops": "warning",
    "god_function": "info",
    "eval_exec": "error",
    "hardcoded_secret": "error",
    "todo_fixme": "info",
    "magic_number": "info",
    "reassigned_param": "warning",
}
DEEP, LONG, LOOPS, NUMBERS, LARGE = 5, 100, 3, 5, 99
DECISIONS = [r"\bfor\b", r"\bwhile\b", r"\bdo\b", r"\bcase\b", r"\bcatch\b", "&&", r"\|\|", r"\?\?"]
EMPTY_CATCH = r"catch\s*\([^)]*\)\s*\{\s*\}"
EVAL = r"\beval\s*\(|\bFunction\s*\("
SECRET_WORD = r"(password|api[_-]?key|secret|token)"
SECRET = "|".join(rf"{q}[^\n]*{SECRET_WORD}[^\n]*{q}" for q in ("'", '"', "`"))
TODO = r"//\s*(TODO|FIXME|HACK)\b"


def _has_secret(body: Column) -> Column:
    """Whether a line has such a word between its first and last quote of a kind; each line is read a few times, however many quotes it has."""

    def between(line: Column, q: str) -> Column:
        first, last = F.instr(line, q), F.length(line) - F.instr(F.reverse(line), q) + 1
        return (first > 0) & (last > first) & F.substr(line, first + 1, F.greatest(last - first - 1, F.lit(0))).rlike("(?i)" + SECRET_WORD)

    return F.exists(F.split(body, "\n"), lambda x: between(x, "'") | between(x, '"') | between(x, "`"))


def nesting_depth(body: Column) -> Column:
    """How deep braces nest, those inside quoted strings apart; a closing brace too many counts as none."""
    bare = F.regexp_replace(F.regexp_replace(body, r"\\.", ""), r"'[^']*'|\"[^\"]*\"", "")
    braces = F.regexp_replace(bare, r"[^{}]", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = F.when(c == "{", acc["now"] + 1).when(c == "}", F.greatest(acc["now"] - 1, F.lit(0))).otherwise(acc["now"])
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(braces, ""), zero, step)["most"]


def complexity(body: Column) -> Column:
    """1 and the decisions of a body: branches, loops, cases, handlers, short circuits and conditional expressions."""
    n = F.lit(1) + F.regexp_count(body, F.lit(r"if\b"))  # an if behind else counts once
    for p in DECISIONS:
        n = n + F.regexp_count(body, F.lit(p))
    return n + F.regexp_count(body, F.lit(r"\?\s*[^.:?]"))


def _loops(body: Column) -> Column:
    """i for each indented line with a loop and z for each other one, in order."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"\b(for|while|do)\b"))
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^\s"), "i").otherwise("z")), "")


def _numbers(body: Column) -> Column:
    """Numbers that stand by themselves, but the smallest: two digits and more, or 3 to 9."""
    words = F.split(body, r"[^a-zA-Z0-9_.]+")
    return F.filter(words, lambda w: w.rlike(r"^([0-9]{2,}|[3-9])$"))


def preset_hits(bodies: DataFrame) -> DataFrame:
    """id, rule, severity, size: the presets that a body meets, and by how much. bodies: id, body, signature, first_line, last_line (null bodies meet the rule of length only)."""
    b = F.col("body")
    loops = _loops(b)
    numbers = _numbers(b)
    large = F.size(F.filter(numbers, lambda w: F.length(w) > 2))
    length = F.col("last_line") - F.col("first_line") + 1
    # one parameter a letter or digit word; what stands behind a colon or an equals sign is its type or default
    params = F.filter(F.transform(F.split(F.regexp_extract("signature", r"\(([^)]*)\)", 1), ","), lambda p: F.regexp_extract(p, r"^\s*(\w+)\s*([:=].*)?$", 1)), lambda p: p != "")
    again = F.aggregate(params, F.lit(0), lambda n, p: n + F.regexp_count(b, F.concat(F.lit(r"\b"), p, F.lit(r"\s*=([^=]|$)"))))
    sizes = {
        "empty_catch": F.regexp_count(b, F.lit(EMPTY_CATCH)),
        "empty_function": F.when(F.trim(F.regexp_replace(b, r"\s+", "")) == "", 1),
        "deeply_nested": F.when(nesting_depth(b) >= DEEP, nesting_depth(b)),
        "nested_loops": F.when(loops.rlike("^iii|zii"), F.length(F.regexp_extract(loops, "(^i{3,}|zi{2,})", 1))),
        "god_function": F.when(length >= LONG, length),
        "eval_exec": F.regexp_count(b, F.lit(EVAL)),
        "hardcoded_secret": F.when(_has_secret(b), 1),
        "todo_fixme": F.regexp_count(b, F.lit("(?i)" + TODO)),
        "magic_number": F.when((large > 0) | (F.size(numbers) >= NUMBERS), F.size(numbers)),
        "reassigned_param": again,
    }
    every = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(PRESETS[k]).alias("severity"), v.cast("int").alias("size")) for k, v in sizes.items()))
    return bodies.select("id", F.explode(F.filter(every, lambda x: x["size"] > 0)).alias("x")).select("id", "x.*")


def custom_hits(bodies: DataFrame, patterns: list[str]) -> DataFrame:
    """id, pattern, size: bodies that meet patterns call:name, string:regex, nesting:depth or lines:number. Another kind, or no number where one is due, is an error."""
    found = []
    for p in patterns:
        kind, colon, value = p.partition(":")
        if not colon or kind not in ("call", "string", "nesting", "lines"):
            raise ValueError(f"no pattern of call, string, nesting or lines: {p}")
        if kind in ("nesting", "lines"):
            n = nesting_depth(F.col("body")) if kind == "nesting" else F.col("last_line") - F.col("first_line") + 1
            size = F.when(n >= int(value), n)
        else:
            size = F.regexp_count("body", F.lit(rf"\b{re.escape(value)}\s*\(" if kind == "call" else value))
        found.append(F.struct(F.lit(p).alias("pattern"), size.cast("int").alias("size")))
    return bodies.select("id", F.explode(F.filter(F.array(*found), lambda x: x["size"] > 0)).alias("x")).select("id", "x.*")
