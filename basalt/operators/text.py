"""Texts: sections, links and terms of documents, command output, prompts, source lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ordered rules, the first that fits counts.
ROLES = [
    ("tutorial", "tutorial|getting.?started|quickstart|walkthrough"),
    ("api", "api|reference|endpoint|method"),
    ("how_to", "how.?to|guide|cookbook"),
    ("concept", "concept|overview|architecture|design|philosophy"),
    ("troubleshooting", "troubleshoot|debug|fix|common.?error|pitfall"),
    ("changelog", "changelog|release|history|what.?new"),
    ("faq", "faq|q&a|frequently"),
    ("example", "example|demo|sample|snippet"),
]
COMMANDS = [
    ("git-diff", r"^git\s+diff"),
    ("git-status", r"^git\s+status"),
    ("test", r"^(npm|pnpm|yarn|bun)\s+test|^(vitest|jest|mocha|pytest|cargo\s+test|go\s+test)"),
    ("install", r"^(npm|pnpm|yarn|bun)\s+(install|i|ci|add)"),
    ("file-read", r"^cat\s|^bat\s|^type\s|^head\s|^tail\s+-n\s+[0-9]+\s+"),
    ("list", r"^ls\s+|^tree|^find\s|^dir\s"),
    ("search", r"^grep\s|^rg\s|^ag\s|^ack\s|^ripgrep\s"),
    ("logs", r"^tail\s|^journalctl|^docker\s+logs|^pm2\s+logs|^kubectl\s+logs"),
]
COMMITS = [
    ("creation", r"^initial commit|first commit"),
    ("feature", r"^add\b|^implement\b|^create\b"),
    ("bugfix", r"\bfix(es)?\b|\bbug\b|\bhotfix\b|\bpatch\b"),
    ("refactor", r"\brefactor\b|\bclean\s*up\b|\breorganize\b"),
    ("perf", r"\bperf(ormance)?\b|\boptimize\b|\bspeed\b"),
    ("rename", r"\brename\b|\bmove\b|\brelocate\b"),
    ("revert", r"\brevert\b|\brollback\b"),
]


def first_rule(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    out = None
    for name, pattern in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line. A null text has no lines."""
    return df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, level, title, first_line, size: the parts of a Markdown text from one heading to the next; what stands before the first is section 0.

    Lines inside fenced code are no headings. The window runs over one text's lines, so its size is bounded by the text.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    x = lines(df, key, text).withColumn("fences", F.sum(F.when(F.col("line").rlike("^```"), 1).otherwise(0)).over(w))
    x = x.withColumn("head", (F.col("fences") % 2 == 0) & F.col("line").rlike("^#{1,6} +[^ ]"))
    x = x.withColumn("section", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(w))
    g = x.groupBy(key, "section").agg(
        F.max(F.when(F.col("head"), F.length(F.regexp_extract("line", "^(#+)", 1))).otherwise(0)).alias("level"),
        F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", "^#+ +", "")))).alias("title"),
        F.min("line_no").alias("first_line"),
        F.count(F.lit(1)).alias("size"),
    )
    return g


def section_bodies(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, title (null before the first heading), body: the parts of a Markdown text with their own lines. A part is as long as its text at most."""
    w = Window.partitionBy(key).orderBy("line_no")
    x = lines(df, key, text).withColumn("fences", F.sum(F.when(F.col("line").rlike("^```"), 1).otherwise(0)).over(w))
    x = x.withColumn("head", (F.col("fences") % 2 == 0) & F.col("line").rlike("^#{1,6} +[^ ]"))
    x = x.withColumn("section", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(w))
    own = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line"))))
    g = x.groupBy(key, "section").agg(F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", "^#+ +", "")))).alias("title"), own.alias("own"))
    return g.select(key, "section", "title", F.array_join(F.transform("own", lambda r: r["line"]), "\n").alias("body"))


def section_parents(sectioned: DataFrame, key: str) -> DataFrame:
    """sectioned with parent: the last section before it of a smaller level, if any. One look back per level, no pairs."""
    w = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == lv, F.col("section"))).over(w) for lv in range(1, 6)]
    none = F.lit(-1).cast("long")
    above = F.greatest(*(F.when(F.col("level") > lv, F.coalesce(last[lv - 1], none)).otherwise(none) for lv in range(1, 6)))
    return sectioned.withColumn("parent", F.when((F.col("level") > 0) & (above >= 0), above))


def log_summary(df: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """key, shape, times, first_line: the most frequent shapes of log lines (numbers and times left out)."""
    shape = F.trim(F.regexp_replace(F.regexp_replace("line", "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]+ ", ""), "[0-9]+", "#"))
    g = lines(df, key, text).withColumn("shape", shape).filter("shape <> ''").groupBy(key, "shape").agg(F.count(F.lit(1)).alias("times"), F.min("line_no").alias("first_line"))
    w = Window.partitionBy(key).orderBy(F.desc("times"), "first_line")
    return g.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).drop("place")


def head_and_tail(df: DataFrame, key: str, text: str, head: int = 120, tail: int = 80, important: str | None = None, most: int = 50) -> DataFrame:
    """key, line_no, part, line: the first and last lines of each text, and the first of the important lines between them; a text no longer than both is kept whole."""
    w = Window.partitionBy(key)
    hit = F.col("line").rlike(important) if important else F.lit(False)
    x = lines(df, key, text).withColumn("n", F.max("line_no").over(w)).withColumn("hit", hit)
    x = x.withColumn("k", F.sum(F.col("hit").cast("int")).over(w.orderBy("line_no")))
    part = F.when((F.col("n") <= head + tail) | (F.col("line_no") <= head), "head").when(F.col("line_no") > F.col("n") - tail, "tail").when(F.col("hit") & (F.col("k") <= most), "important")
    return x.withColumn("part", part).filter("part IS NOT NULL").select(key, "line_no", "part", "line")


def added_lines(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, line, added: lines by how many more of them the new text has than the old one (as multisets). old, new: key, line."""
    n = F.count(F.lit(1))
    a, b = old.groupBy(key, "line").agg(n.alias("was")), new.groupBy(key, "line").agg(n.alias("now"))
    x = b.join(a, [key, "line"], "left").withColumn("added", F.col("now") - F.coalesce("was", F.lit(0)))
    return x.filter("added > 0").select(key, "line", "added")


def name_status(df: DataFrame, text: str) -> DataFrame:
    """path, status of a zero-separated name-status listing: a rename gives both sides, a copy its new side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, states = [], []
            for t in batch.column(0).to_pylist():
                parts, at = (t or "").split("\0"), 0
                while at + 1 < len(parts) and parts[at]:
                    s = parts[at][0]
                    two = s in "RC"
                    for p in parts[at + 1 + (s == "C") : at + 2 + two]:
                        paths.append(p)
                        states.append(s)
                    at += 3 if two else 2
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(states, pa.string())], names=["path", "status"])

    return df.select(text).mapInArrow(run, "path string, status string")


def coverage_hits(df: DataFrame, text: str) -> DataFrame:
    """path, function, line, hits of coverage reports: JSON objects of path to {fnMap, f}."""
    kind = "map<string, struct<fnMap: map<string, struct<name: string, line: int>>, f: map<string, bigint>>>"
    files = df.select(F.explode(F.from_json(text, kind)).alias("path", "c"))
    fn = files.select("path", "c.f", F.explode("c.fnMap").alias("k", "fn"))
    return fn.select("path", F.col("fn.name").alias("function"), F.col("fn.line").alias("line"), F.coalesce(F.try_element_at("f", "k"), F.lit(0)).alias("hits"))


def compact(df: DataFrame, path: str, others: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows as 'prefix|rest|other fields' with directory prefixes in a table of their own, which reads back to the same rows."""
    prefix = F.regexp_extract(path, "^(.*/)?", 0)
    table_ = df.select(prefix.alias("prefix")).distinct().withColumn("code", F.substring(F.sha2("prefix", 256), 1, 12))
    escape = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
    rest = F.substring(F.col(path), F.length(prefix) + 1, F.length(path))
    row = F.concat_ws("|", F.substring(F.sha2(prefix, 256), 1, 12), F.replace(F.replace(rest, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p")), *(F.coalesce(escape(c), F.lit("\\0")) for c in others))
    return df.select(row.alias("row")), table_


def expand(rows: DataFrame, prefixes: DataFrame, path: str, others: list[str]) -> DataFrame:
    """The rows that compact() made, as strings."""
    p = F.split("row", r"\|")
    back = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\\\"), F.lit("\0")), F.lit("\\p"), F.lit("|")), F.lit("\0"), F.lit("\\"))
    x = rows.select(p[0].alias("code"), back(p[1]).alias("rest"), *(F.when(p[i + 2] != "\\0", back(p[i + 2])).alias(c) for i, c in enumerate(others)))
    return x.join(prefixes, "code").select(F.concat("prefix", "rest").alias(path), *others)
