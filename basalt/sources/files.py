"""Files and command output as tables: a repository scan, commit logs, import statements, HTML, checker reports."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED_DIRS = ("node_modules", ".git", "dist", "build", "coverage", "__pycache__", "target", "vendor")
CODE_SUFFIXES = ("js", "mjs", "cjs", "ts", "tsx", "jsx", "py", "rs", "go", "sql", "html")


def scan_files(spark: SparkSession, root: str, most_bytes: int = 1_000_000, suffixes: tuple[str, ...] = CODE_SUFFIXES) -> DataFrame:
    """path, size, content (null if skipped), reason: every file below root, and why it is skipped (ignored, suffix, secret, lock, size, binary).

    Names are judged before contents, so what a name rules out isn't kept. The engine lists neither empty files nor names that begin with a dot.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    p = F.lower("path")
    named = (
        F.when(p.rlike("/(" + "|".join(re.escape(d) for d in IGNORED_DIRS) + ")/"), "ignored")
        .when(p.rlike(r"/\.env[^/]*$|\.(pem|key|p12)$|/id_rsa[^/]*$"), "secret")
        .when(p.rlike(r"/(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock)$|\.min\.js$"), "lock")
        .when(~p.rlike(r"\.(" + "|".join(suffixes) + ")$"), "suffix")
        .when(F.col("length") > most_bytes, "size")
    )
    reason = F.coalesce(named, F.when(F.expr("position(X'00' in content) > 0"), "binary"))
    return files.select("path", F.col("length").alias("size"), F.when(reason.isNull(), F.decode("content", "UTF-8")).alias("content"), reason.alias("reason"))


def commit_files(df: DataFrame, text: str) -> DataFrame:
    """commit, path of logs in which a line COMMIT:<hash> stands before the names of its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for t in batch.column(0).to_pylist():
                now = None
                for line in (t or "").splitlines():
                    line = line.strip()
                    if line.startswith("COMMIT:"):
                        now = line[7:]
                    elif line and now:
                        out.add((now, line))
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["commit", "path"])

    return df.select(text).mapInArrow(run, "commit string, path string")


_IMPORTS = (
    ("import", r"^\s*import\s[^'\"\n]*?from\s*['\"]([^'\"\n]+)['\"]|^\s*import\s*['\"]([^'\"\n]+)['\"]"),
    ("re-export", r"^\s*export\s[^'\"\n]*?from\s*['\"]([^'\"\n]+)['\"]"),
    ("require", r"\brequire\(\s*['\"]([^'\"\n]+)['\"]\s*\)"),
    ("dynamic", r"\bimport\(\s*['\"]([^'\"\n]+)['\"]\s*\)"),
)


def import_statements(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, kind, module: imports in source text, each module once a line. Lines are split in the engine and matched there."""
    lines = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("p", "line"))
    found = []
    for kind, pattern in _IMPORTS:
        groups = pattern.count("([^")
        mods = F.concat(*(F.regexp_extract_all("line", F.lit(pattern), F.lit(g + 1)) for g in range(groups)))
        found.append(_tagged(mods, kind))
    x = lines.select(key, (F.col("p") + 1).alias("line_no"), F.explode(F.array_distinct(F.concat(*found))).alias("i"))
    return x.select(key, "line_no", "i.kind", "i.module")


def _tagged(mods, kind: str):
    return F.transform(F.filter(mods, lambda m: m != ""), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("module")))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.sections: list[list] = [[0, [], []]]
        self.links: list[tuple[int, str]] = []
        self.silent, self.head = 0, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.sections.append([int(tag[1]), [], []])
            self.head = tag
        elif tag == "a" and (to := dict(attrs).get("href")):
            self.links.append((len(self.sections) - 1, to))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == self.head:
            self.head = None

    def handle_data(self, data):
        if not self.silent:
            self.sections[-1][1 if self.head else 2].append(data)


def html_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, level, title, body, links: parts of HTML texts from heading to heading, without scripts and styles."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = _Page()
                page.feed(t or "")
                page.close()
                links: dict[int, list[str]] = {}
                for at, to in page.links:
                    links.setdefault(at, []).append(to)
                for n, (level, *parts) in enumerate(page.sections):
                    title, body = map("".join, parts)
                    if n or body.strip():
                        rows.append((k, n, level, " ".join(title.split()), " ".join(body.split()), links.get(n, [])))
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[key, "section", "level", "title", "body", "links"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, section int, level int, title string, body string, links array<string>")


def checker_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, line, code, message of compiler lines such as ``a/b.ts(3,5): error TS2304: ...`` or ``a/b.py:3:5: E501 ...``."""
    lines = df.filter(F.col(text).isNotNull()).select(key, F.explode(F.split(text, "\r?\n")).alias("line"))
    a, b = r"^(\S+)\((\d+),\d+\): error (\w+): (.*)$", r"^(\S+?):(\d+):\d+: (\w+) (.*)$"
    pick = lambda g: F.coalesce(F.nullif(F.regexp_extract("line", a, g), F.lit("")), F.nullif(F.regexp_extract("line", b, g), F.lit("")))
    return lines.select(key, pick(1).alias("path"), pick(2).try_cast("int").alias("line"), pick(3).alias("code"), pick(4).alias("message")).filter("path IS NOT NULL")
