"""Queries of the readers of text: listings, logs, coverage, imports, pages and checker output, made of the tables' rows so that SQL knows what they say."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import text as T
from ..sources import files as S
from ..sources import views as V
from ..sources.tables import table
from .texts import _LINES, _case

QUERIES: dict = {}
SQL: dict = {}


def _add(name: str, sql: str | None = None, *needs: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = V.sql(sql, *needs)
        return f

    return put


def _text(c):
    return F.col(c).cast("string")


@_add(
    "s9_name_status",
    """SELECT path, CASE id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'R' ELSE 'C' END AS status FROM (SELECT id, CASE WHEN id % 3 = 2 THEN 'copy/' || path ELSE path END AS path FROM files) x
       UNION ALL SELECT 'old/' || path, 'R' FROM files WHERE id % 3 = 1""",
    "files",
)
def s9(spark, d):
    """Paths of a listing of changes: both sides of a rename, the new side of a copy."""
    k, end = F.col("id") % 3, F.lit("\0")
    one = F.when(k == 0, F.concat(F.lit("M\0"), "path", end)).when(k == 1, F.concat(F.lit("R90\0old/"), "path", end, "path", end)).otherwise(F.concat(F.lit("C75\0"), "path", F.lit("\0copy/"), "path", end))
    return T.name_status(V.files(spark, d).select(one.alias("t")), "t")


@_add("s8_commit_log", 'SELECT DISTINCT commit_id::VARCHAR AS "commit", file_id || \'.js\' AS path FROM commits', "commits")
def s8(spark, d):
    """Commits and their files of a log's text. A commit of the tables has few files."""
    g = V.commits(spark, d).groupBy("commit_id").agg(F.array_sort(F.collect_set(F.concat(_text("file_id"), F.lit(".js")))).alias("f"))
    return S.commit_files(g.select(F.concat(F.lit("COMMIT:"), _text("commit_id"), F.lit("\n\n"), F.array_join("f", "\n")).alias("t")), "t").distinct()


@_add("s12_coverage", "SELECT path, 'f' || id AS \"function\", cyclomatic::INT AS line, id % 5 AS hits FROM files UNION ALL SELECT path, 'never', 1, 0 FROM files", "files")
def s12(spark, d):
    """Functions of coverage reports with their hits; one that the report doesn't count has none."""
    text = F.concat(F.lit('{"'), "path", F.lit('": {"fnMap": {"0": {"name": "f'), _text("id"), F.lit('", "line": '), _text("cyclomatic"), F.lit('}, "1": {"name": "never", "line": 1}}, "f": {"0": '), (F.col("id") % 5).cast("string"), F.lit("}}}"))
    return T.coverage_hits(V.files(spark, d).select(text.alias("t")), "t")


@_add(
    "g1_import_edges",
    """SELECT id, 1 AS line_no, 'import' AS kind, './m' || id AS module FROM files UNION ALL SELECT id, 2, 're-export', '../y' FROM files UNION ALL SELECT id, 3, 'require', 'z' || (id % 7) FROM files
       UNION ALL SELECT id, 3, 'dynamic', './lazy' FROM files UNION ALL SELECT id, 4, 'import', './side.css' FROM files""",
    "files",
)
def g1(spark, d):
    """Imports of source texts: statements, re-exports, calls of require and dynamic ones."""
    code = F.concat(F.lit("import a from './m"), _text("id"), F.lit("'\nexport { b } from \"../y\"\nconst z = require('z"), (F.col("id") % 7).cast("string"), F.lit("'), w = import('./lazy')\nimport './side.css'"))
    return S.import_statements(V.files(spark, d).select("id", code.alias("t")), "id", "t")


@_add(
    "d2_html_sections",
    """SELECT id, 1 AS section, 1 AS level, 'Page ' || id || ' one' AS title, 'see a' AS body, '/p/' || id AS links FROM files UNION ALL SELECT id, 2, 2, 'Sub', 'tail', '' FROM files""",
    "files",
)
def d2(spark, d):
    """Sections and links of pages, without what only scripts and styles hold."""
    page = F.concat(F.lit("<style>h1{}</style><h1>Page "), _text("id"), F.lit(" <b>one</b></h1><p>see <a href='/p/"), _text("id"), F.lit("'>a</a><h2>Sub</h2>tail<script>var x</script>"))
    return S.html_sections(V.files(spark, d).select("id", page.alias("t")), "id", "t").withColumn("links", F.array_join("links", " "))


@_add(
    "v5_checker_findings",
    "SELECT id, path, cyclomatic::INT AS line, 'TS2304' AS code, 'Cannot find name ' || id AS message FROM files UNION ALL SELECT id, path, 7, 'E501', 'too long' FROM files WHERE id % 2 = 0",
    "files",
)
def v5(spark, d):
    """Findings of two kinds of checkers."""
    out = F.concat("path", F.lit("("), _text("cyclomatic"), F.lit(",5): error TS2304: Cannot find name "), _text("id"), F.lit("\nFound 1 error."), F.when(F.col("id") % 2 == 0, F.concat(F.lit("\n"), "path", F.lit(":7:1: E501 too long"))).otherwise(""))
    return S.checker_findings(V.files(spark, d).select("id", out.alias("t")), "id", "t")


@_add(
    "s18_reparse",
    """WITH v AS (SELECT id, stable_symbol_id, sha256(coalesce(signature, '') || '|' || start_line || '|' || end_line) AS h, lag(sha256(coalesce(signature, '') || '|' || start_line || '|' || end_line)) OVER w AS was FROM code_symbols WINDOW w AS (PARTITION BY stable_symbol_id ORDER BY indexed_at NULLS FIRST, id))
       SELECT id, CASE WHEN was IS NULL THEN 'new' WHEN was <> h THEN 'reparse' ELSE 'unchanged' END AS decision FROM v""",
)
def s18(spark, d):
    """Whether a symbol that is indexed anew has to be parsed anew: only if its content's hash differs from the stored one."""
    w = Window.partitionBy("stable_symbol_id").orderBy(F.col("indexed_at").asc_nulls_first(), "id")
    h = F.sha2(F.concat_ws("|", F.coalesce("signature", F.lit("")), _text("start_line"), _text("end_line")), 256)
    x = table(spark, d, "code_symbols").select("id", "stable_symbol_id", "indexed_at", h.alias("h")).withColumn("was", F.lag("h").over(w))
    return x.select("id", F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("h"), "reparse").otherwise("unchanged").alias("decision"))


_BODIES = _LINES + r""", a AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM l), b AS (SELECT *, fences % 2 = 0 AND regexp_matches(line, '^#{1,6} +[^ ]') AS head FROM a),
  c AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM b),
  s AS (SELECT doc_id, section, max(CASE WHEN head THEN trim(regexp_replace(line, '^#+ +', '')) END) AS title, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT head), '') AS body FROM c GROUP BY ALL)"""


@_add("d3_roles", f"WITH {_BODIES} SELECT {_case("lower(title || ' ' || left(body, 200))", T.ROLES, 'other')} AS role, count(*) AS sections FROM s WHERE title IS NOT NULL GROUP BY 1")
def d3(spark, d):
    """Sections by role, told by the title and the first 200 characters of the content."""
    s = T.section_bodies(table(spark, d, "documents"), "doc_id", "text").filter("title IS NOT NULL")
    head = F.lower(F.concat_ws(" ", "title", F.substring("body", 1, 200)))
    return s.groupBy(T.first_rule(head, T.ROLES, "other").alias("role")).agg(F.count(F.lit(1)).alias("sections"))


@_add("a11_duplicate_sections", f"WITH {_BODIES} SELECT substr(sha256(title || chr(10) || body), 1, 16) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM s WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a11(spark, d):
    """Sections whose title and content another section has too."""
    s = T.section_bodies(table(spark, d, "documents"), "doc_id", "text").filter("title IS NOT NULL")
    h = F.substring(F.sha2(F.concat_ws("\n", "title", "body"), 256), 1, 16)
    return s.groupBy(h.alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@_add(
    "a18_top_savings",
    """SELECT command_type, count(*) AS runs, sum(original_chars::HUGEINT)::DOUBLE AS original, sum(estimated_saved_tokens::HUGEINT)::DOUBLE AS saved, round(avg(savings_percent), 6) AS avg_percent FROM token_saver_runs GROUP BY 1 ORDER BY saved DESC NULLS LAST, command_type LIMIT 10""",
)
def a18(spark, d):
    """The ten types of commands that save most."""
    g = table(spark, d, "token_saver_runs").groupBy("command_type").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("original_chars").cast("decimal(38,0)")).cast("double").alias("original"), F.sum(F.col("estimated_saved_tokens").cast("decimal(38,0)")).cast("double").alias("saved"), F.round(F.avg("savings_percent"), 6).alias("avg_percent"))
    return g.orderBy(F.col("saved").desc_nulls_last(), "command_type").limit(10)
