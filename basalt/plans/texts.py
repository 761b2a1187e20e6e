"""Queries over documents, prompts, commands and source lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import text as T
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _case(text: str, rules: list, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{other}' END"


_LINES = r"l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)"
_SECTIONS = _LINES + r""", a AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM l),
  b AS (SELECT *, fences % 2 = 0 AND regexp_matches(line, '^#{1,6} +[^ ]') AS head FROM a), c AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM b),
  s AS (SELECT doc_id, section::BIGINT AS section, max(CASE WHEN head THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 0 END) AS level, max(CASE WHEN head THEN trim(regexp_replace(line, '^#+ +', '')) END) AS title, min(line_no) AS first_line, count(*) AS size FROM c GROUP BY ALL)"""


@_add("d1_sections", f"WITH {_SECTIONS} SELECT * FROM s")
def d1(spark, d):
    return T.sections(table(spark, d, "documents"), "doc_id", "text")


@_add("d4_section_parents", f"WITH {_SECTIONS} SELECT x.doc_id, x.section, (SELECT max(y.section) FROM s y WHERE y.doc_id = x.doc_id AND y.section < x.section AND y.level < x.level AND y.level > 0) AS parent FROM s x WHERE x.level > 0")
def d4(spark, d):
    return T.section_parents(d1(spark, d), "doc_id").filter("level > 0").select("doc_id", "section", "parent")


@_add("a31_outline", f"WITH {_SECTIONS} SELECT d.doc_id, count(s.section) AS sections FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND s.level > 0 GROUP BY d.doc_id")
def a31(spark, d):
    s = d1(spark, d).filter("level > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "documents").select("doc_id").join(s, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("sections"))


@_add("d6_links", r"WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9._/?=&%-]+')) AS url FROM documents) SELECT doc_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM u")
def d6(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("https?://[A-Za-z0-9._/?=&%-]+"), F.lit(0))).alias("url"))
    return x.withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))


_PATHS = "(?:[a-z]+/)+[a-z-]+[.](?:md|sql|mjs|js|ts|py|rs|go)"


@_add(
    "d7_backlinks",
    f"WITH u AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_PATHS}')) AS path FROM documents) SELECT u.path, count(*) AS docs, (SELECT count(*) FROM code_symbols s WHERE s.file_path = u.path) AS symbols FROM u GROUP BY u.path",
)
def d7(spark, d):
    u = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_PATHS), F.lit(0))).alias("path")).distinct()
    s = table(spark, d, "code_symbols").groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("symbols"))
    return u.groupBy("path").agg(F.count(F.lit(1)).alias("docs")).join(s, "path", "left").select("path", "docs", F.coalesce("symbols", F.lit(0)).alias("symbols"))


@_add("d8_glossary", r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\*\*([A-Za-z]+)\*\*:', 1)) AS term FROM documents) SELECT term, count(*) AS uses, min(doc_id) AS first_doc FROM t GROUP BY term")
def d8(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\*\*([A-Za-z]+)\*\*:"), F.lit(1))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("uses"), F.min("doc_id").alias("first_doc"))


@_add("d9_code_blocks", f"WITH {_SECTIONS} SELECT doc_id, ((fences + 1) // 2)::BIGINT AS block, count(*) - 1 AS code_lines FROM c WHERE fences % 2 = 1 GROUP BY ALL")
def d9(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    x = T.lines(table(spark, d, "documents"), "doc_id", "text").withColumn("fences", F.sum(F.when(F.startswith("line", F.lit("```")), 1).otherwise(0)).over(w))
    return x.filter("fences % 2 = 1").groupBy("doc_id", F.expr("(fences + 1) div 2").alias("block")).agg((F.count(F.lit(1)) - 1).alias("code_lines"))


@_add("d11_coverage", "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_]+')) AS name FROM documents) SELECT s.kind, count(*) AS symbols, count(w.name) AS mentioned FROM (SELECT DISTINCT kind, name FROM code_symbols) s LEFT JOIN w ON w.name = s.name GROUP BY s.kind")
def d11(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_]+"), F.lit(0)))).alias("name")).distinct().withColumn("seen", F.lit(1))
    s = table(spark, d, "code_symbols").select("kind", "name").distinct()
    return s.join(w, "name", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("symbols"), F.count("seen").alias("mentioned"))


@_add("h1_command_types", f"SELECT {_case('command', T.COMMANDS, 'generic')} AS kind, command_type, count(*) AS runs FROM token_saver_runs GROUP BY ALL")
def h1(spark, d):
    return table(spark, d, "token_saver_runs").groupBy(T.first_rule(F.col("command"), T.COMMANDS, "generic").alias("kind"), "command_type").agg(F.count(F.lit(1)).alias("runs"))


@_add("h2_token_estimates", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS output_tokens, ceil(length(text) / 3.5)::BIGINT AS context_tokens FROM documents WHERE text IS NOT NULL")
def h2(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.ceil(n / 4.0).alias("output_tokens"), F.ceil(n / 3.5).alias("context_tokens"))


@_add(
    "h3_log_summary",
    f"""WITH {_LINES}, k AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9:]+ ', ''), '[0-9]+', '#', 'g')) AS shape FROM l WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_kind = 'log')),
       g AS (SELECT doc_id, shape, count(*) AS times, min(line_no) AS first_line FROM k WHERE shape <> '' GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, first_line) <= 10""",
)
def h3(spark, d):
    return T.log_summary(table(spark, d, "documents").filter("doc_kind = 'log'"), "doc_id", "text")


@_add("h6_diff_lines", f"WITH {_LINES} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^[+][^+]')) AS added, count(*) FILTER (WHERE regexp_matches(line, '^-[^-]')) AS removed FROM l WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_kind = 'diff') GROUP BY doc_id")
def h6(spark, d):
    x = T.lines(table(spark, d, "documents").filter("doc_kind = 'diff'"), "doc_id", "text")
    return x.groupBy("doc_id").agg(F.count_if(F.col("line").rlike("^[+][^+]")).alias("added"), F.count_if(F.col("line").rlike("^-[^-]")).alias("removed"))


@_add("c5_title_classes", f"SELECT {_case('lower(title)', T.COMMITS, 'other')} AS class, count(*) AS memories FROM observations GROUP BY 1".replace("\\b", "\\b"))
def c5(spark, d):
    return table(spark, d, "observations").groupBy(T.first_rule(F.lower("title"), T.COMMITS, "other").alias("class")).agg(F.count(F.lit(1)).alias("memories"))


_STALE = "(?i)deprecated|legacy|temporary"


@_add("i5_stale_lines", f"WITH {_LINES} SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '{_STALE}')")
def i5(spark, d):
    return T.lines(table(spark, d, "documents"), "doc_id", "text").filter(F.col("line").rlike(_STALE)).select("doc_id", "line_no")


_INTENTS = [("check", "^(is|has|can|validate|check|inspect)"), ("change", "^(set|update|rewrite|patch|replace|rename|move)"), ("remove", "^(delete|drop|remove|retire|prune|flush)"), ("build", "^(build|create|make|rebuild|expand)")]


@_add("i6_intents", f"SELECT {_case('lower(name)', _INTENTS, 'other')} AS intent, count(*) AS symbols FROM code_symbols GROUP BY 1")
def i6(spark, d):
    return table(spark, d, "code_symbols").groupBy(T.first_rule(F.lower("name"), _INTENTS, "other").alias("intent")).agg(F.count(F.lit(1)).alias("symbols"))


_FLAGS = {"navigation": r"\b(where|which file|path|module)\b", "historical": r"\b(why|previously|before|earlier|history)\b", "command": r"^(run|commit|stop|continue|retry|please|now|ok|yes)\b"}


@_add("x1_prompt_flags", "SELECT id, " + ", ".join(f"coalesce(regexp_matches(lower(content), '{p}'), false) AS {n}" for n, p in _FLAGS.items()) + " FROM user_prompts")
def x1(spark, d):
    return table(spark, d, "user_prompts").select("id", *(F.coalesce(F.lower("content").rlike(p), F.lit(False)).alias(n) for n, p in _FLAGS.items()))


@_add("x2_decisions", r"SELECT id FROM observations WHERE length(content) >= 150 AND regexp_matches(lower(substr(content, length(content) // 2 + 1)), '\bchose\b|\binstead\b|\brather than\b')")
def x2(spark, d):
    half = F.substr("content", F.expr("length(content) div 2 + 1"), F.length("content"))
    return table(spark, d, "observations").filter((F.length("content") >= 150) & F.lower(half).rlike(r"\bchose\b|\binstead\b|\brather than\b")).select("id")


@_add("x4_snippets", r"WITH l AS (SELECT id, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\*\*(What|Why|Where)\*\*:')) AS l FROM observations) SELECT id, substr(array_to_string(list_transform(l[1:3], lambda x: regexp_replace(x, '^\*\*[A-Za-z]+\*\*: *', '')), ' '), 1, 180) AS snippet FROM l WHERE len(l) > 0")
def x4(spark, d):
    kept = F.filter(F.split("content", "\n"), lambda x: x.rlike(r"^\*\*(What|Why|Where)\*\*:"))
    text = F.array_join(F.transform(F.slice("k", 1, 3), lambda x: F.regexp_replace(x, r"^\*\*[A-Za-z]+\*\*: *", "")), " ")
    return table(spark, d, "observations").select("id", kept.alias("k")).filter(F.size("k") > 0).select("id", F.substring(text, 1, 180).alias("snippet"))


@_add("x5_checkpoints", "SELECT session_id, id, turn FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at NULLS FIRST, id) AS turn FROM user_prompts) x WHERE turn % 10 = 0")
def x5(spark, d):
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return table(spark, d, "user_prompts").select("session_id", "id", F.row_number().over(w).alias("turn")).filter("turn % 10 = 0")


@_add("x6_ids_in_text", "SELECT id, unnest(list_distinct(regexp_extract_all(content, '[A-Z]{2,4}-[0-9]+'))) AS ticket FROM user_prompts")
def x6(spark, d):
    return table(spark, d, "user_prompts").select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Z]{2,4}-[0-9]+"), F.lit(0)))).alias("ticket"))


@_add(
    "v4_added_lines",
    """WITH o AS (SELECT memory_id, field, unnest(string_split(old_value, ' ')) AS line, 1 AS w FROM observation_versions WHERE field = 'content'), a AS (SELECT memory_id, line, count(*) AS was FROM o GROUP BY ALL),
       n AS (SELECT memory_id, unnest(string_split(new_value, ' ')) AS line FROM observation_versions WHERE field = 'content'), b AS (SELECT memory_id, line, count(*) AS now FROM n GROUP BY ALL)
       SELECT b.memory_id, b.line, now - coalesce(was, 0) AS added FROM b LEFT JOIN a ON a.memory_id = b.memory_id AND a.line = b.line WHERE now - coalesce(was, 0) > 0""",
)
def v4(spark, d):
    v = table(spark, d, "observation_versions").filter("field = 'content'")
    words = lambda c: v.select("memory_id", F.explode(F.split(c, " ")).alias("line"))
    return T.added_lines(words("old_value"), words("new_value"), "memory_id")


@_add("s15_compact_rows", "SELECT file_path, name, signature FROM code_symbols")
def s15(spark, d):
    rows, prefixes = T.compact(table(spark, d, "code_symbols"), "file_path", ["name", "signature"])
    return T.expand(rows, prefixes, "file_path", ["name", "signature"])


@_add("s18_changed_files", "SELECT file_path, count(DISTINCT signature) AS forms FROM code_symbols GROUP BY 1 HAVING count(DISTINCT signature) > 1")
def s18(spark, d):
    return table(spark, d, "code_symbols").groupBy("file_path").agg(F.count_distinct("signature").alias("forms")).filter("forms > 1")
