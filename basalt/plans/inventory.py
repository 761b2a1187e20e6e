"""Queries that state rules of the inventory in full: resolution, patterns, hygiene as one snapshot, gates, suggestions, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import memory as M
from ..operators import patterns as P
from ..operators import text as T
from ..operators.resolve import resolve_calls
from ..sources import views as V
from ..sources.tables import table
from .memory import _LIVE, _PRIORITY, _SIGNALS
from .texts import _LINES

QUERIES: dict = {}
SQL: dict = {}


def _add(name: str, sql: str | None = None, *needs: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = V.sql(sql, *needs)
        return f

    return put


def _case(column: str, rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{other}' END"


# Calls, bindings, imports and scopes of symbols: the tables have none, so each symbol calls, binds and imports others, found by arithmetic on its id.
_SYMBOLS = "SELECT id, repo_id % 3 AS repo, repo_id || ':' || file_path AS file, name, kind, parent_name AS owner, qualified_name AS qualified, start_line, end_line FROM code_symbols"
_RESOLVE = f"""WITH sy AS ({_SYMBOLS}), mx AS (SELECT max(id) AS m FROM sy),
  ca AS (SELECT s.id AS call, s.repo, s.file, CASE WHEN s.id % 6 = 1 THEN s.name ELSE t.name END AS callee, CASE s.id % 6 WHEN 1 THEN 'this' WHEN 2 THEN 'super' WHEN 3 THEN t.owner WHEN 5 THEN 'alias' || (s.id % 50) END AS receiver, s.owner, s.start_line AS line
         FROM sy s, mx JOIN sy t ON t.id = (s.id * 7 + 3) % m + 1),
  bi AS (SELECT s.id, s.file, CASE s.id % 4 WHEN 1 THEN 'alias' || (s.id % 50) WHEN 3 THEN t.owner ELSE t.name END AS local, CASE s.id % 4 WHEN 1 THEN '*' WHEN 2 THEN 'default' WHEN 3 THEN t.owner ELSE t.name END AS original, t.file AS target
         FROM sy s, mx JOIN sy t ON t.id = (s.id * 7 + 3) % m + 1 WHERE s.id % 5 < 2 AND s.id % 11 <> 0),
  im AS (SELECT s.file, t.file AS target, min(s.id) AS place FROM sy s, mx JOIN sy t ON t.id = (s.id * 7 + 3) % m + 1 WHERE s.id % 5 = 2 GROUP BY 1, 2),
  pa AS (SELECT s.repo, s.owner AS name, min(t.owner) AS parent FROM sy s, mx JOIN sy t ON t.id = (s.id * 7 + 3) % m + 1 WHERE s.owner IS NOT NULL AND t.owner IS NOT NULL GROUP BY 1, 2),
  sc AS (SELECT s.file, t.name, s.start_line - 3 AS first_line, s.end_line + 3 AS last_line, s.id % 3 AS depth, t.id AS symbol, .98::DOUBLE AS confidence FROM sy s, mx JOIN sy t ON t.id = (s.id * 7 + 3) % m + 1 WHERE s.id % 13 = 0),
  fs AS (SELECT file, name, min(id) AS found FROM sy GROUP BY 1, 2), ff AS (SELECT file, name, min(id) AS found FROM sy WHERE kind = 'function' GROUP BY 1, 2), fc AS (SELECT file, name FROM sy WHERE kind = 'class' GROUP BY 1, 2),
  qu AS (SELECT repo, qualified, min(id) AS found, count(*) AS n FROM sy GROUP BY 1, 2), me AS (SELECT repo, owner, name, min(id) AS found FROM sy WHERE owner IS NOT NULL GROUP BY 1, 2, 3),
  un AS (SELECT repo, name, min(id) AS found FROM sy GROUP BY 1, 2 HAVING count(*) = 1), fb AS (SELECT * FROM bi WHERE local IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file, local ORDER BY id) = 1),
  hit AS (
    SELECT call, 0 AS rule, arg_min(symbol, (-depth, -sc.confidence, symbol)) AS symbol, arg_min(sc.confidence, (-depth, -sc.confidence, symbol)) AS confidence FROM ca JOIN sc ON sc.file = ca.file AND sc.name = callee AND line BETWEEN first_line AND last_line GROUP BY call
    UNION ALL SELECT call, 1, fs.found, 1.0 FROM ca JOIN fb ON fb.file = ca.file AND fb.local = callee JOIN fs ON fs.file = fb.target AND fs.name = CASE WHEN original IN ('*', 'default') THEN callee ELSE original END
    UNION ALL SELECT call, 2, found, .95 FROM ca JOIN qu ON qu.repo = ca.repo AND qualified = ca.owner || '.' || callee WHERE receiver = 'this' AND n = 1
    UNION ALL SELECT call, 3, min(sy.id), .9 FROM ca JOIN qu ON qu.repo = ca.repo AND qu.qualified = ca.owner || '.' || callee JOIN sy ON sy.repo = ca.repo AND sy.qualified = qu.qualified AND sy.file = ca.file WHERE receiver = 'this' AND n > 1 GROUP BY call
    UNION ALL SELECT call, 4, found, .9 FROM ca JOIN pa ON pa.repo = ca.repo AND pa.name = ca.owner JOIN qu ON qu.repo = ca.repo AND qualified = pa.parent || '.' || callee WHERE receiver = 'super' AND n = 1
    UNION ALL SELECT call, 5, ff.found, .95 FROM ca JOIN fb ON fb.file = ca.file AND fb.local = receiver JOIN ff ON ff.file = fb.target AND ff.name = callee WHERE receiver NOT IN ('this', 'super') AND original = '*'
    UNION ALL SELECT call, 6, me.found, .9 FROM ca JOIN fb ON fb.file = ca.file AND fb.local = receiver JOIN fc ON fc.file = fb.target AND fc.name = CASE WHEN original = 'default' THEN receiver ELSE original END JOIN me ON me.repo = ca.repo AND me.owner = fc.name AND me.name = callee WHERE receiver NOT IN ('this', 'super')
    UNION ALL SELECT call, 7, found, .85 FROM ca JOIN qu ON qu.repo = ca.repo AND qualified = receiver || '.' || callee WHERE receiver NOT IN ('this', 'super') AND n = 1
    UNION ALL SELECT call, 8, arg_min(fs.found, (place, fs.found)), .8 FROM ca JOIN im ON im.file = ca.file JOIN fs ON fs.file = im.target AND fs.name = callee GROUP BY call
    UNION ALL SELECT call, 9, found, .9 FROM ca JOIN fs ON fs.file = ca.file AND fs.name = callee
    UNION ALL SELECT call, 10, found, .7 FROM ca JOIN un ON un.repo = ca.repo AND un.name = callee)
  SELECT ca.call, h.rule, h.symbol, coalesce(h.confidence, .5)::DOUBLE AS confidence FROM ca LEFT JOIN (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY call ORDER BY rule) = 1) h ON h.call = ca.call"""


def _code(spark, d) -> dict:
    """The inputs of resolve_calls() that stand for calls, bindings, imports, class parents and scopes."""
    y = table(spark, d, "code_symbols")
    file = F.concat_ws(":", F.col("repo_id").cast("string"), "file_path")
    sy = y.select("id", (F.col("repo_id") % 3).alias("repo"), file.alias("file"), "name", "kind", F.col("parent_name").alias("owner"), F.col("qualified_name").alias("qualified"), "start_line", "end_line")
    s = sy.join(F.broadcast(sy.agg(F.max("id").alias("m"))))

    def other(by: int, plus: int):
        t = sy.select(F.col("id").alias("other"), *(F.col(c).alias(f"t_{c}") for c in ("file", "name", "owner")))
        return s.withColumn("other", (F.col("id") * by + plus) % F.col("m") + 1).join(t, "other")

    alias = F.concat(F.lit("alias"), (F.col("id") % 50).cast("string"))
    k, q = F.col("id") % 6, F.col("id") % 4
    called = other(7, 3)
    receiver = F.when(k == 1, "this").when(k == 2, "super").when(k == 3, F.col("t_owner")).when(k == 5, alias)
    local = F.when(q == 1, alias).when(q == 3, F.col("t_owner")).otherwise(F.col("t_name"))
    original = F.when(q == 1, "*").when(q == 2, "default").when(q == 3, F.col("t_owner")).otherwise(F.col("t_name"))
    return {
        "calls": called.select(F.col("id").alias("call"), "repo", "file", F.when(k == 1, F.col("name")).otherwise(F.col("t_name")).alias("callee"), receiver.alias("receiver"), "owner", F.col("start_line").alias("line")),
        "symbols": sy,
        "bindings": called.filter("id % 5 < 2").select("id", "file", local.alias("local"), original.alias("original"), F.col("t_file").alias("target"), (F.col("id") % 11 == 0).alias("reexport")),
        "imports": called.filter("id % 5 = 2").groupBy("file", F.col("t_file").alias("target")).agg(F.min("id").alias("place")),
        "parents": called.filter("owner IS NOT NULL AND t_owner IS NOT NULL").groupBy("repo", F.col("owner").alias("name")).agg(F.min("t_owner").alias("parent")),
        "scopes": called.filter("id % 13 = 0").select("file", F.col("t_name").alias("name"), (F.col("start_line") - 3).alias("first_line"), (F.col("end_line") + 3).alias("last_line"), (F.col("id") % 3).alias("depth"), F.col("other").alias("symbol"), F.lit(0.98).alias("confidence")),
    }


@_add("g25_callee_cascade", _RESOLVE)
def g25_cascade(spark, d):
    return resolve_calls(**_code(spark, d))


# A document stands for a symbol's body; its text holds its signature too.
_BODIES = "SELECT doc_id AS id, text AS body, len(string_split(text, chr(10))) AS n FROM documents"
_NEST = r"""q AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(body, '\\.', '', 'g'), '''[^'']*''|"[^"]*"', '', 'g'), '[^{}]', '', 'g') AS b FROM bo),
  e AS (SELECT id, unnest(range(1, length(b) + 1)) AS k, unnest(string_split(b, '')) AS c FROM q WHERE b <> ''), s AS (SELECT id, k, sum(CASE c WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY k) AS s FROM e),
  de AS (SELECT id, max(h) AS depth FROM (SELECT id, s - least(0, min(s) OVER (PARTITION BY id ORDER BY k)) AS h FROM s) z GROUP BY id)"""


def _times(pattern: str) -> str:
    return f"len(regexp_extract_all(body, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def _bodies(spark, d):
    x = table(spark, d, "documents").filter("text IS NOT NULL")
    return x.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("text").alias("signature"), F.lit(1).alias("first_line"), F.size(F.split("text", "\n")).alias("last_line"))


_C1 = " + ".join(["1", _times(r"if\b"), *map(_times, P.DECISIONS), _times(r"\?\s*[^.:?]")])


@_add(
    "c1_complexity",
    rf"""WITH bo AS (SELECT * FROM ({_BODIES}) WHERE body IS NOT NULL), {_NEST}, c AS (SELECT id, {_C1} AS cyclomatic, len(list_filter(string_split(body, chr(10)), lambda l: trim(l, E' \t\r') <> '' AND NOT starts_with(trim(l, E' \t\r'), '//'))) AS code_lines,
        len(list_filter(string_split(regexp_extract(body, '\(([^)]*)\)', 1), ','), lambda p: regexp_matches(p, '\S'))) AS params FROM bo)
        SELECT c.*, coalesce(de.depth, 0)::INT AS nesting, CASE WHEN cyclomatic <= 4 THEN 'low' WHEN cyclomatic <= 10 THEN 'medium' ELSE 'high' END AS level FROM c LEFT JOIN de ON de.id = c.id""",
)
def c1(spark, d):
    b = F.col("body")
    code = F.filter(F.split(b, "\n"), lambda x: (F.trim(x, F.lit(" \t\r")) != "") & ~F.startswith(F.trim(x, F.lit(" \t\r")), F.lit("//")))
    params = F.filter(F.split(F.regexp_extract("body", r"\(([^)]*)\)", 1), ","), lambda p: p.rlike(r"\S"))
    x = _bodies(spark, d).select("id", P.complexity(b).alias("cyclomatic"), F.size(code).alias("code_lines"), F.size(params).alias("params"), P.nesting_depth(b).alias("nesting"))
    return x.withColumn("level", F.when(F.col("cyclomatic") <= 4, "low").when(F.col("cyclomatic") <= 10, "medium").otherwise("high"))


_SECRET = P.SECRET.replace("'", "''")


@_add(
    "c4_presets",
    rf"""WITH bo AS (SELECT * FROM ({_BODIES}) WHERE body IS NOT NULL), {_NEST},
      lo AS (SELECT id, array_to_string(list_transform(list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '\b(for|while|do)\b')), lambda l: CASE WHEN regexp_matches(l, '^\s') THEN 'i' ELSE 'z' END), '') AS l,
             list_filter(regexp_split_to_array(body, '[^a-zA-Z0-9_.]+'), lambda w: regexp_matches(w, '^([0-9]{{2,}}|[3-9])$')) AS m,
             list_filter(list_transform(string_split(regexp_extract(body, '\(([^)]*)\)', 1), ','), lambda p: regexp_extract(p, '^\s*(\w+)\s*([:=].*)?$', 1)), lambda p: p <> '') AS p FROM bo),
      x AS (SELECT id, 'empty_catch' AS rule, {_times(P.EMPTY_CATCH)} AS size FROM bo UNION ALL SELECT id, 'empty_function', 1 FROM bo WHERE NOT regexp_matches(body, '\S') UNION ALL SELECT id, 'deeply_nested', depth FROM de WHERE depth >= {P.DEEP}
        UNION ALL SELECT id, 'nested_loops', length(regexp_extract(l, '(^i{{3,}}|zi{{2,}})', 1)) FROM lo UNION ALL SELECT id, 'god_function', n FROM bo WHERE n >= {P.LONG} UNION ALL SELECT id, 'eval_exec', {_times(P.EVAL)} FROM bo
        UNION ALL SELECT id, 'hardcoded_secret', 1 FROM bo WHERE regexp_matches(body, '(?i){_SECRET}') UNION ALL SELECT id, 'todo_fixme', {_times("(?i)" + P.TODO)} FROM bo
        UNION ALL SELECT id, 'magic_number', len(m) FROM lo WHERE len(m) >= {P.NUMBERS} OR len(list_filter(m, lambda w: length(w) > 2)) > 0
        UNION ALL SELECT y.id, 'reassigned_param', sum(len(regexp_extract_all(bo.body, '\b' || y.q || '\s*=([^=]|$)'))) FROM (SELECT id, unnest(p) AS q FROM lo) y JOIN bo ON bo.id = y.id GROUP BY y.id)
      SELECT id, rule, CASE WHEN rule IN ('eval_exec', 'hardcoded_secret') THEN 'error' WHEN rule IN ('god_function', 'todo_fixme', 'magic_number') THEN 'info' ELSE 'warning' END AS severity, size::INT AS size FROM x WHERE size > 0""",
)
def c4(spark, d):
    return P.preset_hits(_bodies(spark, d))


_PATTERNS = ["call:run", "string:[Ss]tale \\w+", "nesting:2", "lines:25"]


@_add(
    "c4_custom",
    rf"""WITH bo AS (SELECT * FROM ({_BODIES}) WHERE body IS NOT NULL), {_NEST}, x AS (SELECT id, 'call:run' AS pattern, {_times(r"\brun\s*\(")} AS size FROM bo UNION ALL SELECT id, 'string:[Ss]tale \w+', {_times(r"[Ss]tale \w+")} FROM bo
        UNION ALL SELECT id, 'nesting:2', depth FROM de WHERE depth >= 2 UNION ALL SELECT id, 'lines:25', n FROM bo WHERE n >= 25) SELECT id, pattern, size::INT AS size FROM x WHERE size > 0""",
)
def c4_custom(spark, d):
    return P.custom_hits(_bodies(spark, d), _PATTERNS)


# Class signatures: the symbols' have no bases, so each class extends and implements others, found by arithmetic on its id.
_CLASSES = """SELECT s.id, s.repo_id AS repo, s.name, s.kind, CASE WHEN s.kind = 'class' THEN 'class ' || s.name || CASE WHEN s.id % 3 < 2 THEN ' extends ' || a.name ELSE '' END || CASE WHEN s.id % 5 < 3 THEN ' implements ' || b.name || ', ' || a.name || ' {' ELSE ' {' END END AS signature
  FROM code_symbols s, (SELECT max(id) AS m FROM code_symbols) x JOIN code_symbols a ON a.id = (s.id * 7 + 1) % m + 1 JOIN code_symbols b ON b.id = (s.id * 13 + 5) % m + 1"""


@_add(
    "g20_relations",
    rf"""WITH c AS ({_CLASSES}), t AS (SELECT repo, name, min(id) AS target FROM c WHERE kind IN ('class', 'interface', 'type') GROUP BY 1, 2), e AS (SELECT id, repo, regexp_extract(signature, 'extends\s+(\w+)', 1) AS base FROM c WHERE kind = 'class'),
        i AS (SELECT id, repo, trim(unnest(string_split(regexp_extract(signature, 'implements\s+([\w,\s]+?)(?:\s*\{{|$)', 1), ','))) AS base FROM c WHERE kind = 'class')
        SELECT DISTINCT e.id AS source, t.target, 'extends' AS kind FROM e JOIN t ON t.repo = e.repo AND t.name = e.base UNION ALL SELECT DISTINCT i.id, t.target, 'implements' FROM i JOIN t ON t.repo = i.repo AND t.name = i.base""",
)
def g20(spark, d):
    """Edges of the class signatures: the base behind extends, and each name behind implements, met with the first such class or interface of the repository."""
    y = table(spark, d, "code_symbols")
    name = lambda by, plus, to: y.join(F.broadcast(y.agg(F.max("id").alias("m")))).select("id", ((F.col("id") * by + plus) % F.col("m") + 1).alias("other")).join(y.select(F.col("id").alias("other"), F.col("name").alias(to)), "other").drop("other")
    x = y.select("id", F.col("repo_id").alias("repo"), "name", "kind").join(name(7, 1, "a"), "id").join(name(13, 5, "b"), "id")
    base = F.when(F.col("id") % 3 < 2, F.concat(F.lit(" extends "), "a")).otherwise("")
    faces = F.when(F.col("id") % 5 < 3, F.concat(F.lit(" implements "), "b", F.lit(", "), "a", F.lit(" {"))).otherwise(" {")
    c = x.withColumn("signature", F.when(F.col("kind") == "class", F.concat(F.lit("class "), "name", base, faces)))
    return G.class_relations(c)


@_add("a28_precision", "SELECT session_id % 10 AS source, round(avg(was_useful), 6) AS precision, CASE WHEN avg(was_useful) < .85 THEN .98 ELSE .95 END::DOUBLE AS threshold FROM recalls WHERE was_useful IS NOT NULL GROUP BY 1", "recalls")
def a28(spark, d):
    g = V.recalls(spark, d).filter("was_useful IS NOT NULL").groupBy((F.col("session_id") % 10).alias("source")).agg(F.avg("was_useful").alias("p"))
    return g.select("source", F.round("p", 6).alias("precision"), F.when(F.col("p") < 0.85, 0.98).otherwise(0.95).alias("threshold"))


_HEADERS, _TICKET = r"(?im)^\s*(From|Subject|To|Cc|Date)\s*:", r"(?i)\bTicket\s*#[0-9]+|\b(Status|Priority|Severity)\s*:"


@_add(
    "x3_content_kinds",
    rf"""WITH p AS (SELECT id, content, left(content, 512) AS head, len(list_filter(regexp_split_to_array(content, '\n\s*\n'), lambda x: regexp_matches(x, '\S'))) AS n FROM observations WHERE regexp_matches(content, '\S'))
        SELECT id, CASE WHEN regexp_matches(head, '{_HEADERS}') THEN 'email' WHEN regexp_matches(head, '{_TICKET}') THEN 'triage' WHEN n = 1 AND length(content) < 800 THEN 'guard' ELSE 'moderate' END AS kind FROM p""",
)
def x3(spark, d):
    head, n = F.substring("content", 1, 512), F.size(F.filter(F.split("content", r"\n\s*\n"), lambda x: x.rlike(r"\S")))
    kind = F.when(head.rlike(_HEADERS), "email").when(head.rlike(_TICKET), "triage").when((n == 1) & (F.length("content") < 800), "guard").otherwise("moderate")
    return table(spark, d, "observations").filter(F.col("content").rlike(r"\S")).select("id", kind.alias("kind"))


# Memories of one topic: each newer one supersedes the one before it.
_RELATIONS = "SELECT id AS source_id, prev AS target_id, 'supersedes' AS relation, round(.5 + (id % 5) / 10.0, 1)::DOUBLE AS confidence FROM (SELECT id, lag(id) OVER (PARTITION BY topic_key ORDER BY id) AS prev FROM observations WHERE topic_key IS NOT NULL) x WHERE prev IS NOT NULL"


def relations(spark, d):
    w = Window.partitionBy("topic_key").orderBy("id")
    x = table(spark, d, "observations").filter("topic_key IS NOT NULL").withColumn("prev", F.lag("id").over(w)).filter("prev IS NOT NULL")
    return x.select(F.col("id").alias("source_id"), F.col("prev").alias("target_id"), F.lit("supersedes").alias("relation"), F.round(0.5 + (F.col("id") % 5) / 10.0, 1).alias("confidence"))


@_add(
    "m20_attached_relations",
    f"""WITH r AS ({_RELATIONS}), k AS (SELECT id FROM observations WHERE deleted_at IS NULL AND lower(project) = 'heron-core')
        SELECT k.id, source_id, target_id, relation, confidence FROM k JOIN (SELECT source_id AS at, * FROM r UNION ALL SELECT target_id, * FROM r) x ON x.at = k.id""",
)
def m20(spark, d):
    """Relations of the results of a search, from either end; a relation between two results comes with both."""
    found = table(spark, d, "observations").filter("deleted_at IS NULL AND lower(project) = 'heron-core'").select("id")
    ends = relations(spark, d).withColumn("id", F.explode(F.array("source_id", "target_id")))
    return found.join(ends, "id").select("id", "source_id", "target_id", "relation", "confidence")


@_add(
    "m11_marked_duplicates",
    f"""WITH r AS ({_RELATIONS}), t AS (SELECT target_id, max(confidence) AS c FROM r WHERE confidence >= .6 GROUP BY 1) SELECT o.id, o.deleted_at IS NOT NULL OR t.c IS NOT NULL AS deleted, CASE WHEN o.deleted_at IS NULL AND t.c IS NOT NULL THEN .9 END::DOUBLE AS confidence
        FROM observations o LEFT JOIN t ON t.target_id = o.id""",
)
def m11(spark, d):
    """The snapshot after duplicates were marked: the target of a sure relation is deleted, and the relation that says so has 0.9."""
    t = relations(spark, d).filter("confidence >= 0.6").select(F.col("target_id").alias("id"), F.lit(True).alias("hit")).distinct()
    x = table(spark, d, "observations").select("id", "deleted_at").join(t, "id", "left")
    return x.select("id", (F.col("deleted_at").isNotNull() | F.col("hit").isNotNull()).alias("deleted"), F.when(F.col("deleted_at").isNull() & F.col("hit"), 0.9).alias("confidence"))


# Sessions by the memories saved in them; one of a single save is still open.
_SESSIONS = "SELECT session_id AS id, min(project) AS project, min(created_at) AS started_at, CASE WHEN count(*) > 1 THEN max(created_at) END AS ended_at FROM observations WHERE session_id IS NOT NULL GROUP BY 1"


@_add(
    "m16_compaction",
    f"""WITH now AS (SELECT max(created_at) AS t FROM observations), o1 AS (SELECT o.* FROM observations o, now WHERE NOT coalesce(expires_at < t, false)), dead AS (SELECT id FROM symbol_links l WHERE try_cast(trim(memory_id) AS BIGINT) NOT IN (SELECT id FROM o1 WHERE deleted_at IS NULL) OR try_cast(trim(memory_id) AS BIGINT) IS NULL),
      o2 AS (SELECT o1.* FROM o1, now WHERE NOT coalesce(deleted_at < t - INTERVAL 30 DAY, false)),
      o3 AS (SELECT * FROM o2 WHERE id NOT IN (SELECT id FROM o2 WHERE type = 'session_summary' AND deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC NULLS LAST, id DESC) > 1)),
      p1 AS (SELECT * FROM user_prompts QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC NULLS LAST, id DESC) <= 10), s0 AS ({_SESSIONS}),
      s1 AS (SELECT * FROM s0 WHERE ended_at IS NULL OR id IN (SELECT id FROM s0 QUALIFY row_number() OVER (PARTITION BY project ORDER BY started_at DESC NULLS LAST, id DESC) <= 10)), p2 AS (SELECT * FROM p1 WHERE session_id IN (SELECT id FROM s1) OR session_id IS NULL),
      l1 AS (SELECT l.id, CASE WHEN o3.id IS NOT NULL AND o3.updated_at < t - INTERVAL 90 DAY AND trust_score > 0 THEN round(greatest(0, trust_score - .05), 6) ELSE trust_score END AS trust FROM symbol_links l JOIN now ON true LEFT JOIN o3 ON o3.id = try_cast(trim(memory_id) AS BIGINT) WHERE l.id NOT IN (SELECT id FROM dead))
      SELECT 'observations' AS kept, id::VARCHAR AS id, NULL::DOUBLE AS trust FROM o3 UNION ALL SELECT 'user_prompts', id::VARCHAR, NULL FROM p2 UNION ALL SELECT 'sessions', id, NULL FROM s1 UNION ALL SELECT 'links', id::VARCHAR, trust FROM l1""",
)
def m16(spark, d):
    """What a compaction keeps: its steps in their order, each over what those before it left, as one snapshot."""
    tabs = {t: table(spark, d, t) for t in ("observations", "user_prompts", "symbol_links")}
    g = tabs["observations"].filter("session_id IS NOT NULL").groupBy(F.col("session_id").alias("id"))
    sessions = g.agg(F.min("project").alias("project"), F.min("created_at").alias("started_at"), F.when(F.count(F.lit(1)) > 1, F.max("created_at")).alias("ended_at"))
    links = tabs["symbol_links"].withColumn("memory_id", F.trim("memory_id").try_cast("bigint"))
    kept = M.compacted(tabs["observations"], tabs["user_prompts"], sessions, links)
    part = lambda name, trust: kept[name].select(F.lit(name).alias("kept"), F.col("id").cast("string").alias("id"), trust.cast("double").alias("trust"))
    none = F.lit(None)
    return part("observations", none).unionByName(part("user_prompts", none)).unionByName(part("sessions", none)).unionByName(part("links", F.col("trust_score")))


_QUERY = "Where does the cache reader keep stale rows, and why? list."


def _needle_sql() -> str:
    fields = ["lower(coalesce(topic_key, ''))", "lower(coalesce(title, ''))", "lower(coalesce(content, ''))"]
    hits = " + ".join(f"contains({f}, '{n}')::INT" for n in M.topic_needles(_QUERY) for f in fields)
    return f"SELECT id, {hits} AS matches FROM observations WHERE {hits} > 0"


@_add("m7_topic_needles", _needle_sql())
def m7(spark, d):
    """How many of the needles of a topic each memory has, over key, title and content."""
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in ("topic_key", "title", "content")]
    n = sum((F.contains(f, F.lit(x)).cast("int") for x in M.topic_needles(_QUERY) for f in fields), F.lit(0))
    return table(spark, d, "observations").select("id", n.alias("matches")).filter("matches > 0")


_GATE = """SELECT p_partkey AS id, p_size % 9 = 0 AS no_ai, p_size % 10 <> 0 AS enabled, p_size % 11 = 0 AS forced, p_size % 8 <> 0 AS auto_gate, p_size % 13 = 0 AS new_repo, p_size % 3 = 1 AS added, p_size % 5 = 1 AS changed, p_size % 7 = 1 AS deleted,
  (p_partkey % 60)::INT AS commits, (p_partkey % 9)::INT AS days, p_size % 4 = 0 AS body FROM part"""


@_add(
    "k3_gate",
    f"""WITH g AS ({_GATE}), r AS (SELECT *, list_filter([CASE WHEN added THEN 'NewExports' END, CASE WHEN changed THEN 'SignatureChanged' END, CASE WHEN deleted THEN 'ExportsDeleted' END, CASE WHEN commits >= 50 OR days >= 7 THEN 'PeriodicRevalidation' END], lambda x: x IS NOT NULL) AS r FROM g)
        SELECT id, CASE WHEN no_ai OR NOT enabled THEN false WHEN forced OR NOT auto_gate OR new_repo THEN true ELSE len(r) > 0 END AS should_run,
        CASE WHEN no_ai THEN 'NoAiFlag' WHEN NOT enabled THEN 'Disabled' WHEN forced OR NOT auto_gate THEN 'Forced' WHEN new_repo THEN 'NewRepo' WHEN len(r) > 0 THEN array_to_string(r, ',') WHEN body THEN 'BodyOnlyOnly' ELSE 'NoApiSurfaceChange' END AS reasons FROM r""",
)
def k3(spark, d):
    """Whether an index is looked at again, and why: the first rule that fits, else all reasons that hold."""
    c = F.col
    p = table(spark, d, "part")
    s, k = c("p_size"), c("p_partkey")
    r = F.concat_ws(",", F.when(s % 3 == 1, "NewExports"), F.when(s % 5 == 1, "SignatureChanged"), F.when(s % 7 == 1, "ExportsDeleted"), F.when((k % 60 >= 50) | (k % 9 >= 7), "PeriodicRevalidation"))
    off, forced, new = (s % 9 == 0) | (s % 10 == 0), (s % 11 == 0) | (s % 8 == 0), s % 13 == 0
    runs = F.when(off, False).when(forced | new, True).otherwise(r != "")
    why = F.when(s % 9 == 0, "NoAiFlag").when(s % 10 == 0, "Disabled").when(forced, "Forced").when(new, "NewRepo").when(r != "", r).when(s % 4 == 0, "BodyOnlyOnly").otherwise("NoApiSurfaceChange")
    return p.select(k.alias("id"), runs.alias("should_run"), why.alias("reasons"))


_EDGES = """SELECT o_orderkey AS id, '{"edges":[{"entity_a":"' || o_custkey || '","entity_b":"' || o_orderkey || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ',"edge_type":"SharedType"' WHEN o_orderkey % 3 = 1 THEN ',"edge_type":"Other"' ELSE '' END
  || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',"confidence":0.9' || (o_orderkey % 10) END || '},{"entity_a":null,"entity_b":"x"},{"entity_a":"' || o_orderkey || '","entity_b":"' || o_custkey || '","edge_type":"DataFlow","confidence":0.97,"reasoning":"r"}]}' AS body FROM orders"""


@_add(
    "k2_suggestions",
    f"""WITH b AS ({_EDGES}), e AS (SELECT id, unnest(json_extract(body, '$.edges[*]')) AS e FROM b), x AS (SELECT id, e->>'entity_a' AS exporter, e->>'entity_b' AS consumer, CASE WHEN e->>'edge_type' IN ('SharedType', 'DataFlow', 'EventContract') THEN e->>'edge_type' ELSE 'APIContract' END AS edge_type,
        coalesce(e->>'reasoning', '') AS reasoning, coalesce((e->>'confidence')::DOUBLE, .5) AS confidence FROM e) SELECT id, consumer AS source, exporter AS target, edge_type, reasoning, confidence, confidence >= .95 AS accepted FROM x WHERE exporter IS NOT NULL AND consumer IS NOT NULL""",
)
def k2(spark, d):
    """Suggested edges of JSON answers, and whether they are sure enough to be taken: from the consumer to the exporter."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    s = lambda c: F.col(c).cast("string")
    kind = F.when(k % 3 == 0, ',"edge_type":"SharedType"').when(k % 3 == 1, ',"edge_type":"Other"').otherwise("")
    sure = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(',"confidence":0.9'), (k % 10).cast("string")))
    body = F.concat(F.lit('{"edges":[{"entity_a":"'), s("o_custkey"), F.lit('","entity_b":"'), s("o_orderkey"), F.lit('"'), kind, sure, F.lit('},{"entity_a":null,"entity_b":"x"},{"entity_a":"'), s("o_orderkey"), F.lit('","entity_b":"'), s("o_custkey"), F.lit('","edge_type":"DataFlow","confidence":0.97,"reasoning":"r"}]}'))
    return G.suggested_edges(o.select(k.alias("id"), body.alias("body")), "body")


@_add("k5_feedback", "SELECT e.event_id, l.id AS suggestion, l.trust_score, e.event_type AS decision, e.ts FROM events e LEFT JOIN symbol_links l ON l.id = e.event_id * 3")
def k5(spark, d):
    """Feedback with the suggestion that it is about, if that is still there, newest first."""
    e = table(spark, d, "events").withColumn("about", F.col("event_id") * 3)
    l = table(spark, d, "symbol_links").select(F.col("id").alias("about"), F.col("id").alias("suggestion"), "trust_score")
    return e.join(l, "about", "left").select("event_id", "suggestion", "trust_score", F.col("event_type").alias("decision"), "ts").orderBy(F.desc("ts"), F.desc("event_id"))


_KINDS = ["Deleted", "SignatureChanged", "BodyOnly", "Moved", "Renamed", "Added"]
_EDGE_KINDS = ["Imports", "PackageDep", "Calls", "Contains"]


@_add(
    "g30_classified_impact",
    f"""WITH x AS (SELECT src, dst, confidence, {_KINDS}[src % 6 + 1] AS change, {_EDGE_KINDS}[dst % 4 + 1] AS edge FROM calls),
        y AS (SELECT *, CASE WHEN change = 'Deleted' THEN 1.0 WHEN change = 'SignatureChanged' AND edge IN ('Imports', 'PackageDep') THEN .9 WHEN change = 'BodyOnly' AND edge = 'PackageDep' THEN .7 WHEN change = 'BodyOnly' AND edge = 'Calls' THEN .6
              WHEN change IN ('Moved', 'Renamed') THEN .4 WHEN confidence < .65 THEN .5 ELSE .1 END::DOUBLE AS score FROM x WHERE edge <> 'Contains')
        SELECT src, dst, change, edge, score, CASE score WHEN 1.0 THEN 'Breaking' WHEN .9 THEN 'Breaking' WHEN .7 THEN 'NeedsUpdate' WHEN .6 THEN 'NeedsUpdate' WHEN .4 THEN 'Investigate' WHEN .5 THEN 'Investigate' ELSE 'Safe' END AS class,
        CASE WHEN score < .3 THEN 'Low' WHEN score < .6 THEN 'Medium' WHEN score < .85 THEN 'High' ELSE 'Critical' END AS level FROM y""",
    "calls",
)
def g30(spark, d):
    """What a change means for each entity that depends on it, over edges of all kinds but containment."""
    one = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    x = V.calls(spark, d).select("src", "dst", "confidence", one(_KINDS, "src").alias("change"), one(_EDGE_KINDS, "dst").alias("edge"))
    return G.impact_classes(x.filter(G.is_dependency(F.col("edge")))).select("src", "dst", "change", "edge", "score", "class", "level")


@_add(
    "a32_report_risk",
    "WITH y AS (" + SQL["g30_classified_impact"] + ") SELECT src, max(score) AS score, CASE WHEN max(score) < .3 THEN 'Low' WHEN max(score) < .6 THEN 'Medium' WHEN max(score) < .85 THEN 'High' ELSE 'Critical' END AS level FROM y GROUP BY src",
)
def a32(spark, d):
    x = g30(spark, d).groupBy("src").agg(F.max("score").alias("score"))
    return x.withColumn("level", G.level(F.col("score"), {"Critical": 0.85, "High": 0.6, "Medium": 0.3}, "Low"))


@_add(
    "a26_provenance",
    f"""WITH c AS (SELECT DISTINCT file_id, commit_id, author_id, committed_at FROM commits), n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY committed_at DESC NULLS LAST, commit_id DESC, author_id DESC) <= 50),
        k AS (SELECT n.*, {_case("lower(o_orderpriority || ' ' || CASE o_orderkey % 5 WHEN 0 THEN 'fix bug' WHEN 1 THEN 'refactor' WHEN 2 THEN 'add x' ELSE 'other' END)", T.COMMITS, "other")} AS class FROM n JOIN (SELECT DISTINCT o_orderkey, o_orderpriority FROM orders) o ON o_orderkey = commit_id)
        SELECT file_id, class, count(DISTINCT commit_id) AS commits, count(DISTINCT author_id) AS authors, max(committed_at) AS last_seen FROM k GROUP BY 1, 2""",
    "commits",
)
def a26(spark, d):
    """Commits and authors of each file by the class of the commit's message, over its 50 newest."""
    w = Window.partitionBy("file_id").orderBy(F.col("committed_at").desc_nulls_last(), F.desc("commit_id"), F.desc("author_id"))
    n = V.commits(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 50")
    k = F.col("o_orderkey") % 5
    message = F.concat_ws(" ", "o_orderpriority", F.when(k == 0, "fix bug").when(k == 1, "refactor").when(k == 2, "add x").otherwise("other"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), T.first_rule(F.lower(message), T.COMMITS, "other").alias("class")).distinct()
    return n.join(o, "commit_id").groupBy("file_id", "class").agg(F.count_distinct("commit_id").alias("commits"), F.count_distinct("author_id").alias("authors"), F.max("committed_at").alias("last_seen"))


@_add("a30_unit_summary", "SELECT command_type, CASE WHEN exit_code IS NULL THEN 'not-analyzed' WHEN exit_code = 0 THEN 'proved' ELSE 'unproved' END AS status, count(*) AS units FROM token_saver_runs GROUP BY 1, 2")
def a30(spark, d):
    status = F.when(F.col("exit_code").isNull(), "not-analyzed").when(F.col("exit_code") == 0, "proved").otherwise("unproved")
    return table(spark, d, "token_saver_runs").groupBy("command_type", status.alias("status")).agg(F.count(F.lit(1)).alias("units"))


@_add("f10_test_like_paths", "SELECT id FROM code_symbols WHERE contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec')")
def f10(spark, d):
    p = F.lower("file_path")
    return table(spark, d, "code_symbols").filter(F.contains(p, F.lit("test")) | F.contains(p, F.lit("spec"))).select("id")


@_add("f11_access_guard", "SELECT id, CASE WHEN project IS NULL OR lower(project) = 'heron-core' OR scope = 'personal' THEN 'allowed' ELSE 'other project' END AS access FROM observations WHERE deleted_at IS NULL")
def f11(spark, d):
    ok = F.col("project").isNull() | M.in_scope("heron-core")
    return table(spark, d, "observations").filter("deleted_at IS NULL").select("id", F.when(ok, "allowed").otherwise("other project").alias("access"))


@_add("u2_related_paths", "SELECT DISTINCT path FROM (SELECT f.path FROM files f JOIN calls c ON c.dst = f.id WHERE c.src = 112 UNION SELECT f.path FROM files f JOIN imports i ON i.src = f.id WHERE i.dst = 112) x ORDER BY path LIMIT 20", "files", "calls", "imports")
def u2(spark, d):
    f = V.files(spark, d)
    a = V.calls(spark, d).filter("src = 112").select(F.col("dst").alias("id"))
    return f.join(a.union(V.imports(spark, d).filter("dst = 112").select(F.col("src").alias("id"))).distinct(), "id").select("path").distinct().orderBy("path").limit(20)


@_add("e4_known_repos", "SELECT r.name, count(DISTINCT s.file_path) AS files, count(s.id) AS symbols FROM code_repos r LEFT JOIN code_symbols s ON s.repo_id = r.id GROUP BY r.id, r.name")
def e4(spark, d):
    s = table(spark, d, "code_symbols").groupBy(F.col("repo_id").alias("id")).agg(F.count_distinct("file_path").alias("files"), F.count("id").alias("symbols"))
    zero = F.lit(0)
    return table(spark, d, "code_repos").join(s, "id", "left").select("name", F.coalesce("files", zero).alias("files"), F.coalesce("symbols", zero).alias("symbols"))


@_add("e6_read_model", "SELECT id, name, kind, file_path FROM code_symbols WHERE repo_id = 3 AND kind IN ('function', 'method') AND contains(lower(name), 'cache') AND starts_with(file_path, 's')")
def e6(spark, d):
    """Symbols by filters that are added one by one."""
    x = table(spark, d, "code_symbols")
    for keep in (F.col("repo_id") == 3, F.col("kind").isin("function", "method"), F.contains(F.lower("name"), F.lit("cache")), F.startswith("file_path", F.lit("s"))):
        x = x.filter(keep)
    return x.select("id", "name", "kind", "file_path")


@_add("d12_stale_pages", "SELECT doc_id, date_diff('day', created_at, t) AS days FROM documents, (SELECT max(created_at) AS t FROM documents) x WHERE created_at < t - INTERVAL 90 DAY")
def d12(spark, d):
    x = table(spark, d, "documents")
    return M.with_now(x, x).filter(F.col("created_at") < F.col("now") - F.make_dt_interval(F.lit(90))).select("doc_id", F.datediff("now", "created_at").alias("days"))


@_add("d15_doc_repositories", "SELECT source, count(*) AS documents, count(text) AS with_text, max(created_at) AS last_indexed, count(DISTINCT doc_kind) AS kinds FROM documents WHERE source IS NOT NULL GROUP BY source")
def d15(spark, d):
    g = table(spark, d, "documents").filter("source IS NOT NULL").groupBy("source")
    return g.agg(F.count(F.lit(1)).alias("documents"), F.count("text").alias("with_text"), F.max("created_at").alias("last_indexed"), F.count_distinct("doc_kind").alias("kinds"))


@_add(
    "v6_captured",
    """WITH p AS (SELECT doc_id, right(text, 262144) AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, sha256('tsc' || chr(1) || t) AS sha, trim(replace(string_split(t, chr(10))[1], chr(92), '/'), ' ') AS file FROM p)
        SELECT sha, min(doc_id) AS first_doc, count(*) AS copies FROM h WHERE NOT starts_with(file, '../') AND NOT starts_with(file, '/') AND file <> '' GROUP BY sha""",
)
def v6(spark, d):
    """Outputs by the digest of their last 256 KB, each once; what names a file outside of the repository first is left out."""
    t = F.right("text", F.lit(262144))
    x = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(F.concat(F.lit("tsc\u0001"), t), 256).alias("sha"), F.trim(F.replace(F.split(t, "\n")[0], F.lit("\\"), F.lit("/"))).alias("file"))
    return x.filter(~F.startswith("file", F.lit("../")) & ~F.startswith("file", F.lit("/")) & (F.col("file") != "")).groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


_TOPIC = "(SELECT min(topic_key) FROM observations WHERE lower(project) = 'heron-core')"


def _orders_sql() -> str:
    fields = ["lower(coalesce(topic_key, ''))", "lower(coalesce(title, ''))", "lower(coalesce(content, ''))"]
    hits = " + ".join(f"contains({f}, '{n}')::INT" for n in M.topic_needles(_QUERY) for f in fields)
    new, mine = "created_at DESC NULLS LAST, id DESC", "lower(project) = 'heron-core'"
    tops = {
        "cross": f"SELECT *, row_number() OVER (ORDER BY n DESC, trust DESC NULLS LAST, p DESC, {new}) AS place FROM k WHERE scope = 'project'",
        "topic": f"SELECT *, row_number() OVER (ORDER BY n DESC, CASE WHEN topic_key = {_TOPIC} THEN {M.TOPIC_BOOST} ELSE p END DESC, trust DESC NULLS LAST, {new}) AS place FROM k WHERE {mine}",
        "plain": f"SELECT *, row_number() OVER (ORDER BY n DESC, p DESC, trust DESC NULLS LAST, {new}) AS place FROM k WHERE {mine}",
        "query": f"SELECT *, row_number() OVER (ORDER BY a, m DESC, n DESC, trust DESC NULLS LAST, p DESC, {new}) AS place FROM (SELECT *, {hits} AS m, coalesce(starts_with(content, '{M.AUTO_CAPTURED}'), false)::INT AS a FROM k WHERE {mine} AND {hits} > 0 ORDER BY a, m DESC, {new} LIMIT 10) z",
    }
    parts = " UNION ALL ".join(f"SELECT '{v}' AS variant, place, id FROM ({q}) y WHERE place <= 10 AND (type IS NULL OR type NOT IN {M.NO_CONTEXT})" for v, q in tops.items())
    return f"WITH {_SIGNALS}, k AS (SELECT o.*, t.trust, coalesce(r.n, 0) AS n, {_PRIORITY} AS p FROM observations o LEFT JOIN t ON t.memory_id = o.id LEFT JOIN r ON r.memory_id = o.id WHERE {_LIVE} AND type <> 'skill') {parts}"


@_add("m6_context_orders", _orders_sql(), "links", "recalls")
def m6_orders(spark, d):
    """The first memories of a context in each of its four orders."""
    o = table(spark, d, "observations")
    topic = o.filter("lower(project) = 'heron-core'").agg(F.min("topic_key")).first()[0]
    known = M.signals(M.with_now(o, o).filter(M.live(F.col("now")) & (F.col("type") != "skill")), V.links(spark, d), V.recalls(spark, d))
    out = None
    for variant in ("cross", "topic", "plain", "query"):
        x = M.context_order(known, variant, "heron-core", topic, _QUERY).withColumn("variant", F.lit(variant))
        out = x if out is None else out.unionByName(x)
    return out.select("variant", "place", "id")


_CODE_QUERY = "staleCache snapshotReader run"
_CODE_TERMS = M.code_terms(_CODE_QUERY)


def _code_search_sql() -> str:
    n = range(len(_CODE_TERMS))
    tf = ", ".join(f"len(list_filter(w, lambda x: starts_with(x, '{t}'))) AS tf{i}" for i, t in enumerate(_CODE_TERMS))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in n)
    rel = " + ".join(f"greatest(ln((s.n - s.df{i} + .5) / (s.df{i} + .5)), {M.IDF_FLOOR}) * tf{i} * {M.BM25_K1 + 1} / (tf{i} + {M.BM25_K1} * ({1 - M.BM25_B} + {M.BM25_B} * size / s.avg_size))" for i in n)
    return f"""WITH w AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', name, kind, signature, file_path)), '[a-z0-9]+') AS w FROM code_symbols), c AS (SELECT id, len(w) AS size, {tf} FROM w), s AS (SELECT count(*) AS n, avg(size) AS avg_size, {df} FROM c),
      b AS (SELECT c.id, {rel} AS b FROM c, s WHERE {" + ".join(f"tf{i}" for i in n)} > 0 ORDER BY b DESC, c.id LIMIT 40),
      k AS (SELECT b.id, b.b, 2.0 * (SELECT count(*) FROM calls WHERE dst = b.id) + 1.5 * (SELECT count(*) FROM imports WHERE dst = b.id) + .25 * (SELECT count(*) FROM calls WHERE src = b.id) AS c FROM b), m AS (SELECT CASE WHEN max(c) > 0 THEN max(c) ELSE 1 END AS m FROM k)
      SELECT id, round(.75 * b / (1 + b) + .25 * c / m, 6)::DOUBLE AS score FROM k, m ORDER BY score DESC, id LIMIT 10"""


@_add("m4_code_search", _code_search_sql(), "calls", "imports")
def m4(spark, d):
    return M.code_search(table(spark, d, "code_symbols"), V.calls(spark, d), V.imports(spark, d), _CODE_QUERY)


#: Fixed value: words that make a line of output important.
_IMPORTANT = r"(?i)\b(?:error|failed|failure|exception|todo|fixme|warning|deprecated|security|password|token|api\s?key)\b"


@_add(
    "h5_head_tail",
    f"""WITH {_LINES}, n AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS n, count(*) FILTER (WHERE regexp_matches(line, '{_IMPORTANT}')) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l),
        x AS (SELECT *, CASE WHEN n <= 20 OR line_no <= 12 THEN 'head' WHEN line_no > n - 8 THEN 'tail' WHEN regexp_matches(line, '{_IMPORTANT}') AND k <= 50 THEN 'important' END AS part FROM n) SELECT doc_id, line_no, part, line FROM x WHERE part IS NOT NULL""",
)
def h5(spark, d):
    """Texts cut down to their first and last lines and the important ones between (12, 8 and 50 here, as the tables' texts are short)."""
    return T.head_and_tail(table(spark, d, "documents"), "doc_id", "text", 12, 8, _IMPORTANT)


def _quoted(x: str) -> str:
    return x.replace("'", "''")


@_add(
    "m15_cleanup",
    f"""WITH {_SIGNALS}, rel AS ({_RELATIONS}), a AS (SELECT o.*, t.trust, coalesce(r.u, 0) AS u, coalesce(expires_at < n.now, false) AS gone, coalesce(created_at < n.now - INTERVAL {M.MIN_AGE_DAYS} DAY, false) AS old
         FROM observations o CROSS JOIN (SELECT max(created_at) AS now FROM observations) n LEFT JOIN t ON t.memory_id = o.id LEFT JOIN r ON r.memory_id = o.id),
      ov AS (SELECT DISTINCT target_id FROM rel WHERE confidence >= {M.SURE_RELATION} AND source_id IN (SELECT id FROM a WHERE NOT gone AND deleted_at IS NULL)),
      b AS (SELECT *, CASE WHEN gone THEN 'expired' WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN id IN (SELECT target_id FROM ov) THEN 'superseded' WHEN type IN ('progress', 'accomplished') AND u = 0 AND old THEN 'stale'
         WHEN type IN {M.SELF_CAPTURED_TYPES} AND u = 0 AND starts_with(lower(content), '{M.AUTO_CAPTURED.lower()}') AND (trust IS NULL OR trust < {M.LOW_TRUST}) AND old THEN 'auto-detected' WHEN starts_with(lower(title), 'correction:') AND old THEN 'correction'
         WHEN type = 'decision' AND (regexp_matches(title, '{_quoted(M.NOISE_TITLES[0])}') OR regexp_matches(title, '{_quoted(M.NOISE_TITLES[1])}')) THEN 'noise' END AS phase FROM a),
      g AS (SELECT topic_key, project, min(id) AS kept_id FROM b WHERE phase IS NULL AND topic_key <> '' AND expires_at IS NULL AND type NOT IN ('skill', 'session_summary') GROUP BY 1, 2 HAVING count(*) >= {M.TOPIC_GROUP}),
      s AS (SELECT id FROM b WHERE phase IS NULL AND type = 'session_summary' QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC NULLS LAST, id DESC) > 1)
      SELECT b.id, coalesce(phase, CASE WHEN b.id = g.kept_id THEN 'merged' WHEN g.kept_id IS NOT NULL THEN 'consolidated' WHEN b.id IN (SELECT id FROM s) THEN 'summary' END) AS phase, CASE WHEN phase IS NULL THEN g.kept_id END AS kept_id
      FROM b LEFT JOIN g ON g.topic_key = b.topic_key AND g.project IS NOT DISTINCT FROM b.project AND b.phase IS NULL AND b.expires_at IS NULL AND b.type NOT IN ('skill', 'session_summary')""",
    "links",
    "recalls",
)
def m15_cleanup(spark, d):
    return M.cleaned(table(spark, d, "observations"), relations(spark, d), V.links(spark, d), V.recalls(spark, d))


_MODULES = """SELECT i.src, f.path, CASE i.src % 4 WHEN 0 THEN 'lib' || dst WHEN 1 THEN '../' || split_part(g.path, '/', 2) || '/' || regexp_replace(split_part(g.path, '/', 3), '[.]js$', '') WHEN 2 THEN './../' || split_part(g.path, '/', 2) || '/./' || split_part(g.path, '/', 3)
  ELSE './' || split_part(g.path, '/', 3) END AS module, CASE i.src % 4 WHEN 1 THEN 'src/' || split_part(g.path, '/', 2) || '/' || regexp_replace(split_part(g.path, '/', 3), '[.]js$', '') WHEN 2 THEN g.path WHEN 3 THEN 'src/' || split_part(f.path, '/', 2) || '/' || split_part(g.path, '/', 3) END AS at
  FROM (SELECT DISTINCT src, dst FROM imports) i JOIN files f ON f.id = i.src JOIN files g ON g.id = i.dst"""


@_add(
    "g3_import_targets",
    f"WITH m AS (SELECT row_number() OVER () AS n, * FROM ({_MODULES}) z), e AS (SELECT unnest({list(G.IMPORT_ENDINGS)}) AS ending, unnest(range({len(G.IMPORT_ENDINGS)})) AS place), t AS (SELECT n, arg_min(f.id, place) AS target FROM m CROSS JOIN e JOIN files f ON f.path = m.at || e.ending GROUP BY n) SELECT src, module, target FROM m LEFT JOIN t ON t.n = m.n",
    "imports",
    "files",
)
def g3(spark, d):
    """The files that modules of imports mean."""
    f = V.files(spark, d).select("id", "path")
    i = V.imports(spark, d).select("src", "dst").distinct().join(f.select(F.col("id").alias("src"), "path"), "src").join(f.select(F.col("id").alias("dst"), F.col("path").alias("to")), "dst")
    part, k = F.split("to", "/"), F.col("src") % 4
    bare = F.regexp_replace(part[2], "[.]js$", "")
    module = F.when(k == 0, F.concat(F.lit("lib"), F.col("dst").cast("string"))).when(k == 1, F.concat(F.lit("../"), part[1], F.lit("/"), bare)).when(k == 2, F.concat(F.lit("./../"), part[1], F.lit("/./"), part[2])).otherwise(F.concat(F.lit("./"), part[2]))
    return G.import_targets(i.select("src", "path", module.alias("module")), f).select("src", "module", "target")
