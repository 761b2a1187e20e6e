"""Further queries: joins, aggregates and pipelines of the same families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import memory as M
from ..operators import text as T
from ..operators.similar import minhash_pairs
from ..sources import views as V
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def _n(name: str):
    return F.count(F.lit(1)).alias(name)


def _add(name: str, sql: str | None = None, *needs: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = V.sql(sql, *needs)
        return f

    return put


@_add("f2_scope", "SELECT scope, count(*) AS memories FROM observations WHERE lower(project) = 'heron-core' OR scope = 'personal' GROUP BY scope")
def f2(spark, d):
    return table(spark, d, "observations").filter(M.in_scope("Heron-Core")).groupBy("scope").agg(_n("memories"))


@_add("f6_regex_names", "SELECT id FROM code_symbols WHERE regexp_matches(name, '^(get|move|sort)[A-Z_]')")
def f6(spark, d):
    return table(spark, d, "code_symbols").filter(F.col("name").rlike("^(get|move|sort)[A-Z_]")).select("id")


@_add("j1_symbols_of_repos", "SELECT r.name AS repo, s.kind, count(*) AS symbols FROM code_symbols s JOIN code_repos r ON r.id = s.repo_id GROUP BY ALL")
def j1(spark, d):
    counts = table(spark, d, "code_symbols").groupBy("repo_id", "kind").agg(_n("symbols"))
    return counts.join(table(spark, d, "code_repos").select(F.col("id").alias("repo_id"), F.col("name").alias("repo")), "repo_id").select("repo", "kind", "symbols")


@_add("j3_link_counts", "SELECT o.id, coalesce(c.n, 0) AS links FROM observations o LEFT JOIN (SELECT memory_id, count(*) AS n FROM links GROUP BY 1) c ON c.memory_id = o.id", "links")
def j3(spark, d):
    c = V.links(spark, d).filter("memory_id IS NOT NULL").groupBy(F.col("memory_id").alias("id")).agg(_n("n"))
    return table(spark, d, "observations").select("id").join(c, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("links"))


@_add("j7_prefiltered", "SELECT id FROM observations WHERE id IN (SELECT id FROM observations WHERE contains(lower(content), 'snapshot')) AND type = 'decision'")
def j7(spark, d):
    o = table(spark, d, "observations")
    return o.filter("type = 'decision'").select("id").join(o.filter(F.contains(F.lower("content"), F.lit("snapshot"))).select("id"), "id", "left_semi")


@_add("j12_json_fields", "SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE cast(json_extract_string(props, '$.k') AS BIGINT) > 50")
def j12(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k").filter("k > 50")


@_add(
    "j13_suffix_paths",
    "SELECT DISTINCT l.id, s.file_path FROM symbol_links l JOIN code_symbols s ON s.file_path = l.symbol_path OR ends_with(s.file_path, '/' || array_to_string(string_split(l.symbol_path, '/')[-2:], '/'))",
)
def j13(spark, d):
    # the last name is an equality key, the longer suffix a condition on what meets
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    tail = F.array_join(F.slice(F.split("symbol_path", "/"), -2, 2), "/")
    l = table(spark, d, "symbol_links").filter("symbol_path IS NOT NULL").select("id", "symbol_path", base(F.col("symbol_path")).alias("b"), tail.alias("t"))
    s = table(spark, d, "code_symbols").filter("file_path IS NOT NULL").select("file_path", base(F.col("file_path")).alias("b")).distinct()
    hit = l.join(s, "b").filter((F.col("file_path") == F.col("symbol_path")) | F.endswith("file_path", F.concat(F.lit("/"), "t")))
    return hit.select("id", "file_path").distinct()


@_add("j16_like_names", "SELECT id, first_id FROM (SELECT id, stable_symbol_id, min(id) OVER (PARTITION BY lower(name)) AS first_id, arg_min(stable_symbol_id, id) OVER (PARTITION BY lower(name)) AS first_symbol FROM code_symbols) x WHERE id > first_id AND stable_symbol_id <> first_symbol")
def j16(spark, d):
    # against the first symbol of the name, not all pairs of a name
    s = table(spark, d, "code_symbols").select("id", F.lower("name").alias("n"), "stable_symbol_id")
    first = s.groupBy("n").agg(F.min("id").alias("first_id"), F.min_by("stable_symbol_id", "id").alias("first_symbol"))
    return s.join(first, "n").filter("id > first_id AND stable_symbol_id <> first_symbol").select("id", "first_id")


@_add("i1_similar_prompts")
def i1(spark, d):
    """Prompts alike by MinHash bands, as pairs of classes."""
    return minhash_pairs(table(spark, d, "user_prompts"), "content")


@_add("a15_file_churn", "SELECT count(DISTINCT commit_id) AS commits, count(DISTINCT author_id) AS authors, min(committed_at) AS first_seen, max(committed_at) AS last_seen FROM commits WHERE file_id = 112", "commits")
def a15(spark, d):
    return V.commits(spark, d).filter("file_id = 112").agg(F.count_distinct("commit_id").alias("commits"), F.count_distinct("author_id").alias("authors"), F.min("committed_at").alias("first_seen"), F.max("committed_at").alias("last_seen"))


@_add("a21_traffic", "WITH h AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT CASE WHEN q >= 1000 THEN 'hot' WHEN q >= 100 THEN 'warm' ELSE 'cold' END AS traffic, count(*) AS symbols FROM h GROUP BY 1")
def a21(spark, d):
    h = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return h.groupBy(G.level(F.col("q"), {"hot": 1000, "warm": 100}, "cold").alias("traffic")).agg(_n("symbols"))


@_add("a22_run_states", "SELECT CASE WHEN exit_code IS NULL THEN 'unknown' WHEN exit_code = 0 THEN 'ok' ELSE 'failed' END AS state, count(*) AS runs FROM token_saver_runs GROUP BY 1")
def a22(spark, d):
    s = F.when(F.col("exit_code").isNull(), "unknown").when(F.col("exit_code") == 0, "ok").otherwise("failed")
    return table(spark, d, "token_saver_runs").groupBy(s.alias("state")).agg(_n("runs"))


@_add("a24_memory_stats", "SELECT project, count(*) AS memories, count(deleted_at) AS deleted, count(expires_at) AS expiring, count(DISTINCT topic_key) AS topics, count(DISTINCT session_id) AS sessions FROM observations GROUP BY project")
def a24(spark, d):
    return table(spark, d, "observations").groupBy("project").agg(_n("memories"), F.count("deleted_at").alias("deleted"), F.count("expires_at").alias("expiring"), F.count_distinct("topic_key").alias("topics"), F.count_distinct("session_id").alias("sessions"))


@_add(
    "a25_repo_health",
    """SELECT r.name, round((CASE WHEN r.path IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN r.indexed_at >= (SELECT max(indexed_at) FROM code_repos) - INTERVAL 30 DAY THEN 1 ELSE 0 END + coalesce(q.q, 0)) / 3, 2)::DOUBLE AS health
       FROM code_repos r LEFT JOIN (SELECT repo_id, avg(CASE WHEN signature IS NULL THEN 0.0 ELSE 1.0 END) AS q FROM code_symbols GROUP BY 1) q ON q.repo_id = r.id""",
)
def a25(spark, d):
    r = table(spark, d, "code_repos")
    q = table(spark, d, "code_symbols").groupBy(F.col("repo_id").alias("id")).agg(F.avg(F.when(F.col("signature").isNull(), 0.0).otherwise(1.0)).alias("q"))
    fresh = F.col("indexed_at") >= F.expr("now - INTERVAL 30 DAYS")
    x = M.with_now(r, r, "indexed_at").join(q, "id", "left")
    return x.select("name", F.round((F.when(F.col("path").isNotNull(), 1).otherwise(0) + F.when(fresh, 1).otherwise(0) + F.coalesce("q", F.lit(0.0))) / 3, 2).alias("health"))


@_add("a29_cost_fold", "SELECT user_id % 10 AS mission, count(*) AS calls, round(sum(value), 4) AS cost, sum(event_id % 1000 + event_id % 377)::BIGINT AS tokens FROM events GROUP BY 1")
def a29(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("mission")).agg(_n("calls"), F.round(F.sum("value"), 4).alias("cost"), F.sum(F.expr("event_id % 1000 + event_id % 377")).alias("tokens"))


@_add("w6_skipped_summaries", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM observations WHERE deleted_at IS NULL) x WHERE rn > 5")
def w6(spark, d):
    w = Window.partitionBy("project").orderBy(F.col("created_at").desc_nulls_last(), F.desc("id"))
    return table(spark, d, "observations").filter("deleted_at IS NULL").select("id", F.row_number().over(w).alias("rn")).filter("rn > 5").select("id")


@_add("w7_newest_runs", "SELECT command_type, id FROM token_saver_runs QUALIFY row_number() OVER (PARTITION BY command_type ORDER BY id DESC) <= 20")
def w7(spark, d):
    return M.keep_newest(table(spark, d, "token_saver_runs").select("command_type", "id"), "command_type", "id", 20)


@_add("w10_widest_symbols", "SELECT id, end_line - start_line AS height FROM code_symbols ORDER BY height DESC, start_line, id LIMIT 25")
def w10(spark, d):
    return table(spark, d, "code_symbols").select("id", (F.col("end_line") - F.col("start_line")).alias("height"), "start_line").orderBy(F.desc("height"), "start_line", "id").limit(25).select("id", "height")


@_add("w13_first_definition", "SELECT name, arg_min(id, (start_line, id)) AS id FROM code_symbols GROUP BY name")
def w13(spark, d):
    return table(spark, d, "code_symbols").groupBy("name").agg(F.min_by("id", F.struct("start_line", "id")).alias("id"))


@_add(
    "u3_superseded",
    """SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project, title ORDER BY created_at DESC NULLS LAST, id DESC) AS k FROM observations WHERE deleted_at IS NULL AND project IS NOT NULL) x WHERE k > 1
       UNION SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project, topic_key, type ORDER BY created_at DESC NULLS LAST, id DESC) AS k FROM observations WHERE deleted_at IS NULL AND topic_key IS NOT NULL AND project IS NOT NULL) x WHERE k > 1""",
)
def u3(spark, d):
    o = table(spark, d, "observations").filter("deleted_at IS NULL AND project IS NOT NULL").select("id", "project", "title", "topic_key", "type", "created_at")
    place = lambda *g: F.row_number().over(Window.partitionBy(*g).orderBy(F.col("created_at").desc_nulls_last(), F.desc("id")))
    a = o.withColumn("k", place("project", "title")).filter("k > 1").select("id")
    return a.union(o.filter("topic_key IS NOT NULL").withColumn("k", place("project", "topic_key", "type")).filter("k > 1").select("id")).distinct()


@_add("u5_upsert", "SELECT id, CASE WHEN id % 5 = 0 THEN upper(name) ELSE name END AS name FROM code_symbols UNION ALL SELECT -id, name FROM code_symbols WHERE id % 50 = 0")
def u5(spark, d):
    s = table(spark, d, "code_symbols").select("id", "name")
    new = s.filter("id % 5 = 0").select("id", F.upper("name").alias("name")).unionByName(s.filter("id % 50 = 0").select((-F.col("id")).alias("id"), "name"))
    return G.upsert(s, new, "id")


@_add("u6_first_wins", "SELECT min(id) AS id, memory_id, symbol_id FROM links WHERE memory_id IS NOT NULL AND symbol_id IS NOT NULL GROUP BY memory_id, symbol_id", "links")
def u6(spark, d):
    return V.links(spark, d).filter("memory_id IS NOT NULL AND symbol_id IS NOT NULL").groupBy("memory_id", "symbol_id").agg(F.min("id").alias("id"))


@_add(
    "g8_levels",
    """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM imports WHERE src < dst), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), p(id, level) AS (SELECT id, 0 FROM v UNION SELECT e.dst, p.level + 1 FROM p JOIN e ON e.src = p.id)
       SELECT id, max(level) AS level FROM p GROUP BY id""",
    "imports",
)
def g8(spark, d):
    return G.levels(V.imports(spark, d).filter("src < dst"))


@_add("g22_reference_edges", "SELECT DISTINCT s.file_path AS dst_path, l.symbol_path AS src_path FROM symbol_links l JOIN code_symbols s ON s.stable_symbol_id = l.symbol_id WHERE l.symbol_path <> s.file_path AND s.kind <> 'function'")
def g22(spark, d):
    s = table(spark, d, "code_symbols").filter("kind <> 'function'").select(F.col("stable_symbol_id").alias("symbol_id"), F.col("file_path").alias("dst_path")).distinct()
    return table(spark, d, "symbol_links").select("symbol_id", F.col("symbol_path").alias("src_path")).join(s, "symbol_id").filter("src_path <> dst_path").select("dst_path", "src_path").distinct()


@_add(
    "g24_resolved_exports",
    """WITH b AS (SELECT DISTINCT src AS name, dst AS via FROM imports WHERE kind = 're-export'), t0 AS (SELECT id AS name, id AS target FROM files WHERE cyclomatic >= 30),
       s1 AS (SELECT b.name, min(t.target) AS target FROM b JOIN t0 t ON t.name = b.via WHERE b.name NOT IN (SELECT name FROM t0) GROUP BY 1), t1 AS (SELECT * FROM t0 UNION ALL SELECT * FROM s1),
       s2 AS (SELECT b.name, min(t.target) AS target FROM b JOIN t1 t ON t.name = b.via WHERE b.name NOT IN (SELECT name FROM t1) GROUP BY 1), t2 AS (SELECT * FROM t1 UNION ALL SELECT * FROM s2),
       s3 AS (SELECT b.name, min(t.target) AS target FROM b JOIN t2 t ON t.name = b.via WHERE b.name NOT IN (SELECT name FROM t2) GROUP BY 1)
       SELECT *, 0 AS passes FROM t0 UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3""",
    "imports",
    "files",
)
def g24(spark, d):
    b = V.imports(spark, d).filter("kind = 're-export'").select(F.col("src").alias("name"), F.col("dst").alias("via")).distinct()
    return G.resolve_aliases(b, V.files(spark, d).filter("cyclomatic >= 30").select(F.col("id").alias("name"), F.col("id").alias("target")), 3)


@_add("g26_affected", "WITH c AS (SELECT DISTINCT file_id AS id FROM commits, (SELECT max(committed_at) AS t FROM commits) n WHERE committed_at >= t - INTERVAL 7 DAY) SELECT id FROM c UNION SELECT src FROM imports WHERE dst IN (SELECT id FROM c) UNION SELECT src FROM calls WHERE dst IN (SELECT id FROM c)", "imports", "calls", "commits")
def g26(spark, d):
    c = G.churn(V.commits(spark, d), 7).select(F.col("file_id").alias("id"))  # what the newest week changed
    near = lambda e: e.join(c.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return c.union(near(V.imports(spark, d))).union(near(V.calls(spark, d))).distinct()


@_add("m13_list_items", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_kind = 'list') SELECT doc_id, trim(regexp_replace(line, '^ *([-*]|[0-9]+[.)]) +', '')) AS item FROM l WHERE regexp_matches(line, '^ *([-*]|[0-9]+[.)]) +')")
def m13(spark, d):
    mark = r"^ *([-*]|[0-9]+[.)]) +"
    l = table(spark, d, "documents").filter("doc_kind = 'list'").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(mark))
    return l.select("doc_id", F.trim(F.regexp_replace("line", mark, "")).alias("item"))


_TOP = "SELECT symbol_id FROM links WHERE symbol_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, symbol_id LIMIT 1"


@_add("m19_symbol_cluster", f"SELECT symbol_id, count(*) AS shared FROM links WHERE memory_id IN (SELECT memory_id FROM links WHERE symbol_id = ({_TOP})) AND symbol_id <> ({_TOP}) GROUP BY 1", "links")
def m19(spark, d):
    """Symbols that share memories with the symbol that has most links."""
    l = V.links(spark, d).filter("memory_id IS NOT NULL AND symbol_id IS NOT NULL").select("memory_id", "symbol_id")
    top = F.broadcast(l.groupBy("symbol_id").agg(_n("n")).orderBy(F.desc("n"), "symbol_id").limit(1).select("symbol_id"))
    memories = l.join(top, "symbol_id", "left_semi").select("memory_id").distinct()
    return l.join(top, "symbol_id", "left_anti").join(memories, "memory_id", "left_semi").groupBy("symbol_id").agg(_n("shared"))


@_add("t4_adjusted", "SELECT id, round(greatest(0, least(1, trust_score + CASE WHEN id % 2 = 0 THEN .4 ELSE -.7 END)), 4)::DOUBLE AS trust_score FROM links", "links")
def t4(spark, d):
    delta = F.when(F.col("id") % 2 == 0, 0.4).otherwise(-0.7)
    return V.links(spark, d).select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("trust_score") + delta)), 4).alias("trust_score"))


@_add(
    "c7_likely_tests",
    r"""WITH t AS (SELECT id FROM files WHERE regexp_matches(path, '[._](test|spec)\.')), x AS (SELECT dst AS id, src AS test, 'calls' AS reason FROM calls WHERE src IN (SELECT id FROM t) UNION SELECT dst, src, 'imports' FROM imports WHERE src IN (SELECT id FROM t))
        SELECT id, test, string_agg(reason, ',' ORDER BY reason) AS reasons FROM x GROUP BY ALL""",
    "calls",
    "imports",
    "files",
)
def c7(spark, d):
    t = V.files(spark, d).filter(F.col("path").rlike(r"[._](test|spec)\.")).select(F.col("id").alias("src"))
    part = lambda e, why: e.join(t, "src", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("test"), F.lit(why).alias("reason"))
    x = part(V.calls(spark, d), "calls").unionByName(part(V.imports(spark, d), "imports"))
    return x.groupBy("id", "test").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@_add("c3_outline", "SELECT file_path, string_agg(name, ',' ORDER BY start_line, id) AS names FROM code_symbols GROUP BY file_path")
def c3(spark, d):
    g = table(spark, d, "code_symbols").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "name"))).alias("s"))
    return g.select("file_path", F.array_join(F.transform("s", lambda x: x["name"]), ",").alias("names"))


_TERMS = ["snapshot", "checker", "guarded"]


@_add(
    "d5_doc_search",
    "WITH c AS (SELECT doc_id, "
    + ", ".join(f"len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))
    + ", len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS size FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(size) AS a, "
    + ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(3))
    + " FROM c) SELECT doc_id, round("
    + " + ".join(f"greatest(ln((n - df{i} + .5) / (df{i} + .5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (.25 + .75 * size / a))" for i in range(3))
    + ", 6) AS relevance FROM c, s WHERE tf0 + tf1 + tf2 > 0 ORDER BY relevance DESC, doc_id LIMIT 20",
)
def d5(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    x = M.bm25(M.term_counts(docs, _TERMS, F.col("text")), 3).filter("matched > 0")
    return x.select("doc_id", F.round("relevance", 6).alias("relevance")).orderBy(F.desc("relevance"), "doc_id").limit(20)


@_add("d10_texts_without_mention", "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(content, '[a-z]+/[a-z/]+[a-z-]+[.][a-z]+')) AS path FROM observations) SELECT DISTINCT file_path FROM code_symbols WHERE file_path NOT IN (SELECT path FROM w)")
def d10(spark, d):
    w = table(spark, d, "observations").select(F.explode(F.regexp_extract_all("content", F.lit("[a-z]+/[a-z/]+[a-z-]+[.][a-z]+"), F.lit(0))).alias("file_path")).distinct()
    return table(spark, d, "code_symbols").select("file_path").distinct().join(w, "file_path", "left_anti")


@_add("v1_unique_names", "WITH p AS (SELECT DISTINCT file_path, string_split(file_path, '/')[-1] AS base FROM code_symbols) SELECT file_path FROM (SELECT *, count(*) OVER (PARTITION BY base) AS n FROM p) x WHERE n = 1")
def v1(spark, d):
    p = table(spark, d, "code_symbols").select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("base")).distinct()
    one = p.groupBy("base").agg(_n("n"), F.min("file_path").alias("file_path")).filter("n = 1")
    return one.select("file_path")


@_add(
    "v2_proof_state",
    """WITH l AS (SELECT command, arg_max(coalesce(exit_code, -1), id) AS code, max(created_at) AS seen FROM token_saver_runs WHERE command IS NOT NULL GROUP BY command)
       SELECT CASE WHEN seen < (SELECT max(created_at) FROM token_saver_runs) - INTERVAL 60 DAY THEN 'stale' WHEN code = -1 THEN 'unknown' WHEN code = 0 THEN 'proved' ELSE 'failed' END AS state, count(*) AS commands FROM l GROUP BY 1""",
)
def v2(spark, d):
    r = table(spark, d, "token_saver_runs").filter("command IS NOT NULL")
    l = r.groupBy("command").agg(F.max_by(F.coalesce("exit_code", F.lit(-1)), "id").alias("code"), F.max("created_at").alias("at"))
    l = l.join(F.broadcast(table(spark, d, "token_saver_runs").agg(F.max("created_at").alias("now"))))
    s = F.when(F.col("at") < F.expr("now - INTERVAL 60 DAYS"), "stale").when(F.col("code") == -1, "unknown").when(F.col("code") == 0, "proved").otherwise("failed")
    return l.groupBy(s.alias("state")).agg(_n("commands"))


@_add("v3_new_failures", "SELECT DISTINCT command FROM token_saver_runs WHERE exit_code <> 0 AND id % 2 = 0 AND command NOT IN (SELECT command FROM token_saver_runs WHERE exit_code <> 0 AND id % 2 = 1 AND command IS NOT NULL)")
def v3(spark, d):
    f = table(spark, d, "token_saver_runs").filter("exit_code <> 0 AND command IS NOT NULL").select("command", "id")
    return f.filter("id % 2 = 0").select("command").distinct().join(f.filter("id % 2 = 1").select("command").distinct(), "command", "left_anti")


@_add("e5_longest_prefix", "WITH r AS (SELECT DISTINCT string_split(file_path, '/')[1] AS one, string_split(file_path, '/')[1] || '/' || string_split(file_path, '/')[2] AS two FROM code_symbols WHERE id % 3 = 0) SELECT l.id, CASE WHEN string_split(symbol_path, '/')[1] || '/' || string_split(symbol_path, '/')[2] IN (SELECT two FROM r) THEN 2 WHEN string_split(symbol_path, '/')[1] IN (SELECT one FROM r) THEN 1 ELSE 0 END AS depth FROM symbol_links l WHERE symbol_path IS NOT NULL")
def e5(spark, d):
    # prefixes by depth are equality keys; the deepest that meets counts
    parts = lambda c, n: F.array_join(F.slice(F.split(c, "/"), 1, n), "/")
    r = table(spark, d, "code_symbols").filter("id % 3 = 0").select(F.explode(F.array(*(F.struct(F.lit(n).alias("depth"), parts("file_path", n).alias("prefix")) for n in (1, 2)))).alias("p")).select("p.*").distinct()
    l = table(spark, d, "symbol_links").filter("symbol_path IS NOT NULL").select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("depth"), parts("symbol_path", n).alias("prefix")) for n in (1, 2)))).alias("p")).select("id", "p.*")
    hit = l.join(r.withColumn("hit", F.lit(1)), ["depth", "prefix"], "left")
    return hit.groupBy("id").agg(F.max(F.when(F.col("hit") == 1, F.col("depth")).otherwise(0)).alias("depth"))


@_add("h4_paths_by_file", r"WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:[a-z]+/)+[a-z-]+[.][a-z]+')) AS path FROM documents), g AS (SELECT doc_id, path, count(*) AS hits FROM u GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, path) <= 10")
def h4(spark, d):
    u = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?:[a-z]+/)+[a-z-]+[.][a-z]+"), F.lit(0))).alias("path"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("hits"), "path")
    return u.groupBy("doc_id", "path").agg(_n("hits")).withColumn("k", F.row_number().over(w)).filter("k <= 10").drop("k")


@_add("k6_reindex_keeps", "SELECT c.src, c.dst FROM calls c WHERE NOT (confidence >= .9 AND (src IN (SELECT id FROM files WHERE layer = 'Brand#1') OR dst IN (SELECT id FROM files WHERE layer = 'Brand#1')))", "calls", "files")
def k6(spark, d):
    r = V.files(spark, d).filter("layer = 'Brand#1'").select("id", F.lit(True).alias("hit"))
    c = V.calls(spark, d).join(r.select(F.col("id").alias("src"), F.col("hit").alias("a")), "src", "left").join(r.select(F.col("id").alias("dst"), F.col("hit").alias("b")), "dst", "left")
    return c.filter("NOT (confidence >= 0.9 AND (a IS NOT NULL OR b IS NOT NULL))").select("src", "dst")


@_add("k7_soft_deleted", "SELECT id, CASE WHEN indexed_at < (SELECT max(indexed_at) FROM code_symbols) - INTERVAL 100 DAY THEN 'gone' ELSE 'kept' END AS state FROM code_symbols")
def k7(spark, d):
    s = table(spark, d, "code_symbols")
    return M.with_now(s, s, "indexed_at").select("id", F.when(F.col("indexed_at") < F.expr("now - INTERVAL 100 DAYS"), "gone").otherwise("kept").alias("state"))


@_add("d13_numbered_steps", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_kind = 'guide') SELECT doc_id, max(regexp_extract(line, '^([0-9]{1,4})[.] ', 1)::INT) AS steps FROM l WHERE regexp_matches(line, '^[0-9]{1,4}[.] ') GROUP BY doc_id")
def d13(spark, d):
    l = T.lines(table(spark, d, "documents").filter("doc_kind = 'guide'"), "doc_id", "text").filter(F.col("line").rlike("^[0-9]{1,4}[.] "))
    return l.groupBy("doc_id").agg(F.max(F.regexp_extract("line", "^([0-9]{1,4})[.] ", 1).cast("int")).alias("steps"))
