"""Queries over code files, imports, calls and commits."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import views as V
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
SEED = 112


def _add(name: str, sql: str | None = None, *needs: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = V.sql(sql, *needs)
        return f

    return put


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def _walk(edges: str, depth: int) -> str:
    """SQL of the least depths from SEED along an edge table, level by level."""
    parts = [f"s0 AS (SELECT {SEED}::BIGINT AS id)", f"v0 AS (SELECT id, 0 AS depth FROM s0)"]
    for k in range(1, depth + 1):
        parts.append(f"s{k} AS (SELECT DISTINCT e.dst AS id FROM {edges} e JOIN s{k - 1} ON e.src = s{k - 1}.id WHERE e.dst NOT IN (SELECT id FROM v{k - 1}))")
        parts.append(f"v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT id, {k} FROM s{k})")
    return ", ".join(parts)


@_add("f9_test_files", r"SELECT id FROM files WHERE regexp_matches(path, '(^|/)(test|tests|spec|__tests__)(/|$)|[._](test|spec)\.|(^|/)test_[^/]*$')", "files")
def f9(spark, d):
    return V.files(spark, d).filter(G.is_test_path(F.col("path"))).select("id")


@_add("f5_glob", "SELECT id FROM files WHERE path GLOB 'src/small/*bolt_1*.js'", "files")
def f5(spark, d):
    return V.files(spark, d).filter(F.col("path").rlike(r"^src/small/.*bolt_1.*\.js$")).select("id")


@_add("f4_path_match", "SELECT id, path FROM files WHERE path = '_12.js' OR ends_with(path, '_12.js') ORDER BY length(path), path LIMIT 1", "files")
def f4(spark, d):
    return V.files(spark, d).filter(F.endswith("path", F.lit("_12.js"))).orderBy(F.length("path"), "path").limit(1).select("id", "path")


@_add(
    "f7_winnow",
    """WITH i AS (SELECT dst, count(DISTINCT src) AS n FROM imports GROUP BY dst) SELECT f.id, f.cyclomatic, coalesce(i.n, 0) AS importers FROM files f LEFT JOIN i ON i.dst = f.id
       WHERE f.cyclomatic >= 10 AND coalesce(i.n, 0) >= 1 AND regexp_matches(path, 'bolt|gear') ORDER BY importers DESC, f.cyclomatic DESC, f.id LIMIT 100""",
    "imports",
    "files",
)
def f7(spark, d):
    i = V.imports(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("importers"))
    x = V.files(spark, d).filter((F.col("cyclomatic") >= 10) & F.col("path").rlike("bolt|gear")).join(i, "id").filter("importers >= 1")
    return x.select("id", "cyclomatic", "importers").orderBy(F.desc("importers"), F.desc("cyclomatic"), "id").limit(100)


@_add(
    "j2_import_edges",
    "SELECT i.src, coalesce(f.path, 'module:' || i.dst) AS target, i.kind FROM imports i LEFT JOIN files f ON f.id = i.dst",
    "imports",
    "files",
)
def j2(spark, d):
    f = V.files(spark, d).select(F.col("id").alias("dst"), "path")
    return V.imports(spark, d).join(f, "dst", "left").select("src", F.coalesce("path", F.concat(F.lit("module:"), F.col("dst").cast("string"))).alias("target"), "kind")


@_add(
    "j10_two_hop_calls",
    f"SELECT DISTINCT b.dst AS id FROM calls a JOIN calls b ON a.dst = b.src WHERE a.src = {SEED}",
    "calls",
)
def j10(spark, d):
    c = V.calls(spark, d)
    first = c.filter(F.col("src") == SEED).select(F.col("dst").alias("src")).distinct()
    return c.join(first, "src", "left_semi").select(F.col("dst").alias("id")).distinct()


@_add(
    "j11_symbol_at_line",
    """SELECT file_path, line, arg_min(id, (end_line - start_line, id)) AS id FROM (SELECT s.*, l.line FROM code_symbols s JOIN (SELECT DISTINCT file_path AS p, start_line + 2 AS line FROM code_symbols) l
       ON l.p = s.file_path AND l.line BETWEEN s.start_line AND s.end_line) x GROUP BY file_path, line""",
)
def j11(spark, d):
    s = table(spark, d, "code_symbols").select("id", "file_path", "start_line", "end_line")
    lines = s.select("file_path", (F.col("start_line") + 2).alias("line")).distinct()
    hit = s.join(lines, "file_path").filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return hit.groupBy("file_path", "line").agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), "id")).alias("id"))


@_add(
    "j14_runtime_match",
    """WITH k AS (SELECT id, file_path || ':' || name AS key, file_path || ':' || qualified_name AS full_key FROM code_symbols),
       r AS (SELECT id AS hit, CASE WHEN id % 3 = 0 THEN file_path || ':' || qualified_name ELSE file_path || ':' || name END AS key FROM code_symbols)
       SELECT hit, coalesce((SELECT min(id) FROM k WHERE k.key = r.key), (SELECT min(id) FROM k WHERE k.full_key = r.key)) AS symbol FROM r""",
)
def j14(spark, d):
    s = table(spark, d, "code_symbols")
    by = lambda c: s.groupBy(F.concat_ws(":", "file_path", c).alias("key")).agg(F.min("id").alias(c))
    key = F.when(F.col("id") % 3 == 0, F.concat_ws(":", "file_path", "qualified_name")).otherwise(F.concat_ws(":", "file_path", "name"))
    hits = s.select(F.col("id").alias("hit"), key.alias("key"))
    return hits.join(by("name"), "key", "left").join(by("qualified_name"), "key", "left").select("hit", F.coalesce("name", "qualified_name").alias("symbol"))


@_add(
    "a12_coupling",
    """WITH a AS (SELECT dst AS id, count(DISTINCT src) AS ca FROM imports GROUP BY dst), e AS (SELECT src AS id, count(DISTINCT dst) AS ce FROM imports WHERE kind <> 're-export' GROUP BY src),
       x AS (SELECT f.id, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM files f LEFT JOIN a ON a.id = f.id LEFT JOIN e ON e.id = f.id),
       y AS (SELECT *, CASE WHEN ca + ce > 0 THEN round(ce / (ca + ce), 2) ELSE 0 END AS instability FROM x)
       SELECT *, CASE WHEN instability <= .3 THEN 'stable' WHEN instability >= .7 THEN 'unstable' ELSE 'balanced' END AS category FROM y""",
    "imports",
    "files",
)
def a12(spark, d):
    return G.coupling(V.imports(spark, d), V.files(spark, d))


@_add(
    "a13_extraction",
    """SELECT c.dst AS id, count(DISTINCT c.src) AS callers, round(f.cyclomatic * log10(1 + count(DISTINCT c.src)), 4) AS score, string_agg(DISTINCT g.layer, ',' ORDER BY g.layer) AS layers
       FROM calls c JOIN files f ON f.id = c.dst JOIN files g ON g.id = c.src WHERE f.cyclomatic >= 5 GROUP BY c.dst, f.cyclomatic HAVING count(DISTINCT c.src) >= 2""",
    "calls",
    "files",
)
def a13(spark, d):
    f = V.files(spark, d)
    c = V.calls(spark, d).join(f.select(F.col("id").alias("src"), "layer"), "src")
    g = c.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers")).filter("callers >= 2")
    return g.join(f.filter("cyclomatic >= 5").select("id", "cyclomatic"), "id").select("id", "callers", F.round(F.col("cyclomatic") * F.log10(1 + F.col("callers")), 4).alias("score"), "layers")


@_add(
    "a14_churn",
    """WITH n AS (SELECT max(committed_at) AS now FROM commits) SELECT file_id, count(DISTINCT commit_id) AS commits, count(DISTINCT author_id) AS authors, min(committed_at) AS first_seen, max(committed_at) AS last_seen,
       round(count(DISTINCT commit_id) / (365 / 7.0), 2) AS per_week FROM commits, n WHERE committed_at >= now - INTERVAL 365 DAY GROUP BY file_id""",
    "commits",
)
def a14(spark, d):
    return G.churn(V.commits(spark, d), 365)


_COCHANGE = """c AS (SELECT DISTINCT commit_id, file_id FROM commits), n AS (SELECT commit_id FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
       p AS (SELECT x.file_id AS a, y.file_id AS b, count(*) AS together FROM c x JOIN c y ON x.commit_id = y.commit_id AND x.file_id < y.file_id WHERE x.commit_id IN (SELECT commit_id FROM n) GROUP BY 1, 2),
       q AS (SELECT a, b, together, round(together / (SELECT max(together) FROM p), 2) AS strength FROM p)"""


@_add("a16_cochange", f"WITH {_COCHANGE} SELECT * FROM q UNION ALL SELECT b, a, together, strength FROM q", "commits")
def a16(spark, d):
    return G.cochange(V.commits(spark, d))


_CENTRAL = """i AS (SELECT dst AS id, count(*) AS n FROM calls GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM calls GROUP BY 1), m AS (SELECT dst AS id, count(DISTINCT src) AS n FROM imports GROUP BY 1)"""


@_add(
    "a17_centrality",
    f"WITH {_CENTRAL} SELECT f.id, (2.0 * coalesce(i.n, 0) + 1.5 * coalesce(m.n, 0) + .25 * coalesce(o.n, 0))::DOUBLE AS centrality FROM files f LEFT JOIN i ON i.id = f.id LEFT JOIN o ON o.id = f.id LEFT JOIN m ON m.id = f.id",
    "calls",
    "imports",
    "files",
)
def a17(spark, d):
    c, n = V.calls(spark, d), F.count(F.lit(1))
    i, o = c.groupBy(F.col("dst").alias("id")).agg(n.alias("i")), c.groupBy(F.col("src").alias("id")).agg(n.alias("o"))
    m = V.imports(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("m"))
    x = V.files(spark, d).select("id").join(i, "id", "left").join(o, "id", "left").join(m, "id", "left").na.fill(0)
    return x.select("id", (2.0 * F.col("i") + 1.5 * F.col("m") + 0.25 * F.col("o")).alias("centrality"))


@_add(
    "a27_graph_metrics",
    """SELECT (SELECT count(DISTINCT id) FROM (SELECT src AS id FROM calls UNION ALL SELECT dst FROM calls) x) AS nodes, (SELECT count(*) FROM calls) AS edges,
       (SELECT max(n) FROM (SELECT count(*) AS n FROM calls GROUP BY dst) x) AS max_in, (SELECT max(n) FROM (SELECT count(*) AS n FROM calls GROUP BY src) x) AS max_out""",
    "calls",
)
def a27(spark, d):
    c, n = V.calls(spark, d), F.count(F.lit(1))
    deg = c.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    g = deg.groupBy("e.id").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    return g.agg(n.alias("nodes"), F.sum("o").alias("edges"), F.max("i").alias("max_in"), F.max("o").alias("max_out"))


@_add(
    "c2_hotspots",
    """WITH c AS (SELECT file_id, count(DISTINCT commit_id) AS n FROM commits GROUP BY 1), h AS (SELECT f.id, round(f.cyclomatic * log10(1 + c.n), 2) AS hotspot FROM files f JOIN c ON c.file_id = f.id)
       SELECT id, hotspot, CASE WHEN hotspot >= 20 THEN 'critical' WHEN hotspot >= 10 THEN 'high' WHEN hotspot >= 5 THEN 'medium' ELSE 'low' END AS risk FROM h ORDER BY hotspot DESC, id LIMIT 50""",
    "commits",
    "files",
)
def c2(spark, d):
    c = V.commits(spark, d).groupBy(F.col("file_id").alias("id")).agg(F.count_distinct("commit_id").alias("n"))
    h = V.files(spark, d).join(c, "id").select("id", F.round(F.col("cyclomatic") * F.log10(1 + F.col("n")), 2).alias("hotspot"))
    return h.withColumn("risk", G.level(F.col("hotspot"), {"critical": 20, "high": 10, "medium": 5}, "low")).orderBy(F.desc("hotspot"), "id").limit(50)


@_add(
    "e1_modules",
    """WITH f AS (SELECT id, split_part(path, '/', 2) AS module FROM files) SELECT f.module, count(*) AS files, sum(coalesce(i.n, 0))::BIGINT AS importers FROM f
       LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM imports GROUP BY dst) i ON i.dst = f.id GROUP BY f.module""",
    "imports",
    "files",
)
def e1(spark, d):
    i = V.imports(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
    f = V.files(spark, d).select("id", F.split_part("path", F.lit("/"), F.lit(2)).alias("module"))
    return f.join(i, "id", "left").groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("importers"))


@_add(
    "e2_repo_graph",
    """WITH s AS (SELECT file_path, count(*) AS n FROM code_symbols GROUP BY 1), t AS (SELECT file_path, n, least(1.0, n / 50.0) AS importance FROM s ORDER BY n DESC, file_path LIMIT 50) SELECT * FROM t""",
)
def e2(spark, d):
    s = table(spark, d, "code_symbols").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return s.orderBy(F.desc("n"), "file_path").limit(50).withColumn("importance", F.least(F.lit(1.0), F.col("n") / 50.0))


@_add("e3_file_hotspots", "SELECT file_path, count(*) AS symbols, sum(end_line - start_line + 1)::BIGINT AS lines FROM code_symbols GROUP BY 1 ORDER BY lines DESC, file_path LIMIT 20")
def e3(spark, d):
    g = table(spark, d, "code_symbols").groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    return g.orderBy(F.desc("lines"), "file_path").limit(20)


@_add("g4_import_closure", f"WITH {_walk('imports', 3)} SELECT id, depth FROM v3", "imports")
def g4(spark, d):
    return G.closure(V.imports(spark, d), _ids(spark, SEED), 3)


def _named_walk(name: str, edges: str, depth: int) -> str:
    """_walk() with its tables named apart."""
    return re.sub(r"\b([sv])(\d)\b", rf"{name}\1\2", _walk(edges, depth))


@_add(
    "g5_blast_radius",
    f"""WITH e AS (SELECT dst AS src, src AS dst FROM calls WHERE confidence >= .7), m AS (SELECT dst AS src, src AS dst FROM imports), {_named_walk('c', 'e', 3)}, {_named_walk('i', 'm', 3)},
        u AS (SELECT id, depth, 1 AS calls, 0 AS imports FROM cv3 UNION ALL SELECT id, depth, 0, 1 FROM iv3) SELECT id, min(depth) AS depth, max(calls) AS calls, max(imports) AS imports FROM u GROUP BY id""",
    "calls",
    "imports",
)
def g5(spark, d):
    """Files that a change reaches within three hops, by sure calls, by imports, or both."""
    turned = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    c = G.closure(turned(V.calls(spark, d).filter("confidence >= 0.7")), _ids(spark, SEED), 3).withColumn("calls", F.lit(1)).withColumn("imports", F.lit(0))
    i = G.closure(turned(V.imports(spark, d)), _ids(spark, SEED), 3).withColumn("calls", F.lit(0)).withColumn("imports", F.lit(1))
    return c.unionByName(i).groupBy("id").agg(F.min("depth").alias("depth"), F.max("calls").alias("calls"), F.max("imports").alias("imports"))


@_add(
    "g6_call_hierarchy",
    f"""WITH e AS (SELECT dst AS src, src AS dst FROM calls), {_named_walk('d', 'calls', 3)}, {_named_walk('u', 'e', 3)}, x AS (SELECT 'callees' AS side, * FROM dv3 UNION ALL SELECT 'callers', * FROM uv3)
        SELECT side, x.id, depth, f.path FROM x LEFT JOIN files f ON f.id = x.id""",
    "calls",
    "files",
)
def g6(spark, d):
    """Callers and callees within three hops; one without a file is kept."""
    c = V.calls(spark, d)
    down = G.closure(c, _ids(spark, SEED), 3).withColumn("side", F.lit("callees"))
    up = G.closure(c.select(F.col("dst").alias("src"), F.col("src").alias("dst")), _ids(spark, SEED), 3).withColumn("side", F.lit("callers"))
    return down.unionByName(up).join(V.files(spark, d).select("id", "path"), "id", "left").select("side", "id", "depth", "path")


@_add(
    "g7_import_cycles",
    """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM imports WHERE src <> dst), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
       m AS (SELECT x.a AS id, min(x.b) AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT id, least(id, other) AS component FROM m WHERE id <> other OR id IN (SELECT other FROM m WHERE id <> other)""",
    "imports",
)
def g7(spark, d):
    return G.components(V.imports(spark, d))


_TARGET = "(SELECT min(dst) FROM calls WHERE src IN (SELECT dst FROM calls WHERE src = 112))"


@_add("g10_shortest_path", f"WITH {_walk('calls', 6)} SELECT {SEED}::BIGINT AS source, id AS target, depth AS hops FROM v6 WHERE id = {_TARGET}", "calls")
def g10(spark, d):
    c = V.calls(spark, d)
    second = c.join(c.filter(F.col("src") == SEED).select(F.col("dst").alias("src")).distinct(), "src", "left_semi").agg(F.min("dst").alias("id"))
    target = second.first()["id"]
    return G.path_length(c, SEED, -1 if target is None else target, 6)


def _rank_sql(edges: str, nodes: str) -> str:
    parts = [f"n AS (SELECT count(*) AS n FROM {nodes})", f"o AS (SELECT src, count(*) AS k FROM {edges} GROUP BY src)", f"r0 AS (SELECT id, 1.0::DOUBLE / n.n AS rank FROM {nodes}, n)"]
    for k in range(1, 11):
        parts.append(
            f"r{k} AS (SELECT v.id, .15::DOUBLE / n.n + .85::DOUBLE * coalesce(g.s, 0) AS rank FROM {nodes} v CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(r.rank / o.k) AS s FROM {edges} e JOIN r{k - 1} r ON r.id = e.src JOIN o ON o.src = e.src GROUP BY e.dst) g ON g.dst = v.id)"
        )
    return "WITH " + ", ".join(parts)


@_add("g11_page_rank", _rank_sql("calls", "files") + " SELECT id, round(rank, 12) AS rank FROM r10", "calls", "files")
def g11(spark, d):
    return G.page_rank(V.calls(spark, d), V.files(spark, d).select("id")).select("id", F.round("rank", 12).alias("rank"))


@_add("g12_importance", _rank_sql("calls", "files") + " SELECT id, round(rank, 6) AS rank FROM r10 ORDER BY round(rank, 6) DESC, id LIMIT 20", "calls", "files")
def g12(spark, d):
    return G.page_rank(V.calls(spark, d), V.files(spark, d).select("id")).select("id", F.round("rank", 6).alias("rank")).orderBy(F.desc("rank"), "id").limit(20)


@_add(
    "g13_dead_code",
    f"""WITH RECURSIVE e AS (SELECT src, dst FROM imports), entry AS (SELECT id FROM files WHERE cyclomatic % 25 = 0), reach(id) AS (SELECT id FROM entry UNION SELECT e.dst FROM reach JOIN e ON e.src = reach.id),
       c AS (SELECT DISTINCT dst AS id FROM calls WHERE confidence >= .7), x AS (SELECT DISTINCT dst AS id FROM imports WHERE kind = 're-export'),
       s AS (SELECT f.id, round(CASE WHEN f.id NOT IN (SELECT id FROM c) THEN .33 ELSE 0 END + CASE WHEN f.id NOT IN (SELECT id FROM reach) THEN .34 ELSE 0 END - CASE WHEN f.id IN (SELECT id FROM x) THEN .34 ELSE 0 END, 2)::DOUBLE AS confidence FROM files f)
       SELECT * FROM s WHERE confidence >= .5""",
    "imports",
    "calls",
    "files",
)
def g13(spark, d):
    f, i = V.files(spark, d).select("id", "cyclomatic"), V.imports(spark, d)
    reach = G.closure(i, f.filter("cyclomatic % 25 = 0")).select("id", F.lit(1).alias("reached"))
    called = V.calls(spark, d).filter("confidence >= 0.7").select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(1))
    out = i.filter("kind = 're-export'").select(F.col("dst").alias("id")).distinct().withColumn("exported", F.lit(1))
    x = f.join(reach, "id", "left").join(called, "id", "left").join(out, "id", "left")
    c = F.when(F.col("called").isNull(), 0.33).otherwise(0.0) + F.when(F.col("reached").isNull(), 0.34).otherwise(0.0) - F.when(F.col("exported").isNotNull(), 0.34).otherwise(0.0)
    return x.select("id", F.round(c, 2).alias("confidence")).filter("confidence >= 0.5")


@_add(
    "g14_untested",
    r"""WITH t AS (SELECT id FROM files WHERE regexp_matches(path, '[._](test|spec)\.')), a AS (SELECT DISTINCT dst AS id FROM calls WHERE src IN (SELECT id FROM t)),
       b AS (SELECT DISTINCT dst AS id FROM calls WHERE src IN (SELECT id FROM a)), m AS (SELECT DISTINCT dst AS id FROM imports WHERE src IN (SELECT id FROM t))
       SELECT f.id, CASE WHEN f.id IN (SELECT id FROM b) THEN .4 WHEN f.id IN (SELECT id FROM m) THEN .7 ELSE 1.0 END::DOUBLE AS confidence FROM files f WHERE f.id NOT IN (SELECT id FROM t) AND f.id NOT IN (SELECT id FROM a)""",
    "calls",
    "imports",
    "files",
)
def g14(spark, d):
    f, c = V.files(spark, d), V.calls(spark, d)
    t = f.filter(F.col("path").rlike(r"[._](test|spec)\.")).select("id")
    hop = lambda edges, ids: edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    a = hop(c, t)
    b, m = hop(c, a).withColumn("b", F.lit(1)), hop(V.imports(spark, d), t).withColumn("m", F.lit(1))
    x = f.select("id").join(t, "id", "left_anti").join(a, "id", "left_anti").join(b, "id", "left").join(m, "id", "left")
    return x.select("id", F.when(F.col("b").isNotNull(), 0.4).when(F.col("m").isNotNull(), 0.7).otherwise(1.0).alias("confidence"))


@_add(
    "g15_change_risk",
    f"""WITH e AS (SELECT dst AS src, src AS dst FROM calls WHERE confidence >= .7), {_walk('e', 5)}, k AS (SELECT count(*) - 1 AS callers FROM v5),
       c AS (SELECT count(DISTINCT commit_id) AS commits FROM commits WHERE file_id = {SEED}), y AS (SELECT cyclomatic FROM files WHERE id = {SEED}),
       r AS (SELECT callers, commits, cyclomatic, round(.375 * least(1, callers / 50.0) + .25 * least(1, cyclomatic / 30.0) + .25 * least(1, commits / 20.0), 4)::DOUBLE AS risk FROM k, c, y)
       SELECT *, CASE WHEN risk <= .3 THEN 'low' WHEN risk <= .6 THEN 'medium' WHEN risk <= .8 THEN 'high' ELSE 'critical' END AS level FROM r""",
    "calls",
    "commits",
    "files",
)
def g15(spark, d):
    k = g15_callers(spark, d).agg((F.count(F.lit(1)) - 1).alias("callers"))
    c = V.commits(spark, d).filter(F.col("file_id") == SEED).agg(F.count_distinct("commit_id").alias("commits"))
    y = V.files(spark, d).filter(F.col("id") == SEED).select("cyclomatic")
    part = lambda x, most: F.least(F.lit(1.0), F.col(x) / most)
    r = k.join(F.broadcast(c)).join(F.broadcast(y)).withColumn("risk", F.round(0.375 * part("callers", 50.0) + 0.25 * part("cyclomatic", 30.0) + 0.25 * part("commits", 20.0), 4))
    return r.withColumn("level", F.when(F.col("risk") <= 0.3, "low").when(F.col("risk") <= 0.6, "medium").when(F.col("risk") <= 0.8, "high").otherwise("critical"))


def g15_callers(spark, d):
    back = V.calls(spark, d).filter("confidence >= 0.7").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.closure(back, _ids(spark, SEED), 5)


def _spread(depth: int) -> str:
    parts = [f"v0 AS (SELECT {SEED}::BIGINT AS id, 1.0::DOUBLE AS score, 0 AS depth)", "s0 AS (SELECT id FROM v0)"]
    for k in range(1, depth + 1):
        parts.append(f"h{k} AS (SELECT e.dst AS id, max(e.base * pow(.85, {k})) AS score FROM b e JOIN s{k - 1} s ON s.id = e.src WHERE e.dst NOT IN (SELECT id FROM v{k - 1}) GROUP BY e.dst HAVING max(e.base * pow(.85, {k})) >= .1)")
        parts.append(f"s{k} AS (SELECT id FROM h{k})")
        parts.append(f"v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT id, score, {k} FROM h{k})")
    return ", ".join(parts)


@_add(
    "g16_propagation",
    f"""WITH {_COCHANGE}, w AS (SELECT dst AS src, src AS dst, confidence * .7 AS base FROM calls UNION ALL SELECT dst, src, .5 FROM imports UNION ALL SELECT a, b, strength * .3 FROM q UNION ALL SELECT b, a, strength * .3 FROM q),
       b AS (SELECT src, dst, max(base) AS base FROM w GROUP BY 1, 2), {_spread(4)} SELECT id, round(score, 6) AS score, depth FROM v4""",
    "calls",
    "imports",
    "commits",
)
def g16(spark, d):
    back = lambda e, w, k: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w.alias("weight"), F.lit(k).alias("kind"))
    c = G.cochange(V.commits(spark, d)).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("strength").alias("weight"), F.lit("cochange").alias("kind"))
    edges = back(V.calls(spark, d), F.col("confidence"), "call").unionByName(back(V.imports(spark, d), F.lit(1.0), "import")).unionByName(c)
    return G.propagate(edges, _ids(spark, SEED), depth=4).select("id", F.round("score", 6).alias("score"), "depth")


_CLASSES = "SELECT DISTINCT name AS child, parent_name AS parent FROM code_symbols WHERE parent_name IS NOT NULL"


@_add("g17_class_members", f"WITH h AS ({_CLASSES}) SELECT parent, count(*) AS members, min(child) AS first_member FROM h GROUP BY parent")
def g17(spark, d):
    h = table(spark, d, "code_symbols").filter("parent_name IS NOT NULL").select(F.col("name").alias("child"), F.col("parent_name").alias("parent")).distinct()
    return h.groupBy("parent").agg(F.count(F.lit(1)).alias("members"), F.min("child").alias("first_member"))


@_add(
    "g18_signal_chains",
    """WITH n AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS k FROM calls) x WHERE k = 1), c0 AS (SELECT id AS gate, id FROM files WHERE cyclomatic = 1),
       c1 AS (SELECT gate, n.dst AS id FROM c0 JOIN n ON n.src = c0.id), c2 AS (SELECT gate, n.dst AS id FROM c1 JOIN n ON n.src = c1.id), c3 AS (SELECT gate, n.dst AS id FROM c2 JOIN n ON n.src = c2.id)
       SELECT *, 1 AS step FROM c1 UNION ALL SELECT *, 2 FROM c2 UNION ALL SELECT *, 3 FROM c3""",
    "calls",
    "files",
)
def g18(spark, d):
    n = G.newest_per(V.calls(spark, d), ["src"], [F.desc("confidence"), F.col("dst")]).select(F.col("src").alias("id"), "dst")
    at, out = V.files(spark, d).filter("cyclomatic = 1").select(F.col("id").alias("gate"), "id"), None
    for step in (1, 2, 3):
        at = at.join(n, "id").select("gate", F.col("dst").alias("id"))
        part = at.withColumn("step", F.lit(step))
        out = part if out is None else out.unionByName(part)
    return out


@_add(
    "g19_layer_violations",
    "SELECT i.src, i.dst, a.layer AS src_layer, b.layer AS dst_layer FROM imports i JOIN files a ON a.id = i.src JOIN files b ON b.id = i.dst WHERE (a.layer, b.layer) IN (('Brand#11', 'Brand#22'), ('Brand#12', 'Brand#3'), ('Brand#13', 'Brand#4'))",
    "imports",
    "files",
)
def g19(spark, d):
    rules = spark.createDataFrame([("Brand#11", "Brand#22"), ("Brand#12", "Brand#3"), ("Brand#13", "Brand#4")], "src_layer string, dst_layer string")
    f = V.files(spark, d)
    a, b = f.select(F.col("id").alias("src"), F.col("layer").alias("src_layer")), f.select(F.col("id").alias("dst"), F.col("layer").alias("dst_layer"))
    return V.imports(spark, d).join(a, "src").join(b, "dst").join(F.broadcast(rules), ["src_layer", "dst_layer"], "left_semi").select("src", "dst", "src_layer", "dst_layer")


@_add(
    "g21_reexport_closure",
    """WITH e AS (SELECT DISTINCT src, dst FROM imports WHERE kind = 're-export'), a AS (SELECT src, dst, 1 AS depth FROM e), b AS (SELECT a.src, e.dst, 2 AS depth FROM a JOIN e ON a.dst = e.src), c AS (SELECT b.src, e.dst, 3 AS depth FROM b JOIN e ON b.dst = e.src),
       u AS (SELECT src, dst, min(depth) AS depth FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) x WHERE src <> dst GROUP BY 1, 2) SELECT src, dst, depth, CASE depth WHEN 1 THEN 1.0 WHEN 2 THEN .49 ELSE .343 END::DOUBLE AS weight FROM u""",
    "imports",
)
def g21(spark, d):
    e = V.imports(spark, d).filter("kind = 're-export'").select("src", "dst").distinct()
    at, every = e, e.withColumn("depth", F.lit(1))
    for depth in (2, 3):
        at = at.select("src", F.col("dst").alias("via")).join(e.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        every = every.unionByName(at.withColumn("depth", F.lit(depth)))
    u = every.filter("src <> dst").groupBy("src", "dst").agg(F.min("depth").alias("depth"))
    return u.withColumn("weight", F.when(F.col("depth") == 1, 1.0).when(F.col("depth") == 2, 0.49).otherwise(0.343))


@_add(
    "g25_resolved_names",
    """WITH n AS (SELECT id AS link, symbol_path, repo FROM symbol_links WHERE symbol_path IS NOT NULL), s AS (SELECT l.id AS link, y.id AS symbol, CASE WHEN y.file_path = l.symbol_path THEN 1.0 WHEN r.name = l.repo THEN .7 ELSE .5 END::DOUBLE AS confidence
       FROM symbol_links l JOIN code_symbols y ON y.stable_symbol_id = l.symbol_id JOIN code_repos r ON r.id = y.repo_id) SELECT link, symbol, confidence FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY confidence DESC, symbol) AS k FROM s) x WHERE k = 1""",
)
def g25(spark, d):
    l = table(spark, d, "symbol_links").select(F.col("id").alias("link"), "symbol_path", "repo", F.col("symbol_id").alias("stable_symbol_id"))
    y = table(spark, d, "code_symbols").join(table(spark, d, "code_repos").select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name")), "repo_id")
    x = l.join(y.select("stable_symbol_id", F.col("id").alias("symbol"), "file_path", "repo_name"), "stable_symbol_id")
    x = x.withColumn("confidence", F.when(F.col("file_path") == F.col("symbol_path"), 1.0).when(F.col("repo_name") == F.col("repo"), 0.7).otherwise(0.5))
    return G.newest_per(x, ["link"], [F.desc("confidence"), F.col("symbol")]).select("link", "symbol", "confidence")


def _least_conf(depth: int) -> str:
    parts = [f"v0 AS (SELECT {SEED}::BIGINT AS id, 0 AS depth, 1.0::DOUBLE AS confidence)", "s0 AS (SELECT * FROM v0)"]
    for k in range(1, depth + 1):
        parts.append(f"s{k} AS (SELECT e.dst AS id, {k} AS depth, max(least(s.confidence, e.confidence)) AS confidence FROM e JOIN s{k - 1} s ON s.id = e.src WHERE e.dst NOT IN (SELECT id FROM v{k - 1}) GROUP BY e.dst)")
        parts.append(f"v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM s{k})")
    return ", ".join(parts)


@_add("g28_impact", f"WITH e AS (SELECT dst AS src, src AS dst, confidence FROM calls WHERE confidence >= .5), {_least_conf(8)} SELECT * FROM v8", "calls")
def g28(spark, d):
    back = V.calls(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence")
    return G.least_confidence_paths(back, _ids(spark, SEED), depth=8)


@_add(
    "g29_version_diff",
    """WITH o AS (SELECT p_partkey AS id, p_name AS name, p_size AS body, p_brand AS place FROM part WHERE p_partkey % 11 <> 0),
       n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_name || 'X' ELSE p_name END AS name, p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS body, CASE WHEN p_partkey % 7 = 0 THEN 'moved' ELSE p_brand END AS place FROM part WHERE p_partkey % 13 <> 0)
       SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN o.name <> n.name THEN 'renamed' WHEN o.body = n.body AND o.place = n.place THEN 'unchanged' WHEN o.place <> n.place THEN 'moved' ELSE 'body' END AS change FROM o FULL JOIN n ON o.id = n.id""",
)
def g29(spark, d):
    p = table(spark, d, "part")
    o = p.filter("p_partkey % 11 <> 0").selectExpr("p_partkey as id", "p_name as name", "p_size as body", "p_brand as place", "true as was").alias("o")
    n = p.filter("p_partkey % 13 <> 0").selectExpr("p_partkey as id", "case when p_partkey % 5 = 0 then concat(p_name, 'X') else p_name end as name", "p_size + case when p_partkey % 3 = 0 then 1 else 0 end as body", "case when p_partkey % 7 = 0 then 'moved' else p_brand end as place", "true as now").alias("n")
    x = o.join(n, "id", "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("o.name") != F.col("n.name"), "renamed")
    return x.select("id", kind.when((F.col("o.body") == F.col("n.body")) & (F.col("o.place") == F.col("n.place")), "unchanged").when(F.col("o.place") != F.col("n.place"), "moved").otherwise("body").alias("change"))


#: Files that were touched within a year of the newest commit.
_LIVE = "SELECT file_id FROM commits, (SELECT max(committed_at) AS t FROM commits) n WHERE committed_at >= t - INTERVAL 365 DAY"


@_add("g31_stale_edges", f"WITH a AS ({_LIVE}) SELECT c.src, c.dst FROM calls c WHERE c.src NOT IN (SELECT file_id FROM a) OR c.dst NOT IN (SELECT file_id FROM a)", "calls", "commits")
def g31(spark, d):
    alive = G.churn(V.commits(spark, d), 365).select(F.col("file_id").alias("id"), F.lit(True).alias("alive"))
    c = V.calls(spark, d).join(alive.select(F.col("id").alias("src"), F.col("alive").alias("a")), "src", "left").join(alive.select(F.col("id").alias("dst"), F.col("alive").alias("b")), "dst", "left")
    return c.filter("a IS NULL OR b IS NULL").select("src", "dst")


@_add(
    "g32_fingerprints",
    "SELECT id, substr(sha256(coalesce(signature, '')), 1, 16) AS signature_hash, substr(sha256(file_path || ':' || start_line || ':' || end_line), 1, 16) AS place_hash, substr(sha256(concat_ws('|', qualified_name, kind)), 1, 16) AS identity_hash FROM code_symbols",
)
def g32(spark, d):
    h = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    place = F.concat_ws(":", "file_path", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    return table(spark, d, "code_symbols").select("id", h(F.coalesce("signature", F.lit(""))).alias("signature_hash"), h(place).alias("place_hash"), h(F.concat_ws("|", "qualified_name", "kind")).alias("identity_hash"))


@_add("k1_public_symbols", "SELECT qualified_name, kind, count(*) AS versions FROM code_symbols WHERE parent_name IS NULL AND NOT starts_with(name, '_') GROUP BY 1, 2")
def k1(spark, d):
    return table(spark, d, "code_symbols").filter("parent_name IS NULL AND NOT startswith(name, '_')").groupBy("qualified_name", "kind").agg(F.count(F.lit(1)).alias("versions"))


@_add("k4_stale_symbols", "SELECT id FROM (SELECT id, indexed_at, max(indexed_at) OVER (PARTITION BY stable_symbol_id) AS newest FROM code_symbols) x WHERE indexed_at < newest")
def k4(spark, d):
    s = table(spark, d, "code_symbols").select("id", "indexed_at", F.max("indexed_at").over(Window.partitionBy("stable_symbol_id")).alias("newest"))
    return s.filter("indexed_at < newest").select("id")


@_add("k8_repo_graph", "SELECT c.src, c.dst FROM calls c WHERE c.src IN (SELECT id FROM files WHERE layer = 'Brand#11') AND c.dst IN (SELECT id FROM files WHERE layer = 'Brand#11')", "calls", "files")
def k8(spark, d):
    inside = V.files(spark, d).filter("layer = 'Brand#11'").select("id")
    return V.calls(spark, d).join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@_add("k9_languages", "SELECT CASE WHEN regexp_matches(file_path, '\\.(m?js|cjs)$') THEN 'javascript' WHEN ends_with(file_path, '.ts') THEN 'typescript' WHEN ends_with(file_path, '.py') THEN 'python' WHEN ends_with(file_path, '.rs') THEN 'rust' WHEN ends_with(file_path, '.go') THEN 'go' ELSE 'other' END AS language, count(*) AS symbols FROM code_symbols GROUP BY 1")
def k9(spark, d):
    p = F.col("file_path")
    lang = F.when(p.rlike(r"\.(m?js|cjs)$"), "javascript").when(p.endswith(".ts"), "typescript").when(p.endswith(".py"), "python").when(p.endswith(".rs"), "rust").when(p.endswith(".go"), "go").otherwise("other")
    return table(spark, d, "code_symbols").groupBy(lang.alias("language")).agg(F.count(F.lit(1)).alias("symbols"))


@_add(
    "i2_agent_blast",
    f"""WITH a AS (SELECT DISTINCT src AS id FROM calls WHERE dst = {SEED}), b AS (SELECT DISTINCT src AS id FROM calls WHERE dst IN (SELECT id FROM a)), m AS (SELECT DISTINCT src AS id FROM imports WHERE dst = {SEED})
        SELECT (SELECT count(*) FROM a) AS direct, (SELECT count(*) FROM b) AS transitive, (SELECT count(*) FROM m) AS importers""",
    "calls",
    "imports",
)
def i2(spark, d):
    c = V.calls(spark, d)
    a = c.filter(F.col("dst") == SEED).select("src").distinct()
    b = c.join(a.select(F.col("src").alias("dst")), "dst", "left_semi").select("src").distinct()
    m = V.imports(spark, d).filter(F.col("dst") == SEED).select("src").distinct()
    n = lambda x, name: F.broadcast(x.agg(F.count(F.lit(1)).alias(name)))
    return n(a, "direct").join(n(b, "transitive")).join(n(m, "importers"))


@_add("i4_hot_symbols", "SELECT l_partkey AS id, sum(l_quantity) AS hits, CASE WHEN sum(l_quantity) >= 1000 THEN 'hot' WHEN sum(l_quantity) >= 100 THEN 'warm' ELSE 'cold' END AS traffic FROM lineitem GROUP BY 1")
def i4(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("hits"))
    return g.withColumn("traffic", G.level(F.col("hits"), {"hot": 1000, "warm": 100}, "cold"))
