"""Queries over memories, prompts, edits, links and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import memory as M
from ..sources import views as V
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
QUERY, PROJECT = "Why does the snapshot cleaner keep legacy tokens?", "heron-core"


def _add(name: str, sql: str | None = None, *needs: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = V.sql(sql, *needs)
        return f

    return put


_NOW = "(SELECT max(created_at) FROM observations)"
_LIVE = f"deleted_at IS NULL AND (expires_at IS NULL OR expires_at > {_NOW})"
_SCOPE = f"(lower(project) = '{PROJECT}' OR scope = 'personal')"
_BOOST = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in M.TYPE_BOOST.items()) + " ELSE 1.0 END"
_PRIORITY = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in M.TYPE_PRIORITY.items()) + " ELSE 0 END"
_TERMS = M.query_terms(QUERY)
_SIGNALS = """t AS (SELECT memory_id, max(trust_score) AS trust FROM links WHERE memory_id IS NOT NULL GROUP BY 1),
     r AS (SELECT memory_id, count(*) AS n, count(*) FILTER (WHERE was_useful = 1) AS u FROM recalls GROUP BY 1)"""
_USEFUL = "CASE WHEN coalesce(r.n, 0) > 0 THEN r.u / r.n ELSE 0.5 END"


@_add(
    "f1_live_by_type",
    f"SELECT type, count(*) AS memories FROM observations WHERE {_LIVE} AND {_SCOPE} GROUP BY type",
)
def f1(spark, d):
    o = V.observations(spark, d)
    return M.with_now(o, o).filter(M.live(F.col("now")) & M.in_scope(PROJECT)).groupBy("type").agg(F.count(F.lit(1)).alias("memories"))


@_add("f3_substring", "SELECT id FROM observations WHERE contains(lower(title), '100%_') OR contains(lower(content), 'what surprised us: b')")
def f3(spark, d):
    return V.observations(spark, d).filter(F.contains(F.lower("title"), F.lit("100%_")) | F.contains(F.lower("content"), F.lit("what surprised us: b"))).select("id")


@_add("f8_timeline", "SELECT id, title FROM observations WHERE id BETWEEN 500 - 5 AND 500 + 5 AND deleted_at IS NULL")
def f8(spark, d):
    return V.observations(spark, d).filter(F.col("id").between(495, 505) & F.col("deleted_at").isNull()).select("id", "title")


@_add(
    "f12_type_priority",
    f"SELECT {_PRIORITY} AS priority, count(*) AS memories FROM observations GROUP BY 1",
)
def f12(spark, d):
    return V.observations(spark, d).groupBy(M.case_of(F.col("type"), M.TYPE_PRIORITY, 0).alias("priority")).agg(F.count(F.lit(1)).alias("memories"))


_NEEDLES = ["snapshot cleaner", "snapshot", "cleaner", "legacy"]


@_add(
    "f13_match_count",
    "SELECT id, " + " + ".join(f"(CASE WHEN contains(lower({c}), '{n}') THEN 1 ELSE 0 END)" for n in _NEEDLES for c in ("title", "content")) + " AS hits FROM observations WHERE hits > 1",
)
def f13(spark, d):
    hits = sum((F.contains(F.lower(F.col(c)), F.lit(n)).cast("int") for n in _NEEDLES for c in ("title", "content")), F.lit(0))
    return V.observations(spark, d).select("id", hits.alias("hits")).filter("hits > 1")


@_add(
    "a1_dashboard",
    f"""SELECT count(*) FILTER (WHERE deleted_at IS NULL) AS total, count(DISTINCT project) FILTER (WHERE deleted_at IS NULL) AS projects,
        count(*) FILTER (WHERE deleted_at IS NULL AND created_at >= {_NOW} - INTERVAL 7 DAY) AS saved_7d, count(*) FILTER (WHERE deleted_at >= {_NOW} - INTERVAL 7 DAY) AS cleaned_7d,
        count(*) FILTER (WHERE {_LIVE} AND expires_at < {_NOW} + INTERVAL 7 DAY) AS expiring_7d,
        (SELECT round(avg(trust_score), 6) FROM links) AS avg_trust,
        (SELECT count(*) FROM observations o WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM recalls r WHERE r.memory_id = o.id)) AS never_recalled FROM observations""",
    "links",
    "recalls",
)
def a1(spark, d):
    o = V.observations(spark, d)
    o = M.with_now(o, o)
    week, kept = F.expr("now - INTERVAL 7 DAYS"), F.col("deleted_at").isNull()
    recalled = V.recalls(spark, d).select("memory_id").distinct().withColumn("recalled", F.lit(True))
    o = o.join(recalled, o["id"] == recalled["memory_id"], "left")
    out = o.agg(
        F.count_if(kept).alias("total"),
        F.count_distinct(F.when(kept, F.col("project"))).alias("projects"),
        F.count_if(kept & (F.col("created_at") >= week)).alias("saved_7d"),
        F.count_if(F.col("deleted_at") >= week).alias("cleaned_7d"),
        F.count_if(M.live(F.col("now")) & (F.col("expires_at") < F.expr("now + INTERVAL 7 DAYS"))).alias("expiring_7d"),
        F.count_if(kept & F.col("recalled").isNull()).alias("never_recalled"),
    )
    return out.join(F.broadcast(V.links(spark, d).agg(F.round(F.avg("trust_score"), 6).alias("avg_trust"))))


@_add("a2_types", "SELECT type, count(*) AS memories FROM observations WHERE deleted_at IS NULL AND type <> 'skill' GROUP BY type")
def a2(spark, d):
    return V.observations(spark, d).filter(F.col("deleted_at").isNull() & (F.col("type") != "skill")).groupBy("type").agg(F.count(F.lit(1)).alias("memories"))


@_add(
    "a3_trust_histogram",
    """SELECT count(*) FILTER (WHERE trust_score >= .8) AS high, count(*) FILTER (WHERE trust_score >= .5 AND trust_score < .8) AS medium,
       count(*) FILTER (WHERE trust_score > 0 AND trust_score < .5) AS low, (SELECT count(*) FROM observations WHERE deleted_at IS NULL) - count(*) AS no_link FROM links""",
    "links",
)
def a3(spark, d):
    t = F.col("trust_score")
    h = V.links(spark, d).agg(F.count_if(t >= 0.8).alias("high"), F.count_if((t >= 0.5) & (t < 0.8)).alias("medium"), F.count_if((t > 0) & (t < 0.5)).alias("low"), F.count(F.lit(1)).alias("n"))
    total = V.observations(spark, d).filter("deleted_at IS NULL").agg(F.count(F.lit(1)).alias("m"))
    return h.join(F.broadcast(total)).select("high", "medium", "low", (F.col("m") - F.col("n")).alias("no_link"))


@_add("a4_recall_stats", "SELECT count(*) AS recalls, round(avg(was_useful), 6) AS usefulness, count(DISTINCT memory_id) AS memories FROM recalls", "recalls")
def a4(spark, d):
    return V.recalls(spark, d).agg(F.count(F.lit(1)).alias("recalls"), F.round(F.avg("was_useful"), 6).alias("usefulness"), F.count_distinct("memory_id").alias("memories"))


@_add("a5_projects", "SELECT project, count(*) AS memories, max(created_at) AS newest FROM observations WHERE deleted_at IS NULL AND project IS NOT NULL GROUP BY project")
def a5(spark, d):
    return V.observations(spark, d).filter("deleted_at IS NULL AND project IS NOT NULL").groupBy("project").agg(F.count(F.lit(1)).alias("memories"), F.max("created_at").alias("newest"))


@_add(
    "a6_workspaces",
    """SELECT p.project, count(o.id) FILTER (WHERE o.deleted_at IS NULL) AS memories, max(o.created_at) AS newest
       FROM (SELECT DISTINCT project FROM user_prompts WHERE project IS NOT NULL) p LEFT JOIN observations o ON o.project = p.project GROUP BY p.project""",
)
def a6(spark, d):
    p = table(spark, d, "user_prompts").filter("project IS NOT NULL").select("project").distinct()
    o = V.observations(spark, d).groupBy("project").agg(F.count_if(F.col("deleted_at").isNull()).alias("memories"), F.max("created_at").alias("newest"))
    return p.join(o, "project", "left").select("project", F.coalesce("memories", F.lit(0)).alias("memories"), "newest")


@_add("a7_idle_projects", f"SELECT project, max(started_at) AS last_start FROM sessions GROUP BY project HAVING max(started_at) < (SELECT max(started_at) FROM sessions) - INTERVAL 1 HOUR", "sessions")
def a7(spark, d):
    s = V.sessions(spark, d)
    g = s.groupBy("project").agg(F.max("started_at").alias("last_start"))
    return g.join(F.broadcast(s.agg(F.max("started_at").alias("now")))).filter(F.col("last_start") < F.expr("now - INTERVAL 1 HOUR")).select("project", "last_start")


@_add(
    "a8_session_stats",
    """SELECT project, count(*) AS sessions, count(*) FILTER (WHERE saved = 0) AS empty, count(*) FILTER (WHERE ended_at IS NULL) AS open, sum(saved)::BIGINT AS saved,
       min(started_at) AS first_start, max(started_at) AS last_start, greatest(count(*) - 5, 0) AS to_prune FROM sessions GROUP BY project""",
    "sessions",
)
def a8(spark, d):
    n = F.count(F.lit(1))
    return V.sessions(spark, d).groupBy("project").agg(
        n.alias("sessions"), F.count_if(F.col("saved") == 0).alias("empty"), F.count_if(F.col("ended_at").isNull()).alias("open"), F.sum("saved").alias("saved"),
        F.min("started_at").alias("first_start"), F.max("started_at").alias("last_start"), F.greatest(n - 5, F.lit(0)).alias("to_prune"),
    )


@_add(
    "a10_topic_groups",
    """SELECT project, topic_key, min(id) AS kept_id, count(*) AS memories, string_agg(title, ' | ' ORDER BY created_at, id) AS titles FROM observations
       WHERE deleted_at IS NULL AND topic_key IS NOT NULL AND project IS NOT NULL GROUP BY project, topic_key HAVING count(*) >= 3""",
)
def a10(spark, d):
    g = V.observations(spark, d).filter("deleted_at IS NULL AND topic_key IS NOT NULL AND project IS NOT NULL").groupBy("project", "topic_key")
    out = g.agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("memories"), F.array_sort(F.collect_list(F.struct("created_at", "id", F.coalesce("title", F.lit("")).alias("title")))).alias("t"))
    return out.filter("memories >= 3").select("project", "topic_key", "kept_id", "memories", F.array_join(F.transform("t", lambda x: x["title"]), " | ").alias("titles"))


@_add(
    "a18_savings",
    """SELECT command_type, count(*) AS runs, sum(estimated_saved_tokens::HUGEINT)::DOUBLE AS saved, round(avg(savings_percent), 6) AS avg_percent,
       count(*) FILTER (WHERE exit_code <> 0) AS failed FROM token_saver_runs GROUP BY command_type""",
)
def a18(spark, d):
    return table(spark, d, "token_saver_runs").groupBy("command_type").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("estimated_saved_tokens").cast("double").alias("saved"), F.round(F.avg("savings_percent"), 6).alias("avg_percent"), F.count_if(F.col("exit_code") != 0).alias("failed")
    )


@_add("a23_top_recalled", "SELECT memory_id, count(*) AS recalls FROM recalls GROUP BY 1 ORDER BY recalls DESC, memory_id LIMIT 20", "recalls")
def a23(spark, d):
    return V.recalls(spark, d).groupBy("memory_id").agg(F.count(F.lit(1)).alias("recalls")).orderBy(F.desc("recalls"), "memory_id").limit(20)


def _newest(group: str, at: str, keep: int, where: str, source: str) -> str:
    return f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {group} ORDER BY {at} DESC NULLS LAST, id DESC) AS rn FROM {source} WHERE {where}) x WHERE rn <= {keep}"


@_add("w1_latest_summaries", _newest("project", "created_at", 1, "type = 'session_summary' AND deleted_at IS NULL", "observations"))
def w1(spark, d):
    return M.keep_newest(V.observations(spark, d).filter("type = 'session_summary' AND deleted_at IS NULL").select("id", "project", "created_at"), "project", "created_at", 1).select("id")


@_add("w2_latest_prompts", _newest("project", "created_at", 10, "true", "user_prompts"))
def w2(spark, d):
    return M.keep_newest(table(spark, d, "user_prompts").select("id", "project", "created_at"), "project", "created_at", 10).select("id")


@_add(
    "w3_pruned_sessions",
    "SELECT id FROM sessions WHERE ended_at IS NOT NULL AND id NOT IN (" + _newest("project", "started_at", 10, "true", "sessions") + ")",
    "sessions",
)
def w3(spark, d):
    s = V.sessions(spark, d)
    keep = M.keep_newest(s.select("id", "project", "started_at"), "project", "started_at", 10).select("id")
    return s.filter("ended_at IS NOT NULL").join(keep, "id", "left_anti").select("id")


@_add(
    "w4_old_sessions",
    """SELECT id, project, place, sessions FROM (SELECT id, project, row_number() OVER (PARTITION BY project ORDER BY started_at DESC, id DESC) AS place,
       count(*) OVER (PARTITION BY project) AS sessions FROM sessions) x WHERE place > 5""",
    "sessions",
)
def w4(spark, d):
    w = Window.partitionBy("project").orderBy(F.desc("started_at"), F.desc("id"))
    s = V.sessions(spark, d).select("id", "project", F.row_number().over(w).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("project")).alias("sessions"))
    return s.filter("place > 5")


@_add(
    "w5_memories_of_symbol",
    """SELECT symbol_id, id, place FROM (SELECT symbol_id, o.id, row_number() OVER (PARTITION BY symbol_id ORDER BY o.created_at DESC, o.id DESC) AS place
       FROM (SELECT DISTINCT symbol_id, memory_id FROM links WHERE symbol_id IS NOT NULL) l JOIN observations o ON o.id = l.memory_id WHERE o.deleted_at IS NULL) x WHERE place <= 5""",
    "links",
)
def w5(spark, d):
    l = V.links(spark, d).filter("symbol_id IS NOT NULL").select("symbol_id", "memory_id").distinct()
    o = V.observations(spark, d).filter("deleted_at IS NULL").select("id", "created_at")
    w = Window.partitionBy("symbol_id").orderBy(F.desc("created_at"), F.desc("id"))
    return l.join(o, l["memory_id"] == o["id"]).withColumn("place", F.row_number().over(w)).filter("place <= 5").select("symbol_id", "id", "place")


@_add("w8_latest_run", "SELECT command_type, max(id) AS id, arg_max(exit_code, id) AS exit_code FROM (SELECT command_type, id, coalesce(exit_code, -1) AS exit_code FROM token_saver_runs) x GROUP BY command_type")
def w8(spark, d):
    return table(spark, d, "token_saver_runs").groupBy("command_type").agg(F.max("id").alias("id"), F.max_by(F.coalesce("exit_code", F.lit(-1)), "id").alias("exit_code"))


@_add(
    "w9_partial_days",
    """WITH c AS (SELECT command_type, cast(created_at AS DATE) AS run_day, count(*) AS n FROM token_saver_runs GROUP BY ALL),
       m AS (SELECT *, max(n) OVER (PARTITION BY command_type) AS most FROM c) SELECT command_type, strftime(run_day, '%Y-%m-%d') AS run_day, n, n * 2 < most AS partial FROM m""",
)
def w9(spark, d):
    c = table(spark, d, "token_saver_runs").groupBy("command_type", F.date_format("created_at", "yyyy-MM-dd").alias("run_day")).agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy("command_type"))
    return c.withColumn("partial", F.col("n") * 2 < most)


@_add(
    "j4_signals",
    f"WITH {_SIGNALS} SELECT o.id, t.trust, coalesce(r.n, 0) AS recall_count, coalesce(r.u, 0) AS useful_count FROM observations o LEFT JOIN t ON t.memory_id = o.id LEFT JOIN r ON r.memory_id = o.id",
    "links",
    "recalls",
)
def j4(spark, d):
    return M.signals(V.observations(spark, d).select("id"), V.links(spark, d), V.recalls(spark, d))


@_add("j5_dead_links", "SELECT id FROM links WHERE memory_id IS NULL OR memory_id NOT IN (SELECT id FROM observations WHERE deleted_at IS NULL)", "links")
def j5(spark, d):
    alive = V.observations(spark, d).filter("deleted_at IS NULL").select(F.col("id").alias("memory_id"))
    return V.links(spark, d).join(alive, "memory_id", "left_anti").select("id")


@_add(
    "j6_stale_sessions",
    """SELECT s.id FROM sessions s WHERE s.ended_at IS NULL AND s.started_at < (SELECT max(started_at) FROM sessions) - INTERVAL 6 HOUR
       AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.user_id = s.id // 1000 AND e.ts > s.started_at + INTERVAL 18 HOUR)""",
    "sessions",
)
def j6(spark, d):
    s = V.sessions(spark, d)
    now = F.broadcast(s.agg(F.max("started_at").alias("now")))
    opened = s.filter("ended_at IS NULL").join(now).filter(F.col("started_at") < F.expr("now - INTERVAL 6 HOURS")).withColumn("user_id", F.expr("id div 1000"))
    last = table(spark, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    return opened.join(last, "user_id", "left").filter(F.col("last").isNull() | (F.col("last") <= F.expr("started_at + INTERVAL 18 HOURS"))).select("id")


@_add("j8_never_recalled", "SELECT id FROM observations o WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM recalls r WHERE r.memory_id = o.id)", "recalls")
def j8(spark, d):
    seen = V.recalls(spark, d).select(F.col("memory_id").alias("id"))
    return V.observations(spark, d).filter("deleted_at IS NULL").select("id").join(seen, "id", "left_anti")


@_add(
    "j9_replaced_configs",
    """SELECT DISTINCT o1.id FROM observations o1 JOIN observations o2 ON o1.project = o2.project AND o1.topic_key = o2.topic_key AND o1.id < o2.id
       WHERE o1.type = 'config' AND o2.type = 'config' AND o1.deleted_at IS NULL AND o2.deleted_at IS NULL""",
)
def j9(spark, d):
    # an older row is replaced if any newer one exists: the newest of its topic decides, so no pairs are made
    o = V.observations(spark, d).filter("type = 'config' AND deleted_at IS NULL AND project IS NOT NULL AND topic_key IS NOT NULL").select("id", "project", "topic_key")
    newest = o.groupBy("project", "topic_key").agg(F.max("id").alias("newest"))
    return o.join(newest, ["project", "topic_key"]).filter("id < newest").select("id")


@_add("u1_recalled_ids", "SELECT memory_id AS id FROM recalls WHERE was_useful = 1 UNION SELECT memory_id FROM links WHERE trust_score > .9 AND memory_id IS NOT NULL", "recalls", "links")
def u1(spark, d):
    a = V.recalls(spark, d).filter("was_useful = 1").select(F.col("memory_id").alias("id"))
    return a.union(V.links(spark, d).filter("trust_score > 0.9 AND memory_id IS NOT NULL").select("memory_id")).distinct()


@_add("u7_snapshot_after_purge", f"SELECT id FROM observations WHERE (deleted_at IS NULL OR deleted_at >= {_NOW} - INTERVAL 30 DAY) AND (expires_at IS NULL OR expires_at >= {_NOW})")
def u7(spark, d):
    o = V.observations(spark, d)
    return M.with_now(o, o).filter((F.col("deleted_at").isNull() | (F.col("deleted_at") >= F.expr("now - INTERVAL 30 DAYS"))) & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.col("now")))).select("id")


@_add(
    "u8_trust_decay",
    f"""SELECT l.id, round(CASE WHEN o.id IS NOT NULL THEN greatest(0, l.trust_score - .05) ELSE l.trust_score END, 4) AS trust_score
        FROM links l LEFT JOIN observations o ON o.id = l.memory_id AND o.updated_at < {_NOW} - INTERVAL 90 DAY""",
    "links",
)
def u8(spark, d):
    o = V.observations(spark, d)
    old = M.with_now(o, o).filter(F.col("updated_at") < F.expr("now - INTERVAL 90 DAYS")).select(F.col("id").alias("memory_id"), F.lit(True).alias("old"))
    t = F.when(F.col("old"), F.greatest(F.lit(0.0), F.col("trust_score") - 0.05)).otherwise(F.col("trust_score"))
    return V.links(spark, d).join(old, "memory_id", "left").select("id", F.round(t, 4).alias("trust_score"))


@_add(
    "u9_changed_fields",
    """SELECT o.id, f.field, f.old_value, f.new_value FROM (SELECT id, title, type, scope, coalesce(topic_key, '') AS topic_key FROM observations) o,
       LATERAL (VALUES ('title', o.title, upper(o.title)), ('type', o.type, CASE WHEN o.type = 'config' THEN 'decision' ELSE o.type END), ('topic_key', o.topic_key, replace(o.topic_key, '/', '-'))) AS f(field, old_value, new_value)
       WHERE f.old_value <> f.new_value""",
)
def u9(spark, d):
    o = V.observations(spark, d).withColumn("topic_key", F.coalesce("topic_key", F.lit("")))
    edit = lambda f, new: F.struct(F.lit(f).alias("field"), F.col(f).alias("old_value"), new.alias("new_value"))
    e = F.explode(F.array(edit("title", F.upper("title")), edit("type", F.when(F.col("type") == "config", "decision").otherwise(F.col("type"))), edit("topic_key", F.replace("topic_key", F.lit("/"), F.lit("-")))))
    return o.select("id", e.alias("e")).filter("e.old_value <> e.new_value").select("id", "e.*")


def _words(t: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{t}'))"


_N = len(_TERMS)
_IDF = [f"greatest(ln((s.n - s.df{i} + .5) / (s.df{i} + .5)), {M.IDF_FLOOR})" for i in range(_N)]
_REL = " + ".join(f"{_IDF[i]} * tf{i} * {M.BM25_K1 + 1} / (tf{i} + {M.BM25_K1} * ({1 - M.BM25_B} + {M.BM25_B} * size / s.avg_size))" for i in range(_N))
_M1 = f"""WITH {_SIGNALS},
  w AS (SELECT *, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, content)), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM observations),
  c AS (SELECT *, len(w) AS size, {", ".join(f"{_words(t)} AS tf{i}" for i, t in enumerate(_TERMS))} FROM w),
  s AS (SELECT count(*) AS n, avg(size) AS avg_size, {", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(_N))} FROM c),
  x AS (SELECT c.*, {_REL} AS relevance, {" + ".join(f"(tf{i} > 0)::INT" for i in range(_N))} AS matched FROM c, s),
  f AS (SELECT *, CASE WHEN matched = {_N} THEN 1 WHEN matched > 0 THEN 2 WHEN {" OR ".join(f"contains(lower(concat_ws(' ', title, content)), '{t}')" for t in _TERMS)} THEN 3 END AS tier FROM x WHERE {_LIVE} AND {_SCOPE}),
  p AS (SELECT * FROM f WHERE tier = (SELECT min(tier) FROM f) ORDER BY CASE WHEN tier < 3 THEN relevance ELSE epoch(created_at) END DESC, id LIMIT 30)
SELECT p.id, p.title, p.tier, round((CASE WHEN tier < 3 THEN relevance ELSE 0 END * .4
   + exp(-coalesce(epoch({_NOW}) - epoch(p.created_at), 0) / 86400.0 / 7) * .3 + coalesce(t.trust, .7) * .15 + (ln(1 + coalesce(r.n, 0)) * .2 * {_USEFUL} + {_USEFUL} * .15) * .15) * {_BOOST}, 6) AS score
FROM p LEFT JOIN t ON t.memory_id = p.id LEFT JOIN r ON r.memory_id = p.id ORDER BY score DESC, p.id LIMIT 10"""


@_add("m1_ranked_search", _M1, "links", "recalls")
def m1(spark, d):
    return M.ranked_search(V.observations(spark, d), V.links(spark, d), V.recalls(spark, d), QUERY, PROJECT)


@_add(
    "m6_context",
    f"""WITH {_SIGNALS} SELECT o.id, {_PRIORITY} AS priority, coalesce(r.n, 0) AS recall_count FROM observations o LEFT JOIN t ON t.memory_id = o.id LEFT JOIN r ON r.memory_id = o.id
        WHERE {_LIVE} AND {_SCOPE} AND type NOT IN ('progress', 'accomplished', 'session_summary') ORDER BY recall_count DESC, priority DESC, coalesce(t.trust, 0) DESC, o.created_at DESC, o.id DESC LIMIT 10""",
    "links",
    "recalls",
)
def m6(spark, d):
    o = V.observations(spark, d)
    o = M.with_now(o, o).filter(M.live(F.col("now")) & M.in_scope(PROJECT) & ~F.col("type").isin("progress", "accomplished", "session_summary")).select("id", "type", "created_at")
    x = M.signals(o, V.links(spark, d), V.recalls(spark, d)).withColumn("priority", M.case_of(F.col("type"), M.TYPE_PRIORITY, 0))
    return x.orderBy(F.desc("recall_count"), F.desc("priority"), F.desc(F.coalesce("trust", F.lit(0.0))), F.desc("created_at"), F.desc("id")).limit(10).select("id", "priority", "recall_count")


@_add("m5_packed_context")
def m5(spark, d):
    """Memories of every project from the newest on, packed into 2,000 tokens each."""
    o = V.observations(spark, d).filter("deleted_at IS NULL AND project IS NOT NULL")
    return M.pack_newest(o.select("id", "project", "created_at", "title", "content"), "project", 2000)


_TRI = "list_distinct(list_transform(range(1, greatest(length({p}) - 1, 1)), lambda i: substr({p}, i, 3)))"


@_add(
    "m10_duplicate_titles",
    f"""WITH b AS (SELECT id, project, type, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '', 'g') AS p, lower(trim(coalesce(title, ''))) AS t, row_number() OVER (PARTITION BY project, type ORDER BY created_at NULLS FIRST, id) AS k
        FROM observations WHERE deleted_at IS NULL AND project IS NOT NULL), g AS (SELECT *, CASE WHEN length(p) < 3 THEN [] ELSE {_TRI.format(p='p')} END AS g FROM b),
      x AS (SELECT a.id, b.id AS other_id, CASE WHEN len(a.g) = 0 AND len(b.g) = 0 THEN (a.t = b.t)::INT::DOUBLE ELSE round(len(list_intersect(a.g, b.g)) / greatest(len(a.g), len(b.g), 1), 2) END AS similarity
        FROM g a JOIN g b ON a.project = b.project AND a.type = b.type AND b.k BETWEEN a.k - 20 AND a.k - 1)
      SELECT * FROM x WHERE similarity >= .6""",
)
def m10(spark, d):
    return M.duplicate_titles(V.observations(spark, d))


@_add(
    "m12_ttl",
    """SELECT id, CASE WHEN id % 4 = 0 THEN created_at + to_hours((id % 9)) WHEN id % 4 = 1 THEN created_at + to_days((id % 5)::INT) WHEN id % 4 = 2 THEN created_at + to_days(30 * (id % 3)::INT) END AS until
       FROM observations WHERE created_at IS NOT NULL AND CASE WHEN id % 4 = 0 THEN id % 9 WHEN id % 4 = 1 THEN id % 5 WHEN id % 4 = 2 THEN id % 3 ELSE 0 END > 0""",
)
def m12(spark, d):
    o = V.observations(spark, d).filter("created_at IS NOT NULL")
    ttl = F.expr("case id % 4 when 0 then concat(id % 9, 'h') when 1 then concat(' ', id % 5, ' D') when 2 then concat(id % 3, 'm') else 'soon' end")
    return o.select("id", M.ttl_until(ttl, F.col("created_at")).alias("until")).filter("until IS NOT NULL")


@_add("m14_slugs", "SELECT id, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS topic FROM observations")
def m14(spark, d):
    return V.observations(spark, d).select("id", M.slug(F.col("title")).alias("topic"))


@_add(
    "m15_stale_memories",
    f"""WITH {_SIGNALS}, x AS (SELECT o.id, CASE WHEN regexp_matches(title, '^(CORRECTION|Correction|Corrected|Edited)') THEN 'correction'
          WHEN type IN ('decision', 'bugfix', 'discovery', 'architecture', 'pattern') AND (t.trust IS NULL OR t.trust < .3) AND starts_with(content, '**What**') AND coalesce(r.u, 0) = 0 THEN 'low_trust' END AS reason
        FROM observations o LEFT JOIN t ON t.memory_id = o.id LEFT JOIN r ON r.memory_id = o.id WHERE o.deleted_at IS NULL AND o.created_at < {_NOW} - INTERVAL 7 DAY) SELECT * FROM x WHERE reason IS NOT NULL""",
    "links",
    "recalls",
)
def m15(spark, d):
    o = V.observations(spark, d)
    o = M.with_now(o, o).filter(F.col("deleted_at").isNull() & (F.col("created_at") < F.expr("now - INTERVAL 7 DAYS")))
    x = M.signals(o, V.links(spark, d), V.recalls(spark, d))
    low = F.col("type").isin("decision", "bugfix", "discovery", "architecture", "pattern") & (F.col("trust").isNull() | (F.col("trust") < 0.3)) & F.startswith("content", F.lit("**What**")) & (F.col("useful_count") == 0)
    return x.select("id", F.when(F.col("title").rlike("^(CORRECTION|Correction|Corrected|Edited)"), "correction").when(low, "low_trust").alias("reason")).filter("reason IS NOT NULL")


@_add(
    "m18_recovery_digest",
    """SELECT session_id, type, count(*) AS memories, string_agg(title, '; ' ORDER BY id) AS digest FROM observations WHERE deleted_at IS NULL AND session_id IS NOT NULL AND title IS NOT NULL
       GROUP BY session_id, type HAVING count(*) > 1""",
)
def m18(spark, d):
    g = V.observations(spark, d).filter("deleted_at IS NULL AND session_id IS NOT NULL AND title IS NOT NULL").groupBy("session_id", "type")
    x = g.agg(F.count(F.lit(1)).alias("memories"), F.array_sort(F.collect_list(F.struct("id", "title"))).alias("t")).filter("memories > 1")
    return x.select("session_id", "type", "memories", F.array_join(F.transform("t", lambda r: r["title"]), "; ").alias("digest"))


#: Paths of symbols that were indexed anew.
_CHANGED_PATHS = "SELECT DISTINCT file_path AS path FROM code_symbols WHERE stable_symbol_id IN (SELECT stable_symbol_id FROM code_symbols GROUP BY 1 HAVING count(*) > 1)"
_CHANGED_SYMBOLS = "SELECT DISTINCT stable_symbol_id AS symbol_id FROM code_symbols WHERE file_path IN (SELECT path FROM cp)"


def _changed_paths(symbols):
    again = symbols.groupBy("stable_symbol_id").count().filter("count > 1")
    return symbols.join(again, "stable_symbol_id", "left_semi").select("file_path").distinct()


@_add("t2_changed_symbols", f"WITH cp AS ({_CHANGED_PATHS}) {_CHANGED_SYMBOLS}")
def t2(spark, d):
    s = table(spark, d, "code_symbols")
    return s.join(_changed_paths(s), "file_path", "left_semi").select(F.col("stable_symbol_id").alias("symbol_id")).distinct()


@_add(
    "t1_trust_evaluation",
    f"""WITH cp AS ({_CHANGED_PATHS}), cs AS ({_CHANGED_SYMBOLS}),
      x AS (SELECT l.*, CASE WHEN symbol_path IS NOT NULL THEN symbol_path IN (SELECT path FROM cp) ELSE coalesce(symbol_id IN (SELECT symbol_id FROM cs), false) END AS hit FROM links l)
      SELECT id, round(CASE WHEN hit THEN greatest(0, trust_score - .3) WHEN trust_score < .95 THEN least(trust_score + .05, .95) ELSE trust_score END, 4) AS new_trust,
      CASE WHEN hit THEN 'changed' WHEN trust_score < .95 THEN 'survived' ELSE 'kept' END AS reason FROM x""",
    "links",
)
def t1(spark, d):
    return M.evaluate_trust(V.links(spark, d), _changed_paths(table(spark, d, "code_symbols")).withColumnRenamed("file_path", "path"), t2(spark, d))


@_add(
    "t3_auto_links",
    r"""WITH w AS (SELECT id AS memory_id, unnest(list_distinct(regexp_extract_all(content, '[A-Za-z]+[a-z][A-Z][A-Za-z]+|[a-z]+_[a-z_]+'))) AS name FROM observations),
        u AS (SELECT name, min(stable_symbol_id) AS symbol_id FROM code_symbols GROUP BY name HAVING count(DISTINCT stable_symbol_id) = 1)
        SELECT memory_id, u.name, symbol_id FROM w JOIN u ON u.name = w.name""",
)
def t3(spark, d):
    names = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z]+[a-z][A-Z][A-Za-z]+|[a-z]+_[a-z_]+"), F.lit(0))))
    w = V.observations(spark, d).select(F.col("id").alias("memory_id"), names.alias("name"))
    u = table(spark, d, "code_symbols").groupBy("name").agg(F.min("stable_symbol_id").alias("symbol_id"), F.count_distinct("stable_symbol_id").alias("n")).filter("n = 1").drop("n")
    return w.join(u, "name").select("memory_id", "name", "symbol_id")


@_add(
    "t5_trust_recovery",
    "SELECT l.id, round(least(1, trust_score + .1), 4) AS trust_score FROM links l WHERE memory_id IN (SELECT memory_id FROM recalls WHERE was_useful = 1)",
    "links",
    "recalls",
)
def t5(spark, d):
    r = V.recalls(spark, d).filter("was_useful = 1").select("memory_id").distinct()
    return V.links(spark, d).join(r, "memory_id", "left_semi").select("id", F.round(F.least(F.lit(1.0), F.col("trust_score") + 0.1), 4).alias("trust_score"))


@_add("t6_stale_links", "SELECT id, trust_score FROM links WHERE trust_score < .6 ORDER BY trust_score, id LIMIT 50", "links")
def t6(spark, d):
    return V.links(spark, d).filter("trust_score < 0.6").orderBy("trust_score", "id").limit(50).select("id", "trust_score")


@_add("e9_saves_per_session", "SELECT session_id, count(*) AS saves FROM observations GROUP BY session_id")
def e9(spark, d):
    return V.observations(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("saves"))
